"""Thresholds that a sample chooses for itself: exact Otsu splits per key, as window SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def otsu_split(df: DataFrame, keys: list[str], value: str, empty: float) -> DataFrame:
    """(keys, threshold): midpoint of the gap that divides the values best into two classes.

    Among gaps within 1e-12 of the best, the widest counts, and among those the lowest. Fewer than two values, or a range
    under 1e-9, give `empty`. Null values are ignored; a key has a row if it has any value.
    """
    w = Window.partitionBy(*keys)
    order = w.orderBy(value)
    d = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("x_"), F.row_number().over(order).alias("r_"), F.count(F.lit(1)).over(w).alias("n_"),
        F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("c_"), F.sum(value).over(w).alias("t_"), F.lead(value).over(order).alias("next_"),
    )
    d = d.withColumn("between_", F.when(F.col("r_") < F.col("n_"), (F.col("r_") / F.col("n_")) * (1 - F.col("r_") / F.col("n_")) * F.pow(F.col("c_") / F.col("r_") - (F.col("t_") - F.col("c_")) / (F.col("n_") - F.col("r_")), F.lit(2))))
    d = d.withColumn("best_", F.max("between_").over(w)).withColumn("gap_", F.col("next_") - F.col("x_"))
    near = F.col("between_") >= F.col("best_") - 1e-12
    split = F.min(F.when(near, F.struct(-F.col("gap_"), F.col("x_"), ((F.col("x_") + F.col("next_")) / 2).alias("mid")))).alias("s_")
    out = d.groupBy(*keys).agg(split, F.max("n_").alias("n_"), (F.max("x_") - F.min("x_")).alias("range_"))
    return out.select(*keys, F.when((F.col("n_") < 2) | (F.col("range_") < 1e-9), F.lit(float(empty))).otherwise(F.col("s_.mid")).alias("threshold"))


def cluster_cut(df: DataFrame, keys: list[str], value: str, ratio: float = 3.0) -> DataFrame:
    """(keys, threshold): Otsu split of the logarithms, or -inf unless the upper class starts at `ratio` times the lower's end.

    Values that are null, not finite or not positive are ignored; a key without others has -inf.
    """
    good = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.col(value) > 0) & (F.col(value) < float("inf"))
    keyed = df.select(*keys).distinct()
    d = df.where(good).select(*keys, F.col(value).cast("double").alias("v_"), F.log10(value).alias("l_"))
    cut = otsu_split(d, keys, "l_", float("-inf"))
    both = d.join(cut, keys).groupBy(*keys, "threshold").agg(F.max(F.when(F.col("l_") < F.col("threshold"), F.col("v_"))).alias("low_"), F.min(F.when(F.col("l_") >= F.col("threshold"), F.col("v_"))).alias("high_"))
    far = F.col("low_").isNotNull() & (F.col("high_") >= F.lit(ratio) * F.col("low_"))
    found = both.select(*keys, F.when(far, F.pow(F.lit(10.0), F.col("threshold"))).otherwise(F.lit(float("-inf"))).alias("threshold"))
    return keyed.join(found, keys, "left").select(*keys, F.coalesce("threshold", F.lit(float("-inf"))).alias("threshold"))


def exact_median(value: Column) -> Column:
    """Mean of the middle two for an even count; exact."""
    return F.percentile(value, F.lit(0.5))


def median_of(values: Column) -> Column:
    """Median of an array; null if it is empty."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)
