"""What the operators share: a workspace in the cluster's shared folder, ranks without hot tasks, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Separators of words: space and the control characters from tab to carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without it has one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


class Workspace:
    """Intermediate tables as Parquet in the shared folder; they cut lineage and survive lost executors.

    Results read them lazily, so what is not dropped earlier stays until the session's JVM ends, which deletes the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n, self.written = 0, set()
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}_{name}"
        df.write.parquet(path)
        self.written.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}_{name}"

    def keep_only(self, *tables: DataFrame) -> None:
        """Deletes the other tables of this workspace."""
        kept = {t._workspace_path for t in tables}
        for path in self.written - kept:
            delete(self.spark, path)
        self.written = kept

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, t._workspace_path)
            self.written.discard(t._workspace_path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def names(df: DataFrame, *wanted: str) -> list[str]:
    """column_name for each of several distinct names."""
    return [column_name(df, w) for w in wanted]


def column_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, or with underscores added until no column of df has that name (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def bucketed_rank(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """Adds `name`: 0-based rank inside `keys`, by bucket and then `order`.

    No task gets a whole key: rows are ranked inside (keys, bucket), and buckets are offset by the counts of those
    before them. `bucket` must be deterministic; rows that tie on bucket and order are ranked in any order.
    """
    b, n, before = (column_name(df, x) for x in ("bucket_", "n_", "before_"))
    df = df.withColumn(b, bucket)
    counts = df.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n))
    w = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(before, F.coalesce(F.sum(n).over(w), F.lit(0))).drop(n)
    on = [*keys, b]
    inside = df.withColumn(name, F.row_number().over(Window.partitionBy(*on).orderBy(*order)) - 1)
    of_right = {c: column_name(df, f"{c}_r_") for c in on}
    right = offsets.select(*[F.col(c).alias(r) for c, r in of_right.items()], before)
    joined = inside.join(right, [inside[c].eqNullSafe(right[r]) for c, r in of_right.items()])
    return joined.withColumn(name, (F.col(name) + F.col(before)).cast("long")).drop(before, b, *of_right.values())


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v); component is the smallest node reachable.

    Alternating large-star and small-star rounds. Minimum neighbours are aggregated with map-side combination, and both
    join sides are stored tables, so that a hub's edges can be split between tasks. Every round writes its edges.
    """
    old = None
    e = ws.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        mark = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if mark == old or not mark[0]:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
                e.select("v", F.col("v").alias("component")).distinct()
            ).groupBy("node").agg(F.min("component").alias("component"))
        old, last = mark, e
        both = e.union(e.select("v", "u"))
        least = ws.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = ws.write(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least2 = ws.write(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least2, "u")
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least2)
        e = ws.write(small.distinct(), "edges")
        ws.drop(last, least, large, least2)
