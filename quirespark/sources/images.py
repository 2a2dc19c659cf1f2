"""Page images and clips as tables; selectors, drops, swaps and patches of pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Suffixes of page images, compared without case.
SUFFIXES = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp", "heic", "heif")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_index, content): image files of a folder or glob, by file name. An empty selection is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.*").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    d = files.where(suffix.isin(*SUFFIXES)).withColumn("name_", F.regexp_extract("path", r"([^/]+)$", 1))
    if d.isEmpty():
        raise FileNotFoundError(f"no page images in {path}")
    return d.select("path", (F.row_number().over(Window.orderBy("name_", "path")) - 1).cast("long").alias("page_index"), "content")


def page_id(stem: Column, part: Column) -> Column:
    return F.concat(stem, F.lit("p"), part.cast("string"))


def run_page_id(run: Column, part: Column) -> Column:
    return F.format_string("r%03dp%d", run, part)


def resolve_selectors(selectors: DataFrame, page_map: DataFrame) -> DataFrame:
    """selectors(token) with page_index: a number is a position, else the first page with that id; unknown ones are null."""
    ids = page_map.groupBy("page_id").agg(F.min("page_index").alias("of_id"))
    d = selectors.join(ids, F.col("token") == F.col("page_id"), "left")
    return d.select(*selectors.columns, F.when(F.col("token").rlike("^[0-9]+$"), F.col("token").cast("long")).otherwise(F.col("of_id")).alias("page_index"))


def drop_pages(pages: DataFrame, dropped: DataFrame) -> DataFrame:
    """pages without the given ones (book_id, page_index)."""
    return pages.join(dropped.select("book_id", "page_index").distinct(), ["book_id", "page_index"], "left_anti")


def swap_pages(pages: DataFrame, swaps: DataFrame) -> DataFrame:
    """pages with swaps (book_id, seq, a, b) made in order on positions; one with a missing page is skipped."""
    order = swaps.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("seq", "a", "b"))).alias("swaps_"))
    slim = pages.select("book_id", "page_index").join(order, "book_id", "left")

    def fold(pdf):
        at = {int(p): int(p) for p in pdf["page_index"]}
        steps = pdf["swaps_"].iloc[0]
        for s in steps if steps is not None else ():
            if s["a"] in at and s["b"] in at:
                at[s["a"]], at[s["b"]] = at[s["b"]], at[s["a"]]
        return pd.DataFrame([(pdf["book_id"].iloc[0], original, position) for position, original in at.items()], columns=["book_id", "page_index", "position"])

    moved = slim.groupBy("book_id").applyInPandas(fold, "book_id string, page_index long, position long")
    others = [c for c in pages.columns if c not in ("book_id", "page_index")]
    return pages.join(moved, ["book_id", "page_index"]).select("book_id", F.col("position").alias("page_index"), *others)


def parse_patches(specs: DataFrame) -> DataFrame:
    """(token, path) from specs (spec): a JSON map, or pairs `id=path` parted by commas."""
    json_map = F.from_json("spec", "map<string,string>")
    inline = F.transform(F.split("spec", r"\s*,\s*"), lambda x: F.split(x, "=", 2))
    pairs = F.map_from_arrays(F.transform(inline, lambda x: F.element_at(x, 1)), F.transform(inline, lambda x: F.coalesce(F.try_element_at(x, F.lit(2)), F.lit(""))))
    chosen = F.when(F.trim("spec").startswith("{"), json_map).otherwise(pairs)
    return specs.select(F.explode(chosen).alias("token", "path")).where("path <> ''")


def apply_patches(pages: DataFrame, patches: DataFrame) -> DataFrame:
    """pages(book_id, page_index, path) with the path of the best readable patch (book_id, page_index, path, score, frame_idx).

    The highest score counts, the later frame on ties; patches without a score are unreadable and skipped.
    """
    best = patches.where("score is not null").groupBy("book_id", "page_index").agg(F.max_by("path", F.struct("score", "frame_idx")).alias("patch_"))
    return pages.join(best, ["book_id", "page_index"], "left").withColumn("path", F.coalesce("patch_", "path")).drop("patch_")


def shots_to_pages(best: DataFrame, parts: DataFrame) -> DataFrame:
    """(album, page_index, path, page_id): the chosen shot of each burst (album, burst, path), split into its parts (path, parts)."""
    d = best.join(parts, "path", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("parts", F.lit(1)), F.lit(1)) - 1)))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    index = F.row_number().over(Window.partitionBy("album").orderBy("burst", "part")) - 1
    return d.select("album", index.cast("long").alias("page_index"), "path", page_id(stem, F.col("part")).alias("page_id"))


def first_thin_page(pages: DataFrame, limit: int = 25) -> DataFrame:
    """(book_id, page_index): the first page with fewer than `limit` words, for a cover."""
    n = F.size(F.array_remove(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), ""))
    return pages.where(n < limit).groupBy("book_id").agg(F.min("page_index").alias("page_index"))
