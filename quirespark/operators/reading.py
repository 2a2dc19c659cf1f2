"""What to believe of a page's readings, as one decision table; blank pages; layers of publisher's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

DEGENERATE, LAYER_OVERLAP, LAYER_WORDS = 0.4, 0.2, 40


def vocabulary(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)))


def agreement(a: Column, b: Column) -> Column:
    """Jaccard of the vocabularies; two readings without words agree."""
    return T.jaccard(vocabulary(a), vocabulary(b))


def layer_can_testify(layer: Column) -> Column:
    return F.regexp_count(F.lower(F.coalesce(layer, F.lit(""))), F.lit("[a-z]{3,}")) >= LAYER_WORDS


def contradicts_layer(reading: Column, layer: Column) -> Column:
    """Both have 40 words (the layer distinct ones) and under a fifth of the reading's vocabulary is in the layer."""
    long = (F.regexp_count(F.lower(F.coalesce(reading, F.lit(""))), F.lit("[a-z]{3,}")) >= LAYER_WORDS) & (F.size(vocabulary(layer)) >= LAYER_WORDS)
    return long & (T.containment(vocabulary(reading), vocabulary(layer)) < LAYER_OVERLAP)


def six_gram_share(text: Column) -> Column:
    """Share of 6-grams that occur more than once; 0 under 40 words."""
    ws = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))
    twice = lambda g: F.size(F.filter(g, lambda x, i: F.coalesce(x == F.get(g, i - 1), F.lit(False)) | F.coalesce(x == F.get(g, i + 1), F.lit(False)))) / F.size(g)
    return T.let(ws, lambda w: F.when(F.size(w) < 40, F.lit(0.0)).otherwise(T.let(F.array_sort(T.windows(w, 6)), twice)))


def looks_fabricated(reading: Column, layer: Column) -> Column:
    return (six_gram_share(reading) >= DEGENERATE) | F.coalesce(contradicts_layer(reading, layer), F.lit(False))


def native_body(layer: Column) -> Column:
    """A page rebuilt from the publisher's text: leading lines that are digits, roman numerals or have an address are dropped;
    null if under 40 characters are left."""
    lines = F.filter(F.transform(F.split(F.coalesce(layer, F.lit("")), r"\r?\n"), F.trim), lambda x: x != "")
    skip = lambda x: x.rlike("(?i)^(?:[0-9]+|[ivxlcdm]+)$") | x.contains("http")
    kept = T.let(lines, lambda ls: F.slice(ls, F.coalesce(F.nullif(F.array_position(F.transform(ls, lambda x: ~skip(x)), True), F.lit(0)).cast("int"), F.size(ls) + 1), F.greatest(F.size(ls), F.lit(1))))
    body = T.let(kept, lambda ls: F.array_join(F.transform(ls, lambda x: F.concat(F.lit("<p>"), F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</p>"))), "\n"))
    return F.when(F.length(F.regexp_replace(body, "<[^>]+>", "")) >= 40, body)


def decide_readings(readings: DataFrame) -> DataFrame:
    """readings with text_kept, decision and cacheable.

    Columns: read1, read2 (null if not read again), layer_text, is_native, has_ink, witness_words (null if absent).
    An empty reading of an inked page, and one that loops or contradicts the layer, is read again; if the second is no
    better, a native page is restored from its layer, else the page is refused. A reading of 40 words where the
    witness saw fewer than five must agree with the second to one half. Only good readings and blank pages may be cached.
    """
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    first, second, layer = F.col("read1"), F.col("read2"), F.col("layer_text")
    restored = F.when(F.coalesce("is_native", F.lit(False)), native_body(layer))
    n = F.regexp_count(F.lower(F.coalesce(first, F.lit(""))), F.lit("[a-z]{3,}"))
    silent = F.coalesce(F.col("witness_words") < 5, F.lit(False)) & (n >= 40)
    bad1, bad2 = looks_fabricated(first, layer), looks_fabricated(second, layer)
    decision = (
        F.when(empty(first) & ~F.coalesce("has_ink", F.lit(False)), "blank")
        .when(empty(first) & ~empty(second) & ~bad2, "second")
        .when(empty(first), F.when(restored.isNotNull(), "restored").otherwise("refused"))
        .when(bad1 & ~empty(second) & ~bad2, "second")
        .when(bad1, F.when(restored.isNotNull(), "restored").otherwise("refused"))
        .when(silent & (second.isNull() | (agreement(first, second) < 0.5)), "refused")
        .otherwise("first")
    )
    d = readings.withColumn("decision", decision)
    text = F.when(F.col("decision") == "first", first).when(F.col("decision") == "second", second).when(F.col("decision") == "restored", restored).when(F.col("decision") == "blank", F.lit(""))
    return d.withColumn("text_kept", text).withColumn("cacheable", F.col("decision").isin("first", "second", "blank"))


def blank_pages(pages: DataFrame, witness: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """(book_id, page_index, unwitnessed): pages without text and pictures, unless a witness read ten words of three letters.

    witness: book_id, page_index, n_words; pages that it does not have are unwitnessed.
    """
    d = pages.where((T.strip_tags(F.col("body")) == "") & ~F.coalesce(F.col("body"), F.lit("")).contains("<img"))
    if dropped is not None:
        d = d.join(dropped.select("book_id", "page_index"), ["book_id", "page_index"], "left_anti")
    d = d.join(witness.select("book_id", "page_index", "n_words"), ["book_id", "page_index"], "left").where("n_words is null or n_words < 10")
    return d.select("book_id", "page_index", F.col("n_words").isNull().alias("unwitnessed"))


def page_kind(facts: DataFrame) -> DataFrame:
    """Facts of a PDF page (images, image_share, placed_share, aspect, upright, behind_share) with extract, is_native, facsimile."""
    extract = (F.col("images") == 1) & (F.col("image_share") >= 0.5) & (F.col("placed_share") >= 0.97) & F.col("aspect").between(0.8, 1.25) & F.col("upright")
    return facts.withColumn("extract", F.coalesce(extract, F.lit(False))).withColumn("is_native", ~F.col("extract") & (F.coalesce("behind_share", F.lit(0.0)) < 0.9)).withColumn("facsimile", ~F.col("is_native"))
