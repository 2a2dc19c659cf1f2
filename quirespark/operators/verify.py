"""A finished collection against its source: holes, coverage, bag differences, word duels. Tables: pages(book_id, page_index, text)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .dedupe import coverage

RESCAN, MIN_WORDS = 0.75, 25


def _ascii_words(c: str):
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def is_scan(images: DataFrame) -> DataFrame:
    """(book_id, scan): more than 6 of the first 12 pages have an image over at least 90 % of the page. images: book_id, page_index, share."""
    first = images.where("page_index < 12").groupBy("book_id", "page_index").agg(F.max("share").alias("share"))
    return first.groupBy("book_id").agg((F.count_if(F.col("share") >= 0.9) > 6).alias("scan"))


def holes(ours: DataFrame, source: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(book_id, page_index, n_words, n_real, coverage, covered_by, status): source pages that are empty in ours.

    A page counts if it has MIN_WORDS words, of which at least max(8, a quarter) have three letters and are in the
    dictionary (without one, every word is known). It is `rescanned` if one page of ours has RESCAN of its 6-word shingles, else a `hole`.
    """
    s = source.select("book_id", "page_index", "text", _ascii_words("text").alias("ws")).withColumn("n_words", F.size("ws").cast("long")).where(F.col("n_words") >= MIN_WORDS)
    kept = ours.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("book_id", "page_index")
    s = s.join(kept, ["book_id", "page_index"], "left_anti")
    long = s.select("book_id", "page_index", "n_words", F.explode_outer(F.filter("ws", lambda w: F.length(w) > 2)).alias("word"))
    if dictionary is not None:
        known = dictionary.select(F.lower("word").alias("word")).distinct().withColumn("known", F.lit(1))
        long = long.join(known, "word", "left")
    else:
        long = long.withColumn("known", F.when(F.col("word").isNotNull(), 1))
    real = long.groupBy("book_id", "page_index", "n_words").agg(F.count("known").alias("n_real")).where("n_real >= greatest(8, n_words div 4)")
    covered = coverage(s, ours).drop("n_shingles")
    out = real.join(covered, ["book_id", "page_index"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    return out.withColumn("status", F.when(F.col("coverage") >= RESCAN, "rescanned").otherwise("hole"))


def verdict(ours: DataFrame, source: DataFrame, found: DataFrame) -> DataFrame:
    """(book_id, our_words, source_words, ratio, holes, exit_code): totals; the exit code is 1 if there is a hole."""
    total = lambda d, n: d.groupBy("book_id").agg(F.sum(F.size(_ascii_words("text"))).alias(n))
    n = found.groupBy("book_id").agg(F.count_if(F.col("status") == "hole").alias("holes"))
    d = total(source, "source_words").join(total(ours, "our_words"), "book_id", "left").join(n, "book_id", "left").na.fill(0, ["our_words", "holes"])
    return d.select("book_id", "our_words", "source_words", (F.col("our_words") / F.nullif(F.col("source_words"), F.lit(0))).alias("ratio"), "holes", (F.col("holes") > 0).cast("int").alias("exit_code"))


def bag_difference(ours: DataFrame, source: DataFrame) -> DataFrame:
    """(book_id, page_index, side, word, n): words that one side has oftener on a page. Inputs: book_id, page_index, word."""
    count = lambda d, n: d.groupBy("book_id", "page_index", "word").agg(F.count(F.lit(1)).alias(n))
    both = count(ours, "a").join(count(source, "b"), ["book_id", "page_index", "word"], "full").na.fill(0, ["a", "b"])
    side = F.when(F.col("a") > F.col("b"), "ours").otherwise("source")
    return both.where("a <> b").select("book_id", "page_index", side.alias("side"), "word", F.abs(F.col("a") - F.col("b")).alias("n"))


def page_words(pages: DataFrame) -> DataFrame:
    """(book_id, page_index, word): folded words, one row for each."""
    return pages.select("book_id", "page_index", F.explode(F.transform(T.tokens(F.col("text")), T.fold_word)).alias("word"))


def duels(difference: DataFrame) -> DataFrame:
    """(book_id, page_index, kind, ours, source, n) from bag_difference: `hyphen` repairs, word `duel`s, `surplus`es.

    First a word of ours that is two words of the source set together (at a cut two letters or more from either end)
    takes both out. Then the sorted leftovers are paired greedily within an edit distance of 2; the source word has more
    than three letters. The rest are surpluses. Close words are found by a join on page and length; the fold has only
    their names.
    """
    page, side = ["book_id", "page_index"], lambda s: difference.where(F.col("side") == s)
    theirs = side("source").where(F.length("word") > 3).select(*page, F.col("word").alias("other"), F.explode(F.sequence(F.greatest(F.length("word") - 2, F.lit(0)), F.length("word") + 2)).alias("size"))
    close = side("ours").withColumn("size", F.length("word")).join(theirs, [*page, "size"]).where(F.levenshtein("word", "other", 2) >= 0)
    close = close.groupBy(*page, "word").agg(F.array_sort(F.collect_list("other")).alias("close")).withColumn("side", F.lit("ours"))
    difference = difference.join(close, [*page, "word", "side"], "left")

    def fight(pdf):
        left = {s: {r.word: r.n for r in pdf[pdf["side"] == s].itertuples()} for s in ("ours", "source")}
        a, b, out = left["ours"], left["source"], []
        for w in sorted(a):
            for cut in range(2, len(w) - 1):
                x, y = w[:cut], w[cut:]
                while a[w] and b.get(x) and b.get(y) and (x != y or b[x] > 1):
                    for bag, k in ((a, w), (b, x), (b, y)):
                        bag[k] -= 1
                    out.append(("hyphen", w, f"{x} {y}", 1))
        near = {r.word: r.close for r in pdf[pdf["side"] == "ours"].itertuples() if r.close is not None}
        for w in sorted(x for x in near if a[x]):
            for v in near[w]:
                if a[w] and b[v]:
                    n = min(a[w], b[v])
                    a[w], b[v] = a[w] - n, b[v] - n
                    out.append(("duel", w, v, n))
        out += [("surplus", w, None, n) for w, n in sorted(a.items()) if n] + [("surplus", None, w, n) for w, n in sorted(b.items()) if n]
        book, page = pdf["book_id"].iloc[0], pdf["page_index"].iloc[0]
        return pd.DataFrame([(book, page, *r) for r in out], columns=["book_id", "page_index", "kind", "ours", "source", "n"])

    return difference.groupBy("book_id", "page_index").applyInPandas(fight, "book_id string, page_index long, kind string, ours string, source string, n long")


def compare(ours: DataFrame, source: DataFrame) -> DataFrame:
    return duels(bag_difference(page_words(ours), page_words(source)))


def plain_page(xhtml: str) -> str:
    """Text of a page file without figures; tags become spaces."""
    return re.sub(r"<[^>]+>", " ", re.sub(r"(?s)<figure\b.*?</figure>", " ", xhtml))
