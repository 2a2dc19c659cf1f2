"""Repeated, degenerate and turned pages. Tables: pages(book_id, page_index, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..functions import text as T

WINDOW, SHINGLE_WORDS, MIN_SHINGLES = 10, 5, 12
DUPLICATE, BORDERLINE, PDF_FLOOR = 0.55, 0.35, 0.90


def pair_scores(pages: DataFrame, *, window: int = WINDOW, k: int = SHINGLE_WORDS, min_shingles: int = MIN_SHINGLES) -> DataFrame:
    """(book_id, i, j, shared, score): overlap coefficient of page i with an earlier page j at most `window` before it.

    Only pairs that share a shingle are given. Pages are posted under (book, bucket of pages, shingle) and meet there, so
    that a shingle on very many pages meets only those near it, and a long book is spread over its buckets.
    """
    # shingles travel as 64-bit hashes; a page has them distinct, so that counts of matches are counts of shingles
    # the generator keeps filters from copying the shingle expression
    hashed = F.transform(T.page_shingles(F.col("text"), k), lambda x: F.xxhash64(x))
    s = pages.select("book_id", F.col("page_index").alias("i"), F.explode(F.array(hashed)).alias("s")).withColumn("n", F.size("s")).where(F.col("n") >= min_shingles)
    own = F.floor(F.col("i") / window)
    # one posting list for each (book, bucket, shingle): the bucket's pages, and those of the next one as later pages only
    page = F.named_struct(F.lit("i"), "i", F.lit("n"), "n", F.lit("own"), F.col("bucket") == own)
    posted = s.select("book_id", "i", "n", "s", F.explode(F.array(own, own - 1)).alias("bucket")).select("book_id", "bucket", F.explode("s").alias("shingle"), page.alias("p"))
    lists = posted.groupBy("book_id", "bucket", "shingle").agg(F.collect_list("p").alias("ps")).where(F.size("ps") > 1)  # at most 2 * window pages
    first = lists.select("book_id", "ps", F.explode("ps").alias("a")).where("a.own")
    near = first.select("book_id", "a", F.explode("ps").alias("b")).where((F.col("a.i") < F.col("b.i")) & (F.col("a.i") >= F.col("b.i") - window))
    shared = near.groupBy("book_id", F.col("b.i").alias("i"), F.col("a.i").alias("j"), F.col("b.n").alias("ni"), F.col("a.n").alias("nj")).agg(F.count(F.lit(1)).alias("shared"))
    return shared.select("book_id", "i", "j", "shared", (F.col("shared") / F.least("ni", "nj")).alias("score"))


def page_verdicts(pages: DataFrame, *, window: int = WINDOW, min_shingles: int = MIN_SHINGLES) -> DataFrame:
    """(book_id, page_index, status, match, score): kept, duplicate, borderline or unjudged.

    Pages are judged in order against earlier ones that are not duplicates; the best score counts, the earliest page on
    ties. From DUPLICATE on, the shorter text is the duplicate (the later page on ties), which may overturn an earlier
    verdict. Only pair scores and text lengths enter the fold.
    """
    length = F.length(F.coalesce("text", F.lit("")))
    facts = pages.select("book_id", "page_index", length.alias("length"), (F.size(T.page_shingles(F.col("text"))) >= min_shingles).alias("judged"))
    scores = pair_scores(pages, window=window, min_shingles=min_shingles).groupBy("book_id", F.col("i").alias("page_index")).agg(F.array_sort(F.collect_list(F.struct("j", "score"))).alias("near"))
    rows = facts.join(scores, ["book_id", "page_index"], "left")

    def fold(pdf):
        pdf = pdf.sort_values("page_index")
        length = dict(zip(pdf["page_index"], pdf["length"], strict=True))
        verdict = {}
        for page, judged, near in zip(pdf["page_index"], pdf["judged"], pdf["near"], strict=True):
            if not judged:
                verdict[page] = ("unjudged", None, 0.0)
                continue
            match, best = None, 0.0
            for x in near if near is not None else ():
                if verdict[x["j"]][0] != "duplicate" and x["score"] > best:
                    match, best = x["j"], x["score"]
            verdict[page] = ("kept", match, best)
            if match is not None and best >= DUPLICATE:
                if length[match] < length[page]:
                    verdict[match] = ("duplicate", page, best)
                else:
                    verdict[page] = ("duplicate", match, best)
            elif match is not None and best >= BORDERLINE:
                verdict[page] = ("borderline", match, best)
        out = pdf[["book_id", "page_index"]].copy()
        out["status"], out["match"], out["score"] = zip(*[verdict[p] for p in out["page_index"]], strict=True)
        return out.astype({"match": "Int64"})

    return rows.groupBy("book_id").applyInPandas(fold, "book_id string, page_index long, status string, match long, score double")


def drop_decisions(verdicts: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages to drop as duplicates: never native ones; a book with any PDF page needs a score of PDF_FLOOR.

    pages: book_id, page_index, is_native, from_pdf.
    """
    floor = F.when(F.max("from_pdf").over(Window.partitionBy("book_id")), F.lit(PDF_FLOOR)).otherwise(F.lit(DUPLICATE))
    facts = pages.select("book_id", "page_index", "is_native", floor.alias("floor"))
    return verdicts.join(facts, ["book_id", "page_index"]).where("status = 'duplicate' and not coalesce(is_native, false) and score >= floor").select("book_id", "page_index", "match", "score")


def final_survivors(verdicts: DataFrame) -> DataFrame:
    """(book_id, page_index, survivor): a duplicate's match, followed through further duplicates; a cycle ends the walk."""

    def follow(pdf):
        match = {p: m for p, m, s in zip(pdf["page_index"], pdf["match"], pdf["status"], strict=True) if s == "duplicate" and m == m and m is not None}
        rows = []
        for p in match:
            seen, at = {p}, match[p]
            while at in match and at not in seen:
                seen.add(at)
                at = match[at]
            rows.append((pdf["book_id"].iloc[0], p, at))
        import pandas as pd

        return pd.DataFrame(rows, columns=["book_id", "page_index", "survivor"])

    return verdicts.where("status = 'duplicate'").groupBy("book_id").applyInPandas(follow, "book_id string, page_index long, survivor long")


def _neighbours(column: str, reach: int) -> Column:
    w = Window.partitionBy("book_id").orderBy("page_index")
    near = [F.lag(column, d).over(w) for d in range(reach, 0, -1)] + [F.lead(column, d).over(w) for d in range(1, reach + 1)]
    return F.filter(F.array(*near), lambda x: x.isNotNull())


def sparse_pages(pages: DataFrame, *, share: float = 0.35, least: int = 80) -> DataFrame:
    """(book_id, page_index, words, median_words, kind): pages with no words ('blank') or few beside their neighbours ('sparse').

    Neighbours are the two pages on either side; their median must be at least `least` words.
    """
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")).cast("long")
    d = pages.select("book_id", "page_index", n.alias("words")).withColumn("near", _neighbours("words", 2)).withColumn("median_words", stats.median_of(F.col("near")))
    kind = F.when(F.col("words") == 0, "blank").when((F.col("median_words") >= least) & (F.col("words") < F.lit(share) * F.col("median_words")), "sparse")
    return d.withColumn("kind", kind).where("kind is not null").select("book_id", "page_index", "words", "median_words", "kind")


def outlying_pages(pages: DataFrame, *, hand: float = 0.06, aspect: float = 0.35) -> DataFrame:
    """Flags from measures (book_id, page_index, skin, ratio): 'hand' above max(hand, median skin + 0.05), 'uncropped' where
    the ratio is off the book's median by more than `aspect` of it."""
    medians = pages.groupBy("book_id").agg(stats.exact_median(F.col("skin")).alias("ms"), stats.exact_median(F.col("ratio")).alias("mr"))
    kinds = F.array(F.when(F.col("skin") > F.greatest(F.lit(hand), F.col("ms") + 0.05), "hand"), F.when(F.abs(F.col("ratio") - F.col("mr")) / F.col("mr") > aspect, "uncropped"))
    return pages.join(medians, "book_id").select("book_id", "page_index", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("kind"))


def page_turns(pages: DataFrame, *, shorter: float = 0.5, contained: float = 0.7, reach: int = 2) -> DataFrame:
    """(book_id, page_index, match, share): pages caught while being turned.

    Such a page has fewer than `shorter` of its neighbours' median words (60 or more), five stubs of four letters or
    more, and at least `contained` of the stubs inside the squashed text (200 characters or more) of a page at most
    `reach` away. The best share counts, the earliest page on ties.
    """
    ws = T.simple_words(F.col("text"))
    d = pages.select("book_id", "page_index", ws.alias("ws")).withColumn("words", F.size("ws").cast("long"))
    d = d.withColumn("m", stats.median_of(_neighbours("words", reach))).withColumn("squashed", F.array_join("ws", ""))
    mine = d.where((F.col("m") >= 60) & (F.col("words") < F.lit(shorter) * F.col("m"))).select("book_id", F.col("page_index").alias("i"), F.filter("ws", lambda x: F.length(x) >= 4).alias("stubs")).where(F.size("stubs") >= 5)
    mine = mine.withColumn("j", F.explode(F.array(*[F.col("i") + k for k in range(-reach, reach + 1) if k])))
    near = d.where(F.length("squashed") >= 200).select("book_id", F.col("page_index").alias("j"), "squashed")
    scored = mine.join(near, ["book_id", "j"]).withColumn("share", F.size(F.filter("stubs", lambda s: F.col("squashed").contains(s))) / F.size("stubs"))
    best = scored.where(F.col("share") >= contained).groupBy("book_id", F.col("i").alias("page_index")).agg(F.min(F.struct(-F.col("share"), F.col("j").alias("match"), F.col("share").alias("share"))).alias("b"))
    return best.select("book_id", "page_index", "b.match", "b.share")


def repeated_share(pages: DataFrame, *, n: int = 6, min_words: int = 40) -> DataFrame:
    """(book_id, page_index, share): share of a text's n-grams that occur more than once; 0 for under min_words words.

    Words are runs of two or more of a-z and 0-9. Computed inside the row by sorting, without a shuffle.
    """
    ws = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))

    def share(grams: Column) -> Column:
        s = F.array_sort(grams)
        twice = T.let(s, lambda g: F.size(F.filter(g, lambda x, i: F.coalesce(x == F.get(g, i - 1), F.lit(False)) | F.coalesce(x == F.get(g, i + 1), F.lit(False)))))
        return twice / F.size(grams)

    return pages.select("book_id", "page_index", T.let(ws, lambda w: F.when(F.size(w) < min_words, F.lit(0.0)).otherwise(T.let(T.windows(w, n), share))).alias("share"))


def coverage(pages: DataFrame, others: DataFrame, *, k: int = 6, min_words: int = 25) -> DataFrame:
    """(book_id, page_index, n_shingles, coverage, covered_by): the largest share of a page's shingles that one other page has.

    An inverted join on shingles. Pages on either side need min_words words; uncovered pages have 0 and null.
    """

    def sets(df: DataFrame) -> DataFrame:
        ws = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
        # shingles travel as 64-bit hashes; a page has them distinct, so that counts of matches are counts of shingles
        hashed = F.transform(T.strict_shingles(F.col("text"), k), lambda x: F.xxhash64(x))
        return df.where(F.size(ws) >= min_words).select("book_id", "page_index", F.explode(F.array(hashed)).alias("s"))

    mine = sets(pages)
    theirs = sets(others).select(F.col("page_index").alias("other"), F.explode("s").alias("shingle"), "book_id")
    hits = mine.select("book_id", "page_index", F.size("s").alias("n"), F.explode("s").alias("shingle")).join(theirs, ["book_id", "shingle"])
    counted = hits.groupBy("book_id", "page_index", "n", "other").agg(F.count(F.lit(1)).alias("shared"))
    best = counted.groupBy("book_id", "page_index").agg(F.min(F.struct(-F.col("shared"), F.col("other").alias("other"), (F.col("shared") / F.col("n")).alias("share"))).alias("b"))
    return mine.select("book_id", "page_index", F.size("s").cast("long").alias("n_shingles")).join(best, ["book_id", "page_index"], "left").select("book_id", "page_index", "n_shingles", F.coalesce("b.share", F.lit(0.0)).alias("coverage"), F.col("b.other").alias("covered_by"))
