"""Printed page numbers: reading, auditing, filling and resolving. Tables: folios(book_id, page_index, number, text, confident)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

REPEATS = 5


def folios_from_furniture(lines: DataFrame) -> DataFrame:
    """folios from furniture lines (book_id, page_index, pos, text).

    A bare number of one to three digits, decoration aside, beats one parsed from a running head; earlier lines win.
    A number on more than REPEATS pages is not confident; nor is a page without one.
    """
    bare = F.regexp_extract(F.trim("text"), r"^[\s\-–—•·|:.\[\](){}*~]*([0-9]{1,3})[\s\-–—•·|:.\[\](){}*~]*$", 1)
    plain = F.nullif(bare, F.lit("")).cast("int")
    number = F.coalesce(F.when(plain > 0, plain), T.parse_folio(F.col("text")))
    d = lines.withColumn("number", number).withColumn("rank", F.when(plain > 0, 0).when(F.col("number").isNotNull(), 1).otherwise(2))
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    best = F.min(F.struct("rank", blank.cast("int"), "pos", "number", "text")).alias("b")
    d = d.groupBy("book_id", "page_index").agg(best).select("book_id", "page_index", "b.number", F.coalesce("b.text", F.lit("")).alias("text"))
    seen = F.count("number").over(Window.partitionBy("book_id", "number"))
    return d.select("book_id", "page_index", "number", "text", (F.col("number").isNotNull() & (seen <= REPEATS)).alias("confident"))


def misreads(folios: DataFrame) -> DataFrame:
    """(book_id, page_index, number): folios that stand against neighbours which fit each other.

    Where most numbers of a book are compound (1000 and more), only those are looked at. In page order, a number is dropped
    if the last surviving number and the next one fit (0 < step <= 2 * pages + 2), it does not lie between them, is equal
    to neither, and exchanging it with either would not put things right.
    """

    def fold(pdf):
        pdf = pdf.sort_values("page_index")
        rows = list(zip(pdf["page_index"], pdf["number"], strict=True))
        compound = [r for r in rows if r[1] >= 1000]
        rows = compound if 2 * len(compound) > len(rows) else rows
        out, before = [], None
        for k, (page, n) in enumerate(rows):
            after = rows[k + 1] if k + 1 < len(rows) else None
            if before and after:
                low, high = before[1], after[1]
                fit = 0 < high - low <= 2 * (after[0] - before[0]) + 2
                two_back = rows[k - 2][1] if k >= 2 else float("-inf")
                two_on = rows[k + 2][1] if k + 2 < len(rows) else float("inf")
                in_place = low <= n <= high  # an equal neighbour is a duplicate, not a misread
                swapped = two_back < n < low or high < n < two_on
                if fit and not in_place and not swapped:
                    out.append((page, n))
                    continue
            before = (page, n)
        import pandas as pd

        return pd.DataFrame([(pdf["book_id"].iloc[0], p, n) for p, n in out], columns=["book_id", "page_index", "number"])

    return folios.where("number is not null and confident").select("book_id", "page_index", "number").groupBy("book_id").applyInPandas(fold, "book_id string, page_index long, number int")


def audit_folios(folios: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """(book_id, kind, page_a, page_b, number, missing): inversions, gaps, duplicates and misreads, as rows.

    Misreads are left out first (or `dropped`, if given). An inversion is a number not above its predecessor. A gap is
    a step within one thousand that misses more numbers than there are pages between. A duplicate has the number and its
    pages in order (in `missing`).
    """
    read = folios.where("number is not null and confident").select("book_id", F.col("page_index").cast("long").alias("page_index"), F.col("number").cast("long").alias("number"))
    wrong = misreads(folios) if dropped is None else dropped
    kept = read.join(wrong.select("book_id", F.col("page_index").cast("long").alias("page_index")), ["book_id", "page_index"], "left_anti")
    w = Window.partitionBy("book_id").orderBy("page_index")
    pairs = kept.select("book_id", "page_index", "number", F.lead("page_index").over(w).alias("next_page"), F.lead("number").over(w).alias("next")).where("next is not null")
    none = F.array().cast("array<bigint>")
    inversion = pairs.where("next <= number").select("book_id", F.lit("inversion").alias("kind"), F.col("page_index").alias("page_a"), F.col("next_page").alias("page_b"), F.col("next").alias("number"), none.alias("missing"))
    jump = (F.col("next") > F.col("number") + 1) & (F.floor(F.col("next") / 1000) == F.floor(F.col("number") / 1000)) & (F.col("next") - F.col("number") > F.col("next_page") - F.col("page_index"))
    gap = pairs.where(jump).select("book_id", F.lit("gap"), "page_index", "next_page", "number", F.sequence(F.col("number") + 1, F.col("next") - 1))
    twice = kept.groupBy("book_id", "number").agg(F.array_sort(F.collect_list("page_index")).alias("pages")).where(F.size("pages") > 1).select("book_id", F.lit("duplicate"), F.element_at("pages", 1), F.element_at("pages", -1), "number", "pages")
    bad = wrong.select("book_id", F.lit("misread"), F.col("page_index").cast("long"), F.lit(None).cast("long"), F.col("number").cast("long"), none)
    return inversion.union(gap).union(twice).union(bad)


def longest_increasing(values: list, strict: bool = True) -> list[int]:
    """Positions of a longest increasing (or non-decreasing) subsequence: the first longest end, the earliest predecessors."""
    best, back = [], []
    for i, x in enumerate(values):
        at = [j for j in range(i) if (values[j] < x if strict else values[j] <= x)]
        j = max(at, key=lambda j: (best[j], -j), default=None)
        best.append(1 if j is None else best[j] + 1)
        back.append(j)
    out, i = [], best.index(max(best)) if best else None
    while i is not None:
        out.append(i)
        i = back[i]
    return out[::-1]


def fill_folio_gaps(folios: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, page_index, number, source): 'read' anchors and 'filled' pages between two of them.

    Anchors are the longest strictly increasing run of confident numbers. Pages between two anchors are numbered only if
    pages and numbers advance alike; nothing is extrapolated. pages: book_id, page_index.
    """

    def anchors(pdf):
        pdf = pdf.sort_values("page_index")
        return pdf.iloc[longest_increasing(pdf["number"].tolist())][["book_id", "page_index", "number"]]

    a = folios.where("number is not null and confident").select("book_id", F.col("page_index").cast("long").alias("page_index"), F.col("number").cast("long").alias("number"))
    a = a.groupBy("book_id").applyInPandas(anchors, "book_id string, page_index long, number long")
    w = Window.partitionBy("book_id").orderBy("page_index")
    spans = a.withColumn("p", F.lead("page_index").over(w)).withColumn("n", F.lead("number").over(w)).where("p - page_index = n - number and p > page_index + 1")
    inner = spans.select("book_id", F.explode(F.sequence(F.col("page_index") + 1, F.col("p") - 1)).alias("i"), (F.col("number") - F.col("page_index")).alias("shift"))
    filled = inner.select("book_id", F.col("i").alias("page_index"), (F.col("i") + F.col("shift")).alias("number"), F.lit("filled").alias("source"))
    present = pages.select("book_id", F.col("page_index").cast("long").alias("page_index")).distinct()
    return a.withColumn("source", F.lit("read")).union(filled.join(present, ["book_id", "page_index"], "left_semi"))


def resolve_folios(wanted: DataFrame, folios: DataFrame) -> DataFrame:
    """wanted(book_id, folio) with page_index: the page that shows the folio, else as its neighbours project it.

    Without an exact page, the nearest lower and higher folios project a page each; they must agree, unless only one
    side exists. The lookup is an as-of join in both directions: one window over both tables.
    """
    f = folios.where("number is not null and confident").groupBy("book_id", F.col("number").cast("long").alias("folio")).agg(F.min(F.col("page_index").cast("long")).alias("at"))
    q = wanted.select("book_id", F.col("folio").cast("long").alias("folio")).where("folio is not null").distinct()
    both = f.select("book_id", "folio", "at").withColumn("known", F.struct("folio", "at")).union(q.select("book_id", "folio", F.lit(None).cast("long")).withColumn("known", F.lit(None).cast("struct<folio:bigint,at:bigint>")))
    w = Window.partitionBy("book_id").orderBy("folio")
    lower = F.last("known", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    upper = F.first("known", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    d = both.select("book_id", "folio", "known", lower.alias("lo"), upper.alias("hi")).where("known is null")
    low, high = F.col("lo.at") + F.col("folio") - F.col("lo.folio"), F.col("hi.at") - F.col("hi.folio") + F.col("folio")
    page = F.when(F.col("lo.folio") == F.col("folio"), F.col("lo.at")).when(F.col("lo").isNull(), high).when(F.col("hi").isNull(), low).when(low == high, low)
    return wanted.join(d.select("book_id", "folio", page.alias("page_index")), ["book_id", "folio"], "left")
