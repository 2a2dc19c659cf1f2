"""Notes bound to their markers by key joins that refuse what is ambiguous. Tables: pages(book_id, page_index, body)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .edits import apply_edits, find, plain

# How the headings of note groups and the entries under them are set.
GROUP_NAMES = r"CHAPTER\s+[A-Z\-]+|CHAPTER\s+\d{1,3}|INTRODUCTION|PREFACE|PROLOGUE|FOREWORD|FORWARD|CONCLUSION|EPILOGUE|AFTERWORD|POSTSCRIPT"
NOTES_HEAD = r"<h\d[^>]*>\s*NOTES?\s*</h\d>"
MARKER = r"<sup>\s*(\d{1,3})\s*</sup>"
FOOT_SHAPE = r"<p[^>]*>\s*(?:<sup>\s*)?(?:<a[^>]*>)?\s*(?:\*{1,2}|†|‡|\d{1,3}[.)]?)\s*(?:</a>)?\s*(?:</sup>)?\s*\S"
SYMBOLS = ("**", "*", "†", "‡")


def body_markers(pages: DataFrame) -> DataFrame:
    """(book_id, page_index, pos, stop, n): superscript numbers that do not open a paragraph, and are not links yet."""

    def look(body: str) -> list[tuple]:
        return [(m.start(), m.end(), int(m.group(1))) for m in re.finditer(MARKER, body) if not re.search(r"<p[^>]*>\s*$", body[: m.start()])]

    return find(pages, look, "pos long, stop long, n long")


def marker_groups(markers: DataFrame) -> DataFrame:
    """markers with group_no: a new group starts where a 1 follows a 3 or more and is followed by 3 or less, or by nothing."""
    w = Window.partitionBy("book_id").orderBy("page_index", "pos")
    last, after = F.lag("n").over(w), F.lead("n").over(w)
    starts = (F.col("n") == 1) & (last >= 3) & (after.isNull() | (after <= 3))
    d = markers.withColumn("s_", F.coalesce(starts, F.lit(False)).cast("long"))
    return d.withColumn("group_no", F.sum("s_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("s_")


def _events(body: str) -> list[tuple]:
    """Heads ('head', pos, stop, label) and entries ('sup' or 'plain', pos, stop, number) of a notes page, by offset."""
    out = [("notes", m.start(), m.end(), "") for m in re.finditer(NOTES_HEAD, body, re.I)]
    heads = [m for m in re.finditer(rf"<(h[1-6]|p)\b[^>]*>\s*(?:<[^/][^>]*>\s*)*({GROUP_NAMES})\s*(?:</[a-zA-Z]+>\s*)*</\1>", body, re.I)]
    out += [("head", m.start(), m.end(), m.group(2)) for m in heads]
    out += [("head", m.start(), m.end(), m.group(1)) for m in re.finditer(r"<h\d[^>]*>\s*(\d{1,2}|[IVXL]{1,6})\.\s[^<]*</h\d>", body)]
    sup = [("entry", m.start(), m.end(), m.group(1)) for m in re.finditer(rf"<p>\s*{MARKER}", body)]
    out += sup
    if not sup:
        out += [("entry", m.start(), m.end(), m.group(1)) for m in re.finditer(r"<(?:p|li[^>]*)>\s*(\d{1,3})\.\s+(?=\S)", body)]
    return sorted(out, key=lambda x: x[1])


def notes_section(pages: DataFrame) -> DataFrame:
    """(book_id, group_no, label, page_index, pos, stop, n): entries of the section that the first Notes head opens.

    Heads open groups. The section ends before two pages in a row without heads and entries. Without group heads, the
    entries are one group if there are three or more and they climb strictly; else there are none.
    """
    ev = find(pages, _events, "kind string, pos long, stop long, label string")
    per_page = pages.select("book_id", F.col("page_index").cast("long").alias("page_index")).join(ev.groupBy("book_id", "page_index").agg(F.count(F.lit(1)).alias("events")), ["book_id", "page_index"], "left").na.fill(0, ["events"])
    first = ev.where("kind = 'notes'").groupBy("book_id").agg(F.min("page_index").alias("start"))
    w = Window.partitionBy("book_id").orderBy("page_index")
    in_section = per_page.join(first, "book_id").where("page_index >= start").withColumn("two", (F.col("events") == 0) & (F.lag("events").over(w) == 0))
    ended = in_section.where("two").groupBy("book_id").agg(F.min("page_index").alias("end"))
    d = ev.join(first, "book_id").join(ended, "book_id", "left").where("page_index >= start and (end is null or page_index < end)")
    d = d.where("kind <> 'notes'").withColumn("group_no", F.sum((F.col("kind") == "head").cast("long")).over(Window.partitionBy("book_id").orderBy("page_index", "pos").rowsBetween(Window.unboundedPreceding, 0)))
    label = F.last(F.when(F.col("kind") == "head", F.col("label")), ignorenulls=True).over(Window.partitionBy("book_id").orderBy("page_index", "pos"))
    heads = F.max("group_no").over(Window.partitionBy("book_id"))
    e = d.withColumn("label", label).withColumn("heads", heads).where("kind = 'entry'")
    numbers = find(pages, lambda b: [(p, int(x)) for k, p, _, x in _events(b) if k == "entry"], "pos long, n long")
    e = e.join(numbers, ["book_id", "page_index", "pos"])
    w2 = Window.partitionBy("book_id")
    one = e.where("heads = 0").withColumn("up", F.coalesce((F.col("n") > F.lag("n").over(w2.orderBy("page_index", "pos"))).cast("int"), F.lit(1)))
    one = one.withColumn("ok", (F.min("up").over(w2) == 1) & (F.count(F.lit(1)).over(w2) >= 3)).where("ok").withColumn("group_no", F.lit(1).cast("long"))
    columns = ["book_id", "group_no", "label", "page_index", "pos", "stop", "n"]
    return e.where("heads > 0 and group_no > 0").select(*columns).union(one.select(*columns))


def link_notes(pages: DataFrame, chapters: DataFrame | None = None, *, spread: int = 2) -> tuple[DataFrame, DataFrame]:
    """(pages with linked endnotes, stats(book_id, linked, unlinked, misaligned)).

    Markers before the notes section are grouped by chapter starts (chapters: book_id, chapter_no, page_index; the latest
    start at or before the page), else by marker_groups of two or more. Groups of markers and of notes are paired in
    order. If their counts differ by more than `spread`, or if under 75 % of the pairs have like highest numbers (within
    2 or a quarter), the book is misaligned and nothing is linked. A number binds to its first entry; the first citation
    carries the way back.
    """
    notes = notes_section(pages).withColumn("r", F.row_number().over(Window.partitionBy("book_id", "group_no", "n").orderBy("page_index", "pos"))).where("r = 1").drop("r")
    notes = notes.withColumn("g", F.dense_rank().over(Window.partitionBy("book_id").orderBy("group_no")))
    begin = notes.groupBy("book_id").agg(F.min("page_index").alias("begin"))
    marks = body_markers(pages).join(begin, "book_id").where("page_index < begin")
    if chapters is not None:
        w = Window.partitionBy("book_id").orderBy("page_index", "is_mark", "pos")
        c = chapters.select("book_id", F.col("page_index").cast("long").alias("page_index"), F.lit(0).alias("is_mark"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("stop"), F.lit(0).cast("long").alias("n"), F.col("chapter_no").cast("long").alias("c"))
        m = marks.select("book_id", "page_index", F.lit(1).alias("is_mark"), "pos", "stop", "n", F.lit(None).cast("long").alias("c"))
        marks = c.union(m).withColumn("group_no", F.last("c", ignorenulls=True).over(w)).where("is_mark = 1 and group_no is not null").drop("is_mark", "c")
    else:
        marks = marker_groups(marks).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("book_id", "group_no"))).where("size >= 2").drop("size")
    marks = marks.withColumn("g", F.dense_rank().over(Window.partitionBy("book_id").orderBy("group_no")))
    top = lambda d, n: d.groupBy("book_id", "g").agg(F.max("n").alias(n))
    paired = top(marks, "a").join(top(notes, "b"), ["book_id", "g"], "full")
    like = F.abs(F.col("a") - F.col("b")) <= F.greatest(F.lit(2.0), F.greatest("a", "b") * 0.25)
    gate = paired.groupBy("book_id").agg(F.count("a").alias("na"), F.count("b").alias("nb"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("judged"), F.count_if(like).alias("alike"))
    few = F.when(F.col("na") != F.col("nb"), 2).otherwise(4)
    gate = gate.withColumn("good", (F.abs(F.col("na") - F.col("nb")) <= spread) & ((F.col("judged") < few) | (F.col("alike") >= 0.75 * F.col("judged"))) & (F.col("na") > 0))
    bound = marks.join(gate.where("good").select("book_id"), "book_id").join(notes.select("book_id", "g", "n", F.col("page_index").alias("np"), F.col("pos").alias("npos"), F.col("stop").alias("nstop")), ["book_id", "g", "n"], "left")
    bound = bound.withColumn("first", F.row_number().over(Window.partitionBy("book_id", "g", "n").orderBy("page_index", "pos")) == 1)
    linked = bound.where("np is not null")
    name = F.concat_ws("-", "g", "n")
    page = lambda c: F.format_string("page_%04d.xhtml", F.col(c) + 1)
    back = F.when(F.col("first"), F.concat(F.lit(' id="ref-'), name, F.lit('"'))).otherwise(F.lit(""))
    cite = linked.select("book_id", "page_index", F.col("pos").alias("start"), "stop", F.concat(F.lit("<sup"), back, F.lit('><a href="'), page("np"), F.lit("#note-"), name, F.lit('">'), F.col("n").cast("string"), F.lit("</a></sup>")).alias("new"))
    target = linked.where("first").select("book_id", F.col("np").alias("page_index"), F.col("npos").alias("start"), (F.col("npos") + 2).alias("stop"), F.concat(F.lit('<p id="note-'), name, F.lit('"')).alias("new"))
    stats = marks.groupBy("book_id").agg(F.count(F.lit(1)).alias("markers")).join(linked.groupBy("book_id").agg(F.count(F.lit(1)).alias("linked")), "book_id", "left").join(gate.select("book_id", (~F.col("good")).alias("misaligned")), "book_id", "left").na.fill(0, ["linked"])
    stats = stats.select("book_id", "linked", (F.col("markers") - F.col("linked")).alias("unlinked"), F.coalesce("misaligned", F.lit(True)).alias("misaligned"))
    li = find(pages, lambda b: [(m.start(),) for m in re.finditer(r"<li", b)], "start long").withColumn("li", F.lit(1))
    target = target.join(li, ["book_id", "page_index", "start"], "left").select("book_id", "page_index", "start", F.when(F.col("li") == 1, F.col("stop") + 1).otherwise(F.col("stop")).alias("stop"), F.when(F.col("li") == 1, F.replace("new", F.lit("<p "), F.lit("<li "))).otherwise(F.col("new")).alias("new"))
    return apply_edits(pages, cite.union(target)), stats


def looks_like_foot_block(below: str) -> bool:
    """A part of a page under its rule: no heading, opens with a foot-shaped paragraph, 80 % of the words are in such."""
    blocks = re.findall(r"(?s)<p[^>]*>.*?</p>", below)
    if re.search(r"<h[1-6]", below) or not re.match(r"(?s)\s*" + FOOT_SHAPE, below):
        return False
    words = len(plain(below).split())
    return sum(len(plain(b).split()) for b in blocks if re.match(FOOT_SHAPE, b)) >= 0.8 * words


def foot_block_start(body: str) -> int | None:
    """Where a page's foot block starts: after its <hr/>, or at a trailing run of superscript entries under 30 words or more."""
    m = re.search(r"<hr\s*/?>", body)
    if m:
        return m.end()
    blocks = list(re.finditer(r"(?s)<(p|h[1-6]|ul|ol|table|figure)\b.*?</\1>", body))
    k = len(blocks)
    while k and re.match(rf"<p[^>]*>\s*{MARKER}", blocks[k - 1].group()):
        k -= 1
    if 0 < k < len(blocks) and len(plain(body[: blocks[k].start()]).split()) >= 30:
        return blocks[k].start()
    return None


def _foot_pairs(body: str, numbered: bool) -> list[tuple]:
    cut = foot_block_start(body)
    if cut is None:
        return []
    above, below, rows = body[:cut], body[cut:], []
    for s in SYMBOLS:
        mark = rf"(?<!\*){re.escape(s)}(?!\*)"
        up = [m for m in re.finditer(mark, above) if above[: m.start()].rfind("<") <= above[: m.start()].rfind(">")]
        down = list(re.finditer(rf"<p[^>]*>\s*(?:<sup>\s*)?({mark})", below))
        rows += [("symbol", s, m.start(), m.end(), len(up), len(down), cut + down[0].start(1) if down else -1) for m in up]
    if numbered and looks_like_foot_block(below):
        up = list(re.finditer(MARKER, above))
        down = list(re.finditer(r"<p[^>]*>\s*(?:<sup>\s*)?(\d{1,3})[.)]?\s*(?:</sup>)?\s+(?=\S)", below))
        for m in up:
            n = m.group(1)
            entries = [d for d in down if d.group(1) == n]
            rows.append(("number", n, m.start(1), m.end(1), sum(x.group(1) == n for x in up), len(entries), cut + entries[0].start(1) if entries else -1))
    return rows


def link_footnotes(pages: DataFrame, numbered: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pages with linked footnotes, stats(book_id, linked, unlinked)). A mark binds only if its page has one above and one below."""
    found = find(pages, lambda b: _foot_pairs(b, numbered), "kind string, mark string, start long, stop long, above long, below long, foot long")
    one = (F.col("above") == 1) & (F.col("below") == 1)
    ok = found.where(one).withColumn("k", F.row_number().over(Window.partitionBy("book_id", "page_index").orderBy("start")))
    cite = ok.select("book_id", "page_index", "start", "stop", F.concat(F.lit('<a id="fr'), F.col("k"), F.lit('" href="#fn'), F.col("k"), F.lit('">'), F.col("mark"), F.lit("</a>")).alias("new"))
    foot = ok.select("book_id", "page_index", F.col("foot").alias("start"), (F.col("foot") + F.length("mark")).alias("stop"), F.concat(F.lit('<a id="fn'), F.col("k"), F.lit('" href="#fr'), F.col("k"), F.lit('">'), F.col("mark"), F.lit("</a>")).alias("new"))
    stats = found.groupBy("book_id").agg(F.count_if(one).alias("linked"), F.count_if(~one).alias("unlinked"))
    return apply_edits(pages, cite.union(foot)), stats


def chapter_notes(pages: DataFrame) -> DataFrame:
    """(book_id, section, page_index, pos, stop, n, entry_page, entry_pos): markers bound to the Notes head that closes their chapter.

    A book needs two Notes heads. Markers after the previous head and before this one belong to it. Of the entries
    after a head, only those count that climb from 1 without a gap.
    """
    ev = find(pages, _events, "kind string, pos long, stop long, label string")
    place = F.struct("page_index", "pos")
    heads = ev.where("kind = 'notes'").withColumn("section", F.row_number().over(Window.partitionBy("book_id").orderBy("page_index", "pos"))).withColumn("heads", F.count(F.lit(1)).over(Window.partitionBy("book_id"))).where("heads >= 2")
    h = heads.select("book_id", "section", place.alias("at"), F.lag(place).over(Window.partitionBy("book_id").orderBy("page_index", "pos")).alias("before"), F.lead(place).over(Window.partitionBy("book_id").orderBy("page_index", "pos")).alias("after"))
    entries = ev.where("kind = 'entry'").withColumn("p", place).join(h, "book_id").where("p > at and (after is null or p < after)").withColumn("n", F.expr("try_cast(label as bigint)"))
    order = Window.partitionBy("book_id", "section").orderBy("page_index", "pos")
    entries = entries.withColumn("k", F.row_number().over(order))

    def climb(pdf):
        expect, keep = 1, []
        for n in pdf.sort_values(["page_index", "pos"])["n"]:
            keep.append(n == expect)
            expect += n == expect
        return pdf.sort_values(["page_index", "pos"])[keep]

    entries = entries.select("book_id", F.col("section").cast("long").alias("section"), "page_index", "pos", F.coalesce("n", F.lit(-1).cast("long")).alias("n"))
    entries = entries.groupBy("book_id", "section").applyInPandas(climb, "book_id string, section long, page_index long, pos long, n long")
    marks = body_markers(pages).withColumn("p", place).join(h, "book_id").where("p < at and (before is null or p > before)")
    e = entries.select("book_id", "section", "n", F.col("page_index").alias("entry_page"), F.col("pos").alias("entry_pos"))
    return marks.withColumn("section", F.col("section").cast("long")).join(e, ["book_id", "section", "n"]).select("book_id", "section", "page_index", "pos", "stop", "n", "entry_page", "entry_pos")


def link_chapter_notes(pages: DataFrame) -> DataFrame:
    """pages with the citations of chapter_notes linked."""
    b = chapter_notes(pages)
    name = F.concat_ws("-", F.lit("c"), "section", "n")
    cite = b.select("book_id", "page_index", F.col("pos").alias("start"), "stop", F.concat(F.lit('<sup><a href="'), F.format_string("page_%04d.xhtml", F.col("entry_page") + 1), F.lit("#"), name, F.lit('">'), F.col("n").cast("string"), F.lit("</a></sup>")).alias("new"))
    target = b.select("book_id", F.col("entry_page").alias("page_index"), F.col("entry_pos").alias("start"), (F.col("entry_pos") + 2).alias("stop"), F.concat(F.lit('<p id="'), name, F.lit('"')).alias("new")).dropDuplicates(["book_id", "page_index", "start"])
    return apply_edits(pages, cite.union(target))
