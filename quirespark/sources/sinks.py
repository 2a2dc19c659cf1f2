"""Reports, review sheets, page maps and progress events as text and JSON tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.adjudicate import review_order


def adjudication_report(judged: DataFrame, lexicon: DataFrame, page_files: DataFrame) -> DataFrame:
    """(book_id, report): JSON with pages, lexicon_size, rungs and disputes in reading order. page_files: book_id, pages."""
    rungs = judged.groupBy("book_id", "rung").agg(F.count(F.lit(1)).alias("n")).groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rung", "n")))).alias("rungs"))
    rows = judged.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_index").alias("page"), "seq", "ours", "theirs", "rung", "winner"))).alias("disputes"))
    size = lexicon.groupBy("book_id").agg(F.count(F.lit(1)).alias("lexicon_size"))
    d = page_files.join(size, "book_id", "left").join(rungs, "book_id", "left").join(rows, "book_id", "left").na.fill(0, ["lexicon_size"])
    return d.select("book_id", F.to_json(F.struct("pages", "lexicon_size", "rungs", "disputes")).alias("report"))


def decision_rows(tiered: DataFrame) -> DataFrame:
    """Decisions that a reviewer would confirm: page, occurrence, old, new, source, rung, for verdicts against the shipped word."""
    return tiered.where("winner is not null and winner <> ours").select("book_id", F.col("page_index").cast("string").alias("page"), "occurrence", F.col("ours").alias("old"), F.col("winner").alias("new"), F.lit("verdict").alias("source"), "rung")


def fingerprint(columns: list[str]) -> Column:
    """Twelve hexadecimal digits that identify a sheet's rows."""
    return F.substring(F.sha1(F.to_json(F.struct(*columns)).cast("binary")), 1, 12)


def _escape(c):
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def review_sheet(tiered: DataFrame) -> DataFrame:
    """(book_id, html): a self-contained sheet of the rows that need eyes, in review order."""
    need = tiered.where("tier <> 'confirmed'")
    row = F.concat(F.lit("<tr><td>"), F.col("page_index").cast("string"), F.lit("</td><td>"), "tier", F.lit("</td><td>"), _escape(F.col("ours")), F.lit("</td><td>"), _escape(F.col("theirs")), F.lit("</td><td>"), F.coalesce(_escape(F.col("winner")), F.lit("?")), F.lit("</td></tr>"))
    g = need.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(review_order(need).alias("o"), row.alias("r")))).alias("rows"))
    table = F.array_join(F.transform("rows", lambda x: x["r"]), "\n")
    return g.select("book_id", F.concat(F.lit("<!doctype html><meta charset='utf-8'><title>Review</title><table><tr><th>page<th>tier<th>shipped<th>witness<th>verdict</tr>\n"), table, F.lit("\n</table>")).alias("html"))


def page_sheet(verdicts: DataFrame, flags: DataFrame) -> DataFrame:
    """(book_id, page_index, kind, detail): duplicates, borderline and unjudged pages, and flagged ones, for a page sheet."""
    v = verdicts.where("status <> 'kept'").select("book_id", "page_index", F.col("status").alias("kind"), F.when(F.col("match").isNotNull(), F.concat(F.lit("page "), F.col("match").cast("string"), F.lit(", score "), F.format_number("score", 3))).otherwise(F.lit("")).alias("detail"))
    return v.unionByName(flags.select("book_id", "page_index", "kind", F.lit("").alias("detail")))


def page_map_rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.to_json(F.struct("page_index", "page_id")).alias("value"))


def thumbnail_uri(content) -> Column:
    """data: address of an image that has been scaled already."""
    return F.concat(F.lit("data:image/jpeg;base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


PROGRESS_SCHEMA = "event string, phase string, done long, total long, note string, message string, epub string, pdf string"


def progress_events(lines: DataFrame) -> DataFrame:
    """lines(value) as events; a line that is no JSON object with an event is a log line (event null, message the line)."""
    parsed = F.from_json("value", PROGRESS_SCHEMA)
    d = lines.select("value", parsed.alias("e"))
    known = F.col("e.event").isNotNull()
    fields = ["event", "phase", "done", "total", "note", "epub", "pdf"]
    return d.select(*[F.col(f"e.{c}").alias(c) for c in fields], F.when(known, F.col("e.message")).otherwise(F.col("value")).alias("message"))


def progress_lines(events: DataFrame) -> DataFrame:
    """One JSON object per event, nulls left out."""
    return events.select(F.to_json(F.struct(*[c for c in events.columns])).alias("value"))
