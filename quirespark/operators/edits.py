"""Edits of page bodies as tables: (book_id, page_index, start, stop, new), offsets in code points of the body."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plain(fragment: str | None) -> str:
    """Text of a fragment: block ends and breaks become spaces, other tags vanish, entities are decoded."""
    t = re.sub(r"(?i)</(?:p|div|h[1-6]|li|tr|td|th|table|ul|ol|blockquote|figcaption)>|<(?:br|hr)\b[^>]*>", " ", fragment or "")
    return html.unescape(re.sub(r"<[^>]+>", "", t)).strip()


def apply_edits(pages: DataFrame, edits: DataFrame, keep_words: bool = True) -> DataFrame:
    """pages(book_id, page_index, body, ...) with the edits made, and `edited`, `reverted`.

    Edits go last first; one that overlaps an edit already made is skipped. With keep_words a page whose words would
    change keeps its body.
    """
    todo = edits.groupBy("book_id", "page_index").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "new")), asc=False).alias("todo_"))

    @F.pandas_udf("struct<body:string,edited:int,reverted:boolean>")
    def change(body: pd.Series, todo: pd.Series) -> pd.DataFrame:
        rows = []
        for b, steps in zip(body, todo, strict=True):
            out, limit, n = b, None, 0
            for s in steps if steps is not None else ():
                if limit is None or s["stop"] <= limit:
                    out, limit, n = out[: s["start"]] + s["new"] + out[s["stop"] :], s["start"], n + 1
            changed = keep_words and n and plain(out).split() != plain(b).split()
            rows.append((b, 0, True) if changed else (out, n, False))
        return pd.DataFrame(rows, columns=["body", "edited", "reverted"])

    others = [c for c in pages.columns if c != "body"]
    joined = pages.join(todo, ["book_id", "page_index"], "left")
    return joined.select(*others, change("body", "todo_").alias("r_")).select(*others, "r_.*")


def rewrite(pages: DataFrame, change: Callable[[str], str], where=None) -> DataFrame:
    """pages with change(body), a function of one fragment, on the pages for which `where` (a Column) holds."""

    @F.pandas_udf("string")
    def each(body: pd.Series) -> pd.Series:
        return body.map(lambda b: None if b is None else change(b))

    new = each("body") if where is None else F.when(where, each("body")).otherwise(F.col("body"))
    return pages.withColumn("body", new)


def find(pages: DataFrame, look: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """(book_id, page_index, *schema): what look(body) finds on every page."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(b, p, *r) for b, p, body in zip(pdf["book_id"], pdf["page_index"], pdf["body"], strict=True) for r in look(body or "")]
            yield pd.DataFrame(rows, columns=["book_id", "page_index", *names])

    return pages.select("book_id", F.col("page_index").cast("long").alias("page_index"), "body").mapInPandas(run, f"book_id string, page_index long, {schema}")


def in_text(body: str, start: int, stop: int) -> bool:
    """Whether a span has no tag, is not inside one, and is not inside a link."""
    before = body[:start]
    return "<" not in body[start:stop] and before.rfind("<") <= before.rfind(">") and len(re.findall(r"<a\b", before)) == before.count("</a>")
