"""Bodies against the publisher's text layer, well-formed fragments, and readings that only lack labels or furniture."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .layout import match_labels

_VOID = {"br", "hr", "img", "wbr", "col", "input", "meta", "link"}


class _Rebuild(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "p" and "p" in self.open:
            self.handle_endtag("p")
        given = "".join(f' {k}="{html.escape(v if v is not None else k, quote=True)}"' for k, v in dict(attrs).items() if re.fullmatch(r"[A-Za-z_:][\w:.\-]*", k))
        self.out.append(f"<{tag}{given}{'/' if tag in _VOID else ''}>")
        if tag not in _VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while (last := self.open.pop()) != tag:
                self.out.append(f"</{last}>")
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        self.out.append(html.escape("".join(c for c in data if c in "\t\n\r" or ord(c) >= 32), quote=False))


def well_formed(fragment: str) -> str:
    """The fragment as well-formed XHTML: what is open is closed, what was never opened is dropped, attributes are quoted."""
    p = _Rebuild()
    p.feed(fragment or "")
    p.close()
    return "".join([*p.out, *(f"</{t}>" for t in reversed(p.open))])


def to_xhtml(items: DataFrame, column: str = "html") -> DataFrame:
    @F.pandas_udf("string")
    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else well_formed(x))

    return items.withColumn(column, each(column))


def compare_words(text: str) -> list[str]:
    """Words for the comparison of two editions: NFKC, plain punctuation, lower case."""
    t = unicodedata.normalize("NFKC", text or "").translate(str.maketrans(T.TYPOGRAPHIC)).lower()
    return re.findall(r"[^\W\d_]+(?:['-][^\W\d_]+)*", t)


def reconcile(body: str, layer: str, least: int = 10, most: int = 3) -> tuple[str, int]:
    """(body with the layer's words where the two differ by equally many, at most `most`, words; number of words changed).

    The layer needs `least` words. Words with control characters, or whose place in the body has a tag, stay.
    """
    theirs = (layer or "").split()
    if len(theirs) < least:
        return body, 0
    spots = [(part.start() + m.start(), part.start() + m.end()) for part in re.finditer(r"<[^>]*>|[^<]+", body) if part.group()[0] != "<" for m in re.finditer(r"\S+", part.group())]
    ours, edits = [html.unescape(body[a:b]) for a, b in spots], []
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, ours, theirs, autojunk=False).get_opcodes():
        if op == "replace" and i2 - i1 == j2 - j1 <= most:
            edits += [(*spots[i], theirs[j]) for i, j in zip(range(i1, i2), range(j1, j2), strict=True) if not any(unicodedata.category(c) == "Cc" for c in theirs[j])]
    for a, b, new in reversed(edits):
        body = body[:a] + html.escape(new, quote=False) + body[b:]
    return body, len(edits)


def reconcile_native_text(pages: DataFrame) -> DataFrame:
    """pages(book_id, page_index, body, layer_text, is_native) with `reconciled`: words taken from the layer of born-digital pages."""

    @F.pandas_udf("struct<body:string,reconciled:int>")
    def each(body: pd.Series, layer: pd.Series, native: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([reconcile(b or "", t or "") if n else (b, 0) for b, t, n in zip(body, layer, native, strict=True)], columns=["body", "reconciled"])

    others = [c for c in pages.columns if c != "body"]
    return pages.withColumn("r_", each("body", "layer_text", "is_native")).select(*others, "r_.*")


def placeholder_figures(items: DataFrame) -> DataFrame:
    """(book_id, page_index, item_index, action): items with an <img> that has no source.

    `crop` if the item holds nothing else and is 16 pixels or more either way (pixel_w, pixel_h), else `strip` the tag.
    """
    bare = F.col("html").rlike(r"<img(?![^>]*\bsrc=)[^>]*>")
    alone = T.strip_tags(F.col("html")) == ""
    action = F.when(alone & (F.col("pixel_w") >= 16) & (F.col("pixel_h") >= 16), "crop").otherwise("strip")
    return items.where(bare).select("book_id", "page_index", "item_index", action.alias("action"))


def relabel(items: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with labels where they had none, stats(book_id, labelled, unlabelled)); texts stay as they are."""
    found = match_labels(items.drop("label").withColumn("label", F.lit(None).cast("string")), blocks).select("book_id", "page_index", "item_index", F.col("label").alias("new_"))
    d = items.join(found, ["book_id", "page_index", "item_index"], "left")
    stats = d.groupBy("book_id").agg(F.count_if(F.col("label").isNull() & F.col("new_").isNotNull()).alias("labelled"), F.count_if(F.col("label").isNull() & F.col("new_").isNull()).alias("unlabelled"))
    return d.withColumn("label", F.coalesce("label", "new_")).drop("new_"), stats


def read_missing_folios(pages: DataFrame, known: DataFrame, reader: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Furniture lines of pages without known furniture, from an external reader of pages; a page it cannot read has one null line."""
    todo = pages.join(known.select("book_id", "page_index").distinct(), ["book_id", "page_index"], "left_anti")
    return todo.select("book_id", "page_index").join(reader(todo), ["book_id", "page_index"], "left").select("book_id", "page_index", F.coalesce("pos", F.lit(0)).alias("pos"), "text")
