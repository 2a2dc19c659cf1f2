"""Typography of page bodies: quotes, spaces, lists, hyphens over page ends, headings of notes, mathematics."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .edits import plain, rewrite

# Suspicious characters, words written with an apostrophe before them, characters after which a double and a
# single quote opens, Greek letters by macro, the words at a page's end and start.
SUSPECT = r"[¬¦§¤°^~`|\\\x{2500}-\x{257F}\x{FFFD}\x{80}-\x{9F}]"
ELISIONS = r"(?i)(?:tis|twas|twere|em|cause|til|till|round|bout|neath|gainst|\d0s?)\b"
OPENS_DOUBLE, OPENS_SINGLE = " \t\n(—–[{‘“", " \t\n(—–[{“"
PAGE_END = r"([A-Za-z]+)-(?:\s*</[^>]+>)*\s*$"
PAGE_START = r"^(?:\s*<[^>]+>)*\s*([a-z][A-Za-z'’]*[.,;:!?'’\"]*)"
GREEK = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "Delta": "Δ", "mu": "μ", "pi": "π", "psi": "ψ", "epsilon": "ε", "omega": "ω"}


def unusual_characters(pages: DataFrame) -> DataFrame:
    """(book_id, ch, n): characters outside tags that usually mean a misreading. `top` of them are for report()."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce("body", F.lit("")), "<[^>]+>", ""), F.lit(SUSPECT), F.lit(0))
    return pages.select("book_id", F.explode(found).alias("ch")).groupBy("book_id", "ch").agg(F.count(F.lit(1)).alias("n"))


def report(counts: DataFrame, top: int = 8) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("book_id").orderBy(F.col("n").desc(), "ch"))
    return counts.withColumn("r", r).where(F.col("r") <= top).drop("r")


def requote(text: str) -> str:
    """Straight quotes made directional; double spaces between words made single.

    A double quote opens at the start, after space, an opening bracket, a dash or an opening directional quote; else it
    closes. A single quote opens there too, but not after another single one, and only before a letter, a digit or a
    double quote that begin no elision; else it is an apostrophe.
    """

    def directed(m: re.Match) -> str:
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if m.group() == '"':
            return "“" if not before or before in OPENS_DOUBLE else "”"
        starts = (not before or before in OPENS_SINGLE) and (after.isalnum() or after in ("“", '"'))
        return "‘" if starts and not re.match(ELISIONS, text[m.end() :]) else "’"

    return re.sub(r"(?<=\S) {2,}(?=\S)", " ", re.sub("[\"']", directed, text))


def normalise_typography(pages: DataFrame) -> DataFrame:
    """pages with requote on text between tags; born-digital pages (is_native) keep theirs."""
    change = lambda body: "".join(p if p.startswith("<") else requote(p) for p in re.split(r"(<[^>]*>)", body))
    return rewrite(pages, change, ~F.coalesce("is_native", F.lit(False)) if "is_native" in pages.columns else None)


def double_spaces(text: Column) -> Column:
    """The column form of the space rule."""
    return F.regexp_replace(text, r"(?<=\S) {2,}(?=\S)", " ")


def reflow(text: str) -> str:
    """Lines to paragraphs: hyphens at line ends joined; a line under three quarters of the median length ends one."""
    lines = [x.strip() for x in re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", text or "").split("\n")]
    lengths = sorted(len(x) for x in lines if x)
    median = (lengths[(len(lengths) - 1) // 2] + lengths[len(lengths) // 2]) / 2 if lengths else 0
    out, current = [], []
    for x in lines:
        if x:
            current.append(x)
        if current and (not x or len(x) < 0.75 * median):
            out.append(" ".join(current))
            current = []
    return "\n\n".join([*out, " ".join(current)] if current else out)


def normalise_math(pages: DataFrame) -> DataFrame:
    """Inline <math> as letters (see plain_math); displayed formulas stay."""
    inline = r'(?s)<math(?![^>]*display="block")[^>]*>(.*?)</math>'
    return rewrite(pages, lambda body: re.sub(inline, lambda m: plain_math(m.group(1)), body))


def plain_math(text: str) -> str:
    """Text wrappers opened, names of Greek letters as letters (also where more letters follow), thin spaces as commas; of
    any other macro the backslash goes."""
    names = "|".join(sorted(GREEK, key=len, reverse=True))
    pattern = rf"\\(?:text|mathrm|mathit)\{{([^}}]*)\}}|\\({names})|\\(,?)"

    def letter(m: re.Match) -> str:
        return plain_math(m.group(1)) if m.group(1) is not None else GREEK[m.group(2)] if m.group(2) else m.group(3)

    return re.sub(pattern, letter, text)


def normalise_lists(pages: DataFrame) -> DataFrame:
    """Lists whose items print their own markers do without a second one.

    If at least half of a list's own items begin with a number or bullet, the list gets list-style-type: none; else
    stray bullets in a <ul> are removed.
    """
    number, bullet = r"<li[^>]*>\s*(?:<[^/][^>]*>\s*)*\d{1,3}[.)]\s", r"(<li[^>]*>\s*(?:<[^/][^>]*>\s*)*)[•·▪‣∙]\s+"

    def change(body: str) -> str:
        stack, lists = [], []
        for m in re.finditer(r"(?i)<(/?)(ol|ul|li)\b[^>]*>", body):
            closing, name = m.group(1), m.group(2).lower()
            if name != "li":
                if closing and stack:
                    stack.pop()
                elif not closing:
                    stack.append({"at": m, "items": [], "kind": name})
                    lists.append(stack[-1])
            elif not closing and stack:
                stack[-1]["items"].append(m.start())
        edits = []
        for x in lists:
            marked = sum(bool(re.match(number, body[i:]) or re.match(bullet, body[i:])) for i in x["items"])
            if x["items"] and 2 * marked >= len(x["items"]):
                tag = x["at"].group()
                if "list-style-type" not in tag:
                    edits.append((x["at"].start(), x["at"].end(), tag[:-1] + ' style="list-style-type: none">'))
            elif x["kind"] == "ul":
                for i in x["items"]:
                    if m := re.match(bullet, body[i:]):
                        edits.append((i, i + m.end(), m.group(1)))
        for a, b, new in sorted(edits, reverse=True):
            body = body[:a] + new + body[b:]
        return body

    return rewrite(pages, change)


def normalise_note_heads(pages: DataFrame, notes_start: DataFrame) -> DataFrame:
    """Bold paragraphs that head a group of notes as <h2>, on pages with entries from the notes' start (book_id, start) on."""
    d = pages.join(notes_start, "book_id", "left")
    where = (F.col("page_index") >= F.col("start")) & F.col("body").rlike(r"<p>\s*<sup>\s*[0-9]{1,3}\s*</sup>|<(?:p|li[^>]*)>\s*[0-9]{1,3}\.\s+\S")
    return rewrite(d, lambda b: re.sub(r"<p>\s*<b>([^<]{1,80})</b>\s*</p>", r"<h2>\1</h2>", b), F.coalesce(where, F.lit(False))).drop("start")


def page_hyphens(pages: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """(book_id, page_index, next_page, stem, rest, status): words cut by the end of a kept page.

    `joined` if the whole word stands elsewhere in the book, else `refused`.
    """
    d = pages if dropped is None else pages.join(dropped.select("book_id", "page_index"), ["book_id", "page_index"], "left_anti")
    w = Window.partitionBy("book_id").orderBy("page_index")
    stem = F.regexp_extract(F.coalesce("body", F.lit("")), PAGE_END, 1)
    rest = F.regexp_extract(F.coalesce(F.lead("body").over(w), F.lit("")), PAGE_START, 1)
    cut = d.select("book_id", "page_index", F.lead("page_index").over(w).alias("next_page"), stem.alias("stem"), rest.alias("rest")).where("stem <> '' and rest <> ''")
    known = d.select("book_id", F.explode(F.array_distinct(F.transform(T.tokens(T.strip_tags(F.col("body"))), T.fold_word))).alias("word")).distinct()
    cut = cut.withColumn("word", T.fold_word(F.concat("stem", F.regexp_replace("rest", r"[.,;:!?'’\"]+$", ""))))
    return cut.join(known.withColumn("k_", F.lit(True)), ["book_id", "word"], "left").select("book_id", "page_index", "next_page", "stem", "rest", F.when(F.col("k_"), "joined").otherwise("refused").alias("status"))


def join_page_hyphens(pages: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """pages with the joined words of page_hyphens whole on the first page."""
    j = page_hyphens(pages, dropped).where("status = 'joined'")
    d = pages.join(j.select("book_id", "page_index", F.col("rest").alias("take_")), ["book_id", "page_index"], "left").join(j.select("book_id", F.col("next_page").alias("page_index"), F.col("rest").alias("give_")), ["book_id", "page_index"], "left")

    @F.pandas_udf("string")
    def change(body: pd.Series, take: pd.Series, give: pd.Series) -> pd.Series:
        def one(b, t, g):
            if isinstance(g, str):
                m = re.match(r"((?:\s*<[^>]+>)*\s*)([a-z][A-Za-z'’]*)[.,;:!?'’\"]*\s*", b)
                b = m.group(1) + b[m.end() :]
            if isinstance(t, str):
                b = re.sub(r"([A-Za-z]+)-((?:\s*</[^>]+>)*\s*)$", lambda m: m.group(1) + t + m.group(2), b)
            return b

        return pd.Series([one(b, t, g) for b, t, g in zip(body, take, give, strict=True)])

    return d.withColumn("body", change("body", "take_", "give_")).drop("take_", "give_")


def plain_texts(pages: DataFrame) -> DataFrame:
    """(book_id, page_index, text) by the full entity table, in Python; functions.text.strip_tags covers the common entities."""

    @F.pandas_udf("string")
    def text(body: pd.Series) -> pd.Series:
        return body.map(plain)

    return pages.select("book_id", "page_index", text("body").alias("text"))
