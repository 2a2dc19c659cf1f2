"""Contents, headings and navigation. Tables: pages(book_id, page_index, body), toc(book_id, entry_index, title, folio, depth)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .edits import find, plain, rewrite
from .folios import longest_increasing, resolve_folios
from .typography import plain_math

# The headings that open a chapter, and the forms in which a reference work sets the head of an entry.
ENTRY_FORMS = (r"<h[1-4][^>]*>\s*(?:<b>\s*)?(#\d{1,3}\..*?)(?:</b>\s*)?</h[1-4]>", r"<p>\s*<b>\s*(#\d{1,3}\..*?)</b>\s*</p>", r"^\s*<b>\s*(#\d{1,3}\..*?)</b>", r"<p>\s*(#\d{1,3}\..*?)</p>")
CHAPTER_HEAD = r"<(h[1-6])[^>]*>\s*(?:<[^/][^>]*>\s*)*(CHAPTER|Chapter)\s+(\d{1,3}|[IVXL]{1,7})\s*[.:—-]?\s*(.*?)</\1>"
_TENS, _UNITS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
ROMAN = {t + u: 10 * i + j for i, t in enumerate(_TENS) for j, u in enumerate(_UNITS) if i or j}


def _number(token: str) -> int | None:
    return int(token) if token.isdigit() else ROMAN.get(token)


def chapter_heads(pages: DataFrame) -> DataFrame:
    """(book_id, page_index, pos, level, n, title): headings that open a chapter, numbered in digits or roman."""

    def look(body: str) -> list[tuple]:
        found = [(m.start(), int(m.group(1)[1]), _number(m.group(3)), plain(m.group(4))) for m in re.finditer(CHAPTER_HEAD, body, re.S)]
        return [f for f in found if f[2] is not None]

    return find(pages, look, "pos long, level int, n long, title string")


def numbered_entries(pages: DataFrame) -> DataFrame:
    """(book_id, page_index, n, title): the first page of each entry of a reference work, headed `#41. Name`."""

    def look(body: str) -> list[tuple]:
        # headings and paragraphs in order, and the page's beginning where that is bare
        blocks = [m.group(2) for m in re.finditer(r"(?s)<(h[1-4]|p)\b[^>]*>(.*?)(?:</\1>|$)", body)] + [body]
        heads = (re.match(r"(?s)#(\d{1,3})\.([^;]*)", plain_math(plain(b))) for b in blocks)
        return [(int(m.group(1)), f"#{m.group(1)}. {' '.join(m.group(2).split())[:60]}".strip()) for m in heads if m][:1]

    first = F.row_number().over(Window.partitionBy("book_id", "n").orderBy("page_index"))
    return find(pages, look, "n long, title string").withColumn("r", first).where("r = 1").drop("r")


def heads_contents(pages: DataFrame) -> DataFrame:
    """(book_id, entry_index, title, target_page): contents from chapter heads, if three or more climb strictly."""
    w = Window.partitionBy("book_id").orderBy("page_index", "pos")
    first = chapter_heads(pages).withColumn("r", F.row_number().over(Window.partitionBy("book_id", "n").orderBy("page_index", "pos"))).where("r = 1")
    d = first.withColumn("up", F.coalesce((F.col("n") > F.lag("n").over(w)).cast("int"), F.lit(1)))
    b = Window.partitionBy("book_id")
    d = d.withColumn("ok", (F.min("up").over(b) == 1) & (F.count(F.lit(1)).over(b) >= 3)).where("ok")
    title = F.concat(F.lit("Chapter "), F.col("n").cast("string"), F.when(F.col("title") != "", F.concat(F.lit(": "), F.col("title"))).otherwise(F.lit("")))
    return d.select("book_id", (F.row_number().over(w) - 1).cast("long").alias("entry_index"), title.alias("title"), F.col("page_index").alias("target_page"))


def normalise_chapter_heads(pages: DataFrame) -> DataFrame:
    """All chapter headings of a book at the highest rank any of them has; a book with one is left alone."""
    rank = chapter_heads(pages).groupBy("book_id").agg(F.min("level").alias("rank_"), F.count(F.lit(1)).alias("n_")).where("n_ >= 2").drop("n_")

    @F.pandas_udf("string")
    def level(body: pd.Series, rank: pd.Series) -> pd.Series:
        def one(b, r):
            if b is None or r != r:
                return b
            change = lambda m: m.group() if _number(m.group(3)) is None else re.sub(rf"^<{m.group(1)}|</{m.group(1)}>$", lambda x: x.group().replace(m.group(1), f"h{int(r)}"), m.group())
            return re.sub(CHAPTER_HEAD, change, b, flags=re.S)

        return pd.Series([one(b, r) for b, r in zip(body, rank, strict=True)])

    return pages.join(rank, "book_id", "left").withColumn("body", level("body", "rank_")).drop("rank_")


def missing_chapters(pages: DataFrame) -> DataFrame:
    """(book_id, n, page_index, pos): the one place that a chapter missing from the sequence can open at.

    For each number missing between two headed chapters: mentions `Chapter N` that open a sentence and are followed by a
    capital, on the pages from the one heading to the other; there must be exactly one.
    """
    heads = chapter_heads(pages).groupBy("book_id", "n").agg(F.min("page_index").alias("page"))
    w = Window.partitionBy("book_id").orderBy("n")
    holes = heads.withColumn("n2", F.lead("n").over(w)).withColumn("p2", F.lead("page").over(w)).where("n2 > n + 1 and p2 >= page").select("book_id", F.explode(F.sequence(F.col("n") + 1, F.col("n2") - 1)).alias("n"), "page", "p2")

    def look(body: str) -> list[tuple]:
        spots = re.finditer(r"(?:^|[.!?:>]\s*)((?:CHAPTER|Chapter)\s+(\d{1,3}|[IVXL]{1,7}))\s*[.:—-]?\s+(?=[A-Z])", body)
        return [(m.start(1), _number(m.group(2))) for m in spots if _number(m.group(2)) is not None and not re.search(r"<h[1-6][^>]*>\s*$", body[: m.start(1)])]

    found = find(pages, look, "pos long, n long").join(holes, ["book_id", "n"]).where("page_index between page and p2")
    return found.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("book_id", "n"))).where("c = 1").select("book_id", "n", "page_index", "pos")


def promote_missing_chapters(pages: DataFrame) -> DataFrame:
    """pages with the mentions of missing_chapters set as headings of the book's rank."""
    rank = chapter_heads(pages).groupBy("book_id").agg(F.min("level").alias("rank_"))
    spots = missing_chapters(pages).join(rank, "book_id").groupBy("book_id", "page_index").agg(F.sort_array(F.collect_list(F.struct("pos", "rank_")), asc=False).alias("spots_"))

    @F.pandas_udf("string")
    def set_heads(body: pd.Series, spots: pd.Series) -> pd.Series:
        def one(b, ss):
            for s in ss if ss is not None else ():
                m = re.match(r"(?:CHAPTER|Chapter)\s+(?:\d{1,3}|[IVXL]{1,7})", b[s["pos"] :])
                before, after = b[: s["pos"]], b[s["pos"] + m.end() :]
                opened = before.rfind("<p") > before.rfind("</p>")
                b = f"{before}{'</p>' if opened else ''}<h{s['rank_']}>{m.group()}</h{s['rank_']}>{'<p>' if opened else ''}{after}"
            return b

        return pd.Series([one(b, s) for b, s in zip(body, spots, strict=True)])

    return pages.join(spots, ["book_id", "page_index"], "left").withColumn("body", set_heads("body", "spots_")).drop("spots_")


_ROW = re.compile(r"^(?P<title>\S.*?)(?P<lead>[\s.·…]*)(?P<folio>\d{1,3}(?:-\d{1,3})?|[A-Z]-\d{1,3}|[ivxl]{1,6})$")
_GROUP = re.compile(r"^(?:BOOK|PART|Book|Part)\s+(?:[A-Z][A-Za-z]*|\d+|[IVXL]+)\b")


def _rows(body: str) -> list[tuple[str, str]]:
    """Lines of a page in order: ('head', text) for headings, ('line', text) for the others."""
    out = []
    for m in re.finditer(r"(?s)<(h[1-6]|p|li|tr|div)\b[^>]*>(.*?)</\1>|([^<]+)", body):
        for line in re.split(r"<br[^>]*>|\n", m.group(2) or m.group(3) or ""):
            text = " ".join(plain(line).split())
            if text:
                out.append(("head" if m.group(1) and m.group(1)[0] == "h" else "line", text))
    return out


def parse_contents(pages: DataFrame, limit: int = 25) -> DataFrame:
    """(book_id, entry_index, title, folio, folio_text, depth, page_index): the printed contents of a book's first pages.

    A page is contents if it says so in its first 1000 characters, or has five rows with folios and dot leaders on
    max(3, a third) of them, or follows a contents page with five rows. BOOK and PART lines have depth 0, other headings
    and titled rows 1, titles without a folio 2 (folio null).
    """

    def fold(pdf):
        out, previous = [], False
        for page, body in pdf.sort_values("page_index")[["page_index", "body"]].itertuples(index=False):
            lines = _rows(body or "")
            rows = [(k, t, _ROW.match(t)) for k, t in lines]
            folios = [m for _, _, m in rows if m]
            dotted = sum(bool(re.search(r"[.·…]{2,}", m.group("lead"))) for m in folios)
            says = "contents" in plain(body)[:1000].lower()
            is_toc = (says and bool(folios)) or (len(folios) >= 5 and dotted >= max(3, len(folios) // 3)) or (previous and len(folios) >= 5)
            previous = is_toc
            if not is_toc:
                continue
            for kind, text, m in rows:
                if re.fullmatch(r"(?i)(?:table of )?contents", text):
                    continue
                if _GROUP.match(text):
                    folio = m.group("folio") if m else None
                    out.append((text if not m else m.group("title").rstrip(" .·…"), folio, 0, page))
                elif m:
                    out.append((m.group("title").rstrip(" .·…"), m.group("folio"), 1, page))
                elif kind == "head":
                    out.append((text, None, 1, page))
                elif len(text) <= 80 and re.search(r"[A-Za-z]{3}", text):
                    out.append((text, None, 2, page))
        book = pdf["book_id"].iloc[0]
        return pd.DataFrame([(book, k, t, f, d, p) for k, (t, f, d, p) in enumerate(out)], columns=["book_id", "entry_index", "title", "folio_text", "depth", "page_index"])

    first = pages.select("book_id", F.col("page_index").cast("long").alias("page_index"), "body").where(F.col("page_index") < limit)
    d = first.groupBy("book_id").applyInPandas(fold, "book_id string, entry_index long, title string, folio_text string, depth int, page_index long")
    tight = F.split("folio_text", "-")
    appendix = (F.ascii(F.element_at(tight, 1)) - 65 + 100) * 1000 + F.try_element_at(tight, F.lit(2)).cast("int")
    folio = F.when(F.col("folio_text").rlike("^[0-9]+$"), F.col("folio_text").cast("int")).when(F.col("folio_text").rlike("^[0-9]+-"), F.element_at(tight, 1).cast("int") * 1000 + F.try_element_at(tight, F.lit(2)).cast("int")).when(F.col("folio_text").rlike("^[A-Z]-"), appendix)
    return d.select("book_id", "entry_index", "title", folio.alias("folio"), "folio_text", "depth", "page_index")


def row_depths(toc: DataFrame) -> DataFrame:
    """toc with depths inferred from `(x)` prefixes: where three or more, but not all, rows of depth 2 have one, a row of
    depth 2 without it, whose next row is of depth 2 with it, is raised to depth 1."""
    b, w = Window.partitionBy("book_id"), Window.partitionBy("book_id").orderBy("entry_index")
    prefixed = F.col("title").rlike(r"^\([a-z0-9ivx]{1,4}\)")
    deep = F.col("depth") == 2
    d = toc.withColumn("pre_", prefixed & deep).withColumn("k_", F.count_if(F.col("pre_")).over(b)).withColumn("all_", F.count_if(deep).over(b)).withColumn("next_", F.coalesce(F.lead("pre_").over(w), F.lit(False)))
    raised = deep & ~F.col("pre_") & F.col("next_") & (F.col("k_") >= 3) & (F.col("k_") < F.col("all_"))
    return d.withColumn("depth", F.when(raised, 1).otherwise(F.col("depth"))).drop("pre_", "k_", "all_", "next_")


def place_entries(toc: DataFrame, folios: DataFrame, pages: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """toc with target_page and verified: where each entry's folio leads.

    The resolved page counts as verified if the title's words stand on it, or on the next, or on the previous one (in
    that order, without dropped pages). Verified or not, targets must not go back: beyond the longest non-decreasing run
    (and further runs of five or more) entries lose their target, if three or more were resolved.
    """
    texts = pages.select("book_id", F.col("page_index").cast("long").alias("page_index"), T.strip_tags(F.col("body")).alias("text_"))
    if dropped is not None:
        texts = texts.join(dropped.select("book_id", F.col("page_index").cast("long").alias("page_index")), ["book_id", "page_index"], "left_anti")
    ask = toc.select("book_id", F.col("folio").cast("long").alias("folio")).where("folio is not null").distinct()
    found = resolve_folios(ask, folios).withColumnRenamed("page_index", "at_")
    d = toc.drop("page_index").withColumn("folio", F.col("folio").cast("long")).join(found, ["book_id", "folio"], "left")
    tries = d.select("book_id", "entry_index", "title", F.posexplode(F.array("at_", F.col("at_") + 1, F.col("at_") - 1)).alias("rank_", "page_index"))
    named = tries.join(texts, ["book_id", "page_index"]).where(T.names_page(F.col("title"), F.col("text_"))).groupBy("book_id", "entry_index").agg(F.min_by("page_index", "rank_").alias("named_"))
    d = d.join(named, ["book_id", "entry_index"], "left").withColumn("target_page", F.coalesce("named_", "at_")).withColumn("verified", F.col("named_").isNotNull()).drop("named_", "at_")

    def guard(pdf):
        rows = pdf[pdf["target_page"].notna()].sort_values("entry_index")
        left, keep = rows, set()
        while len(left):
            run = longest_increasing(left["target_page"].tolist(), strict=False)
            if keep and len(run) < 5:
                break
            keep |= set(left.iloc[run]["entry_index"])
            left = left.drop(left.index[run])
        gone = set(rows["entry_index"]) - keep if len(rows) >= 3 else set()
        return pd.DataFrame({"book_id": pdf["book_id"].iloc[0], "entry_index": sorted(gone)})

    gone = d.select("book_id", "entry_index", "target_page").groupBy("book_id").applyInPandas(guard, "book_id string, entry_index long").withColumn("gone_", F.lit(True))
    d = d.join(gone, ["book_id", "entry_index"], "left")
    return d.withColumn("target_page", F.when(F.col("gone_").isNull(), F.col("target_page"))).withColumn("verified", F.col("verified") & F.col("gone_").isNull()).drop("gone_")


def hunt_titles(placed: DataFrame, pages: DataFrame, contents_pages: DataFrame | None = None) -> DataFrame:
    """placed with targets for entries without one: the first page after the last placed one whose first 300 characters name the title.

    Only the heads of pages enter the fold, never whole bodies.
    """
    heads = pages.select("book_id", F.col("page_index").cast("long").alias("page_index"), F.substring(T.norm_title(T.strip_tags(F.col("body"))), 1, 300).alias("head_"))
    if contents_pages is not None:
        heads = heads.join(contents_pages.select("book_id", F.col("page_index").cast("long").alias("page_index")).distinct(), ["book_id", "page_index"], "left_anti")
    per_book = heads.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "head_"))).alias("heads_"))
    rows = placed.withColumn("norm_", T.norm_title(F.col("title"))).join(per_book, "book_id", "left")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields)
    columns = placed.columns

    def fold(pdf):
        pdf = pdf.sort_values("entry_index").reset_index(drop=True)
        heads = [(h["page_index"], f" {h['head_']} ") for h in (pdf["heads_"].iloc[0] if pdf["heads_"].iloc[0] is not None else ())]
        reached, targets = -1, []
        for norm, target in zip(pdf["norm_"], pdf["target_page"], strict=True):
            if target is None or target != target:
                target = next((p for p, h in heads if p > reached and len(norm) > 6 and f" {norm} " in h), None)
            if target is not None:
                reached = max(reached, target)
            targets.append(target)
        pdf["target_page"] = pd.array(targets, "Int64")
        return pdf[columns]

    return rows.groupBy("book_id").applyInPandas(fold, schema)


def outline(heads: DataFrame) -> DataFrame:
    """(book_id, head_index, parent_index, title, page_index) from labelled heads (book_id, head_index, level, title, page_index).

    The highest rank is the top; deeper heads hang on the latest top head. A book needs four heads, three of them at the top.
    """
    b, w = Window.partitionBy("book_id"), Window.partitionBy("book_id").orderBy("head_index")
    d = heads.withColumn("top_", F.col("level") == F.min("level").over(b))
    d = d.withColumn("ok_", (F.count(F.lit(1)).over(b) >= 4) & (F.count_if(F.col("top_")).over(b) >= 3)).where("ok_")
    parent = F.when(~F.col("top_"), F.last(F.when(F.col("top_"), F.col("head_index")), ignorenulls=True).over(w))
    return d.select("book_id", "head_index", parent.alias("parent_index"), "title", "page_index")


def page_list(breaks: DataFrame) -> DataFrame:
    """(book_id, page_index, id, label) from elements (book_id, page_index, epub_type, id, text, aria_label, title).

    Only page breaks with an id count; the label is the first that is not blank of text, aria label, title and id.
    """
    some = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    d = breaks.where(F.array_contains(F.split(F.coalesce("epub_type", F.lit("")), r"\s+"), "pagebreak") & some("id").isNotNull())
    return d.select("book_id", "page_index", "id", F.coalesce(some("text"), some("aria_label"), some("title"), F.col("id")).alias("label"))


def normalise_entry_heads(pages: DataFrame) -> DataFrame:
    """The first entry head of a page (`#41. Name`), however set, as <h3 class="entry">."""

    def change(body: str) -> str:
        found = next(filter(None, (re.search(form, body, re.S) for form in ENTRY_FORMS)), None)
        return body if found is None else "".join([body[: found.start()], '<h3 class="entry">', found.group(1).strip(), "</h3>", body[found.end() :]])

    return rewrite(pages, change)
