"""Page items and their geometry. Tables: items(book_id, page_index, item_index, html, is_figure, is_caption, is_furniture, box, conf,
label), blocks(book_id, page_index, block_index, label, box), figures(book_id, page_index, name, pixels)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as T

PAGE = ("book_id", "page_index")


def _page_window():
    return Window.partitionBy(*PAGE).orderBy("item_index")


def split_furniture(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(body items, furniture lines as book_id, page_index, pos, text)."""
    lines = items.where("is_furniture").select(*PAGE, F.col("item_index").alias("pos"), T.strip_tags(F.col("html")).alias("text"))
    return items.where("not coalesce(is_furniture, false)"), lines


def is_running_head(text: Column) -> Column:
    """A short line that begins with a number and a separator, is a bare number, or ends with a separator and a number."""
    return (F.length(text) > 0) & (F.length(text) <= 60) & (text.rlike(r"^\s*(?:[0-9]{1,3}\s*[•·|:]|[0-9]{1,3}\s*$)") | text.rlike(r"[•·|:]\s*[0-9]{1,3}\s*$"))


def strip_running_heads(items: DataFrame) -> DataFrame:
    """items without the running heads and feet at either end of a page; the first item that is none ends the search."""
    head = ~F.coalesce("is_figure", F.lit(False)) & ~F.coalesce("is_caption", F.lit(False)) & is_running_head(T.strip_tags(F.col("html")))
    d = items.withColumn("h_", head.cast("int"))
    down = F.min("h_").over(_page_window().rowsBetween(Window.unboundedPreceding, 0))
    up = F.min("h_").over(_page_window().rowsBetween(0, Window.unboundedFollowing))
    return d.withColumn("gone_", F.greatest(down, up)).where("gone_ = 0").drop("h_", "gone_")


def read_order(lines: DataFrame) -> DataFrame:
    """(book_id, page_index, text): lines (x, y, text) by rows of ten units and then by x; half rows round to even."""
    key = F.struct(F.bround(F.col("y") / 10), "x", "text")
    return lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(key)).alias("l")).select(*PAGE, F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def blocks_to_items(blocks: DataFrame) -> DataFrame:
    """Recogniser blocks (book_id, page_index, reading_order, html, label, skipped, error, ...) to items in reading order."""
    kept = blocks.where("not coalesce(skipped, false) and not coalesce(error, false)")
    index = F.row_number().over(Window.partitionBy(*PAGE).orderBy("reading_order")) - 1
    furniture = F.col("label").isin("PageHeader", "PageFooter", "Page-header", "Page-footer")
    return kept.select(*PAGE, index.cast("long").alias("item_index"), "html", F.col("label").isin("Picture", "Figure").alias("is_figure"), (F.col("label") == "Caption").alias("is_caption"), furniture.alias("is_furniture"), "box", "conf", "label")


def page_text(items: DataFrame) -> DataFrame:
    """(book_id, page_index, text): words of a page's items in order, furniture left out."""
    body = items.where("not coalesce(is_furniture, false)")
    g = body.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("item_index", T.strip_tags(F.col("html")).alias("t")))).alias("l"))
    return g.select(*PAGE, F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("text"))


def assemble_bodies(items: DataFrame) -> DataFrame:
    """(book_id, page_index, body): items in order, one to a line. The first Footnote gets an <hr/> before it, unless the page
    has one; formulas are displayed as blocks."""
    first = F.min(F.when(F.col("label") == "Footnote", F.col("item_index"))).over(Window.partitionBy(*PAGE))
    ruled = F.max(F.coalesce(F.col("html").rlike(r"<hr\s*/?>"), F.lit(False))).over(Window.partitionBy(*PAGE))
    html = F.when(F.col("label") == "Formula", F.regexp_replace("html", r"<math(?![^>]*\bdisplay=)", '<math display="block"')).otherwise(F.col("html"))
    d = items.where("not coalesce(is_furniture, false)").withColumn("h_", F.when((F.col("item_index") == first) & ~ruled, F.concat(F.lit("<hr/>"), html)).otherwise(html))
    g = d.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("item_index", F.coalesce("h_", F.lit("")).alias("h")))).alias("l"))
    return g.select(*PAGE, F.array_join(F.transform("l", lambda x: x["h"]), "\n").alias("body"))


def pair_captions(items: DataFrame) -> DataFrame:
    """items with figure_of: for a caption, the item_index of the figure it belongs to.

    Going down a page, a caption takes the figure right after it, else the figure right before it, if that is free.
    """

    def fold(pdf):
        pdf = pdf.sort_values("item_index").reset_index(drop=True)
        index, figure, caption = pdf["item_index"].tolist(), pdf["is_figure"].fillna(False).tolist(), pdf["is_caption"].fillna(False).tolist()
        used, out = set(), [None] * len(pdf)
        for k in range(len(pdf)):
            if caption[k]:
                spot = next((j for j in (k + 1, k - 1) if 0 <= j < len(pdf) and figure[j] and j not in used), None)
                if spot is not None:
                    used.add(spot)
                    out[k] = index[spot]
        pdf["figure_of"] = pd.array(out, "Int64")
        return pdf[["book_id", "page_index", "item_index", "figure_of"]]

    slim = items.select(*PAGE, F.col("item_index").cast("long").alias("item_index"), "is_figure", "is_caption")
    found = slim.groupBy(*PAGE).applyInPandas(fold, "book_id string, page_index long, item_index long, figure_of long")
    return items.join(found, [*PAGE, "item_index"])


def overlaps(items: DataFrame, blocks: DataFrame, least: float) -> DataFrame:
    """(book_id, page_index, item_index, block_index, iou): pairs of a page that overlap; an equi-join on the page."""
    j = items.select(*PAGE, "item_index", F.col("box").alias("a")).join(blocks.select(*PAGE, "block_index", F.col("box").alias("b")), list(PAGE))
    return j.withColumn("iou", G.iou(F.col("a"), F.col("b"))).where(F.col("iou") >= least).select(*PAGE, "item_index", "block_index", "iou")


def match_labels(items: DataFrame, blocks: DataFrame, least: float = 0.5) -> DataFrame:
    """items with labels from layout blocks: one to one, the highest IoU first (ties: block, then item)."""

    def greedy(pdf):
        pdf = pdf.sort_values(["iou", "block_index", "item_index"], ascending=[False, True, True])
        items, blocks, keep = set(), set(), []
        for i, b in zip(pdf["item_index"], pdf["block_index"], strict=True):
            keep.append(i not in items and b not in blocks)
            if keep[-1]:
                items.add(i)
                blocks.add(b)
        return pdf[keep][["book_id", "page_index", "item_index", "block_index"]]

    pairs = overlaps(items, blocks, least).select(*PAGE, F.col("item_index").cast("long"), F.col("block_index").cast("long"), "iou")
    m = pairs.groupBy(*PAGE).applyInPandas(greedy, "book_id string, page_index long, item_index long, block_index long")
    named = m.join(blocks.select(*PAGE, F.col("block_index").cast("long").alias("block_index"), F.col("label").alias("label_")), [*PAGE, "block_index"]).drop("block_index")
    return items.join(named, [*PAGE, "item_index"], "left").withColumn("label", F.coalesce("label_", "label")).drop("label_")


def orphan_artwork(images: DataFrame, figures: DataFrame, *, least: float = 0.02, most: float = 0.9, known: float = 0.3) -> DataFrame:
    """Embedded images (book_id, page_index, image_index, box) of middling area that no emitted figure overlaps."""
    a = G.area(F.col("box"))
    some = images.where((a >= least) & (a <= most))
    hit = some.alias("i").join(figures.select(*PAGE, F.col("box").alias("f")).alias("f"), list(PAGE)).where(G.iou(F.col("box"), F.col("f")) >= known).select(*PAGE, "image_index").distinct()
    return some.join(hit, [*PAGE, "image_index"], "left_anti")


def better_figures(figures: DataFrame, images: DataFrame, least: float = 0.6) -> DataFrame:
    """(book_id, page_index, name, image_index, iou): the embedded image that best covers each figure; the lower index on ties."""
    j = figures.select(*PAGE, "name", F.col("box").alias("f")).join(images.select(*PAGE, "image_index", F.col("box").alias("b")), list(PAGE)).withColumn("iou", G.iou(F.col("f"), F.col("b"))).where(F.col("iou") >= least)
    return j.groupBy(*PAGE, "name").agg(F.max(F.struct("iou", -F.col("image_index"))).alias("m")).select(*PAGE, "name", (-F.col("m.col2")).alias("image_index"), "m.iou")


def ruled_boxes(rectangles: DataFrame, claimed: DataFrame) -> DataFrame:
    """Measured rectangles (box, corners, side_ink array, inner_ink, box_index) that are boxes of text: area .015 to .35, aspect
    .25 to 6, four corners, every side inked to .3, inside at most .2, no overlap with claimed boxes, not inside another."""
    w, h = F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0")
    a = G.area(F.col("box"))
    d = rectangles.where((a >= 0.015) & (a <= 0.35) & (w / h >= 0.25) & (w / h <= 6) & (F.col("corners") == 4) & (F.array_min("side_ink") >= 0.3) & (F.col("inner_ink") <= 0.2))
    meets = d.join(claimed.select(*PAGE, F.col("box").alias("c")), list(PAGE)).where(G.iou(F.col("box"), F.col("c")) > 0).select(*PAGE, "box_index").distinct()
    d = d.join(meets, [*PAGE, "box_index"], "left_anti")
    o = d.select(*PAGE, F.col("box").alias("o"), F.col("box_index").alias("other"))
    inside = (F.col("box.x0") >= F.col("o.x0")) & (F.col("box.y0") >= F.col("o.y0")) & (F.col("box.x1") <= F.col("o.x1")) & (F.col("box.y1") <= F.col("o.y1")) & (F.col("box_index") != F.col("other"))
    return d.join(d.join(o, list(PAGE)).where(inside).select(*PAGE, "box_index").distinct(), [*PAGE, "box_index"], "left_anti")


def cluster_paths(paths: DataFrame, gap: float = 8.0, least: int = 15) -> DataFrame:
    """(book_id, page_index, members, box): clusters of vector paths (box in points) within `gap` of each other, of `least` members.

    Rules over 80 % of the page's width and under 3 points high are left out. paths: page_w, box.
    """

    def join_boxes(pdf):
        rows = [(b["x0"], b["y0"], b["x1"], b["y1"]) for b, w in zip(pdf["box"], pdf["page_w"], strict=True) if not (b["x1"] - b["x0"] > 0.8 * w and b["y1"] - b["y0"] < 3)]
        root = list(range(len(rows)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        by_x = sorted(range(len(rows)), key=lambda i: rows[i][0])
        for k, i in enumerate(by_x):
            for j in by_x[k + 1 :]:
                if rows[j][0] > rows[i][2] + gap:
                    break
                if rows[j][1] <= rows[i][3] + gap and rows[i][1] <= rows[j][3] + gap:
                    root[find(i)] = find(j)
        groups = {}
        for i in range(len(rows)):
            groups.setdefault(find(i), []).append(rows[i])
        out = [(pdf["book_id"].iloc[0], pdf["page_index"].iloc[0], len(g), {"x0": min(b[0] for b in g), "y0": min(b[1] for b in g), "x1": max(b[2] for b in g), "y1": max(b[3] for b in g)}) for g in groups.values() if len(g) >= least]
        return pd.DataFrame(sorted(out, key=lambda r: (r[3]["y0"], r[3]["x0"])), columns=["book_id", "page_index", "members", "box"])

    return paths.select(*PAGE, "box", "page_w").groupBy(*PAGE).applyInPandas(join_boxes, "book_id string, page_index long, members long, box struct<x0:double,y0:double,x1:double,y1:double>")


def signature(pixels: Column) -> Column:
    """0/1 string: which pixels lie above the mean; null for an empty or flat picture."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(pixels)
    bits = T.let(mean, lambda m: F.array_join(F.transform(pixels, lambda x: F.when(x.cast("double") > m, "1").otherwise("0")), ""))
    return F.when((F.size(pixels) > 0) & bits.contains("1"), bits)


def image_furniture(figures: DataFrame, least: int = 3) -> DataFrame:
    """(book_id, sig, names, pages): signatures with `least` names on `least` pages: artwork that furnishes the book."""
    d = figures.withColumn("sig", signature(F.col("pixels"))).where("sig is not null")
    return d.groupBy("book_id", "sig").agg(F.countDistinct("name").alias("names"), F.countDistinct("page_index").alias("pages")).where((F.col("names") >= least) & (F.col("pages") >= least))


def same_picture(a: Column, b: Column, least: float = 0.85) -> Column:
    """Whether two pixel arrays of one length have a Pearson correlation of at least `least`."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(x)
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    centred = lambda x: T.let(mean(x), lambda m: F.transform(x, lambda v: v.cast("double") - m))
    return T.let(centred(a), lambda x: T.let(centred(b), lambda y: F.coalesce(total(x, y) / F.nullif(F.sqrt(total(x, x) * total(y, y)), F.lit(0.0)) >= least, F.lit(False))))


def smaller_encoding(figures: DataFrame) -> DataFrame:
    """(book_id, page_index, name, format): the smaller of png_size and jpeg_size; PNG on ties."""
    best = F.least(F.struct(F.col("png_size").alias("n"), F.lit(0).alias("p"), F.lit("png").alias("f")), F.struct(F.col("jpeg_size").alias("n"), F.lit(1).alias("p"), F.lit("jpeg").alias("f")))
    return figures.select(*PAGE, "name", best["f"].alias("format"))


def reattach_markers(items: DataFrame, furniture_numbers: DataFrame | None = None, *, most_height: float = 0.03) -> DataFrame:
    """(book_id, page_index, item_index, n, action): blocks that hold only digits, no higher than most_height.

    `attach` if the number is the last marker plus 1, or 1 before an inline 2, and the prose before has eight words; else
    `suppress`. The last marker is the highest inline marker so far and carries over to the next page. Numbers that are
    a page's furniture are left alone.
    """
    t = T.strip_tags(F.col("html"))
    inline = F.transform(F.regexp_extract_all("html", F.lit(r"<sup>\s*([0-9]{1,3})\s*</sup>"), F.lit(1)), lambda x: x.cast("int"))
    lone = F.when(t.rlike("^[0-9]{1,3}$") & (F.col("box.y1") - F.col("box.y0") <= most_height), t.cast("int"))
    d = items.where("not coalesce(is_furniture, false)").select("book_id", F.col("page_index").cast("long").alias("page_index"), F.col("item_index").cast("long").alias("item_index"), lone.alias("n"), inline.alias("inline"), F.size(F.array_remove(F.split(t, r"\s+"), "")).alias("words"))
    if furniture_numbers is not None:
        f = furniture_numbers.select("book_id", F.col("page_index").cast("long").alias("page_index"), F.col("number").cast("int").alias("n")).distinct().withColumn("f_", F.lit(True))
        d = d.join(f, ["book_id", "page_index", "n"], "left").withColumn("n", F.when(F.col("f_").isNull(), F.col("n"))).drop("f_")

    def fold(pdf):
        pdf = pdf.sort_values(["page_index", "item_index"]).reset_index(drop=True)
        last, before, out = 0, 0, []
        ahead = [list(x) for x in pdf["inline"]]
        for k, (page, item, n, words) in enumerate(zip(pdf["page_index"], pdf["item_index"], pdf["n"], pdf["words"], strict=True)):
            if n is not None and n == n:
                coming = next((x[0] for x in ahead[k + 1 :] if x), None)
                fits = (n == last + 1 or (n == 1 and coming == 2)) and before >= 8
                out.append((pdf["book_id"].iloc[0], page, item, int(n), "attach" if fits else "suppress"))
                last = int(n) if fits else last
                continue
            last, before = max([last, *ahead[k]]), words
        return pd.DataFrame(out, columns=["book_id", "page_index", "item_index", "n", "action"])

    return d.select("book_id", "page_index", "item_index", "n", "inline", "words").groupBy("book_id").applyInPandas(fold, "book_id string, page_index long, item_index long, n int, action string")


def word_placement(words: DataFrame, witness: DataFrame, reach: float = 20.0) -> DataFrame:
    """(book_id, page_index, block_index, word_index, word, rect, anchored, font): a rectangle for every word of every block.

    In reading order a word takes the first unused witness box of the same letters whose centre is in its block, give or
    take `reach`; words between anchors share the gap by length, on the block's line where there is no anchor. The font
    size is the smaller of 0.9 of the height and the one that fills the area. No word is left out.
    words: block box `box`; witness: tok, box.
    """

    def fold(pdf):
        out = []
        norm = lambda w: re.sub(r"\W+", "", w).lower()
        spots = pdf["boxes"].iloc[0]
        free = [(norm(s["tok"]), s["box"]) for s in (spots if spots is not None else ())]
        used = [False] * len(free)
        for block, rows in pdf.sort_values(["block_index", "word_index"]).groupby("block_index"):
            box, placed = rows["box"].iloc[0], []
            for word in rows["word"]:
                hit = None
                for k, (t, b) in enumerate(free):
                    x, y = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
                    if not used[k] and t and t == norm(word) and box["x0"] - reach <= x <= box["x1"] + reach and box["y0"] - reach <= y <= box["y1"] + reach:
                        used[k], hit = True, b
                        break
                placed.append((hit["x0"], hit["y0"], hit["x1"], hit["y1"]) if hit is not None else None)
            texts, k = rows["word"].tolist(), 0
            anchored = [p is not None for p in placed]
            while k < len(placed):
                if placed[k] is None:
                    stop = k
                    while stop < len(placed) and placed[stop] is None:
                        stop += 1
                    left = placed[k - 1] if k else None
                    right = placed[stop] if stop < len(placed) else None
                    y0, y1 = (left or right or (0, box["y0"], 0, box["y1"]))[1::2]
                    x0, x1 = left[2] if left else box["x0"], right[0] if right else box["x1"]
                    if x1 <= x0:
                        x1 = max(box["x1"], x0 + 1)
                    total, at = sum(len(w) + 1 for w in texts[k:stop]), x0
                    for j in range(k, stop):
                        step = (x1 - x0) * (len(texts[j]) + 1) / total
                        placed[j] = (at, y0, at + step, y1)
                        at += step
                    k = stop
                k += 1
            for j, (w, p) in enumerate(zip(texts, placed, strict=True)):
                size = ((p[2] - p[0]) * (p[3] - p[1]) / (0.62 * max(len(w), 1))) ** 0.5
                out.append((pdf["book_id"].iloc[0], pdf["page_index"].iloc[0], block, j, w, dict(zip(("x0", "y0", "x1", "y1"), p, strict=True)), anchored[j], min(0.9 * (p[3] - p[1]), size)))
        return pd.DataFrame(out, columns=["book_id", "page_index", "block_index", "word_index", "word", "rect", "anchored", "font"])

    spots = witness.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("tok_index", "tok", "box"))).alias("boxes"))
    rows = words.select("book_id", F.col("page_index").cast("long").alias("page_index"), F.col("block_index").cast("long").alias("block_index"), "word_index", "word", "box").join(spots, list(PAGE), "left")
    return rows.groupBy(*PAGE).applyInPandas(fold, "book_id string, page_index long, block_index long, word_index long, word string, rect struct<x0:double,y0:double,x1:double,y1:double>, anchored boolean, font double")
