"""Books as archives of page files, page maps, reading caches, recogniser tables and registered readers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_VERSION = 4
_PAGE = re.compile(r"(?:^|/)page_(\d{4,})\.xhtml$")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, page_index, body): page files of every archive under path; book_id is the file's stem, pages count from 0."""
    files = spark.read.format("binaryFile").load(path)

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                book, rows = re.sub(r"^.*/|\.[^.]*$", "", name), []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for entry in z.namelist():
                        if m := _PAGE.search(entry):
                            text = z.read(entry).decode("utf-8", "replace")
                            body = re.search(r"(?s)<body[^>]*>(.*)</body>", text)
                            rows.append((book, int(m.group(1)) - 1, (body.group(1) if body else text).strip()))
                yield pd.DataFrame(sorted(rows, key=lambda r: r[1]), columns=["book_id", "page_index", "body"])

    return files.select("path", "content").mapInPandas(unzip, "book_id string, page_index long, body string")


def archives(pages: DataFrame, nav: DataFrame | None = None) -> DataFrame:
    """(book_id, content): each book as one archive; the media type comes first and is stored, not deflated.

    nav: book_id, entry_index, title, target_page. Entries without a target are left out.
    """
    body = pages.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("page_index", F.coalesce("body", F.lit("")).alias("body")))).alias("pages_"))
    if nav is not None:
        entries = nav.where("target_page is not null").groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("entry_index", "title", "target_page"))).alias("nav_"))
        body = body.join(entries, "book_id", "left")
    else:
        body = body.withColumn("nav_", F.lit(None).cast("array<struct<entry_index:bigint,title:string,target_page:bigint>>"))

    @F.pandas_udf("binary")
    def pack(book: pd.Series, pages: pd.Series, nav: pd.Series) -> pd.Series:
        return pd.Series([archive(b, [(int(p["page_index"]), p["body"]) for p in ps], [(e["title"], int(e["target_page"])) for e in es] if es is not None else []) for b, ps, es in zip(book, pages, nav, strict=True)])

    return body.select("book_id", pack("book_id", "pages_", "nav_").alias("content"))


def archive(book: str, pages: list[tuple[int, str]], nav: list[tuple[str, int]]) -> bytes:
    head = '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">'
    name = lambda k: f"page_{k + 1:04d}.xhtml"
    links = nav or [(f"Page {k + 1}", k) for k, _ in pages]
    items = "".join(f'<item id="p{k}" href="{name(k)}" media-type="application/xhtml+xml"/>' for k, _ in pages)
    files = {
        "META-INF/container.xml": '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
        "OEBPS/content.opf": f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(book)}</dc:identifier><dc:title>{escape(book)}</dc:title><dc:language>en</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{"".join(f"<itemref idref={chr(34)}p{k}{chr(34)}/>" for k, _ in pages)}</spine></package>',
        "OEBPS/nav.xhtml": f'{head}<body><nav epub:type="toc"><ol>{"".join(f"<li><a href={chr(34)}{name(k)}{chr(34)}>{escape(t)}</a></li>" for t, k in links)}</ol></nav></body></html>',
    } | {f"OEBPS/{name(k)}": f"{head}<body>\n{b}\n</body></html>" for k, b in pages}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype", (1980, 1, 1, 0, 0, 0)), "application/epub+zip", zipfile.ZIP_STORED)
        for path, text in files.items():
            z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def read_page_map(spark: SparkSession, path: str) -> DataFrame:
    """(page_index, page_id) from JSON lines or an array of such rows."""
    return spark.read.schema("page_index long, page_id string").option("multiLine", True).json(path)


def read_word_table(spark: SparkSession, path: str) -> DataFrame:
    """Recogniser rows of tab-separated files with twelve columns and a header line; confidence may be -1."""
    schema = "level int, page int, block int, par int, line int, word int, x int, y int, w int, h int, conf double, text string"
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(path)


def word_boxes(words: DataFrame, least: float = 30.0) -> DataFrame:
    """Word rows (level 5) with text and a confidence of at least `least`."""
    return words.where((F.col("level") == 5) & (F.col("conf") >= least) & (F.trim("text") != ""))


CACHE_SCHEMA = "tag string, content_sha string, v int, items array<struct<html:string,cap:boolean,furn:boolean,conf:double,lab:string>>"


class ReadingCache:
    """Readings by content hash, as Parquet partitioned by tag. New versions are appended; the latest one of a page counts."""

    def __init__(self, spark: SparkSession, path: str, tag: str):
        self.spark, self.path, self.tag = spark, path, tag

    def table(self) -> DataFrame:
        try:
            t = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], CACHE_SCHEMA)
        return t.where(F.col("tag") == self.tag)

    def current(self, serve_stale: bool = False) -> DataFrame:
        """(content_sha, v, items); entries before CACHE_VERSION are misses unless stale ones are served."""
        t = self.table().withColumn("v", F.coalesce("v", F.lit(0)))
        t = t if serve_stale else t.where(F.col("v") >= CACHE_VERSION)
        return t.groupBy("content_sha").agg(F.max("v").alias("v"), F.max_by("items", "v").alias("items"))

    def missing(self, pages: DataFrame, serve_stale: bool = False) -> DataFrame:
        """pages (content) that have to be read."""
        return pages.withColumn("content_sha", F.sha2("content", 256)).join(self.current(serve_stale).select("content_sha"), "content_sha", "left_anti")

    def put(self, read: DataFrame) -> None:
        """Adds (content_sha, items)."""
        read.select(F.lit(self.tag).alias("tag"), "content_sha", F.lit(CACHE_VERSION).alias("v"), "items").write.mode("append").partitionBy("tag").parquet(self.path)


Reader = Callable[[DataFrame], DataFrame]
READERS: dict[str, Reader] = {}


def register_reader(name: str) -> Callable[[Reader], Reader]:
    """Registers a function from pages (book_id, page_index, content) to items as a reader: a recogniser lives outside this library."""

    def add(reader: Reader) -> Reader:
        READERS[name] = reader
        return reader

    return add


def load_reader(name: str) -> Reader:
    if name not in READERS:
        raise LookupError(f"no reader {name!r}; known: {', '.join(sorted(READERS)) or 'none'}")
    return READERS[name]


@register_reader("plain")
def plain_reader(pages: DataFrame) -> DataFrame:
    """Pages whose content is UTF-8 text: one paragraph item a page."""
    text = F.decode("content", "UTF-8")
    return pages.select("book_id", "page_index", F.lit(0).cast("long").alias("item_index"), F.concat(F.lit("<p>"), text, F.lit("</p>")).alias("html"), F.lit(False).alias("is_figure"), F.lit(False).alias("is_caption"), F.lit(False).alias("is_furniture"), F.lit(None).cast("string").alias("label"))


def read_with_cache(cache: ReadingCache, pages: DataFrame, reader: Reader) -> DataFrame:
    """(book_id, page_index, content_sha, items): cached readings, and new ones for the pages without."""
    keyed = pages.withColumn("content_sha", F.sha2("content", 256))
    todo = cache.missing(pages).dropDuplicates(["content_sha"])
    items = reader(todo).join(todo.select("book_id", "page_index", "content_sha"), ["book_id", "page_index"])
    entry = F.struct(F.col("html"), F.col("is_caption").alias("cap"), F.col("is_furniture").alias("furn"), F.lit(None).cast("double").alias("conf"), F.col("label").alias("lab"))
    new = items.groupBy("content_sha").agg(F.array_sort(F.collect_list(F.struct("item_index", entry.alias("e")))).alias("l")).select("content_sha", F.transform("l", lambda x: x["e"]).alias("items"))
    cache.put(new)
    return keyed.join(cache.current().select("content_sha", "items"), "content_sha", "left").select("book_id", "page_index", "content_sha", "items")
