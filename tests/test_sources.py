import io
import zipfile

import pytest

from quirespark.operators import assemble
from quirespark.sources import books, images, sinks


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("b", 0, "<p>one &amp; two</p>"), ("b", 11, "<p>twelve</p>")], "book_id string, page_index long, body string")
    nav = spark.createDataFrame([("b", 0, "A <b>", 11), ("b", 1, "lost", None)], "book_id string, entry_index long, title string, target_page long")
    content = bytes(books.archives(pages, nav).first().content)
    z = zipfile.ZipFile(io.BytesIO(content))
    assert z.namelist()[0] == "mimetype" and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED and b"A &lt;b&gt;" in z.read("OEBPS/nav.xhtml") and b"lost" not in z.read("OEBPS/nav.xhtml")
    (tmp_path / "b.epub").write_bytes(content)
    assert sorted(tuple(r) for r in books.read_archives(spark, str(tmp_path)).collect()) == [("b", 0, "<p>one &amp; two</p>"), ("b", 11, "<p>twelve</p>")]


def test_cache_serves_current_readings_only(spark, tmp_path):
    cache = books.ReadingCache(spark, str(tmp_path / "cache"), "plain-1")
    pages = spark.createDataFrame([("b", i, f"page {i}".encode()) for i in range(3)], "book_id string, page_index long, content binary")
    first = books.read_with_cache(cache, pages, books.load_reader("plain"))
    assert first.where("items is not null").count() == 3 and cache.missing(pages).count() == 0
    assert books.ReadingCache(spark, str(tmp_path / "cache"), "other").missing(pages).count() == 3
    old = spark.createDataFrame([("plain-1", "stale", 3, [])], books.CACHE_SCHEMA)
    old.write.mode("append").partitionBy("tag").parquet(str(tmp_path / "cache"))
    assert cache.current().count() == 3 and cache.current(serve_stale=True).count() == 4
    with pytest.raises(LookupError):
        books.load_reader("none such")


def test_images_are_ordered_by_name(spark, tmp_path):
    for name in ("b.JPG", "a.png", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.path[-5:] for r in images.image_files(spark, str(tmp_path)).orderBy("page_index").collect()] == ["a.png", "b.JPG"]
    with pytest.raises(FileNotFoundError):
        images.image_files(spark, str(tmp_path / "*.txt"))


def test_selectors_swaps_and_patches(spark):
    ids = spark.createDataFrame([(0, "r000p0"), (1, "r001p0"), (2, "r001p0")], "page_index long, page_id string")
    s = spark.createDataFrame([("2",), ("r001p0",), ("x",)], "token string")
    assert {r.token: r.page_index for r in images.resolve_selectors(s, ids).collect()} == {"2": 2, "r001p0": 1, "x": None}
    pages = spark.createDataFrame([("b", i, f"p{i}") for i in range(4)], "book_id string, page_index long, path string")
    swaps = spark.createDataFrame([("b", 0, 0, 1), ("b", 1, 1, 2), ("b", 2, 1, 9)], "book_id string, seq int, a long, b long")
    assert [r.path for r in images.swap_pages(pages, swaps).orderBy("page_index").collect()] == ["p1", "p2", "p0", "p3"]
    patches = spark.createDataFrame([("b", 1, "x", 2.0, 0), ("b", 1, "y", 2.0, 5), ("b", 2, "z", None, 0)], "book_id string, page_index long, path string, score double, frame_idx long")
    assert [r.path for r in images.apply_patches(pages, patches).orderBy("page_index").collect()] == ["p0", "y", "p2", "p3"]
    spec = spark.createDataFrame([('{"3": "a.mp4"}',), ("r001p0=b.png, 2=c.png",)], "spec string")
    assert sorted(tuple(r) for r in images.parse_patches(spec).collect()) == [("2", "c.png"), ("3", "a.mp4"), ("r001p0", "b.png")]


def test_progress_keeps_log_lines(spark):
    d = spark.createDataFrame([('{"event":"result","epub":"x.epub"}',), ("warming up",)], "value string")
    got = sinks.progress_events(d).collect()
    assert (got[0].event, got[0].epub, got[1].event, got[1].message) == ("result", "x.epub", None, "warming up")


def test_a_book_is_assembled(spark):
    rows = []
    for p in range(6):
        text = " ".join(f"w{p}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
        rows += [("b", p, 0, f"Chapter 1 - {p + 10}", True), ("b", p, 1, f"<p>{text}.<sup>{p + 1}</sup></p>" if p < 4 else "<h1>Notes</h1>" + "".join(f"<p><sup>{n}</sup> note {n}</p>" for n in range(1, 5)) if p == 4 else "<p></p>", False)]
    items = spark.createDataFrame([(b, p, i, h, False, False, f, None) for b, p, i, h, f in rows], "book_id string, page_index long, item_index long, html string, is_figure boolean, is_caption boolean, is_furniture boolean, label string")
    out = assemble.assemble(items)
    assert sorted(r.page_index for r in out["dropped"].collect()) == [5]
    pages = {r.page_index: r.body for r in out["pages"].collect()}
    assert "page_0005.xhtml#note-1-2" in pages[1] and 'id="note-1-2"' in pages[4]
    assert [(r.page_index, r.number) for r in out["folios"].orderBy("page_index").collect()][:2] == [(0, 10), (1, 11)]
