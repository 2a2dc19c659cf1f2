import pytest

from quirespark.operators import adjudicate as A
from quirespark.operators import verify as V


def test_equal_runs_are_disputes_and_seams_are_not():
    pairs, seams = A.align_pair("the quick brown fox".split(), "the quick brovvn fox".split())
    assert pairs == [(2, "brown", "brovvn")] and seams == 0
    pairs, seams = A.align_pair("a one two three z".split(), "a elephants giraffes antelopes z".split())
    assert pairs == [] and seams == 3
    assert A.align_pair("a b c".split(), "a x y c".split()) == ([], 0)


def judged(spark, pairs, words=(), dictionary=(), **options):
    p = spark.createDataFrame([("b", 0, i, x, y) for i, (x, y) in enumerate(pairs)], "book_id string, page_index long, seq long, ours string, theirs string")
    w = spark.createDataFrame([("b", k, n) for k, n in words], "book_id string, word string, n long")
    d = spark.createDataFrame([(x,) for x in dictionary], "word string")
    return A.judge(p, w, d, **options), d


def test_the_ladder_stops_at_the_first_rung(spark):
    j, d = judged(spark, [("reëntry", "reentry"), ("XIV", "XIX"), ("modem", "modern"), ("prisoners", "prisonets"), ("ff", "of"), ("qq", "zz")], [("modern", 3)], ["prisoner", "of"])
    got = {r.seq: (r.rung, r.winner) for r in j.collect()}
    assert got == {0: ("fold", "reëntry"), 1: ("roman", None), 2: ("lexicon", "modern"), 3: ("dictionary", "prisoners"), 4: ("abstain", None), 5: ("abstain", None)}
    vision = spark.createDataFrame([("b", 0, "ZZ")], "book_id string, page_index long, word string")
    p = j.drop("rung", "winner")
    again = A.judge(p, spark.createDataFrame([("b", "modern", 3)], "book_id string, word string, n long"), d, vision=vision)
    assert {r.seq: (r.rung, r.winner) for r in again.collect()}[5] == ("vision", "zz")
    assert {r.tier for r in A.tiers(j, d).where("seq = 5").collect()} == {"broken"}


def test_tiers_and_occurrences(spark):
    j, d = judged(spark, [("aa", "bb")] * 4 + [("cat", "cut"), ("modem", "modern")], [("modern", 5)], ["cat", "cut"])
    got = A.tiers(j, d).orderBy("seq").collect()
    assert [(r.tier, r.occurrence) for r in got] == [("systematic", 0), ("systematic", 1), ("systematic", 2), ("systematic", 3), ("open", 0), ("catches", 0)]


@pytest.mark.parametrize(
    ("body", "k", "old", "new", "want"),
    [
        ("<p>cat cat</p>", 1, "cat", "cut", "<p>cat cut</p>"),
        ('<p class="cat">concat cat</p>', 0, "cat", "dog", '<p class="cat">concat dog</p>'),
        ("<p>don’t</p>", 0, "don't", "won't", "<p>won’t</p>"),
        ("<p>Cat</p>", 0, "cat", "dog", None),
        ("<p>cat</p>", 1, "cat", "dog", None),
    ],
)
def test_replace_occurrence(body, k, old, new, want):
    assert A.replace_occurrence(body, k, old, new) == want


def test_decisions_apply_from_the_back_and_refuse_other_books(spark):
    pages = spark.createDataFrame([("b", 0, "<p>cat cat cat</p>"), ("b", 1, "<p>dog</p>")], "book_id string, page_index long, body string")
    d = spark.createDataFrame([("b", "0", 0, "cat", "bat"), ("b", "0", 2, "cat", "hat"), ("b", "x", 0, "cat", "hat"), ("b", "1", 3, "dog", "fog")], "book_id string, page string, occurrence int, old string, new string")
    got = A.apply_decisions(pages, d).orderBy("page_index").collect()
    assert [(r.body, r.applied, r.stale) for r in got] == [("<p>bat cat hat</p>", 2, 0), ("<p>dog</p>", 0, 1)]
    assert [r.applied for r in A.apply_decisions(pages, d, page_files=3).collect()] == [0, 0]


def test_witness_words_join_over_line_ends(spark):
    rows = [("b", 0, 5, 1, 1, 1, 1, 10, 10, 50, 10, 90.0, "in-"), ("b", 0, 5, 1, 1, 2, 1, 10, 22, 40, 10, 90.0, "ner"), ("b", 0, 5, 1, 1, 2, 2, 60, 22, 40, 10, 90.0, "voice"), ("b", 0, 4, 1, 1, 2, 0, 0, 0, 9, 9, -1.0, "")]
    t = spark.createDataFrame(rows, "book_id string, page_index long, level int, block int, par int, line int, word int, x int, y int, w int, h int, conf double, text string")
    got = A.witness_tokens(t).orderBy("tok_index").collect()
    assert [r.tok for r in got] == ["inner", "voice"] and tuple(got[0].box) == (10, 10, 60, 32) and tuple(got[0].crop) == (10, 10, 60, 32)


def test_page_turn_words_are_stitched(spark):
    d = spark.createDataFrame([("b", 0, ["the", "mag-"], "magnet"), ("b", 1, [], None), ("b", 2, ["12", "net", "pulls"], "pulls")], "book_id string, page_index long, toks array<string>, shipped_last string")
    assert [r.toks for r in A.stitch_page_turns(d).orderBy("page_index").collect()] == [["the", "magnet"], [], ["12", "pulls"]]


def test_calibration_pivot(spark):
    j, _ = judged(spark, [("modem", "modern"), ("qq", "zz")], [("modern", 3)])
    truth = spark.createDataFrame([("b", 0, "modern"), ("b", 0, "qq")], "book_id string, page_index long, word string")
    got = {r.rung: (r.right, r.wrong, r.settleable) for r in A.calibrate({0: j}, truth).collect()}
    assert got == {"lexicon": (1, 0, 0), "abstain": (0, 0, 1)}


def pages(spark, texts):
    return spark.createDataFrame([("b", i, t) for i, t in enumerate(texts)], "book_id string, page_index long, text string")


def test_holes_and_rescans(spark):
    full = [" ".join(f"{chr(97 + k)}word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)) for k in range(4)]
    ours = pages(spark, [full[0], "", full[2], ""])
    source = pages(spark, [full[0], full[1], full[2], full[2]])
    found = {r.page_index: r.status for r in V.holes(ours, source).collect()}
    assert found == {1: "hole", 3: "rescanned"}
    assert V.verdict(ours, source, V.holes(ours, source)).first().exit_code == 1


def test_duels(spark):
    got = {(r.kind, r.ours, r.source) for r in V.compare(pages(spark, ["inner modem light"]), pages(spark, ["in ner modern dark"])).collect()}
    assert got == {("hyphen", "inner", "in ner"), ("duel", "modem", "modern"), ("surplus", "light", None), ("surplus", None, "dark")}


def test_scan_vote(spark):
    d = spark.createDataFrame([("s", i, 0.95) for i in range(7)] + [("n", i, 0.95) for i in range(6)] + [("n", 20, 1.0)], "book_id string, page_index long, share double")
    assert {r.book_id: r.scan for r in V.is_scan(d).collect()} == {"s": True, "n": False}


def test_only_fragments_with_a_hyphen_are_stitched(spark):
    rows = [("b", 0, ["went", "in"], "into"), ("b", 1, ["to", "town"], None), ("c", 0, ["a", "mag-"], "magnet"), ("c", 1, ["9", "net", "x"], None), ("d", 0, ["--"], "x"), ("d", 1, ["x"], None)]
    d = spark.createDataFrame(rows, "book_id string, page_index long, toks array<string>, shipped_last string")
    got = {(r.book_id, r.page_index): r.toks for r in A.stitch_page_turns(d).collect()}
    assert got == {("b", 0): ["went", "in"], ("b", 1): ["to", "town"], ("c", 0): ["a", "magnet"], ("c", 1): ["9", "x"], ("d", 0): ["--"], ("d", 1): ["x"]}


def test_disputes_have_the_place_in_the_other_reading():
    pairs, _ = A.align_pair("the quick brown fox".split(), "12 the quick brovvn fox".split())
    assert pairs == [(3, "brown", "brovvn")]
