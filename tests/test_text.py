import pytest
from pyspark.sql import functions as F

from quirespark.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first()[0]


FOLIOS = [
    ("12 • A Title", 12), ("A Title 13", 13), ("60 - Citadel of Words", 60), ("77", None), ("IN 1893 AND AFTER", None), ("THE YEAR IN 1893", None), ("2-7", 2007), ("FM 4-25", 4025), ("FM 3-06", None),
    ("60 - 61", None), ("B-3", 101003), ("Page 303 of 496 61%", 303), ("", None), ("x" * 61 + " 12", None), ("0 Preface", None), ("ab 5", None), ("abc 5", 5), ("Chapter: 9", 9), (None, None),
]


def test_folios_are_read_or_refused(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FOLIOS)], "i int, t string")
    got = {r.i: r.n for r in d.select("i", T.parse_folio(F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(len(FOLIOS))] == [n for _, n in FOLIOS]


def test_roman_numerals_are_strict(spark):
    d = spark.createDataFrame([(x,) for x in ["I", "IV", "XCIX", "IIII", "VX", "", "C", "ix"]], "t string")
    assert [r[0] for r in d.select(T.roman_to_int(F.col("t"))).collect()] == [1, 4, 99, None, None, None, None, None]


@pytest.mark.parametrize(("text", "n"), [("", 0), ("one two", 1), ("a b c d e", 1), ("a b c d e f", 2), ("a a a a a a a a", 1), (None, 0)])
def test_page_shingles(spark, text, n):
    assert len(one(spark, T.page_shingles(F.col("t")), t=text)) == n


def test_strict_shingles_have_no_fallback(spark):
    assert one(spark, T.strict_shingles(F.col("t")), t="a b c d e") == []
    assert one(spark, T.strict_shingles(F.col("t")), t="A b c d e F") == ["a b c d e f"]


def test_tags_and_entities(spark):
    assert one(spark, T.strip_tags(F.col("t")), t="<p>a &amp; b</p><p>c<br/>d &amp;lt; <b>e</b>f</p>") == "a & b c d &lt; ef"


def test_folding_joins_line_ends_and_drops_accents(spark):
    assert one(spark, F.transform(T.tokens(F.col("t")), T.fold_word), t="The re-\nentry of Reë-ntry’s ﬁsh") == ["the", "reentry", "of", "reentrys", "fish"]


def test_three_denominators(spark):
    d = spark.createDataFrame([(["a", "b"], ["b", "c", "d"])], "a array<string>, b array<string>")
    assert d.select(T.overlap_coefficient(F.col("a"), F.col("b")), T.containment(F.col("b"), F.col("a")), T.jaccard(F.col("a"), F.col("b"))).first()[:] == (0.5, 1 / 3, 0.25)
