from pyspark.sql import functions as F

from quirespark.functions import geometry, pixels
from quirespark.operators import native


def test_fragments_become_well_formed():
    assert native.well_formed('<p>a & b<br>c<p>d <i>e</p></b>') == "<p>a &amp; b<br/>c</p><p>d <i>e</i></p>"
    assert native.well_formed("x < y <img src=a.png>") == 'x &lt; y <img src="a.png"/>'


def test_the_layer_wins_short_equal_runs():
    layer = "one two three four five six seven eight nine ten"
    assert native.reconcile("<p>one tvvo three four five six seven eight nine ten</p>", layer) == ("<p>one two three four five six seven eight nine ten</p>", 1)
    assert native.reconcile("<p>one tvvo</p>", "one two") == ("<p>one tvvo</p>", 0)
    assert native.reconcile("<p>one a b c d six seven eight nine ten</p>", layer)[1] == 0


def test_native_pages_only(spark):
    layer = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([("b", 0, layer.replace("two", "tw0"), layer, True), ("b", 1, layer.replace("two", "tw0"), layer, False)], "book_id string, page_index long, body string, layer_text string, is_native boolean")
    assert [r.reconciled for r in native.reconcile_native_text(d).orderBy("page_index").collect()] == [1, 0]


def test_compare_words():
    assert native.compare_words("Ｆｕｌｌ ﬁsh’s Café") == ["full", "fish's", "café"]


def test_pictures(spark):
    flat, edge = [200.0] * 400, [200.0 if (i // 20 + i % 20) % 2 else 0.0 for i in range(400)]
    d = spark.createDataFrame([(0, flat, 20), (1, edge, 20), (2, None, 20)], "i int, p array<double>, w int")
    got = d.select("i", pixels.sharpness("p", "w"), pixels.has_content("p", "w"), pixels.page_ink("p", "w")).orderBy("i").collect()
    assert got[0][1:] == (0.0, False, 0.0) and got[1][1] > 1000 and got[1][2] is True and got[1][3] == 0.5 and got[2][1:] == (None, True, None)
    spread = [0.0 if x == 20 else 200.0 for _ in range(8) for x in range(40)]
    assert spark.createDataFrame([(spread, 40)], "p array<double>, w int").select(pixels.gutter("p", "w")).first()[0] == 20


def test_geometry(spark):
    d = spark.sql("SELECT array(named_struct('x', 0d, 'y', 0d), named_struct('x', 2d, 'y', 0d), named_struct('x', 2d, 'y', 1d), named_struct('x', 0d, 'y', 1d)) AS q, array(named_struct('x', 0d, 'y', 0d), named_struct('x', 2d, 'y', 0d), named_struct('x', 3d, 'y', 1d), named_struct('x', 0d, 'y', 1d)) AS k")
    r = d.select(geometry.unsafe_quad(F.col("q")), geometry.unsafe_quad(F.col("k")), geometry.orientation(F.lit(-1.0), F.lit(0.0), F.lit(0.0), F.lit(-1.0)), geometry.orientation(F.lit(0.0), F.lit(1.0), F.lit(-1.0), F.lit(0.0))).first()
    assert r[:] == (False, True, ["TB", "LR"], None)
