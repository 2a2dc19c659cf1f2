"""Registry of the library's queries over the driver's tables: name -> (spark, sf_dir) -> DataFrame, and the SQL of the same rows.

Documents stand for pages: a source is a book, its documents by doc_id are the pages. Events stand for frames (a user is a
video), embeddings for thumbnails, conversations for books of turns, order lines for folios and boxes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import stats
from ..functions import text as T
from ..operators import adjudicate, dedupe, folios, layout, native, reading, segments, typography, verify
from ..sources import images

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    # a text table of few files would keep most cores idle; a large one has splits enough and is not moved
    return d.repartition(cores) if name == "documents" and d.rdd.getNumPartitions() < cores else d


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    # only ids are sorted by book; texts are joined to their numbers afterwards
    number = (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long").alias("page_index")
    return d.select("doc_id", "text").join(d.select("doc_id", F.col("source").alias("book_id"), number), "doc_id").select("book_id", "page_index", "text")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("video_id"), order.cast("long").alias("frame_idx"), F.col("value").alias("motion"), "event_id")


_PAGES = "pages_ AS (SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_index, text FROM documents)"
_WORDS = "list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), ' '), lambda x: x <> '')"
_SHINGLES = "CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) END"
_PLAIN = "translate(replace(replace({}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '’‘“”–—', '''''\"\"--')"
_TOKENS = "regexp_extract_all(regexp_replace(" + _PLAIN.format("{}") + r", '([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g'), '[A-Za-zÀ-ÖØ-öø-ÿŒœ][A-Za-zÀ-ÖØ-öø-ÿŒœ''’-]*')"
_FOLD = "translate(translate(lower({}), '-''', ''), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


@query(f"WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents) SELECT doc_id, CAST(len(ws) AS BIGINT) AS words, CAST(len({_SHINGLES}) AS BIGINT) AS shingles FROM w")
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.simple_words(F.col("text"))).cast("long").alias("words"), F.size(T.page_shingles(F.col("text"))).cast("long").alias("shingles"))


@query(
    f"""WITH {_PAGES}, w AS (SELECT book_id, page_index, {_WORDS} AS ws FROM pages_), s AS (SELECT book_id, page_index, {_SHINGLES} AS s FROM w),
    n AS (SELECT *, len(s) AS n FROM s WHERE len(s) >= 12), e AS (SELECT book_id, page_index, n, unnest(s) AS g FROM n)
    SELECT a.book_id, a.page_index AS i, b.page_index AS j, count(*) AS shared, count(*) / least(any_value(a.n), any_value(b.n)) AS score
    FROM e a JOIN e b ON a.book_id = b.book_id AND a.g = b.g AND b.page_index < a.page_index AND b.page_index >= a.page_index - 10 GROUP BY 1, 2, 3"""
)
def pair_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.pair_scores(book_pages(spark, sf_dir))


@query()
def page_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.page_verdicts(book_pages(spark, sf_dir))


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS ws FROM documents),
    g AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 4), lambda i: array_to_string(list_slice(ws, i, i + 5), ' '))) AS g FROM w WHERE len(ws) >= 40),
    c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY 1, 2), s AS (SELECT doc_id, sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) AS share FROM c GROUP BY 1)
    SELECT d.doc_id AS page_index, coalesce(share, 0) AS share FROM documents d LEFT JOIN s USING (doc_id)"""
)
def degenerate_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit("all").alias("book_id"), F.col("doc_id").alias("page_index"), "text")
    return dedupe.repeated_share(d).drop("book_id")


@query(
    """WITH w AS (SELECT 0 AS side, item_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM benchmark UNION ALL SELECT 1, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') FROM documents),
    s AS (SELECT side, id, list_distinct(list_transform(range(1, len(ws) - 4), lambda i: array_to_string(list_slice(ws, i, i + 5), ' '))) AS s FROM w WHERE len(ws) >= 25),
    e AS (SELECT side, id, unnest(s) AS g FROM s), p AS (SELECT a.id, b.id AS other, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.side = 0 AND b.side = 1 GROUP BY 1, 2),
    b AS (SELECT id, other, k, row_number() OVER (PARTITION BY id ORDER BY k DESC, other) AS r FROM p)
    SELECT s.id AS page_index, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(b.k / len(s.s), 0) AS coverage, b.other AS covered_by FROM s LEFT JOIN b ON b.id = s.id AND b.r = 1 WHERE s.side = 0"""
)
def coverage_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_pages = lambda name, key: table(spark, sf_dir, name).select(F.lit("all").alias("book_id"), F.col(key).alias("page_index"), "text")
    return dedupe.coverage(as_pages("benchmark", "item_id"), as_pages("documents", "doc_id")).drop("book_id")


@query(f"WITH t AS (SELECT source AS book_id, unnest({_TOKENS.replace('{}', 'text')}) AS w FROM documents), f AS (SELECT book_id, {_FOLD.format('w')} AS word FROM t) SELECT book_id, word, count(*) AS n FROM f WHERE word <> '' GROUP BY 1, 2 HAVING count(*) >= 3")
def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.explode(F.transform(T.tokens(F.col("text")), T.fold_word)).alias("word"))
    return adjudicate.lexicon(t)


_FRAMES = "f AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, value AS motion, event_id FROM events)"


@query(
    f"""WITH {_FRAMES}, r AS (SELECT *, sum(CASE WHEN motion < 60 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY frame_idx) AS g FROM f),
    k AS (SELECT video_id, g, min(frame_idx) AS first_frame, count(*) AS n_frames FROM r WHERE motion < 60 GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY first_frame) - 1 AS run, first_frame, n_frames FROM k"""
)
def still_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.still_runs(frames(spark, sf_dir), 60.0)


_OTSU = """o AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY x) AS r, count(*) OVER (PARTITION BY k) AS n, sum(x) OVER (PARTITION BY k ORDER BY x ROWS UNBOUNDED PRECEDING) AS c,
    sum(x) OVER (PARTITION BY k) AS t, lead(x) OVER (PARTITION BY k ORDER BY x) AS nx FROM v),
    g AS (SELECT *, (r / n) * (1 - r / n) * power(c / r - (t - c) / (n - r), 2) AS sb FROM o WHERE r < n),
    m AS (SELECT *, max(sb) OVER (PARTITION BY k) AS best FROM g), p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY nx - x DESC, x) AS pick FROM m WHERE sb >= best - 1e-12)"""


@query(f"WITH v AS (SELECT user_id AS k, value AS x FROM events), {_OTSU} SELECT user_id AS video_id, CASE WHEN count(*) < 2 OR max(value) - min(value) < 1e-9 THEN CAST('inf' AS DOUBLE) ELSE round(any_value((p.x + p.nx) / 2), 4) END AS threshold FROM events LEFT JOIN p ON p.k = user_id AND pick = 1 GROUP BY 1")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = segments.motion_threshold(frames(spark, sf_dir))
    return cut.select("video_id", F.when(F.col("threshold") < float("inf"), F.round("threshold", 4)).otherwise(F.col("threshold")).alias("threshold"))


@query(
    f"""WITH v AS (SELECT user_id AS k, log10(value) AS x FROM events WHERE value > 0), {_OTSU}, cut AS (SELECT k, (x + nx) / 2 AS th FROM p WHERE pick = 1),
    b AS (SELECT v.k, any_value(th) AS th, max(CASE WHEN x < th THEN x END) AS lo, min(CASE WHEN x >= th THEN x END) AS hi FROM v JOIN cut USING (k) GROUP BY 1)
    SELECT u.user_id, CASE WHEN power(10, hi) >= 3 * power(10, lo) THEN round(power(10, th), 4) ELSE CAST('-inf' AS DOUBLE) END AS threshold FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN b ON b.k = u.user_id"""
)
def cluster_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = stats.cluster_cut(table(spark, sf_dir, "events"), ["user_id"], "value")
    return cut.select("user_id", F.when(F.col("threshold") > 0, F.round("threshold", 4)).otherwise(F.col("threshold")).alias("threshold"))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), m AS (SELECT vec_id, e, list_sum(e) / len(e) AS m FROM e)
    SELECT vec_id, array_to_string(list_transform(e, lambda x: CASE WHEN x > m THEN '1' ELSE '0' END), '') AS sig FROM m"""
)
def picture_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", layout.signature(F.col("embedding")).alias("sig"))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), m AS (SELECT vec_id, e, list_sum(e) / len(e) AS m FROM e),
    s AS (SELECT vec_id, array_to_string(list_transform(e, lambda x: CASE WHEN x > m THEN '1' ELSE '0' END), '') AS sig FROM m)
    SELECT sig, count(*) AS names, count(DISTINCT vec_id) AS pages FROM s WHERE sig LIKE '%1%' GROUP BY 1 HAVING count(*) >= 3"""
)
def repeated_artwork(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings").select(F.lit("all").alias("book_id"), F.col("vec_id").alias("page_index"), F.col("vec_id").alias("name"), F.col("embedding").alias("pixels"))
    return layout.image_furniture(d).drop("book_id")


@query(
    f"""WITH {_PAGES}, w AS (SELECT book_id, page_index, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM pages_),
    n AS (SELECT *, lag(words, 2) OVER q AS a, lag(words, 1) OVER q AS b, lead(words, 1) OVER q AS c, lead(words, 2) OVER q AS d FROM w WINDOW q AS (PARTITION BY book_id ORDER BY page_index)),
    m AS (SELECT *, list_median(list_filter([a, b, c, d], lambda x: x IS NOT NULL)) AS median_words FROM n)
    SELECT book_id, page_index, words, CAST(median_words AS DOUBLE) AS median_words, CASE WHEN words = 0 THEN 'blank' ELSE 'sparse' END AS kind FROM m WHERE words = 0 OR (median_words >= 80 AND words < 0.35 * median_words)"""
)
def sparse_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.sparse_pages(book_pages(spark, sf_dir))


@query(
    f"""WITH {_PAGES}, w AS (SELECT book_id, page_index, {_WORDS} AS ws FROM pages_), l AS (SELECT *, len(ws) AS words, array_to_string(ws, '') AS squashed FROM w),
    n AS (SELECT *, lag(words, 2) OVER q AS a, lag(words, 1) OVER q AS b, lead(words, 1) OVER q AS c, lead(words, 2) OVER q AS d FROM l WINDOW q AS (PARTITION BY book_id ORDER BY page_index)),
    m AS (SELECT *, list_median(list_filter([a, b, c, d], lambda x: x IS NOT NULL)) AS m FROM n), i AS (SELECT book_id, page_index, list_filter(ws, lambda x: length(x) >= 4) AS stubs FROM m WHERE m >= 60 AND words < 0.5 * m),
    s AS (SELECT i.book_id, i.page_index, l.page_index AS match, len(list_filter(stubs, lambda x: contains(squashed, x))) / len(stubs) AS share FROM i JOIN l ON l.book_id = i.book_id AND l.page_index BETWEEN i.page_index - 2 AND i.page_index + 2 AND l.page_index <> i.page_index WHERE len(stubs) >= 5 AND length(squashed) >= 200),
    r AS (SELECT *, row_number() OVER (PARTITION BY book_id, page_index ORDER BY share DESC, match) AS k FROM s WHERE share >= 0.7) SELECT book_id, page_index, match, share FROM r WHERE k = 1"""
)
def page_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.page_turns(book_pages(spark, sf_dir))


_ENTITIES = "html"
for _e, _c in {k: v.replace("'", "''") for k, v in T.ENTITIES.items()}.items():
    _ENTITIES = f"replace({_ENTITIES}, '{_e}', '{_c}')"
_TAGS = _ENTITIES.replace("html", r"regexp_replace(regexp_replace(html, '</(?:p|div|h[1-6]|li|tr|td|th|table|ul|ol|blockquote|figcaption)>|<(?:br|hr)\b[^>]*>', ' ', 'gi'), '<[^>]+>', '', 'g')", 1)


@query(f"SELECT page_id, trim({_TAGS}) AS text FROM pages")
def stripped_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query(r"WITH c AS (SELECT page_id % 10 AS book_id, unnest(regexp_extract_all(regexp_replace(html, '<[^>]+>', '', 'g'), '[¬¦§¤°^~`|\\\x{2500}-\x{257F}\x{FFFD}\x{80}-\x{9F}]')) AS ch FROM pages) SELECT CAST(book_id AS VARCHAR) AS book_id, ch, count(*) AS n FROM c GROUP BY 1, 2")
def unusual_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typography.unusual_characters(table(spark, sf_dir, "pages").select((F.col("page_id") % 10).cast("string").alias("book_id"), F.col("page_id").alias("page_index"), F.col("html").alias("body")))


_LINES = """CASE o_orderkey % 7 WHEN 0 THEN concat(o_orderkey % 1100, ' • ', o_orderpriority) WHEN 1 THEN concat(o_orderpriority, ' ', o_orderkey % 1100) WHEN 2 THEN concat(o_orderkey % 120, '-', o_orderkey % 50)
    WHEN 3 THEN concat('Page ', o_orderkey % 400, ' of 496 12%') WHEN 4 THEN concat('B-', o_orderkey % 40) WHEN 5 THEN concat('FM 4-', o_orderkey % 30) ELSE concat(o_orderkey % 300, ' ', o_orderstatus) END"""


@query(
    f"""WITH l AS (SELECT o_orderkey, {_LINES} AS s FROM orders), h AS (SELECT *, regexp_matches(s, '^[0-9]{{1,2}}-[0-9]{{1,3}}(\\s|$)') AS head FROM l),
    c AS (SELECT *, TRY_CAST(CASE WHEN head THEN regexp_extract(s, '^([0-9]{{1,2}})-', 1) ELSE regexp_extract(s, '\\s([0-9]{{1,2}})-([0-9]{{1,3}})$', 1) END AS INTEGER) AS ch,
      CASE WHEN head THEN regexp_extract(s, '^[0-9]{{1,2}}-([0-9]{{1,3}})', 1) ELSE regexp_extract(s, '\\s([0-9]{{1,2}})-([0-9]{{1,3}})$', 2) END AS pg,
      coalesce(TRY_CAST(regexp_extract(s, '^([0-9]{{1,3}})(?:\\s*[•·|:-]|\\s)\\s*\\S', 1) AS INTEGER), TRY_CAST(regexp_extract(s, '(?:[•·|:-]\\s*|\\s)([0-9]{{1,3}})$', 1) AS INTEGER)) AS plain FROM h)
    SELECT o_orderkey, CASE WHEN length(s) > 60 THEN NULL WHEN regexp_matches(s, '\\bPage [0-9]{{1,3}} of [0-9]{{1,4}}\\b') THEN CAST(regexp_extract(s, 'Page ([0-9]{{1,3}}) of', 1) AS INTEGER)
      WHEN (regexp_matches(s, '[A-Za-z]{{2}}') OR regexp_matches(s, '^[0-9]{{1,2}}-[0-9]{{1,3}}$')) AND pg NOT LIKE '0%' AND ch BETWEEN 1 AND 99 AND TRY_CAST(pg AS INTEGER) BETWEEN 1 AND 999 THEN ch * 1000 + CAST(pg AS INTEGER)
      WHEN regexp_matches(s, '^[A-Z]-[1-9][0-9]{{0,2}}$') THEN (ascii(s) - 65 + 100) * 1000 + CAST(substr(s, 3) AS INTEGER)
      WHEN regexp_matches(s, '[A-Za-z]{{3}}') AND plain BETWEEN 1 AND 999 THEN plain END AS folio FROM c"""
)
def folio_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.parse_folio(F.expr(_LINES)).alias("folio"))


_FOLIOS = "fo AS (SELECT CAST(l_suppkey % 50 AS VARCHAR) AS book_id, row_number() OVER (PARTITION BY l_suppkey % 50 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS page_index, l_partkey % 400 AS number FROM lineitem)"


def order_folios(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("b", F.col("l_suppkey") % 50)
    page = F.row_number().over(Window.partitionBy("b").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1
    return li.select(F.col("b").cast("string").alias("book_id"), page.cast("long").alias("page_index"), (F.col("l_partkey") % 400).alias("number"), F.lit("").alias("text"), F.lit(True).alias("confident"))


@query(
    f"""WITH {_FOLIOS}, p AS (SELECT *, lead(page_index) OVER w AS np, lead(number) OVER w AS nn FROM fo WINDOW w AS (PARTITION BY book_id ORDER BY page_index)), a AS (
    SELECT book_id, 'inversion' AS kind, page_index AS page_a, np AS page_b, nn AS number, CAST(0 AS BIGINT) AS missing FROM p WHERE nn <= number
    UNION ALL SELECT book_id, 'gap', page_index, np, number, nn - number - 1 FROM p WHERE nn > number + 1 AND nn // 1000 = number // 1000 AND nn - number > np - page_index
    UNION ALL SELECT book_id, 'duplicate', min(page_index), max(page_index), number, count(*) FROM fo GROUP BY book_id, number HAVING count(*) > 1) SELECT * FROM a"""
)
def folio_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = order_folios(spark, sf_dir)
    none = f.where("false").select("book_id", "page_index", "number")
    return folios.audit_folios(f, none).withColumn("missing", F.size("missing").cast("long"))


@query(
    f"""WITH {_FOLIOS}, k AS (SELECT book_id, number AS folio, min(page_index) AS at FROM fo WHERE number % 7 <> 0 GROUP BY 1, 2), q AS (SELECT DISTINCT book_id, number AS folio FROM fo),
    lo AS (SELECT q.book_id, q.folio, max(k.folio) AS f FROM q LEFT JOIN k ON k.book_id = q.book_id AND k.folio <= q.folio GROUP BY 1, 2),
    hi AS (SELECT q.book_id, q.folio, min(k.folio) AS f FROM q LEFT JOIN k ON k.book_id = q.book_id AND k.folio >= q.folio GROUP BY 1, 2),
    x AS (SELECT lo.book_id, lo.folio, a.folio AS lf, a.at + lo.folio - a.folio AS lp, a.at AS la, b.at - b.folio + lo.folio AS hp FROM lo JOIN hi USING (book_id, folio) LEFT JOIN k a ON a.book_id = lo.book_id AND a.folio = lo.f LEFT JOIN k b ON b.book_id = hi.book_id AND b.folio = hi.f)
    SELECT book_id, folio, CASE WHEN lf = folio THEN la WHEN lp IS NULL THEN hp WHEN hp IS NULL THEN lp WHEN lp = hp THEN lp END AS page_index FROM x"""
)
def folio_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = order_folios(spark, sf_dir)
    wanted = f.select("book_id", F.col("number").alias("folio")).distinct()
    return folios.resolve_folios(wanted, f.where("number % 7 <> 0")).select("book_id", "folio", "page_index")


@query(
    f"""WITH {_FRAMES}, d AS (SELECT *, lag(motion) OVER (PARTITION BY video_id ORDER BY frame_idx) AS p FROM f)
    SELECT video_id AS album, event_id AS path, CAST(sum(CASE WHEN frame_idx = 0 OR NOT abs(motion - p) < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS BIGINT) AS burst FROM d"""
)
def burst_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    shots = frames(spark, sf_dir).select(F.col("video_id").alias("album"), F.format_string("%012d", "frame_idx").alias("path"), "event_id", F.abs(F.col("motion") - F.lag("motion").over(w)).alias("diff_to_prev"))
    grouped = segments.burst_groups(shots, 20.0)
    return grouped.join(shots.select("album", "path", "event_id"), ["album", "path"]).select("album", F.col("event_id").alias("path"), "burst")


_BAG = "t AS (SELECT CAST(conv_id AS VARCHAR) AS book_id, turn // 2 AS page_index, role, unnest({}) AS w FROM conversations), fw AS (SELECT book_id, page_index, role, {} AS word FROM t)".format(_TOKENS.replace("{}", "text"), _FOLD.format("w"))
_BAG += ", a AS (SELECT book_id, page_index, word, count(*) AS n FROM fw WHERE role = 'user' GROUP BY 1, 2, 3), b AS (SELECT book_id, page_index, word, count(*) AS n FROM fw WHERE role <> 'user' GROUP BY 1, 2, 3)"


def turn_words(spark: SparkSession, sf_dir: str, users: bool) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user" if users else F.col("role") != "user")
    return verify.page_words(c.select(F.col("conv_id").cast("string").alias("book_id"), F.floor(F.col("turn") / 2).alias("page_index"), "text"))


@query(f"WITH {_BAG}, j AS (SELECT book_id, page_index, word, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b USING (book_id, page_index, word)) SELECT book_id, page_index, CASE WHEN x > y THEN 'ours' ELSE 'source' END AS side, word, abs(x - y) AS n FROM j WHERE x <> y")
def bag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.bag_difference(turn_words(spark, sf_dir, True), turn_words(spark, sf_dir, False))


@query(
    f"""WITH {_BAG}, a2 AS (SELECT book_id, word, sum(n) AS n FROM a GROUP BY 1, 2), b2 AS (SELECT book_id, word, sum(n) AS n FROM b GROUP BY 1, 2), j AS (SELECT book_id, coalesce(a2.n, 0) AS x, coalesce(b2.n, 0) AS y FROM a2 FULL JOIN b2 USING (book_id, word))
    SELECT book_id, CAST(sum(least(x, y)) AS BIGINT) AS hits, CAST(sum(x) AS BIGINT) AS ours, CAST(sum(y) AS BIGINT) AS truth FROM j GROUP BY 1"""
)
def bag_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    drop = lambda d: d.select("book_id", "word")
    return adjudicate.bag_recall(drop(turn_words(spark, sf_dir, True)), drop(turn_words(spark, sf_dir, False)))


@query()
def word_duels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.duels(verify.bag_difference(turn_words(spark, sf_dir, True), turn_words(spark, sf_dir, False)))


_ASCII = "regexp_extract_all(lower(text), '[a-z]+')"
_DISPUTES = f"""tw AS (SELECT CAST(conv_id % 5 AS VARCHAR) AS book_id, conv_id * 100 + turn AS page_index, conv_id, turn, {_ASCII} AS ws FROM conversations),
    pr AS (SELECT a.book_id, a.page_index, unnest(range(1, least(len(a.ws), len(b.ws)) + 1)) AS seq, a.ws AS x, b.ws AS y FROM tw a JOIN tw b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    ds AS (SELECT book_id, page_index, seq, x[seq] AS ours, y[seq] AS theirs FROM pr),
    lx AS (SELECT book_id, w AS word, count(*) AS n FROM (SELECT book_id, unnest(ws) AS w FROM tw) GROUP BY 1, 2 HAVING count(*) >= 3),
    dict AS (SELECT DISTINCT unnest({_ASCII}) AS word FROM benchmark)"""
_LEMMAS = " OR ".join(f"(suffix(w, '{s}') AND length(w) > {len(s) + 2} AND left(w, length(w) - {len(s)}) || '{a}' IN (SELECT word FROM dict))" for s, a in T.INFLECTIONS)
_IS_WORD = f"w IN ({', '.join(repr(x) for x in (*T.APPARATUS, 'a', 'i', 'o'))}) OR (length(w) > 1 AND (w IN (SELECT word FROM dict) OR {_LEMMAS}))"
_ROMAN = "(length(w) >= 2 AND regexp_matches(upper(w), '^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$'))"


def turn_disputes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(disputes between the words of consecutive turns, lexicon, dictionary)."""
    ws = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).cast("string").alias("book_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("page_index"), "conv_id", "turn", ws.alias("ws"))
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ws").alias("next"))
    both = t.join(after, ["conv_id", "turn"]).withColumn("n", F.least(F.size("ws"), F.size("next")))
    pairs = both.select("book_id", "page_index", F.posexplode(F.arrays_zip(F.slice("ws", F.lit(1), F.col("n")).alias("ours"), F.slice("next", F.lit(1), F.col("n")).alias("theirs"))).alias("seq", "p"))
    pairs = pairs.select("book_id", "page_index", (F.col("seq") + 1).cast("long").alias("seq"), "p.ours", "p.theirs")
    words = adjudicate.lexicon(t.select("book_id", F.explode("ws").alias("word")))
    dictionary = table(spark, sf_dir, "benchmark").select(F.explode(F.array_distinct(ws)).alias("word")).distinct()
    return pairs, words, dictionary


@query(
    f"""WITH {_DISPUTES}, kw AS (SELECT w, {_IS_WORD} AS is_word, {_ROMAN} AS is_roman FROM (SELECT DISTINCT ours AS w FROM ds UNION SELECT DISTINCT theirs FROM ds)),
    j AS (SELECT ds.*, coalesce(la.n, 0) AS na, coalesce(lb.n, 0) AS nb, ka.is_word AS wa, kb.is_word AS wb, ka.is_roman OR kb.is_roman AS ro FROM ds LEFT JOIN lx la ON la.book_id = ds.book_id AND la.word = ours LEFT JOIN lx lb ON lb.book_id = ds.book_id AND lb.word = theirs JOIN kw ka ON ka.w = ours JOIN kw kb ON kb.w = theirs),
    ru AS (SELECT *, CASE WHEN ours = theirs THEN 'fold' WHEN ro THEN 'roman' WHEN (na >= 3 AND nb = 0) OR (nb >= 3 AND na = 0) THEN 'lexicon' WHEN wa <> wb THEN 'dictionary' ELSE 'abstain' END AS rung FROM j),
    wi AS (SELECT *, CASE rung WHEN 'fold' THEN ours WHEN 'lexicon' THEN CASE WHEN na >= 3 THEN ours ELSE theirs END WHEN 'dictionary' THEN CASE WHEN wa THEN ours ELSE theirs END END AS winner, count(*) OVER (PARTITION BY book_id, ours, theirs) AS pair_count FROM ru)
    SELECT book_id, page_index, seq, ours, theirs, rung, winner, pair_count, CASE WHEN winner IS NULL THEN CASE WHEN pair_count >= 4 THEN 'systematic' WHEN NOT wa THEN 'broken' ELSE 'open' END WHEN winner = ours THEN 'confirmed' WHEN pair_count >= 2 THEN 'systematic' ELSE 'catches' END AS tier,
      row_number() OVER (PARTITION BY book_id, page_index, ours ORDER BY seq) - 1 AS occurrence FROM wi"""
)
def review_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, words, dictionary = turn_disputes(spark, sf_dir)
    return adjudicate.tiers(adjudicate.judge(pairs, words, dictionary), dictionary)


@query()
def alignment_disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").alias("page_index"), "text")
    after = t.select("book_id", (F.col("page_index") - 1).alias("page_index"), F.col("text").alias("theirs"))
    return adjudicate.disputes(adjudicate.align(t.join(after, ["book_id", "page_index"]).withColumnRenamed("text", "ours")))


_BOX = "CAST({p} % 50 AS DOUBLE) / 100 AS x0, CAST({s} % 20 AS DOUBLE) / 40 AS y0, CAST({p} % 50 + 20 AS DOUBLE) / 100 AS x1, CAST({s} % 20 + 12 AS DOUBLE) / 40 AS y1"


@query(
    f"""WITH i AS (SELECT l_orderkey, l_linenumber, {_BOX.format(p="l_partkey", s="l_suppkey")} FROM lineitem), j AS (SELECT a.l_orderkey AS page_index, a.l_linenumber AS item_index, b.l_linenumber AS block_index,
    greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS k, (a.x1 - a.x0) * (a.y1 - a.y0) AS u, (b.x1 - b.x0) * (b.y1 - b.y0) AS v FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber % 2 = 0 AND b.l_linenumber % 2 = 1)
    SELECT page_index, item_index, block_index, round(k / (u + v - k), 6) AS iou FROM j WHERE round(k / (u + v - k), 6) >= 0.3"""
)
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").selectExpr("'all' AS book_id", "l_orderkey AS page_index", "l_linenumber", *[x.strip() for x in _BOX.format(p="l_partkey", s="l_suppkey").split(",")])
    boxed = li.select("book_id", "page_index", "l_linenumber", G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("box"))
    found = layout.overlaps(boxed.where("l_linenumber % 2 = 0").withColumnRenamed("l_linenumber", "item_index"), boxed.where("l_linenumber % 2 = 1").withColumnRenamed("l_linenumber", "block_index"), 0.299)
    return found.select("page_index", "item_index", "block_index", F.round("iou", 6).alias("iou")).where("iou >= 0.3")


@query(
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), i AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) - 1 AS item_index, ls FROM l), t AS (SELECT doc_id, item_index, CASE WHEN item_index % 3 = 0 AND (item_index = 0 OR doc_id % 2 = 0) THEN concat(doc_id % 400, ' • ', ls[item_index + 1]) ELSE ls[item_index + 1] END AS s FROM i),
    h AS (SELECT *, CASE WHEN length(trim(s)) BETWEEN 1 AND 60 AND (regexp_matches(trim(s), '^\s*(?:[0-9]{1,3}\s*[•·|:]|[0-9]{1,3}\s*$)') OR regexp_matches(trim(s), '[•·|:]\s*[0-9]{1,3}\s*$')) THEN 1 ELSE 0 END AS h FROM t),
    g AS (SELECT doc_id, item_index, greatest(min(h) OVER (PARTITION BY doc_id ORDER BY item_index), min(h) OVER (PARTITION BY doc_id ORDER BY item_index DESC)) AS gone FROM h)
    SELECT doc_id AS page_index, item_index FROM g WHERE gone = 0"""
)
def running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit("all").alias("book_id"), F.col("doc_id").alias("page_index"), F.posexplode(F.split("text", "\n")).alias("item_index", "s"))
    marked = F.when((F.col("item_index") % 3 == 0) & ((F.col("item_index") == 0) | (F.col("page_index") % 2 == 0)), F.concat((F.col("page_index") % 400).cast("string"), F.lit(" • "), F.col("s"))).otherwise(F.col("s"))
    items = d.select("book_id", "page_index", F.col("item_index").cast("long").alias("item_index"), marked.alias("html"), F.lit(False).alias("is_figure"), F.lit(False).alias("is_caption"))
    return layout.strip_running_heads(items).select("page_index", "item_index")


@query("SELECT l_orderkey AS page_index, string_agg(CAST(l_partkey AS VARCHAR), chr(10) ORDER BY round_even(l_extendedprice / 10, 0), l_quantity, CAST(l_partkey AS VARCHAR)) AS text FROM lineitem GROUP BY 1")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.lit("all").alias("book_id"), F.col("l_orderkey").alias("page_index"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_partkey").cast("string").alias("text"))
    return layout.read_order(li).drop("book_id")


@query(f"WITH {_PAGES}, w AS (SELECT book_id, page_index, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS n FROM pages_) SELECT book_id, min(page_index) AS page_index FROM w WHERE n < 25 GROUP BY 1")
def cover_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.first_thin_page(book_pages(spark, sf_dir))


@query(
    """WITH s AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS v FROM documents), p AS (SELECT a.doc_id, a.v AS x, b.v AS y FROM s a JOIN s b ON b.doc_id = a.doc_id + 1)
    SELECT doc_id, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END AS agreement FROM p"""
)
def reading_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return d.join(after, "doc_id").select("doc_id", reading.agreement(F.col("text"), F.col("other")).cast("double").alias("agreement"))


@query(
    f"""WITH {_PAGES}, b AS (SELECT book_id, page_index, CASE WHEN page_index % 3 = 0 THEN regexp_replace(text, '[^A-Za-z]+$', '') || '-' ELSE lower(text) END AS body FROM pages_),
    c AS (SELECT book_id, page_index, lead(page_index) OVER q AS next_page, regexp_extract(body, '([A-Za-z]+)-\\s*$', 1) AS stem, regexp_extract(coalesce(lead(body) OVER q, ''), '^\\s*([a-z][A-Za-z''’]*[.,;:!?''’"]*)', 1) AS rest FROM b WINDOW q AS (PARTITION BY book_id ORDER BY page_index)),
    t AS (SELECT book_id, unnest({_TOKENS.replace('{}', 'trim(body)')}) AS w FROM b), k AS (SELECT DISTINCT book_id, {_FOLD.format('w')} AS word FROM t),
    x AS (SELECT *, {_FOLD.format("(stem || regexp_replace(rest, '[.,;:!?''’]+$', ''))")} AS word FROM c WHERE stem <> '' AND rest <> '')
    SELECT book_id, page_index, next_page, stem, rest, CASE WHEN k.word IS NULL THEN 'refused' ELSE 'joined' END AS status FROM x LEFT JOIN k USING (book_id, word)"""
)
def page_end_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.concat(F.regexp_replace("text", r"[^A-Za-z]+\z", ""), F.lit("-"))
    return typography.page_hyphens(book_pages(spark, sf_dir).select("book_id", "page_index", F.when(F.col("page_index") % 3 == 0, cut).otherwise(F.lower("text")).alias("body")))


_HOLES = f"""{_PAGES}, sw AS (SELECT *, regexp_extract_all(lower(text), '[a-z]+') AS ws, regexp_extract_all(lower(text), '[a-z0-9]+') AS gs FROM pages_),
    mi AS (SELECT *, len(ws) AS n_words, len(list_filter(ws, lambda x: length(x) > 2)) AS n_real FROM sw WHERE len(ws) >= 25 AND page_index % 5 = 0),
    sh AS (SELECT book_id, page_index, list_distinct(list_transform(range(1, len(gs) - 4), lambda i: array_to_string(list_slice(gs, i, i + 5), ' '))) AS s FROM sw WHERE len(gs) >= 25),
    es AS (SELECT book_id, page_index, len(s) AS n, unnest(s) AS g FROM sh), hi AS (SELECT a.book_id, a.page_index, b.page_index AS other, count(*) AS k, any_value(a.n) AS n FROM es a JOIN es b ON a.book_id = b.book_id AND a.g = b.g AND a.page_index % 5 = 0 AND b.page_index % 5 <> 0 GROUP BY 1, 2, 3),
    be AS (SELECT *, row_number() OVER (PARTITION BY book_id, page_index ORDER BY k DESC, other) AS r FROM hi),
    ho AS (SELECT mi.book_id, mi.page_index, n_words, n_real, coalesce(k / n, 0) AS coverage, other AS covered_by, CASE WHEN coalesce(k / n, 0) >= 0.75 THEN 'rescanned' ELSE 'hole' END AS status FROM mi LEFT JOIN be ON be.book_id = mi.book_id AND be.page_index = mi.page_index AND r = 1 WHERE n_real >= greatest(8, n_words // 4))"""


def gutted_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pages of which every fifth is empty, whole pages)."""
    source = book_pages(spark, sf_dir)
    return source.withColumn("text", F.when(F.col("page_index") % 5 == 0, "").otherwise(F.col("text"))), source


@query(f"WITH {_HOLES} SELECT * FROM ho")
def verify_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.holes(*gutted_pages(spark, sf_dir))


@query(
    f"""WITH {_HOLES}, to_ AS (SELECT book_id, CAST(sum(CASE WHEN page_index % 5 = 0 THEN 0 ELSE len(ws) END) AS BIGINT) AS our_words, CAST(sum(len(ws)) AS BIGINT) AS source_words FROM sw GROUP BY 1), hc AS (SELECT book_id, count(*) AS n FROM ho WHERE status = 'hole' GROUP BY 1)
    SELECT book_id, our_words, source_words, our_words / source_words AS ratio, coalesce(n, 0) AS holes, CASE WHEN n > 0 THEN 1 ELSE 0 END AS exit_code FROM to_ LEFT JOIN hc USING (book_id)"""
)
def verify_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours, source = gutted_pages(spark, sf_dir)
    return verify.verdict(ours, source, verify.holes(ours, source))


_JUDGED = ORACLES["review_tiers"].rsplit("SELECT book_id, page_index, seq, ours", 1)[0].rstrip()


@query(f"{_JUDGED} SELECT book_id, rung, count(*) AS n FROM wi GROUP BY 1, 2")
def rung_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjudicate.rung_histogram(adjudicate.judge(*turn_disputes(spark, sf_dir)))


@query(
    f"""{_JUDGED}, tr AS (SELECT DISTINCT CAST(conv_id % 5 AS VARCHAR) AS book_id, conv_id * 100 + turn - 1 AS page_index, unnest({_ASCII}) AS word FROM conversations),
    fl AS (SELECT unnest([0, 1, 2]) AS floor), wf AS (SELECT wi.* REPLACE (CASE WHEN rung = 'dictionary' AND CASE WHEN wa THEN na ELSE nb END < floor THEN 'abstain' ELSE rung END AS rung, CASE WHEN rung = 'dictionary' AND CASE WHEN wa THEN na ELSE nb END < floor THEN NULL ELSE winner END AS winner), floor FROM wi, fl),
    tj AS (SELECT wi.*, a.word IS NOT NULL AS ta, b.word IS NOT NULL AS tb FROM wf wi LEFT JOIN tr a ON a.book_id = wi.book_id AND a.page_index = wi.page_index AND a.word = ours LEFT JOIN tr b ON b.book_id = wi.book_id AND b.page_index = wi.page_index AND b.word = theirs),
    oc AS (SELECT floor, rung, CASE WHEN winner IS NULL THEN CASE WHEN ta <> tb THEN 's' ELSE 't' END WHEN CASE WHEN winner = ours THEN ta AND NOT tb ELSE tb AND NOT ta END THEN 'r' WHEN CASE WHEN winner = ours THEN tb AND NOT ta ELSE ta AND NOT tb END THEN 'w' ELSE 'u' END AS o FROM tj)
    SELECT floor, rung, count(CASE WHEN o = 'r' THEN 1 END) AS "right", count(CASE WHEN o = 'w' THEN 1 END) AS wrong, count(CASE WHEN o = 'u' THEN 1 END) AS unjudgeable, count(CASE WHEN o = 's' THEN 1 END) AS settleable, count(CASE WHEN o = 't' THEN 1 END) AS truly_open FROM oc GROUP BY floor, rung"""
)
def rung_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the next turn stands for the true page
    ws = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    truth = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).cast("string").alias("book_id"), (F.col("conv_id") * 100 + F.col("turn") - 1).alias("page_index"), F.explode(ws).alias("word"))
    disputes = turn_disputes(spark, sf_dir)
    return adjudicate.calibrate({floor: adjudicate.judge(*disputes, dictionary_floor=floor) for floor in (0, 1, 2)}, truth)


@query(f"WITH {_DISPUTES} SELECT book_id, page_index, seq, ours, theirs FROM ds WHERE ours <> theirs AND length(theirs) > 3 AND levenshtein(ours, theirs) <= 2")
def close_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, _, _ = turn_disputes(spark, sf_dir)
    return pairs.where((F.col("ours") != F.col("theirs")) & (F.length("theirs") > 3) & T.edit_within(F.col("ours"), F.col("theirs")))


@query(
    """WITH m AS (SELECT source AS book_id, doc_id AS page_index, (n_chars % 97) / 97 AS skin, (n_chars % 7 + 1) / 4 AS ratio FROM documents), q AS (SELECT book_id, median(skin) AS ms, median(ratio) AS mr FROM m GROUP BY 1)
    SELECT book_id, page_index, 'hand' AS kind FROM m JOIN q USING (book_id) WHERE skin > greatest(0.06, ms + 0.05) UNION ALL SELECT book_id, page_index, 'uncropped' FROM m JOIN q USING (book_id) WHERE abs(ratio - mr) / mr > 0.35"""
)
def outlying_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return dedupe.outlying_pages(d.select(F.col("source").alias("book_id"), F.col("doc_id").alias("page_index"), (F.col("n_chars") % 97 / 97).alias("skin"), ((F.col("n_chars") % 7 + 1) / 4).alias("ratio")))


@query(
    f"""WITH {_FRAMES}, e AS (SELECT *, (event_id * 7919 % 1000) / 10 - 5 AS score, event_id % 5 <> 0 AS seen, lead(motion) OVER (PARTITION BY video_id ORDER BY frame_idx) AS out_, sum(CASE WHEN motion < 60 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY frame_idx) AS g FROM f),
    a AS (SELECT *, greatest(motion, coalesce(out_, motion)) AS still, count(*) OVER (PARTITION BY video_id, g) AS n FROM e WHERE motion < 60), b AS (SELECT *, row_number() OVER (PARTITION BY video_id, g ORDER BY frame_idx) - 1 AS pos, row_number() OVER (PARTITION BY video_id, g ORDER BY score DESC, frame_idx) AS by_score, row_number() OVER (PARTITION BY video_id, g ORDER BY still, frame_idx) AS by_still FROM a WHERE n >= 3),
    c AS (SELECT *, CASE WHEN NOT (score > 0 AND seen) THEN 4 WHEN by_score <= {segments.CANDIDATES} AND still < {segments.QUIET_GATE} THEN 0 WHEN by_still <= {segments.QUIET_POOL} THEN 1 WHEN pos > {segments.SETTLE} THEN 2 WHEN by_score <= {segments.CANDIDATES} THEN 3 ELSE 4 END AS k FROM b),
    d AS (SELECT *, row_number() OVER (PARTITION BY video_id, g ORDER BY k, CASE WHEN k <= 1 THEN still ELSE -score END, frame_idx) AS choice FROM c)
    SELECT video_id, dense_rank() OVER (PARTITION BY video_id ORDER BY g) - 1 AS run, frame_idx, ['steady', 'quiet', 'settled', 'candidates', 'any'][k + 1] AS pool FROM d WHERE choice = 1"""
)
def best_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("score", F.col("event_id") * 7919 % 1000 / 10 - 5).withColumn("detectable", F.col("event_id") % 5 != 0)
    return segments.best_frames(f, 60.0)


@query("SELECT l_partkey % 99 + 1 AS n, l_orderkey % 20 AS k, count(*) AS uses FROM lineitem GROUP BY 1, 2")
def roman_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tens, units = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    n = F.col("l_partkey") % 99 + 1
    roman = F.concat(F.get(F.lit(tens), F.floor(n / 10).cast("int")), F.get(F.lit(units), (n % 10).cast("int")))
    d = table(spark, sf_dir, "lineitem").select(T.roman_to_int(roman).cast("long").alias("n"), (F.col("l_orderkey") % 20).alias("k"))
    return d.groupBy("n", "k").agg(F.count(F.lit(1)).alias("uses"))


# ---- structure and layout


#: Boxes on a grid of powers of two, so that areas are exact in either engine.
_GRID = _BOX.format(p="l_partkey", s="l_suppkey").replace("/ 100", "/ 128").replace("/ 40", "/ 32")
_BOXED = f"bx AS (SELECT l_orderkey, l_linenumber, {_GRID} FROM lineitem), ar AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM bx)"
_IOU = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) / (a.area + b.area - greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0))"


def boxes(spark: SparkSession, sf_dir: str, odd: bool) -> DataFrame:
    """Order lines as boxes of a page: the odd ones are artwork, the even ones figures."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") % 2 == int(odd)).selectExpr("'all' AS book_id", "l_orderkey AS page_index", "l_linenumber AS n", *[x.strip() for x in _GRID.split(",")])
    return li.select("book_id", "page_index", "n", G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("box"))


@query(
    f"""WITH {_BOXED}, j AS (SELECT a.l_orderkey AS page_index, a.l_linenumber AS name, b.l_linenumber AS image_index, {_IOU} AS iou FROM ar a JOIN ar b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber % 2 = 0 AND b.l_linenumber % 2 = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_index, name ORDER BY iou DESC, image_index) AS k FROM j WHERE iou >= 0.6) SELECT page_index, name, image_index, round(iou, 6) AS iou FROM r WHERE k = 1"""
)
def better_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures, images = boxes(spark, sf_dir, False).withColumnRenamed("n", "name"), boxes(spark, sf_dir, True).withColumnRenamed("n", "image_index")
    return layout.better_figures(figures, images).select("page_index", "name", "image_index", F.round("iou", 6).alias("iou"))


@query(
    f"""WITH {_BOXED}, h AS (SELECT DISTINCT b.l_orderkey, b.l_linenumber FROM ar a JOIN ar b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber % 2 = 0 AND b.l_linenumber % 2 = 1 WHERE {_IOU} >= 0.25)
    SELECT l_orderkey AS page_index, l_linenumber AS image_index FROM ar WHERE l_linenumber % 2 = 1 AND area BETWEEN 0.02 AND 0.9 AND NOT EXISTS (SELECT 1 FROM h WHERE h.l_orderkey = ar.l_orderkey AND h.l_linenumber = ar.l_linenumber)"""
)
def orphan_artwork(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = boxes(spark, sf_dir, True).withColumnRenamed("n", "image_index")
    return layout.orphan_artwork(images, boxes(spark, sf_dir, False), known=0.25).select("page_index", "image_index")


_ITEMS = """it AS (SELECT l_orderkey AS page_index, l_linenumber AS item_index, CASE l_partkey % 3 WHEN 0 THEN concat('<p>', l_partkey, '</p>') WHEN 1 THEN concat('<math>', l_suppkey, '</math>') ELSE concat('<p>', l_suppkey, '<br/></p>', CASE WHEN l_partkey % 7 = 0 THEN '<hr/>' ELSE '' END) END AS html,
    CASE l_suppkey % 4 WHEN 0 THEN 'Footnote' WHEN 1 THEN 'Formula' ELSE 'Text' END AS label, l_returnflag = 'R' AS furniture FROM lineitem)"""


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.expr("CASE l_partkey % 3 WHEN 0 THEN concat('<p>', l_partkey, '</p>') WHEN 1 THEN concat('<math>', l_suppkey, '</math>') ELSE concat('<p>', l_suppkey, '<br/></p>', CASE WHEN l_partkey % 7 = 0 THEN '<hr/>' ELSE '' END) END")
    label = F.expr("CASE l_suppkey % 4 WHEN 0 THEN 'Footnote' WHEN 1 THEN 'Formula' ELSE 'Text' END")
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.lit("all").alias("book_id"), F.col("l_orderkey").alias("page_index"), F.col("l_linenumber").alias("item_index"), html.alias("html"), label.alias("label"), (F.col("l_returnflag") == "R").alias("is_furniture"))


@query(
    f"""WITH {_ITEMS}, b AS (SELECT *, row_number() OVER (PARTITION BY page_index ORDER BY item_index) AS o, min(CASE WHEN label = 'Footnote' THEN item_index END) OVER (PARTITION BY page_index) AS first, bool_or(html LIKE '%<hr/>%') OVER (PARTITION BY page_index) AS ruled FROM it WHERE NOT furniture),
    h AS (SELECT page_index, item_index, CASE WHEN item_index = first AND NOT ruled THEN '<hr/>' ELSE '' END || CASE WHEN label = 'Formula' THEN replace(html, '<math', '<math display="block"') ELSE html END AS h FROM b) SELECT page_index, string_agg(h, chr(10) ORDER BY item_index, h) AS body FROM h GROUP BY 1"""
)
def body_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.assemble_bodies(order_items(spark, sf_dir)).select("page_index", "body")


@query(f"WITH {_ITEMS}, t AS (SELECT page_index, item_index, trim(regexp_replace(replace(replace(html, '</p>', ' '), '<br/>', ' '), '<hr/>|<[^>]+>', CASE WHEN html LIKE '%<hr/>%' THEN '' ELSE '' END, 'g')) AS t FROM it WHERE NOT furniture) SELECT page_index, string_agg(t, ' ' ORDER BY item_index, t) AS text FROM t GROUP BY 1")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_text(order_items(spark, sf_dir)).select("page_index", "text")


@query(f"WITH {_ITEMS} SELECT page_index, CAST(item_index AS BIGINT) AS pos, trim(regexp_replace(replace(replace(html, '</p>', ' '), '<br/>', ' '), '<[^>]+>', '', 'g')) AS text FROM it WHERE furniture")
def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.split_furniture(order_items(spark, sf_dir))[1].select("page_index", F.col("pos").cast("long").alias("pos"), "text")


@query(
    f"""WITH p AS ({ORACLES["folio_parse"]}), n AS (SELECT CAST(o_custkey % 20 AS VARCHAR) AS book_id, o.o_orderkey AS page_index, {_LINES} AS text, p.folio AS number FROM orders o JOIN p USING (o_orderkey))
    SELECT book_id, page_index, number, text, number IS NOT NULL AND count(number) OVER (PARTITION BY book_id, number) <= {folios.REPEATS} AS confident FROM n"""
)
def furniture_folios(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).cast("string").alias("book_id"), F.col("o_orderkey").alias("page_index"), F.lit(0).alias("pos"), F.expr(_LINES).alias("text"))
    return folios.folios_from_furniture(lines)


@query("WITH i AS (SELECT l_suppkey AS book_id, l_linenumber * 3 + l_partkey % 3 AS page_index, l_discount * 10 + 0.3 AS share FROM lineitem), p AS (SELECT book_id, page_index, max(share) AS share FROM i WHERE page_index < 12 GROUP BY 1, 2) SELECT book_id, count(CASE WHEN share >= 0.9 THEN 1 END) > 6 AS scan FROM p GROUP BY 1")
def scan_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return verify.is_scan(li.select(F.col("l_suppkey").alias("book_id"), (F.col("l_linenumber") * 3 + F.col("l_partkey") % 3).alias("page_index"), (F.col("l_discount") * 10 + 0.3).alias("share")))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')) AS title FROM documents")
def plain_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.norm_title(F.col("text")).alias("title"))


@query(
    f"""WITH p AS (SELECT doc_id, list_filter(regexp_split_to_array(rtrim(trim(text, ' '), ','), '\\s+'), lambda x: x <> '') AS p FROM documents)
    SELECT doc_id, array_to_string(list_filter([p[-1], CASE WHEN len(p) > 1 AND rtrim(lower(p[-2]), '.') IN ({', '.join(repr(x) for x in T.PARTICLES)}) THEN p[-2] || ' ' || p[-1] END], lambda x: length(x) > 2), '|') AS forms FROM p"""
)
def surname_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.surname_forms(F.col("text")), "|").alias("forms"))


@query(
    f"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations), b AS (SELECT w, regexp_replace(w, '^[.,;:]+|[.,;:]+$', '', 'g') AS b FROM t UNION ALL SELECT concat('M', 'MMM', repeat('C', k % 4), repeat('X', k % 5), 'IV'), concat('M', 'MMM', repeat('C', k % 4), repeat('X', k % 5), 'IV') FROM range(20) r(k))
    SELECT w AS word, length(b) >= 2 AND (b = upper(b) OR b = lower(b)) AND regexp_matches(upper(b), '{T.ROMAN}') AS roman, count(*) AS n FROM b GROUP BY 1, 2"""
)
def roman_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word")).distinct()
    made = spark.range(20).select(F.concat(F.lit("MMMM"), F.repeat(F.lit("C"), (F.col("id") % 4).cast("int")), F.repeat(F.lit("X"), (F.col("id") % 5).cast("int")), F.lit("IV")).alias("word"))
    return ws.union(made).select("word", T.is_roman(F.col("word")).alias("roman")).groupBy("word", "roman").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), c AS (SELECT vec_id, list_transform(e, lambda x: x - list_sum(e) / len(e)) AS c FROM e),
    p AS (SELECT a.vec_id, list_dot_product(a.c, b.c) / sqrt(list_dot_product(a.c, a.c) * list_dot_product(b.c, b.c)) AS r FROM c a JOIN c b ON b.vec_id = a.vec_id + 1) SELECT vec_id, coalesce(r >= 0.1, false) AS same FROM p"""
)
def same_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", layout.same_picture(F.col("embedding"), F.col("other"), 0.1).alias("same"))


@query(f"WITH c AS ({ORACLES['unusual_characters']}), r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, ch) AS k FROM c) SELECT book_id, ch, n FROM r WHERE k <= 8")
def unusual_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typography.report(unusual_characters(spark, sf_dir))


@query("SELECT l_orderkey AS page_index, l_linenumber AS name, CASE WHEN l_quantity * 100 <= l_extendedprice / 10 THEN 'png' ELSE 'jpeg' END AS format FROM lineitem")
def figure_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    sized = li.select(F.lit("all").alias("book_id"), F.col("l_orderkey").alias("page_index"), F.col("l_linenumber").alias("name"), (F.col("l_quantity") * 100).alias("png_size"), (F.col("l_extendedprice") / 10).alias("jpeg_size"))
    return layout.smaller_encoding(sized).drop("book_id")


@query(r"SELECT page_id AS page_index, 0 AS item_index, CASE WHEN page_id % 3 = 0 AND page_id % 40 >= 16 THEN 'crop' ELSE 'strip' END AS action FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0")
def placeholder_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.when(F.col("page_id") % 3 == 0, '<img alt="">').when(F.col("page_id") % 2 == 0, '<p>words <img alt=""></p>').otherwise('<p><img src="a.png"></p>')
    items = table(spark, sf_dir, "pages").select(F.lit("all").alias("book_id"), F.col("page_id").alias("page_index"), F.lit(0).alias("item_index"), html.alias("html"), F.lit(40).alias("pixel_w"), (F.col("page_id") % 40).alias("pixel_h"))
    return native.placeholder_figures(items).drop("book_id")


@query(f"WITH dict AS (SELECT DISTINCT unnest({_ASCII}) AS word FROM benchmark), t AS (SELECT DISTINCT unnest({_ASCII}) AS w FROM conversations) SELECT w AS word, {_IS_WORD} AS known FROM t")
def known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    said = table(spark, sf_dir, "conversations").select(F.explode(ws).alias("word")).distinct()
    dictionary = table(spark, sf_dir, "benchmark").select(F.explode(F.array_distinct(ws)).alias("word")).distinct()
    return adjudicate.with_known(said, "word", dictionary, "known")
