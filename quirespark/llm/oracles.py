"""SQL of the queries that SQL can express, for the correctness check."""

from __future__ import annotations

from .quality_rules import CLASS_LIMIT, WORD_LIMIT

_SEP = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"


def _distance(p: str, q: str) -> str:
    half = "CASE WHEN {a} > 0 THEN {a} * log2({a} / (({x} + {y}) / 2)) ELSE 0 END"
    x, y = f"{p}[i]", f"{q}[i]"
    term = f"({half.format(a=x, x=x, y=y)} + {half.format(a=y, x=x, y=y)}) / 2"
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, len({q}) + 1), lambda i: {term}))))"


def quality_rules_sql() -> str:
    classes = ", ".join(f"sum(kc[{i}]) / sum(nc)" for i in range(1, 7))
    return rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS t FROM documents),
    w AS (SELECT id, doc_id, lang, t, regexp_extract_all(t, '{_WORD}') AS ws, regexp_replace(t, '{_SEP}', '', 'g') AS c0, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
    a AS (SELECT *, regexp_replace(c0, '\p{{Ll}}+', '', 'g') AS c1 FROM w), b AS (SELECT *, regexp_replace(c1, '\p{{L}}+', '', 'g') AS c2 FROM a), c AS (SELECT *, regexp_replace(c2, '\p{{Nd}}+', '', 'g') AS c3 FROM b),
    e AS (SELECT *, regexp_replace(c3, '[.,;:!?''"()-]+', '', 'g') AS c4 FROM c), f AS (SELECT *, regexp_replace(c4, '[[:punct:]]+', '', 'g') AS c5, list_transform(ws, lambda x: lower(rtrim(x, '.,;:'))) AS nw FROM e),
    g AS (SELECT id, doc_id, lang, nw, len(ws) AS n, length(c0) AS nc, length(c0) - length(regexp_replace(c0, '[#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
      [length(c0) - length(c1), length(c1) - length(c2), length(c2) - length(c3), length(c3) - length(c4), length(c4) - length(c5), length(c5)] AS kc FROM f),
    lt AS (SELECT lang, sum(n) AS n, [{classes}] AS cls FROM g WHERE n >= 50 AND lang IS NOT NULL GROUP BY 1 HAVING sum(n) >= 10000),
    rw AS (SELECT lang, x, count(*) AS c FROM (SELECT lang, unnest(nw) AS x FROM g WHERE n >= 50) WHERE regexp_matches(x, '^\p{{L}}') GROUP BY 1, 2),
    rk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, x) AS k FROM rw), rl AS (SELECT lt.lang, any_value(cls) AS cls, list(x ORDER BY k) AS common, list(c / lt.n ORDER BY k) AS sh FROM rk JOIN lt USING (lang) WHERE k <= 24 GROUP BY 1),
    rf AS (SELECT lang AS of_lang, cls, common, list_append(sh, 1 - list_sum(sh)) AS sh FROM rl),
    m AS (SELECT g.*, rf.* FROM g LEFT JOIN rf ON rf.of_lang = g.lang OR g.lang IS NULL OR g.lang NOT IN (SELECT of_lang FROM rf)),
    h AS (SELECT *, list_transform(common, lambda k: len(list_filter(nw, lambda x: x = k))) AS hit, list_transform(kc, lambda x: x / greatest(nc, 1)) AS cs FROM m),
    s AS (SELECT *, list_transform(list_append(hit, n - list_sum(hit)), lambda x: x / greatest(n, 1)) AS hs FROM h),
    q AS (SELECT id, min(CASE WHEN nc >= 150 THEN {_distance("cs", "cls")} END) AS cd, min(CASE WHEN n >= 50 THEN {_distance("hs", "sh")} END) AS wd FROM s GROUP BY 1),
    r1 AS (SELECT id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 4), r2 AS (SELECT id, i, count(*) OVER (PARTITION BY id, ws[i], ws[i + 1], ws[i + 2]) AS k FROM r1),
    r3 AS (SELECT DISTINCT id, i + j AS p FROM r2, (SELECT unnest([0, 1, 2]) AS j) WHERE k > 1), r AS (SELECT id, count(*) AS n_repeat_words FROM r3 GROUP BY 1),
    y AS (SELECT doc_id, n AS n_words, nc AS word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n AS base_failed, cd, wd FROM g JOIN q USING (id) LEFT JOIN r USING (id))
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
      NOT base_failed AND coalesce(cd, 0) <= {CLASS_LIMIT} AND coalesce(wd, 0) <= {WORD_LIMIT} AS kept, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM y"""


def line_dedup_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    measured = rf"regexp_extract_all(translate(s, '{upper}', '{lower}'), '{_WORD}') AS ws, length(s) - length(regexp_replace(s, '^{_SEP}', '')) AS lead, length(regexp_replace(s, '{_SEP}$', '')) AS fin"
    return rf"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), u AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS k, ls FROM l), x AS (SELECT doc_id, k, ls[k] AS s FROM u),
    o AS (SELECT *, coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM x), w AS (SELECT doc_id, k, off, s, {measured} FROM o),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS unit FROM w WHERE len(ws) > 0),
    p0 AS (SELECT doc_id, unit, off, len(ws) AS n, string_split(regexp_replace(s, '([.!?])({_SEP})', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM f), p1 AS (SELECT doc_id, unit, off, n, unnest(range(1, len(ps) + 1)) AS j, ps FROM p0), p2 AS (SELECT doc_id, unit, off, n, j, ps[j] AS s FROM p1),
    p3 AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY doc_id, unit ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS more FROM p2), p4 AS (SELECT doc_id, unit, j, n, off + more AS off, {measured} FROM p3),
    q AS (SELECT doc_id, unit, -1 AS part, off, lead, fin, ws FROM f WHERE len(ws) >= 5 UNION ALL SELECT doc_id, unit, j - 1, off, lead, fin, ws FROM p4 WHERE len(ws) >= 8 AND len(ws) < n),
    g AS (SELECT *, array_to_string(ws, ' ') AS key, row_number() OVER (PARTITION BY doc_id, array_to_string(ws, ' ') ORDER BY off + lead) AS again FROM q), m AS (SELECT key, min(doc_id) AS first_doc_id FROM g GROUP BY 1),
    pl AS (SELECT doc_id, unit, part, row_number() OVER (PARTITION BY doc_id ORDER BY unit, part) - 1 AS place FROM q WHERE part >= 0 OR NOT EXISTS (SELECT 1 FROM q o WHERE o.doc_id = q.doc_id AND o.unit = q.unit AND o.part >= 0)),
    sp AS (SELECT doc_id, unit, min(place) AS a, max(place) AS b FROM pl GROUP BY 1, 2),
    z AS (SELECT doc_id, unit, part, CAST(off + lead AS BIGINT) AS start_char, CAST(off + fin AS BIGINT) AS end_char, CAST(len(ws) AS BIGINT) AS n_words, first_doc_id FROM g JOIN m USING (key) WHERE again > 1 OR doc_id <> first_doc_id),
    y AS (SELECT z.*, CASE WHEN z.part < 0 THEN a ELSE place END AS a, CASE WHEN z.part < 0 THEN b ELSE place END AS b FROM z JOIN sp USING (doc_id, unit) LEFT JOIN pl ON pl.doc_id = z.doc_id AND pl.unit = z.unit AND pl.part = z.part
      WHERE z.part < 0 OR NOT EXISTS (SELECT 1 FROM z o WHERE o.doc_id = z.doc_id AND o.unit = z.unit AND o.part < 0)),
    i AS (SELECT *, CASE WHEN a > coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), -2) + 1 THEN 1 ELSE 0 END AS new FROM y), k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS passage FROM i),
    s AS (SELECT *, sum(n_words) OVER (PARTITION BY doc_id, passage) AS total FROM k)
    SELECT doc_id, unit, CAST(part AS BIGINT) AS part, start_char, end_char, n_words, first_doc_id FROM s WHERE total >= 15"""
