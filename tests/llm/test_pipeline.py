import collections
import re

import corpus_pipeline
from quirespark.llm import quality_rules

from .conftest import prose
from .test_operators import base, brute_components, js, low, plain_tiling, shares_of, water, words


def good(text, lang, references):
    """The quality verdict as plain arithmetic."""
    n, _, _, _, _, failed = base(text)
    if failed:
        return False
    classes, plain = shares_of(text)
    c, mine = collections.Counter(plain), [r for r in references if r["lang"] == lang] or references
    hits = [[*(c[w] / n for w in r["words"]), 1 - sum(c[w] for w in r["words"]) / n] for r in mine]
    a, b = min(js(classes, r["classes"]) for r in mine), min(js(h, r["shares"]) for h, r in zip(hits, mine, strict=True))
    return a <= quality_rules.CLASS_LIMIT and b <= quality_rules.WORD_LIMIT


def plain_reference(texts):
    """The one language's reference by plain counting."""
    texts = [t for t in texts if t and len(words(t)) >= 50]
    c, n = collections.Counter(w for t in texts for w in shares_of(t)[1]), sum(len(words(t)) for t in texts)
    top = sorted(((w, k) for w, k in c.items() if w[:1].isalpha()), key=lambda x: (-x[1], x[0]))[:24]
    shares = [k / n for _, k in top]
    return {"lang": "en", "words": [w for w, _ in top], "shares": [*shares, 1 - sum(shares)], "classes": shares_of(" ".join(texts))[0]}


def test_every_stage_equals_its_brute_force(spark, tmp_path):
    rows = [(i, prose(i, 90), ["en", None, "xx"][i % 3], ["a", "b", None][i % 3], 5) for i in range(60)]
    item = prose(700, 30)
    texts = [prose(3, 90), prose(4, 90) + " and", prose(5, 90).upper().replace(" ", "!! "), prose(6, 20), None, "", f"{prose(900, 60)} {item} {prose(901, 60)}", " ".join(w + "###" for w in prose(8, 90).split())]
    rows += [(100 + i, t, "en", "a", 5) for i, t in enumerate(texts)] + [(300 + i, prose(1000 + i, 90), "en", "a", 5) for i in range(100)]
    references = [plain_reference([t for _, t, lang, _, _ in rows if lang == "en"])]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want, columns = {i: (t, s) for i, t, lang, s, _ in rows if good(t, lang, references)}, documents.columns
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert docs.columns == columns
        got = docs.collect()
        seen.append(name)
        if k == 1:
            c = brute_components([(i, t) for i, (t, _) in want.items()], 5, 80)
            want = {i: v for i, v in want.items() if c[i][1] == i}
        if k == 2:
            split = lambda t: re.findall(r"[^\W_]+", low(t))
            want = {i: v for i, v in want.items() if sum(x[2] for x in plain_tiling(split(item), split(v[0]), 5)) < 0.5 * len(split(item))}
        if k < 3:
            assert sorted((r.doc_id, r.text) for r in got) == sorted((i, t) for i, (t, _) in want.items()), name
    assert len(want) > 130 and not {100, 101, 102, 103, 104, 105, 106, 107} & set(want)
    copies = collections.Counter(r.doc_id for r in got)
    sizes = collections.Counter()
    for t, s in want.values():
        sizes[s] += len(words(t))
    target = water(sizes)
    for s in sizes:
        taken = sum(copies[i] * len(words(t)) for i, (t, x) in want.items() if x == s)
        assert abs(taken - target[s]) <= 95
    shard_of = collections.defaultdict(set)
    for r in got:
        shard_of[want[r.doc_id][0]].add(r.shard)
    assert all(len(x) == 1 for x in shard_of.values())
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in again) == sorted((r.doc_id, r.shard, r.slot) for r in got)
