import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirespark.operators import dedupe
from quirespark.operators.folios import longest_increasing


def words(k, n=60):
    r = random.Random(k)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def brute(texts, window=10):
    """The fold on whole texts, as a plain loop."""
    import re

    def shingles(t):
        w = re.sub("[^a-z0-9 ]+", " ", t.lower()).split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())

    s, verdict = [shingles(t) for t in texts], []
    for i, t in enumerate(texts):
        if len(s[i]) < 12:
            verdict.append(("unjudged", None, 0.0))
            continue
        match, best = None, 0.0
        for j in range(max(0, i - window), i):
            if verdict[j][0] == "duplicate" or len(s[j]) < 12:
                continue
            score = len(s[i] & s[j]) / min(len(s[i]), len(s[j]))
            if score > best:
                match, best = j, score
        verdict.append(("kept", match, best))
        if match is not None and best >= 0.55:
            if len(texts[match]) < len(t):
                verdict[match] = ("duplicate", i, best)
            else:
                verdict[i] = ("duplicate", match, best)
        elif match is not None and best >= 0.35:
            verdict[i] = ("borderline", match, best)
    return verdict


def pages(spark, texts, book="b"):
    return spark.createDataFrame([(book, i, t) for i, t in enumerate(texts)], "book_id string, page_index long, text string")


def test_verdicts_equal_the_plain_fold(spark):
    r = random.Random(5)
    base = [words(k) for k in range(30)]
    for k in range(4, 30, 3):
        w = base[k - r.randint(1, 4)].split()
        base[k] = " ".join(w[: r.randint(20, 60)] + words(100 + k, r.randint(0, 40)).split())
    base[7], base[11] = "too short to judge", ""
    got = {x.page_index: (x.status, x.match, round(x.score, 9)) for x in dedupe.page_verdicts(pages(spark, base)).collect()}
    assert [got[i] for i in range(30)] == [(s, m, round(c, 9)) for s, m, c in brute(base)]


def test_a_repeat_outside_the_window_is_kept(spark):
    texts = [words(k) for k in range(14)]
    texts[13] = texts[1]
    assert {x.status for x in dedupe.page_verdicts(pages(spark, texts)).collect()} == {"kept"}
    assert {x.page_index for x in dedupe.page_verdicts(pages(spark, texts), window=12).where("status = 'duplicate'").collect()} == {13}


def test_survivors_follow_chains_and_stop_in_cycles(spark):
    v = spark.createDataFrame([("b", 1, "duplicate", 2), ("b", 2, "duplicate", 3), ("b", 3, "kept", None), ("b", 4, "duplicate", 5), ("b", 5, "duplicate", 4)], "book_id string, page_index long, status string, match long")
    assert {(x.page_index, x.survivor) for x in dedupe.final_survivors(v).collect()} == {(1, 3), (2, 3), (4, 4), (5, 5)}


@pytest.mark.parametrize(("floor", "native", "n"), [(False, False, 1), (True, False, 0), (False, True, 0)])
def test_native_pages_never_drop_and_pdf_books_need_more(spark, floor, native, n):
    v = spark.createDataFrame([("b", 1, "duplicate", 0, 0.7)], "book_id string, page_index long, status string, match long, score double")
    facts = spark.createDataFrame([("b", 0, False, floor), ("b", 1, native, False)], "book_id string, page_index long, is_native boolean, from_pdf boolean")
    assert dedupe.drop_decisions(v, facts).count() == n


def test_a_turned_page_is_found_near_not_far(spark):
    full = [words(k, 80) for k in range(9)]
    stub = "".join(full[3].split()[5:12])
    full[4] = " ".join(stub[i : i + 5] for i in range(0, 40, 5))
    assert [(x.page_index, x.match) for x in dedupe.page_turns(pages(spark, full)).collect()] == [(4, 3)]
    full[8], full[3] = full[3], full[8]
    assert dedupe.page_turns(pages(spark, full)).count() == 0


def test_repeated_share(spark):
    loop = "alpha beta gamma delta epsilon zeta " * 20
    got = [x.share for x in dedupe.repeated_share(pages(spark, [loop, words(1), "few words", None])).orderBy("page_index").collect()]
    assert got == [1.0, 0.0, 0.0, 0.0]


def test_sparse_pages_leave_themselves_out_of_the_median(spark):
    texts = [words(k, 100) for k in range(5)]
    texts[2] = words(9, 20)
    got = dedupe.sparse_pages(pages(spark, [*texts, ""])).orderBy("page_index").collect()
    assert [(x.page_index, x.kind) for x in got] == [(2, "sparse"), (5, "blank")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=15), st.booleans())
def test_longest_increasing(values, strict):
    from itertools import combinations

    run = longest_increasing(values, strict)
    ok = lambda xs: all(a < b if strict else a <= b for a, b in zip(xs, xs[1:], strict=False))
    assert run == sorted(run) and ok([values[i] for i in run])
    longest = next((n for n in range(min(len(values), 9), 0, -1) if any(ok(c) for c in combinations(values, n))), 0) if len(values) <= 9 else len(run)
    assert len(run) >= longest
