import random

import pytest

WORD = "the of and to in a is that for it as was with be by on he at are this or from an his".split()


def prose(seed, n=120):
    r = random.Random(seed)
    out, at = [], 0
    for _ in range(n):
        out.append(r.choice(WORD) if r.random() < 0.45 else "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(3, 9))))
        at += 1
        if at > 9 and r.random() < 0.15:
            out[-1] += ".\n" if r.random() < 0.4 else "."
            at = 0
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def corpus(spark):
    """Ordinary, copied, edited, null, empty, blank, long and odd texts, with a column that clashes with the operators' own."""
    texts = {i: prose(i) for i in range(40)}
    w = texts[3].split(" ")
    texts[40], texts[41] = texts[3], texts[3].upper()
    texts[42] = " ".join([*w[:60], "changed", *w[61:]])
    texts[43] = " ".join(w[:60])
    texts |= {44: None, 45: "", 46: " \n\t ", 47: "one two", 48: "one two", 49: prose(99, 6000), 50: "\x0b".join(texts[5].split(" ")), 51: "日本 語 テスト " * 30, 52: "of of of of of " * 40}
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "c"][i % 4], i) for i, t in texts.items()]
    rows.append(rows[7])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, Size long")


@pytest.fixture
def none(corpus):
    return corpus.where("false")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]
