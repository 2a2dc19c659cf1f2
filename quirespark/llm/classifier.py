"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a Gaussian over the statistics; its covariance is shrunk towards the pooled covariance and then towards
a multiple of the identity, and its Cholesky factor is computed once. A score is the logistic of the difference of the
classes' log densities (Mahalanobis distances by triangular solves) plus log priors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .kernel import iter_words, separators, shingle_hashes, text_buffer

FEATURES = (
    "words", "word_length", "line_words", "distinct_words", "repeated_triples", "commonest_word", "repeated_lines",
    "capitals", "digits", "marks", "stops", "exclamations", "short_words",
)
_CLASS = np.zeros(256, np.int64)  # of bytes: 0 other, 1 capital, 2 digit, 3 mark, 4 stop, 5 exclamation
_CLASS[65:91], _CLASS[48:58] = 1, 2
_CLASS[[ord(c) for c in "#*$%&|<>@^_=+~/\\[]{}"]] = 3
_CLASS[[ord(c) for c in ".,;:"]] = 4
_CLASS[[ord(c) for c in "!?"]] = 5


def _share(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.sqrt(x / np.maximum(n, 1))


def statistics(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; shares as square roots, sizes as logarithms. An empty text has zeros."""
    sep, out = separators(), [np.zeros((0, len(FEATURES)))]
    data, offsets = text_buffer(column)
    for w in iter_words(column, sep):
        docs = len(w.bounds) - 1
        base = int(offsets[w.first])
        buf = data[base : base + int(w.text_starts[-1])]
        sizes = np.diff(w.text_starts)
        kinds = np.bincount(np.repeat(np.arange(docs) * 6, sizes) + _CLASS[buf], minlength=docs * 6).reshape(docs, 6)
        begins = (buf & 0xC0) != 0x80
        chars = np.diff(np.concatenate([[0], np.cumsum(begins)])[w.text_starts])
        n = np.diff(w.bounds)
        at = np.concatenate([[0], np.cumsum(begins)])
        length = at[w.ends] - at[w.starts]
        total = np.concatenate([[0], np.cumsum(length)])
        short = np.concatenate([[0], np.cumsum(length <= 3)])
        feeds = np.concatenate([[0], np.cumsum(buf == 10)])
        lines = np.diff(feeds[w.text_starts]) + 1
        triples = shingle_hashes(w.hashes, 3)
        rows = np.zeros((docs, len(FEATURES)))
        line_of = feeds[w.starts]
        for i in range(docs):
            lo, hi = w.bounds[i], w.bounds[i + 1]
            if hi == lo:
                continue
            _, count = np.unique(w.hashes[lo:hi], return_counts=True)
            rows[i, 3], rows[i, 5] = len(count), count.max()
            if hi - lo > 2:
                _, count = np.unique(triples[lo : hi - 2], return_counts=True)
                rows[i, 4] = count[count > 1].sum()
            first = np.flatnonzero(np.concatenate([[True], np.diff(line_of[lo:hi]) > 0]))
            sums = np.add.reduceat(w.hashes[lo:hi] * np.uint64(3) + np.arange(hi - lo, dtype=np.uint64) - np.repeat(first, np.diff([*first, hi - lo])).astype(np.uint64), first)
            rows[i, 6] = len(sums) - len(np.unique(sums))
        used = total[w.bounds[1:]] - total[w.bounds[:-1]]
        rows[:, 0] = np.log1p(n)
        rows[:, 1] = np.log1p(used / np.maximum(n, 1))
        rows[:, 2] = np.log1p(n / lines)
        for j in (3, 5):
            rows[:, j] = _share(rows[:, j], n)
        rows[:, 4] = _share(rows[:, 4], n - 2)
        rows[:, 6] = _share(rows[:, 6], lines)
        for j, k in ((7, 1), (8, 2), (9, 3), (10, 4), (11, 5)):
            rows[:, j] = _share(kinds[:, k], chars)
        rows[:, 12] = _share(short[w.bounds[1:]] - short[w.bounds[:-1]], n)
        out.append(rows)
    return np.concatenate(out)


class Discriminant(NamedTuple):
    """Means, inverse Cholesky factors, log determinants and log priors of the classes 0 and 1."""

    means: np.ndarray
    whiteners: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        density = [self.log_priors[c] - 0.5 * (((x - self.means[c]) @ self.whiteners[c].T) ** 2).sum(axis=1) - 0.5 * self.log_dets[c] for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(n: np.ndarray, sums: np.ndarray, products: np.ndarray, to_pooled: float = 0.2, to_identity: float = 0.02) -> Discriminant:
    """From the classes' counts (2), sums (2, p) and sums of outer products (2, p, p).

    A class without rows has the overall mean and covariance, so that only the priors tell; without any rows every score
    is one half.
    """
    p = sums.shape[1]
    total = max(n.sum(), 1)
    overall = sums.sum(axis=0) / total
    means = np.array([sums[c] / n[c] if n[c] else overall for c in (0, 1)])
    within = [products[c] - n[c] * np.outer(means[c], means[c]) if n[c] else np.zeros((p, p)) for c in (0, 1)]
    pooled = sum(within) / total
    whiteners, dets = [], []
    for c in (0, 1):
        own = within[c] / n[c] if n[c] > 1 else pooled
        s = (1 - to_pooled) * own + to_pooled * pooled
        s = (1 - to_identity) * s + (to_identity * np.trace(s) / p + 1e-9) * np.eye(p)
        root = np.linalg.cholesky((s + s.T) / 2)
        whiteners.append(np.linalg.inv(root))
        dets.append(2 * np.log(np.diag(root)).sum())
    return Discriminant(means, np.array(whiteners), np.array(dets), np.log((n + 1) / (n.sum() + 2)))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, to_pooled: float = 0.2, to_identity: float = 0.02) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    The model learns from all labelled documents whose crc32(doc_id as text) mod 5 is not 0; the others are held out.
    Only sums over the labelled rows (of fixed size) reach the driver. Labels other than 0 and 1, null labels and labels
    of unknown documents are ignored; a document with both labels counts as 0. A null text is empty. A null doc_id is
    not held out and never learnt from. Other columns are ignored, whatever their names.
    """
    spark, p = docs.sparkSession, len(FEATURES)
    ws = Workspace(spark, "classifier")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "x"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    measured = ws.write(slim.mapInArrow(measure, "doc_id long, x binary"), "statistics")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").where(~held).groupBy("doc_id").agg(F.min("y").alias("y"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + p + p * p))
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(-1, p)
            y = np.asarray(batch.column(1))
            for c in (0, 1):
                z = x[y == c]
                total[c] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    sums = measured.join(known, "doc_id").select("x", "y").mapInArrow(moments, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    total = np.zeros(2 * (1 + p + p * p))
    for r in sums.collect():  # a fixed number of rows
        total[r[0]] = round(r[1], 9)
    total = total.reshape(2, -1)
    model = fit(total[:, 0], total[:, 1 : 1 + p], total[:, 1 + p :].reshape(2, p, p), to_pooled, to_identity)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, p)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    scored = measured.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
