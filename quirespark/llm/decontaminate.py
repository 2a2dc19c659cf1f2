"""Benchmark decontamination by greedy string tiling.

1. Every item of the benchmark has seeds: the hashes of its runs of `min_match` words (rolling hashes in the manner of
   Karp and Rabin; an item with fewer words has one seed, all of it).
2. Texts keep the places whose run is possibly a seed, by a bit table of bounded size that is built in the cluster, and
   are joined with the items on the seeds. An item that is found shares a least number of seeds, so that its most
   common ones, one fewer than that, take no part in the join (prefix filter).
3. For each pair of a text and an item, seeds on one diagonal join to maximal matches; the longest match whose words are
   not yet marked becomes a tile and is marked, and what overlaps is trimmed and tried again, until no match of
   min_match words is left. An item is found in a text if its tiles cover enough of its words, in whatever order they
   stand. Equal texts are tiled once.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, column_name
from .kernel import Words, iter_words, mix, separators, shingle_hashes

#: Bits of the bit table for each seed, so that few other runs pass, and the power of two that bounds the table (16 MB).
BITS_PER_SEED, MOST_BITS = 1024, 27


def runs(item: np.ndarray, places: np.ndarray, seeds: np.ndarray, min_match: int) -> Iterator[tuple[int, int, int]]:
    """Maximal matches (item position, text position, words), from the item's seeds and a text's seeds at ascending places.

    The item is walked seed by seed, with one open match for each diagonal, so that memory is bounded by the text's places.
    """
    order = np.lexsort((places, seeds))
    keys, at = seeds[order], places[order]
    lo, hi = np.searchsorted(keys, item, "left"), np.searchsorted(keys, item, "right")
    diagonals, begin = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for p in range(len(item) + 1):
        now = at[lo[p] : hi[p]] - p if p < len(item) else np.zeros(0, np.int64)
        if not len(now) and not len(diagonals):
            continue
        spot = np.searchsorted(diagonals, now)
        known = spot < len(diagonals)
        known[known] = diagonals[spot[known]] == now[known]
        start = np.full(len(now), p, np.int64)
        start[known] = begin[spot[known]]
        over = np.ones(len(diagonals), bool)
        over[spot[known]] = False
        for d, a in zip(diagonals[over].tolist(), begin[over].tolist(), strict=True):
            yield a, a + d, p - a - 1 + min_match
        diagonals, begin = now, start


def tiles(item: np.ndarray, places: np.ndarray, seeds: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of an item by a text: (item position, text position, length), longest first; ties go to smaller positions."""
    heap = [(-n, a, b) for a, b, n in runs(item, places, seeds, min_match)]
    heapq.heapify(heap)
    free_item = np.ones(len(item) + min_match - 1, bool)
    free_text = np.ones(int(places[-1]) + min_match if len(places) else 0, bool)
    out: list[tuple[int, int, int]] = []
    left = len(free_item)
    while heap and left >= min_match:
        n, a, b = heapq.heappop(heap)
        free = free_item[a : a - n] & free_text[b : b - n]
        if free.all():
            out.append((a, b, -n))
            free_item[a : a - n] = free_text[b : b - n] = False
            left += n
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for k, stop in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # the parts that are still free
            if stop - k >= min_match:
                heapq.heappush(heap, (k - stop, a + k, b + k))
    return out


def _seeds(hashes: np.ndarray, k: int, min_match: int) -> np.ndarray:
    """Seeds of k words; those of short items are kept apart from whole ones."""
    s = shingle_hashes(hashes, k)
    return s if k == min_match else mix(s + np.uint64(k))


def _items(batches: Iterator[pa.RecordBatch], min_match: int) -> Iterator[pa.RecordBatch]:
    """Items with words: item, words, k (words of a seed), seeds in order."""
    for batch in batches:
        rows = []
        for w in iter_words(batch.column(1), separators(punctuation=True)):
            for i, (lo, hi) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
                if hi > lo:
                    k = min(min_match, hi - lo)
                    rows.append((w.first + i, hi - lo, k, _seeds(w.hashes[lo:hi], k, min_match).view(np.int64)))
        if rows:
            at, n, k, seeds = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(seeds, pa.list_(pa.int64()))], ["item", "words", "k", "seeds"])


def _marked(w: Words, table: np.ndarray, bits: int, lengths: list[int], min_match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, seed) of the runs that the table knows; of a short item's seed only the first place in a document."""
    docs, places, seeds = [], [], []
    for k in lengths:
        s = _seeds(w.hashes, k, min_match)
        slot = s >> np.uint64(64 - bits)
        at = np.flatnonzero(table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
        doc = np.searchsorted(w.bounds, at, "right") - 1
        ok = at + k <= w.bounds[doc + 1]  # a run must not leave its document
        at, doc = at[ok], doc[ok]
        if k < min_match and len(at):
            _, first = np.unique(np.stack([doc.astype(np.uint64), s[at]]), axis=1, return_index=True)
            at, doc = at[np.sort(first)], doc[np.sort(first)]
        docs.append(doc)
        places.append(at - w.bounds[doc])
        seeds.append(s[at])
    doc = np.concatenate(docs)
    order = np.lexsort((np.concatenate(places), doc))
    return doc[order], np.concatenate(places)[order], np.concatenate(seeds)[order]


def _tile(batches: Iterator[pa.RecordBatch], coverage: float, min_match: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, item, words, k, mine, places, seeds = (batch.column(i) for i in range(7))
        rows = []
        for i in range(batch.num_rows):
            n, kk = words[i].as_py(), k[i].as_py()
            have = np.asarray(seeds[i].values).view(np.uint64)
            wanted = np.asarray(mine[i].values).view(np.uint64)
            some = np.isin(have, wanted)
            found = tiles(wanted, np.asarray(places[i].values)[some], have[some], kk)
            covered = sum(x[2] for x in found)
            if covered >= coverage * n:
                rows.append((i, covered, len(found)))
        if rows:
            r, covered, count = zip(*rows, strict=True)
            take = pa.array(r)
            yield pa.RecordBatch.from_arrays([at.take(take), item.take(take), words.take(take), pa.array(covered, pa.int64()), pa.array(count, pa.int64())], ["at", "item", "item_words", "covered_words", "n_tiles"])


def _found(ws: Workspace, docs: DataFrame, benchmark: DataFrame, coverage: float, min_match: int) -> tuple[DataFrame, DataFrame]:
    """(texts with an item: at, item_id, item_words, covered_words, n_tiles; marked rows: doc_id, at), from docs (doc_id, text)
    and benchmark (item_id, text); `at` is the MD5 of a text."""
    known = benchmark.where("text is not null and item_id is not null").groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("repeats"))
    known = ws.write(known.withColumn("item", F.monotonically_increasing_id()), "benchmark")
    items = ws.write(known.select("item", "text").mapInArrow(lambda it: _items(it, min_match), "item long, words long, k long, seeds array<long>"), "items")
    postings = ws.write(items.select("item", "words", "k", F.explode("seeds").alias("seed")).groupBy("item", "words", "k", "seed").agg(F.count(F.lit(1)).alias("m")), "postings")

    n, lengths = postings.agg(F.count(F.lit(1)), F.collect_set("k")).first()  # lengths: at most min_match
    bits = min(MOST_BITS, max(16, int(n * BITS_PER_SEED).bit_length()))
    slot = F.call_function("shiftrightunsigned", F.col("seed"), F.lit(64 - bits))
    word = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    filled = postings.groupBy(F.floor(slot / 64).alias("i")).agg(F.bit_or(word).alias("w")).toArrow()  # at most 2**bits / 64 rows
    table = np.zeros(1 << (bits - 6), np.int64)
    table[np.asarray(filled["i"].combine_chunks())] = np.asarray(filled["w"].combine_chunks())
    sent = docs.sparkSession.sparkContext.broadcast(table.view(np.uint8))
    lengths = sorted(lengths)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in iter_words(batch.column(1), separators(punctuation=True)):
                doc, places, seeds = _marked(w, sent.value, bits, lengths, min_match) if lengths else (np.zeros(0, np.int64),) * 3
                if not len(doc):
                    continue
                which, start = np.unique(doc, return_index=True)
                cut = pa.array(np.append(start, len(doc)), pa.int32())
                rows = pa.array(w.first + which)
                texts = batch.column(1).take(rows).to_pylist()
                arrays = [batch.column(0).take(rows), pa.array([hashlib.md5(t.encode()).digest() for t in texts], pa.binary())]
                arrays += [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (places.astype(np.int64), seeds.view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "at", "places", "seeds"])

    marked = ws.write(docs.mapInArrow(mark, "doc_id long, at binary, places array<long>, seeds array<long>"), "marked")
    texts = ws.write(marked.groupBy("at").agg(F.first("places").alias("places"), F.first("seeds").alias("seeds")), "texts")
    # of an item's seeds by falling number of items that have them, the first ones are skipped, in all fewer than `least` places
    least = F.ceil(F.ceil(F.col("words") * coverage - F.lit(1e-9)) / F.col("k"))
    common = postings.groupBy("seed").agg(F.count(F.lit(1)).alias("items"))
    before = F.sum("m").over(Window.partitionBy("item").orderBy(F.col("items").desc(), "seed").rowsBetween(Window.unboundedPreceding, 0))
    probes = ws.write(postings.join(common, "seed").withColumn("before", before).where(F.col("before") >= F.greatest(least, F.lit(1))).select("seed", "item"), "probes")
    hits = ws.write(texts.select("at", F.explode(F.array_distinct("seeds")).alias("seed")).join(probes, "seed").select("at", "item").distinct(), "pairs")
    pairs = hits.join(items, "item").withColumnRenamed("seeds", "mine").join(texts, "at").select("at", "item", "words", "k", "mine", "places", "seeds")
    found = ws.write(pairs.mapInArrow(lambda it: _tile(it, coverage, min_match), "at binary, item long, item_words long, covered_words long, n_tiles long"), "found")
    named = found.join(known.select("item", "item_id", "repeats"), "item").withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    return named.select("at", "item_id", "item_words", "covered_words", "n_tiles"), marked.select("doc_id", "at")


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", coverage: float = 0.5, min_match: int = 5) -> DataFrame:
    """One row per benchmark item found in a document: doc_id, item_id, item_words, covered_words, coverage, n_tiles.

    Words are runs of letters and digits, A-Z lower-cased. An item of fewer than min_match words is found where all of
    them stand in a row; one without words is not. Null and empty texts contain nothing; null items are left out. Rows
    that repeat a document or an item give rows that repeat. Other columns are ignored, whatever their names; an empty
    table on either side gives an empty result. Jobs run when this is called.
    """
    ws = Workspace(docs.sparkSession, "decontaminate")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found, marked = _found(ws, slim, benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")), coverage, min_match)
    return marked.join(found, "at").select("doc_id", "item_id", "item_words", "covered_words", (F.col("covered_words") / F.col("item_words")).alias("coverage"), "n_tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", coverage: float = 0.5, min_match: int = 5) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; columns and other rows are unchanged.

    Null and empty texts stay, repeated rows stay or go together, columns may have any names, an empty benchmark removes
    nothing. Texts that go are few; they are joined by digest, by broadcast where their table is small enough.
    """
    ws = Workspace(docs.sparkSession, "decontaminate")
    slim = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found, _ = _found(ws, slim, benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")), coverage, min_match)
    gone = column_name(docs, "gone_")
    texts = ws.write(found.select(F.col("at").alias(gone)).distinct(), "gone")
    return docs.join(texts, F.unhex(F.md5(F.col(text_col).cast("string").cast("binary"))) == F.col(gone), "left_anti")
