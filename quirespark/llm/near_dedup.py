"""MinHash near-duplicate detection by a signature-coordinate inverted join.

1. Each text becomes its set of word shingles (64-bit hashes), a digest of the set, and a signature of 64 minima.
   Equal sets are one class; a class is represented by its smallest document.
2. Representatives are posted under (coordinate, value) for the first POSTED coordinates. Values that only one
   representative has cannot match, so a representative with fewer than POSTED_MATCHES shared values is skipped whole;
   of the others only the f - POSTED_MATCHES + 1 rarest shared values are posted (prefix filter under one global order).
   Two signatures that agree in POSTED_MATCHES of the posted coordinates meet in at least one such list.
3. Pairs that meet in a list have their collisions counted, coordinate by coordinate; a pair is a candidate if its set
   sizes allow the similarity and MATCHES of 64 coordinates collide. Candidates are confirmed on full shingle sets.
   First each representative is held against the heads (smallest members) of its lists; what that links is one
   component. Then lists with several components are compared across components only, in blocks of bounded size: once
   for each member's nearest partner, then whole. There a pair must also agree in a sketch of 512 bins. So a large group
   of copies costs about its size, not its square, with or without outsiders in its lists.

A pair at similarity 0.8 misses step 2 with probability about 1e-6 (binomial: fewer than 12 of 32 coordinates agree)
and step 3 with about 4e-6 (fewer than 34 of 64; five deviations below the expected bins is rarer); all fall fast above 0.8. No list, bucket or candidate is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, column_name, components
from .kernel import iter_words, mix, separators, shingle_sets

COORDINATES, MATCHES = 64, 34
POSTED, POSTED_MATCHES = 32, 12
#: Bins of the sketch that lists with several components are compared by, and the standard deviations below the expected
#: share of equal bins that a pair may be. Bins sample the union without replacement, so small sets are judged sharply.
BINS, DEVIATIONS = 512, 5.0
#: Members of a list that one comparison step holds from either side.
BLOCK = 512

_rng = np.random.Generator(np.random.PCG64(20240607))
_A = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Low 32 bits of the minimum of each of the 64 hash functions."""
    least = np.full(COORDINATES, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        np.minimum(least, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return mix(least).astype(np.uint32)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    sep = separators()
    for batch in batches:
        for w in iter_words(batch.column(1), sep):
            sets = list(shingle_sets(w, k))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([_sketch(s).tobytes() for s in sets], pa.binary())], ["doc_id", "shingles", "sketch"])


def _signatures(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    sep = separators()
    for batch in batches:
        for w in iter_words(batch.column(1), sep):
            n, digests, sigs = [], [], []
            for s in shingle_sets(w, k):
                n.append(len(s))
                digests.append(np.array([s.sum(), np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))), len(s)], np.uint64).tobytes() if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, len(n)), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, rep) of the posted coordinates; a token is coordinate and value in one integer."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)[:, :POSTED]
        for at in range(0, len(sig), 4096):
            part = sig[at : at + 4096].astype(np.int64) | (np.arange(POSTED, dtype=np.int64) << 32)
            reps = np.asarray(batch.column(0))[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part.ravel()), pa.array(np.repeat(reps, POSTED))], ["token", "rep"])


def _sizes_allow(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _best_heads(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and signatures allow a link, with the number of matching coordinates."""
    for batch in batches:
        a, b, n, m, x, y = (batch.column(i) for i in range(6))
        s, t = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, COORDINATES) for c in (x, y))
        hits = (s == t).sum(axis=1)
        ok = (hits >= MATCHES) & _sizes_allow(np.asarray(n), np.asarray(m), percent)
        yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok)), pa.array(hits[ok], pa.int64())], ["a", "b", "hits"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Those pairs whose full sets have the similarity."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(s) > len(t):
                s, t = t, s
            both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
            ok.append(100 * both >= percent * (len(s) + len(t) - both))
        ok = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["u", "v"])


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """One byte for each of BINS bins: 0 if empty, else a fingerprint of the bin's least hash."""
    v = np.sort(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)))
    bins, at = np.unique(v >> np.uint64(64 - BINS.bit_length() + 1), return_index=True)
    out = np.zeros(BINS, np.uint8)
    out[bins.astype(np.int64)] = (v[at] & np.uint64(0xFFFF)) % np.uint64(255) + np.uint64(1)
    return out


def _across(batches: Iterator[pa.RecordBatch], percent: int, best: bool) -> Iterator[pa.RecordBatch]:
    """Candidate pairs between components; with `best` only the nearest partner of each member of a step.

    Rows come sorted by (token, bi, bj), so that a step's rows are contiguous. A pair that meets under several posted
    values is taken at the first of them.
    """

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        rep, comp, n, block, posted = (np.asarray(rows.column(c).combine_chunks()) for c in ("rep", "comp", "n", "block", "posted"))
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        is_posted = (posted[:, None] >> np.arange(POSTED)) & 1 == 1
        token, bi, bj = (rows.column(c)[0].as_py() for c in ("token", "bi", "bj"))
        left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        out_a, out_b = [], []
        for i in left:
            j = right[right > i] if bi == bj else right
            j = j[(comp[j] != comp[i]) & _sizes_allow(n[j], n[i], percent)]
            if not len(j):
                continue
            same = sig[j] == sig[i]
            ok = same.sum(axis=1) >= MATCHES
            if not best:
                ok &= (same[:, :POSTED] & is_posted[j] & is_posted[i]).argmax(axis=1) == token >> 32
            j = j[ok]
            x, y = sketch[j], sketch[i]
            hits, bins = ((x == y) & (y > 0)).sum(axis=1), ((x > 0) | (y > 0)).sum(axis=1)
            share, union = percent / 100, (n[j] + n[i]) / (1 + percent / 100)
            spread = np.sqrt(share * (1 - share) / bins * np.maximum(1 - bins / np.maximum(union, bins), 0.02))
            ok = hits >= (share - DEVIATIONS * spread) * bins
            j = j[ok]
            if best and len(j):
                j = j[[(hits[ok] / bins[ok]).argmax()]]
            out_a += [rep[i]] * len(j)
            out_b += rep[j].tolist()
        a, b = np.array(out_a, np.int64), np.array(out_b, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        key = [np.asarray(t.column(c).combine_chunks()) for c in ("token", "bi", "bj")]
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in key], axis=0)) + 1
        for lo, hi in zip([0, *cuts[:-1]], cuts, strict=False):
            yield pairs(t.slice(lo, hi - lo))
        rest = t.slice(int(cuts[-1])) if len(cuts) else t
    if rest is not None and rest.num_rows:
        yield pairs(rest)


def _steps(ws: Workspace, labelled: DataFrame) -> DataFrame:
    """(rep, posted, token, comp, block, bi, bj): the members of lists (rep, posted, token, comp) in every comparison of two
    blocks of about BLOCK members that can hold members of different components.

    A component with more than BLOCK members of a list has blocks of its own, which are not compared with each other; the
    others share blocks. So a list with one large component and a few outsiders costs about its size, not its square.
    """
    parts = ws.write(labelled.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m")), "parts")
    mixed = ws.write(parts.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.coalesce(F.sum(F.when(F.col("m") <= BLOCK, F.col("m"))), F.lit(0)).alias("small")).where("comps > 1"), "mixed")
    shared = F.ceil(F.col("small") / BLOCK)  # blocks 0, 1, ... of a list are shared
    large = parts.where(F.col("m") > BLOCK).join(mixed, "token")
    number = Window.partitionBy("token").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1)  # fewer than members / BLOCK rows
    own = F.ceil(F.col("m") / BLOCK)
    large = ws.write(large.select("token", "comp", (shared + F.coalesce(F.sum(own).over(number), F.lit(0))).alias("first"), own.alias("blocks")), "large")
    spans = mixed.select("token", F.lit(None).cast("long").alias("comp"), F.lit(0).cast("long").alias("first"), shared.alias("blocks")).where("blocks > 0").unionByName(large)
    spans = ws.write(spans.select("token", "comp", F.col("first").cast("long").alias("first"), F.col("blocks").cast("long").alias("blocks")), "spans")
    every = lambda first, n: F.explode(F.sequence(F.col(first), F.col(first) + F.col(n) - 1))
    other = spans.select("token", F.col("first").alias("first2"), F.col("blocks").alias("blocks2"))
    pairs = spans.join(other, "token").where((F.col("first") < F.col("first2")) | (F.col("comp").isNull() & (F.col("first") == F.col("first2"))))
    pairs = pairs.withColumn("bi", every("first", "blocks")).withColumn("bj", every("first2", "blocks2")).where("bi <= bj").select("token", "bi", "bj")
    pairs = ws.write(pairs, "block_pairs")
    # a block takes part in steps as either side
    sides = pairs.select("token", F.col("bi").alias("block"), "bi", "bj").union(pairs.where("bi <> bj").select("token", F.col("bj").alias("block"), "bi", "bj"))
    placed = labelled.join(mixed.select("token", shared.cast("long").alias("shared")), "token").join(large.withColumnRenamed("first", "own"), ["token", "comp"], "left")
    in_own = F.col("own") + F.pmod(F.xxhash64("rep"), F.col("blocks"))
    in_shared = F.pmod(F.xxhash64("comp", F.floor(F.xxhash64("rep") / 2**54)), F.greatest("shared", F.lit(1)))
    placed = placed.withColumn("block", F.when(F.col("own").isNotNull(), in_own).otherwise(in_shared).cast("long"))
    return placed.join(sides, ["token", "block"]).select("rep", "posted", "token", "comp", "block", "bi", "bj")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A & B| >= percent * |A | B| on their sets of `shingle_words`-word shingles
    (words are runs of non-separators, A-Z lower-cased). component_id is the smallest doc_id that links reach.
    Null, empty and blank texts have no shingles, are linked with nothing and are kept. Repeated texts are linked;
    rows that repeat a doc_id share its component. Rows with a null doc_id have a null component and are kept.
    Other columns of docs are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "near_dedup")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sigs = ws.write(text.mapInArrow(lambda it: _signatures(it, shingle_words), "doc_id long, n_shingles long, digest binary, sig binary"), "signatures")

    reps = ws.write(
        sigs.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies")), "classes"
    )
    postings = reps.select("rep", "sig").mapInArrow(_postings, "token long, rep long")
    shared = ws.write(postings.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "shared_values")
    per_rep = postings.join(shared, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("m", "token"))).alias("v"))  # at most POSTED entries
    kept = F.size("v") - (POSTED_MATCHES - 1)
    rare = per_rep.where(kept > 0).select("rep", F.slice(F.col("v").getField("token"), F.lit(1), kept).alias("v"))
    coordinates = F.aggregate("v", F.lit(0).cast("long"), lambda x, t: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(t, 32).cast("int"))))
    prefix = ws.write(rare.select("rep", coordinates.alias("posted"), F.explode("v").alias("token")), "prefix")
    lists = ws.write(prefix.groupBy("token").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1"), "lists")
    active = ws.write(prefix.join(lists, "token").select("rep", "posted", "token", "head", "m"), "active")

    ids = ws.write(active.select(F.col("rep").alias("doc_id")).distinct(), "active_ids")
    whole = text.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(lambda it: _sets(it, shingle_words), "doc_id long, shingles binary, sketch binary")
    sets = ws.write(whole.dropDuplicates(["doc_id"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x, y = (sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(v)) for k, v in (("a", "x"), ("b", "y")))
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
        return ws.write(both.mapInArrow(lambda it: _confirm(it, percent), "u long, v long"), "links")

    side = reps.select("rep", "n", "sig")
    heads = active.select(F.col("rep").alias("a"), F.col("head").alias("b")).where("a <> b").distinct()
    heads = heads.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb")
    heads = heads.mapInArrow(lambda it: _best_heads(it, percent), "a long, b long, hits long")
    links = confirmed(ws.write(heads.groupBy("a").agg(F.max_by("b", F.struct("hits", -F.col("b"))).alias("b")), "head_pairs"))
    final = ws.write(components(ws, links), "components")

    members = ws.write(side.join(sets.select(F.col("doc_id").alias("rep"), "sketch"), "rep"), "members")
    for best in (True, False):
        rows = _steps(ws, ws.write(active.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "posted", "token", F.coalesce("component", "rep").alias("comp")), "labelled"))
        rows = rows.join(members, "rep").select("token", "bi", "bj", "block", "rep", "posted", "comp", "n", "sig", "sketch")
        rows = rows.repartition("token", "bi", "bj").sortWithinPartitions("token", "bi", "bj")
        found = ws.write(rows.mapInArrow(lambda it, best=best: _across(it, percent, best), "a long, b long").distinct(), "across")
        links = ws.write(links.union(confirmed(found)), "all_links")
        final = ws.write(components(ws, links), "components")

    of_class = ws.write(
        reps.join(final.withColumnRenamed("node", "rep"), "rep", "left").where("copies > 1 or component is not null").select("digest", F.coalesce("component", "rep").alias("component")), "class_components"
    )
    ws.keep_only(sigs, of_class)
    out = sigs.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Docs without the documents of which near_duplicates keeps another; columns and other rows are unchanged.

    Null, empty and blank texts and rows with a null doc_id stay. Rows that repeat a kept doc_id stay; a doc_id is
    expected to be a key. Columns may have any names; an empty table stays empty.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words, percent=percent)
    key = column_name(docs, "gone_")
    gone = found.where("not kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(key), "left_anti")
