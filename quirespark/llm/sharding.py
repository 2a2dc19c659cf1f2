"""Sharding by longest-processing-time scheduling: groups that must stay together go, by size, to the least-loaded shard.

Equal texts are a group. Groups are counted by exact size. From the largest size down, the groups of a size go one by
one to the least-loaded shard by a heap; where a size has many groups, those that certainly come before a level are
dealt at once, with the same result. Groups inside a size are told apart by their rank by digest. So the driver handles
one row for each distinct size: n bytes of text have at most the square root of 2n of those.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bucketed_rank

#: Groups with more than 1/HOT of all rows, of which there are fewer than HOT, are joined by broadcast.
HOT = 4096


def longest_first(runs: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, dict[int, int]]]:
    """(size, number of groups for each shard that gets some) for (size, number of groups), given from the largest size down.

    Every group goes to the shard with the least bytes so far, the lower one on ties.
    """
    heap = [(0, s) for s in range(shards)]
    for size, n in runs:
        got: dict[int, int] = {}
        if n > shards:
            # a shard with load x takes its groups at loads x, x + size, ...; all those under a level come first
            low, high = heap[0][0], max(heap)[0] + size * n
            while low < high:
                level = (low + high + 1) // 2
                if sum(max(0, -((x - level) // size)) for x, _ in heap) <= n:
                    low = level
                else:
                    high = level - 1
            got = {s: k for x, s in heap if (k := max(0, -((x - low) // size)))}
            heap = [(x + size * got.get(s, 0), s) for x, s in heap]
            heapq.heapify(heap)
        for _ in range(n - sum(got.values())):
            x, s = heap[0]
            got[s] = got.get(s, 0) + 1
            heapq.heapreplace(heap, (x + size, s))
        yield size, got


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, carry: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard (and docs' columns as row_ if carry).

    The law is `bytes`: the shards' sums of size (UTF-8 bytes of the text plus 1) are near equal, and equal texts share
    a shard. A null text is empty: size 1, crc32 0; all null and empty texts are one group. slot counts a shard's rows
    from 0 without gaps; its order is a hash of doc_id and text, and rows that repeat both are interchangeable.
    grown_shard is null under this law. Other columns do not matter. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "sharding")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    measures = [F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")]
    slim = ws.write(docs.select(*measures), "sizes")
    groups = ws.write(slim.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies")), "groups")
    runs = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("bytes").desc()).toArrow()
    sizes, until, at = [], [], []
    for size, got in longest_first(zip(runs["bytes"].to_pylist(), runs["n"].to_pylist(), strict=True), shards):
        n = 0
        sizes.append(size)
        at.append(sorted(got))
        until.append([n := n + got[s] for s in at[-1]])
    plan = pa.table([pa.array(sizes, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(until, pa.list_(pa.int64()))], ["bytes", "at", "until"])
    plan = ws.write(spark.createDataFrame(plan, "bytes long, at array<int>, until array<long>"), "plan")
    ranked = bucketed_rank(groups, ["bytes"], [F.col("digest").asc()], F.substring("digest", 1, 1), "rank")
    # the first shard of the size whose last group is not before this one
    shard_of = F.get("at", F.size(F.filter("until", lambda x: x <= F.col("rank"))))
    placed = ws.write(ranked.join(plan, "bytes").select("digest", "copies", shard_of.alias("shard")), "placed")
    rows = groups.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    is_hot = F.col("copies") * HOT > F.lit(rows)
    hot, cold = placed.where(is_hot).select("digest", "shard"), placed.where(~is_hot).select("digest", "shard")
    source = docs.select(F.struct("*").alias("row_"), *measures) if carry else slim
    located = source.join(F.broadcast(hot), "digest").unionByName(source.join(F.broadcast(hot), "digest", "left_anti").join(cold, "digest"))
    order = F.xxhash64("doc_id", "digest")
    out = bucketed_rank(located, ["shard"], [order.asc(), F.col("doc_id").asc()], F.shiftright(order, 52), "slot")
    return out.select(*(["row_"] if carry else []), "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
