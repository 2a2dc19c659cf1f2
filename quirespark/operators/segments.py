"""Still runs of motion series, best frames, bursts of shots. Tables: frames(video_id, frame_idx, motion, score, sharp, detectable)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats

CANDIDATES, QUIET_POOL, SETTLE, QUIET_GATE = 6, 5, 5, 2.5


def motion_series(frames: DataFrame, stride: int = 1) -> DataFrame:
    """(video_id, frame_idx, motion): mean absolute difference of consecutive thumbs (array of numbers); the first is 0."""
    kept = frames.where(F.col("frame_idx") % stride == 0)
    last = F.lag("thumb").over(Window.partitionBy("video_id").orderBy("frame_idx"))
    total = F.aggregate(F.zip_with("thumb", last, lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda a, b: a + b)
    return kept.select("video_id", "frame_idx", F.coalesce(F.when(last.isNotNull(), total / F.size("thumb")), F.lit(0.0)).alias("motion"))


def motion_threshold(frames: DataFrame) -> DataFrame:
    """(video_id, threshold): Otsu split of the motion; +inf where it does not split, so that all is still."""
    return stats.otsu_split(frames, ["video_id"], "motion", float("inf"))


def _runs(frames: DataFrame, threshold: Column, order: list[str]) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy(*order)
    moving = ~(F.col("motion") < threshold)
    d = frames.withColumn("moving", F.coalesce(moving, F.lit(True)))
    return d.withColumn("run", F.sum(F.col("moving").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def still_runs(frames: DataFrame, threshold: float | None = None, *, min_frames: int = 3, order: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """(video_id, run, first_frame, n_frames): maximal runs of frames under the threshold, of min_frames or more.

    Without a threshold each video chooses its own. run numbers a video's runs from 0.
    """
    if threshold is None:
        frames = frames.join(motion_threshold(frames), "video_id")
        cut = F.col("threshold")
    else:
        cut = F.lit(threshold)
    runs = _runs(frames, cut, list(order)).where("not moving").groupBy("video_id", "run").agg(F.min_by("frame_idx", F.struct(*order)).alias("first_frame"), F.count(F.lit(1)).alias("n_frames"), F.min(F.struct(*order)).alias("at")).where(F.col("n_frames") >= min_frames)
    return runs.select("video_id", (F.row_number().over(Window.partitionBy("video_id").orderBy("at")) - 1).cast("long").alias("run"), "first_frame", "n_frames")


def best_frames(frames: DataFrame, threshold: float, *, min_frames: int = 3) -> DataFrame:
    """(video_id, run, frame_idx, pool): the frame to keep of every still run.

    Stillness of a frame is the larger of the motion into it and out of it (the last one's own). Pools, in the order
    they are tried: `steady` (stillness under QUIET_GATE, of the CANDIDATES best scores), `quiet` (the QUIET_POOL least
    still movements), `settled` (past the first SETTLE frames, best score), `candidates` (best score). A pool counts
    if it has a frame with a score above 0 in which a page was detected; the first of quiet and steady by stillness,
    of the others by score; failing all, the best score.
    """
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    d = _runs(frames.withColumn("out_", F.lead("motion").over(w)), F.lit(threshold), ["frame_idx"]).where("not moving")
    run = Window.partitionBy("video_id", "run")
    d = d.withColumn("still", F.greatest("motion", F.coalesce("out_", "motion"))).withColumn("n", F.count(F.lit(1)).over(run)).where(F.col("n") >= min_frames)
    d = d.withColumn("position", F.row_number().over(run.orderBy("frame_idx")) - 1)
    d = d.withColumn("by_score", F.row_number().over(run.orderBy(F.col("score").desc(), "frame_idx"))).withColumn("by_still", F.row_number().over(run.orderBy("still", "frame_idx")))
    good = (F.col("score") > 0) & F.coalesce("detectable", F.lit(False))
    candidate = F.col("by_score") <= CANDIDATES
    d = d.withColumn("rank", F.when(good & candidate & (F.col("still") < QUIET_GATE), 0).when(good & (F.col("by_still") <= QUIET_POOL), 1).when(good & (F.col("position") > SETTLE), 2).when(good & candidate, 3).otherwise(4))
    first = F.when(F.col("rank") <= 1, F.col("still")).otherwise(-F.col("score"))
    d = d.withColumn("choice", F.row_number().over(run.orderBy("rank", first, "frame_idx"))).where("choice = 1")
    names = F.element_at(F.array(*[F.lit(x) for x in ("steady", "quiet", "settled", "candidates", "any")]), F.col("rank") + 1)
    return d.select("video_id", (F.dense_rank().over(Window.partitionBy("video_id").orderBy("run")) - 1).cast("long").alias("run"), "frame_idx", names.alias("pool"))


def burst_groups(shots: DataFrame, threshold: float | None = None) -> DataFrame:
    """(album, path, burst): shots (album, path, diff_to_prev) by path; a shot joins its predecessor's burst if it differs less.

    A null difference counts as 255. Without a threshold each album cuts its own (0, all apart, where it cannot).
    """
    d = shots.withColumn("diff", F.coalesce(F.col("diff_to_prev"), F.lit(255.0)))
    if threshold is None:
        cut = stats.cluster_cut(d, ["album"], "diff").select("album", F.when(F.col("threshold") == float("-inf"), F.lit(0.0)).otherwise(F.col("threshold")).alias("cut"))
        d = d.join(cut, "album")
    else:
        d = d.withColumn("cut", F.lit(float(threshold)))
    w = Window.partitionBy("album").orderBy("path")
    new = F.when((F.row_number().over(w) == 1) | ~(F.col("diff") < F.col("cut")), 1).otherwise(0)
    return d.withColumn("new", new).select("album", "path", (F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long").alias("burst"))


def burst_pages(bursts: DataFrame, scores: DataFrame) -> DataFrame:
    """(album, burst, path): the best scored shot of each burst, the first on ties."""
    d = bursts.join(scores, ["album", "path"], "left")
    best = F.row_number().over(Window.partitionBy("album", "burst").orderBy(F.col("score").desc_nulls_last(), "path"))
    return d.withColumn("r", best).where("r = 1").select("album", "burst", "path")


def rejected_frames(frames: DataFrame, *, sharp: float | None = None, held: float | None = None) -> DataFrame:
    """Frames (video_id, frame_idx, sharp, held) to reject: under a given sharpness; or, with none given, under both of the
    video's own cuts of sharpness and of holding time."""
    if sharp is not None:
        return frames.where(F.col("sharp") < sharp)
    a = stats.cluster_cut(frames, ["video_id"], "sharp").withColumnRenamed("threshold", "a_")
    b = stats.cluster_cut(frames, ["video_id"], "held").withColumnRenamed("threshold", "b_")
    limit = F.col("b_") if held is None else F.lit(held)
    return frames.join(a, "video_id").join(b, "video_id").where((F.col("sharp") < F.col("a_")) & (F.col("held") < limit)).drop("a_", "b_")
