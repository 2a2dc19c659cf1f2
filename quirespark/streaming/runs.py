"""Still runs and progress events as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.sinks import progress_events

RUN = "video_id string, first_frame long, n_frames long"


def still_run_stream(frames: DataFrame, threshold: float, min_frames: int = 3) -> DataFrame:
    """(video_id, first_frame, n_frames) of a stream of frames (video_id, frame_idx, motion), as runs end.

    Frames of a video must arrive in order across batches; inside a batch they are sorted. The state of a video is its
    open run: first frame and length. A run ends with a moving frame; a last run without one stays open, so a stream
    should close each video with a frame of infinite motion.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, n = state.get if state.exists else (-1, 0)
        pdf = pd.concat(list(batches)).sort_values("frame_idx")
        out = []
        for frame, motion in zip(pdf["frame_idx"], pdf["motion"], strict=True):
            if motion < threshold:
                first, n = (int(frame), 1) if n == 0 else (first, n + 1)
            else:
                if n >= min_frames:
                    out.append((key[0], first, n))
                first, n = -1, 0
        state.update((first, n))
        yield pd.DataFrame(out, columns=["video_id", "first_frame", "n_frames"])

    return frames.groupBy("video_id").applyInPandasWithState(step, RUN, "first long, n long", "append", GroupStateTimeout.NoTimeout)


def progress_totals(lines: DataFrame) -> DataFrame:
    """Latest progress (phase, done, total, events) of a stream of JSON lines."""
    e = progress_events(lines).where("event = 'progress'")
    return e.groupBy("phase").agg(F.max("done").alias("done"), F.max("total").alias("total"), F.count(F.lit(1)).alias("events"))


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums of timed events (ts, event_type, value) by window, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
