import random

from quirespark.functions import stats
from quirespark.operators import segments
from quirespark.streaming.runs import progress_totals, still_run_stream

MOTION = [9, 1, 1, 1, 9, 1, 1, 9, 9, 1, 1, 1, 1]


def frames(spark, motion, **extra):
    rows = [("v", i, float(m), *(x[i] if isinstance(x[i], bool) else float(x[i]) for x in extra.values())) for i, m in enumerate(motion)]
    return spark.createDataFrame(rows, "video_id string, frame_idx long, motion double" + "".join(f", {k} {'boolean' if k == 'detectable' else 'double'}" for k in extra))


def runs(df):
    return sorted((r.first_frame, r.n_frames) for r in df.collect())


def test_still_runs_and_their_own_threshold(spark):
    assert runs(segments.still_runs(frames(spark, MOTION), 5.0)) == [(1, 3), (9, 4)]
    assert runs(segments.still_runs(frames(spark, MOTION))) == [(1, 3), (9, 4)]
    assert runs(segments.still_runs(frames(spark, [3, 3, 3, 3]))) == [(0, 4)]


def otsu(values):
    s, best = sorted(values), []
    for r in range(1, len(s)):
        a, b = s[:r], s[r:]
        best.append((len(a) / len(s) * len(b) / len(s) * (sum(a) / len(a) - sum(b) / len(b)) ** 2, r))
    top = max(x for x, _ in best)
    gap, low = max(((s[r] - s[r - 1], -s[r - 1]) for x, r in best if x >= top - 1e-12))
    return -low + gap / 2


def test_otsu_equals_the_plain_search(spark):
    r = random.Random(3)
    series = {f"k{i}": [r.choice([r.gauss(2, 1), r.gauss(9, 2)]) for _ in range(r.randint(2, 40))] for i in range(20)}
    d = spark.createDataFrame([(k, v) for k, vs in series.items() for v in vs], "k string, v double")
    for row in stats.otsu_split(d, ["k"], "v", -1.0).collect():
        assert abs(row.threshold - otsu(series[row.k])) < 1e-9


def test_cluster_cut_opts_out(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 1.1), ("a", 9.0), ("b", 1.0), ("b", 1.5), ("c", None), ("c", -1.0)], "k string, v double")
    got = {r.k: r.threshold for r in stats.cluster_cut(d, ["k"], "v").collect()}
    assert 1.1 < got["a"] < 9 and got["b"] == got["c"] == float("-inf")


def test_best_frames_prefer_steady_then_quiet(spark):
    f = frames(spark, [9, 1, 1, 1, 9], score=[0.0, 5, 7, 6, 0], detectable=[True] * 5)
    assert [(r.frame_idx, r.pool) for r in segments.best_frames(f, 5.0).collect()] == [(1, "steady")]
    f = frames(spark, [9, 4, 3, 4, 9], score=[0.0, 5, 0, 6, 0], detectable=[True] * 5)
    assert [(r.frame_idx, r.pool) for r in segments.best_frames(f, 5.0).collect()] == [(1, "quiet")]
    f = frames(spark, [9, 1, 1, 1, 9], score=[0.0, 5, 7, 6, 0], detectable=[False] * 5)
    assert [(r.frame_idx, r.pool) for r in segments.best_frames(f, 5.0).collect()] == [(2, "any")]


def test_bursts(spark):
    d = spark.createDataFrame([("a", f"p{i}", x) for i, x in enumerate([None, 3.0, 20.0, 2.0, None])], "album string, path string, diff_to_prev double")
    assert [r.burst for r in segments.burst_groups(d, 10.0).orderBy("path").collect()] == [0, 0, 1, 1, 2]
    best = segments.burst_pages(segments.burst_groups(d, 10.0), spark.createDataFrame([("a", "p0", 1.0), ("a", "p1", 1.0), ("a", "p3", 2.0)], "album string, path string, score double"))
    assert sorted((r.burst, r.path) for r in best.collect()) == [(0, "p0"), (1, "p3"), (2, "p4")]


def test_motion_of_thumbs(spark):
    d = spark.createDataFrame([("v", i, t) for i, t in enumerate([[0, 0], [1, 3], [1, 3], [5, 3]])], "video_id string, frame_idx long, thumb array<int>")
    assert [r.motion for r in segments.motion_series(d).orderBy("frame_idx").collect()] == [0.0, 2.0, 0.0, 2.0]
    assert [r.motion for r in segments.motion_series(d, 2).orderBy("frame_idx").collect()] == [0.0, 2.0]


def test_the_stream_gives_the_batch_runs(spark, tmp_path):
    motion = [*MOTION, float("inf")]
    for k in range(0, len(motion), 4):
        rows = [("v", i, float(motion[i])) for i in range(k, min(k + 4, len(motion)))]
        spark.createDataFrame(rows, "video_id string, frame_idx long, motion double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("video_id string, frame_idx long, motion double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = still_run_stream(source, 5.0).writeStream.format("memory").queryName("runs_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert runs(spark.table("runs_out")) == [(1, 3), (9, 4)]


def test_progress_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text('{"event":"progress","phase":"read","done":3,"total":9}\nplain words\n{"event":"progress","phase":"read","done":5,"total":9,"new":1}\n')
    got = progress_totals(spark.read.text(str(tmp_path / "log"))).collect()
    assert [(r.phase, r.done, r.total, r.events) for r in got] == [("read", 5, 9, 2)]
