"""Regions, segments in files, growing logs, windows of tensors, attempts, the scene cache."""

import json
import math
import os
import random
import subprocess
import sys
import textwrap
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.functions import planes, regions
from cutline.operators import attempts, boundary, tensors
from cutline.sources import files, log_lines, segments

# regions


def plain_region(mask, diagonal):
    """Label of each set cell: the least cell of its region."""
    h, w = mask.shape
    label = np.zeros((h, w), int)
    for r in range(h):
        for c in range(w):
            if mask[r, c] and not label[r, c]:
                stack = [(r, c)]
                while stack:
                    y, x = stack.pop()
                    if 0 <= y < h and 0 <= x < w and mask[y, x] and not label[y, x]:
                        label[y, x] = r * w + c + 1
                        stack += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if diagonal or not a or not b]
    return label


def test_labels_and_holes():
    rng = np.random.default_rng(3)
    masks = rng.random((12, 9, 13)) < np.linspace(0.2, 0.8, 12)[:, None, None]
    for diagonal in (True, False):
        got = regions.labelled(masks, diagonal)
        for m, g in zip(masks, got, strict=True):
            want = plain_region(m, diagonal)
            assert ((want > 0) == (g > 0)).all()
            pairs = {(a, b) for a, b in zip(want.ravel().tolist(), g.ravel().tolist(), strict=True)}
            assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    for m, g in zip(masks, regions.filled(masks), strict=True):
        back = plain_region(~np.pad(m, 1), False)
        assert (g == (back != back[0, 0])[1:-1, 1:-1]).all()
    assert regions.labelled(np.zeros((2, 3, 3), bool), True).sum() == 0


def test_contour_areas():
    """Rectangles of w x h cells have (w - 1)(h - 1) within their outline, a diamond twice the square of its radius; holes count, lines don't."""
    m = np.zeros((6, 30, 40), bool)
    m[0, 3:13, 5:25] = True
    m[1, 3:13, 5:25] = True
    m[1, 5:9, 8:20] = False
    m[1, 6:8, 10:12] = True
    m[2, 10, :] = True
    r, c = np.mgrid[:30, :40]
    m[3] = abs(r - 12) + abs(c - 20) <= 6
    m[4, 2:8, 2:8] = m[4, 20:27, 20:27] = True
    m[5, 2:8, 2:8] = m[5, 8:14, 8:14] = True
    assert regions.contour_area(m).tolist() == [171, 171, 0, 72, 36, 50]
    # those of m[5] touch at a corner: one region of 25 + 25
    assert regions.contour_area(m, 20).tolist() == [171, 171, 0, 72, 61, 50]
    ring = np.zeros((1, 5, 5), bool)
    ring[0, [1, 2, 2, 3], [2, 1, 3, 2]] = True
    assert regions.contour_area(ring, 0).tolist() == [2]


def test_closing_joins_what_is_near():
    m = np.zeros((1, 11, 16), bool)
    m[0, 3:8, 2:5] = m[0, 3:8, 7:10] = True
    out = regions.closed(m)
    assert (out | ~m).all() and out[0, 5, 5] and out[0, 5, 6] and not out[0, 5, 13]
    full = np.ones((1, 4, 4), bool)
    assert regions.closed(full).all()


def test_pair_stats(spark):
    r, c = np.mgrid[:20, :22]
    smooth = 128 + 50 * np.sin(c / 4) + 40 * np.cos(r / 5 + c / 9)
    now, before = smooth[:, 1:21], smooth[:, :20]
    rows = [(0, before, now), (1, before, before), (2, before, before + 100), (3, np.full((20, 20), 100.0), np.full((20, 20), 101.0))]
    df = spark.createDataFrame([(k, a.ravel().tolist(), b.ravel().tolist()) for k, a, b in rows], "k int, a array<double>, b array<double>")
    got = {r.k: r.s for r in df.select("k", regions.pair_stats(F.col("a"), F.col("b"), 20, 20).alias("s")).collect()}
    assert abs(got[0].mean_mag - 1) < 0.1 and got[0].inlier_ratio > 0.9 and got[0].frob_norm == got[0].mean_mag
    assert got[1].mean_mag == 0 and got[1].inlier_ratio == 1 and got[1].diff_fraction == 0
    for k in (2, 3):
        assert (got[k].mean_mag, got[k].diff_fraction, got[k].inlier_ratio, got[k].frob_norm) == (0, 0, 0, None)


# planes


def plain_sample(p, y, x, border=False):
    h, w = p.shape
    if border:
        y, x = min(max(y, 0), h - 1), min(max(x, 0), w - 1)
    r, c = math.floor(y), math.floor(x)
    at = lambda r, c: p[r, c] if 0 <= r < h and 0 <= c < w else 0.0
    v, u = y - r, x - c
    return at(r, c) * (1 - u) * (1 - v) + at(r, c + 1) * u * (1 - v) + at(r + 1, c) * (1 - u) * v + at(r + 1, c + 1) * u * v


@pytest.mark.parametrize(("h", "w", "fh", "fw"), [(4, 6, 4, 6), (5, 7, 3, 2), (2, 3, 4, 5)])
def test_splats(spark, h, w, fh, fw):
    """Against plain loops, with flows that end in, beside and far out of the image, and nulls; no Python runs, so no worker grows with the input."""
    rng = np.random.default_rng(h)
    rows = [(k, rng.normal(size=h * w).tolist(), *(rng.normal(0, s, fh * fw).tolist() for s in (2, 2, 1))) for k in range(5)]
    rows[1][2][0], rows[2][3][1], rows[3][2][2] = 1e300, -1e300, -1.0
    rows += [(8, None, *rows[0][2:]), (9, [None, *rows[0][1][1:]], [0.0] * (fh * fw), [0.0] * (fh * fw), [0.0] * (fh * fw))]
    df = spark.createDataFrame(rows, "k long, p array<double>, x array<double>, y array<double>, m array<double>")
    found = planes.splats(df, "k", F.col("p"), F.col("x"), F.col("y"), F.col("m"), h, w, fh, fw)
    got = {(r.k, r.cell): (r.average, r.soft) for r in found.collect()}
    assert len(got) == len(rows) * h * w
    assert {got[8, i] for i in range(h * w)} == {(None, None)} and got[9, 0] == (None, None)
    assert got[9, h * w - 1] == pytest.approx((rows[9 - 3][1][-1],) * 2)
    for k, *arrays in rows[:5]:
        p, (x, y, m) = np.array(arrays[0]).reshape(h, w), (np.array(a).reshape(fh, fw) for a in arrays[1:])
        large = lambda a, by: np.array([[plain_sample(a, (r + 0.5) * fh / h - 0.5, (c + 0.5) * fw / w - 0.5, True) * by for c in range(w)] for r in range(h)])  # noqa: E731, B023
        x, y, e = large(x, w / fw), large(y, h / fh), np.exp(large(m, 1))
        for r in range(h):
            for c in range(w):
                s = lambda a: plain_sample(a, r + y[r, c], c + x[r, c])  # noqa: E731, B023
                assert got[k, r * w + c] == pytest.approx((s(p) / max(1e-7, s(np.ones((h, w)))), s(p * e) / max(1e-7, s(e))), abs=1e-9)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_match_flow_is_one_softmax(spark):
    rng = np.random.default_rng(5)
    h, w, c = 5, 4, 3
    a, b = rng.normal(size=(2, 6, h * w, c))
    df = spark.createDataFrame([(k, a[k].ravel().tolist(), b[k].ravel().tolist()) for k in range(6)], "k int, own array<double>, other array<double>")
    row, col = np.divmod(np.arange(h * w), w)
    for radius, tile in ((None, 2), (1, 2), (2, 1), (None, 16)):
        got = {(r.k, r.cell): (r.x, r.y) for r in planes.match_flow(df, "k", "own", "other", h, w, c, tile, radius).collect()}
        assert len(got) == 6 * h * w
        for k in range(6):
            score = a[k] @ b[k].T / c**0.5
            if radius is not None:
                score = np.where((abs(row[:, None] - row) <= radius) & (abs(col[:, None] - col) <= radius), score, -np.inf)
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for cell in range(h * w):
                assert np.allclose(got[k, cell], (p[cell] @ col - col[cell], p[cell] @ row - row[cell]))


# walks


def plain_spaced(ts, least):
    out = []
    for t in sorted(ts):
        if not out or t - out[-1] >= least:
            out.append(t)
    return out


def test_greedy_merge_of_dense_islands(spark):
    """One video without a gap, of which thousands are kept, so that chunks are folded into each other; and one of many islands."""
    rng = random.Random(8)
    dense = sorted(rng.sample(range(60_000), 20_000))
    rare = sorted(rng.sample(range(2_000_000), 3000))
    df = spark.createDataFrame([(1, t) for t in dense] + [(2, t) for t in rare] + [(3, 5), (3, 6)], "video_id long, t_us long")
    got = boundary.greedy_merge(df, 7)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "InArrow" not in got._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in got.collect():
        found.setdefault(r.video_id, []).append(r.t_us)
    assert {k: sorted(v) for k, v in found.items()} == {1: plain_spaced(dense, 7), 2: plain_spaced(rare, 7), 3: [5, 6]}


def test_pathological(spark):
    s = 1_000_000
    rows = {1: [0, 2 * s, s, 5 * s, 9 * s], 2: [0], 3: [0, s, s], 4: [k * s // 20 for k in range(40)], 5: [k * s // 25 for k in range(9)], 6: [0, s // 100, 2 * s, 4 * s], 7: [k * s for k in range(4)], 8: [None, None, 3]}
    times = spark.createDataFrame([(v, t) for v, ts in rows.items() for t in ts], "video_id long, t_us long")
    durations = {1: 10 * s, 2: None, 3: 5 * s, 4: 2 * s, 5: 0, 6: 4 * s, 7: s // 10, 8: s, 9: s}
    videos = spark.createDataFrame(list(durations.items()), "video_id long, duration_us long")
    got = {r.video_id: (r.n, r.pathological) for r in boundary.pathological(times, videos).collect()}
    # 1 comes out of order, 4 and 7 are too dense for their duration, 5 by its gaps, 6 has but one short gap
    assert got == {1: (5, False), 2: (1, True), 3: (3, True), 4: (40, True), 5: (9, True), 6: (4, False), 7: (4, True), 8: (1, True), 9: (0, True)}


# segments


def frames_of(spark, counts, size=4):
    return spark.createDataFrame([(v, i, bytes([v, i % 256] * (size // 2))) for v, n in counts.items() for i in range(n)], "video_id long, i long, px binary")


def test_segments_are_published_at_once(spark, tmp_path):
    path = f"{tmp_path}/out"
    frames = frames_of(spark, {1: 700, 2: 5})
    totals = frames.groupBy("video_id").agg(F.count("*").alias("n"))
    cuts = spark.createDataFrame([(1, 300), (1, 9), (1, 300), (2, 0), (2, 77)], "video_id long, i long")
    segments.write_segments(frames, segments.cut_ranges(cuts, totals), path, first=1)
    read = lambda: sorted(map(tuple, segments.read_segments(spark, path, height=2, width=2, channels=1).select("segment", "i", "px").collect()))
    want = [("1_0001", i, bytes([1, i] * 2)) for i in range(9)] + [("1_0002", i, bytes([1, (i + 9) % 256] * 2)) for i in range(291)] + [("1_0003", i, bytes([1, (i + 300) % 256] * 2)) for i in range(400)] + [("2_0001", i, bytes([2, i] * 2)) for i in range(5)]
    assert read() == want
    # a task fails after others have staged their files: what was there stays, and nothing else
    bad = F.when(F.col("i") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("px"))
    with pytest.raises(Exception, match="no"):
        segments.write_segments(frames.withColumn("px", bad), segments.cut_ranges(cuts, totals), path, mode="overwrite")
    assert read() == want and sorted(x for x in os.listdir(path) if x.startswith("_")) == ["_manifest.json"]
    # a name that is taken is refused; others are added, or put in place of all
    with pytest.raises(Exception, match="written twice"):
        segments.write_segments(frames.where("video_id = 2"), segments.cut_ranges(cuts, totals), path, first=1)
    segments.write_segments(frames.where("video_id = 2"), segments.cut_ranges(cuts, totals), path, first=7)
    assert read() == want + [("2_0007", i, bytes([2, i] * 2)) for i in range(5)]
    segments.write_segments(frames.where("video_id = 2"), segments.cut_ranges(cuts, totals), path, mode="overwrite")
    assert read() == [("2_0000", i, bytes([2, i] * 2)) for i in range(5)]
    assert len([x for x in os.listdir(path) if x.startswith("job-")]) == 1


def test_segments_of_a_killed_task(tmp_path):
    """The worker of a task's first attempt dies between writing and commit: the second attempt's files count, each once."""
    code = f"""
        import os, sys
        sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
        from pyspark.sql import SparkSession
        from cutline.sources import segments
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        mark = {str(tmp_path)!r} + "/died"
        class Dying(segments._Writer):
            def write(self, iterator):
                made = super().write(iterator)
                if made.files and not os.path.exists(mark):
                    open(mark, "w").close()
                    os._exit(1)
                return made
        class Source(segments.RawSegments):
            def writer(self, schema, overwrite):
                return Dying(dict(self.options), overwrite)
        spark.dataSource.register(Source)
        rows = [(f"s{{k // 3}}", bytes([k])) for k in range(12)]
        df = spark.createDataFrame(rows, "segment string, px binary").repartition(2, "segment").sortWithinPartitions("segment", "px")
        path = {str(tmp_path)!r} + "/out"
        df.write.format("raw_segments").mode("append").option("path", path).save()
        read = sorted((r.segment, r.i, r.px[0]) for r in segments.read_segments(spark, path, height=1, width=1, channels=1).collect())
        assert os.path.exists(mark) and read == [(f"s{{k // 3}}", k % 3, k) for k in range(12)], read
        assert not [x for x in os.listdir(path) if x.startswith("_staging")]
        print("whole")
    """
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=300)
    assert "whole" in out.stdout, out.stderr[-3000:]


# growing logs


def test_log_lines_that_are_added(spark, tmp_path):
    from cutline.streaming import stateful

    logs, out = tmp_path / "logs", f"{tmp_path}/out"
    logs.mkdir()
    a, b = logs / "a.txt", logs / "b.txt"
    add = lambda f, s: f.open("ab").write(s.encode())

    def start():
        lines = log_lines.read_lines(spark, str(logs), split=16)
        return lines.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").start(out)

    def seen():
        return sorted((os.path.basename(r.path), r["at"], r.line) for r in spark.read.schema("path string, at long, line string").parquet(out).collect())

    add(a, "first\nsecond line that is longer than a task\n\nhalf of")
    q = start()
    q.processAllAvailable()
    want = [("a.txt", 0, "first"), ("a.txt", 6, "second line that is longer than a task"), ("a.txt", 45, "")]
    assert seen() == want
    add(a, " the third\nfourth é\r\n")
    add(b, "one\n")
    q.processAllAvailable()
    want += [("a.txt", 46, "half of the third"), ("a.txt", 64, "fourth é"), ("b.txt", 0, "one")]
    assert seen() == sorted(want)
    q.stop()
    add(a, "after a restart\nopen")
    q = start()
    q.processAllAvailable()
    want += [("a.txt", 75, "after a restart")]
    assert seen() == sorted(want)
    b.write_bytes(b"x\n")  # begun anew, and shorter
    q.processAllAvailable()
    assert seen() == sorted([*want, ("b.txt", 0, "x")])
    q.stop()
    # percent only rises; from 99.5 on it is done
    (logs / "c.log").write_text("".join(f"{p} %\n" for p in ("10", "5", "40", "40", "99.5")) + "Error occured while\n")
    tail = stateful.log_progress(stateful.log_tail(spark, str(logs), suffix=".log"))
    q = tail.writeStream.format("memory").queryName("tail").outputMode("append").option("checkpointLocation", f"{tmp_path}/check2").start()
    q.processAllAvailable()
    with (logs / "c.log").open("a") as f:
        f.write("120 %\n[Done] x\n")
    q.processAllAvailable()
    got = [tuple(r) for r in spark.table("tail").select("percent", "done", "error").collect()]
    q.stop()
    assert [g[0] for g in got if g[0] is not None] == sorted({g[0] for g in got if g[0] is not None}) and got[0][:2] == (10.0, False)
    assert (99.5, True, None) in got and any(e for _, _, e in got) and got[-1][0] == 100.0


# windows of tensors


def test_tensor_windows_equal_scalar_ones(spark):
    from cutline.plans import detect

    shape, rng = (3, 4, 2), np.random.default_rng(2)
    videos = {1: 230, 2: 1, 3: 50, 4: 99, 5: 26}
    px = {v: rng.integers(0, 256, (n, *shape), np.uint8) for v, n in videos.items()}
    frames = spark.createDataFrame([(v, i, px[v][i].tobytes()) for v, n in videos.items() for i in range(n)], "video_id long, i long, px binary").repartition(4)
    totals = spark.createDataFrame(list(videos.items()), "video_id long, n long")
    calls = spark.sparkContext.accumulator(0)

    def model(x):
        calls.add(1)
        assert x.dtype == np.uint8 and x.shape[1:] == (100, *shape)
        bright = x.reshape(*x.shape[:2], -1).mean(axis=2)
        return bright - bright.mean(axis=1, keepdims=True)

    got = {(r.video_id, r.i): r.score for r in tensors.window_scores(frames, totals, model, shape, block=2, batch=4).collect()}
    scalar = spark.createDataFrame([(v, i, float(px[v][i].mean())) for v, n in videos.items() for i in range(n)], "video_id long, i long, feature double")
    want = {(r.video_id, r.i): r.score for r in detect.window_scores(scalar, lambda x: x - x.mean(axis=1, keepdims=True)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert calls.value < 10
    with pytest.raises(Exception, match="missing or repeated"):
        tensors.window_scores(frames.where("i <> 60"), totals, model, shape).collect()


# attempts


def test_ladder_tries_only_what_failed(spark, tmp_path):
    rows = spark.createDataFrame([(k, "a") for k in range(20)], "k long, name string").repartition(2)
    tried = spark.sparkContext.accumulator(0)

    def first(row):
        if row["k"] % 2:
            raise ValueError("odd")
        return f"first {row['k']}"

    def second(row):
        tried.add(1)
        if row["k"] % 3 == 0:
            raise RuntimeError("gpu gone" if row["k"] % 9 == 0 else "")
        return "second"

    got = {r.k: (r.how, r.made, r.error) for r in attempts.ladder(rows, [("one", first, F.col("k") < 18), ("two", second, None), ("three", lambda r: "third", F.col("error").contains("gpu"))], f"{tmp_path}/l").collect()}
    assert tried.value == 11
    want = {k: ("one", f"first {k}", None) for k in range(0, 18, 2)} | {k: ("two", "second", None) for k in (1, 5, 7, 11, 13, 17, 19)} | {9: ("three", "third", None), 18: ("three", "third", None)} | {3: (None, None, "RuntimeError"), 15: (None, None, "RuntimeError")}
    assert got == want
    left = attempts.failures(attempts.attempt(rows, first)).collect()
    assert [(r.error, r.n) for r in left] == [("odd", 10)]
    assert attempts.ladder(rows.limit(0), [("one", first, None)], f"{tmp_path}/m").count() == 0


# cache


def test_cache_of_two_writers(spark, tmp_path):
    cache = files.SceneCache(spark, f"{tmp_path}/cache")
    scenes = spark.createDataFrame([("a", "keyframe", k) for k in range(5)] + [("b", "edges", 0)], "print string, method string, scene_index long")
    assert cache.read() is None and cache.listed() is None and not cache.clear("edges")
    failed = []

    def add():
        try:
            files.SceneCache(spark, f"{tmp_path}/cache").add(scenes)
        except Exception as e:
            failed.append(e)

    both = [threading.Thread(target=add) for _ in range(3)]
    [t.start() for t in both]
    [t.join() for t in both]
    cache.add(scenes)
    rows = lambda: sorted(map(tuple, cache.read().select("print", "method", "scene_index").collect()))
    want = [("a", "keyframe", k) for k in range(5)] + [("b", "edges", 0)]
    assert not failed and rows() == want
    os.makedirs(f"{tmp_path}/cache/batch=0-lost/method=keyframe")  # of a job that has never committed
    cache.add(spark.createDataFrame([("a", "edges", 9)], "print string, method string, scene_index long"))
    assert rows() == sorted([*want, ("a", "edges", 9)])
    cache.compact()
    assert rows() == sorted([*want, ("a", "edges", 9)]) and len(cache._listed("batch=*/_SUCCESS")) == 1
    assert {(r.print, r.method, r.n_scenes) for r in cache.listed().collect()} == {("a", "keyframe", 5), ("b", "edges", 1), ("a", "edges", 1)}
    assert cache.clear("edges") and not cache.clear("edges") and rows() == want[:5]


def test_job_as_one_object(spark, tmp_path):
    job = spark.createDataFrame([(1, "/in/a.mkv", True, "keyframe", ["slow"], None), (2, "/in/b.mkv", False, "edges", None, "no stream")], "job long, video string, cache boolean, detector string, warnings array<string>, error string")
    scenes = spark.createDataFrame([(1, 1, 2.5, 4.0, "b.mp4", None), (1, 0, 0.0, 2.5, "a.mp4", "a.jpg")], "job long, scene_index long, start double, end double, path string, thumbnail string")
    files.write_job(spark, f"{tmp_path}/jobs", scenes, job)
    got = {x["job"]: x for x in (json.loads(r.value) for r in spark.read.text(f"{tmp_path}/jobs").collect())}
    assert [s["scene_index"] for s in got[1]["scenes"]] == [0, 1] and got[1]["scenes"][1]["duration"] == 1.5 and got[1]["ok"] and got[1]["warnings"] == ["slow"] and got[1]["error"] is None
    assert got[2]["scenes"] == [] and not got[2]["ok"] and got[2]["error"] == "no stream" and got[2]["warnings"] == []


# packets, rounding, streams in time


def test_exact_rounding(spark):
    rng = random.Random(12)
    xs = [2.675, 1.005, 0.5, 1.5, 2.5, -2.675, 1e-9, 0.0, -0.0, 0.125, 0.375, 1e15 + 0.5, 123456.785, float(1 << 46), 5e22, -1e300]
    xs += [rng.randrange(-(10**9), 10**9) / 1000 for _ in range(40_000)] + [rng.randrange(10**7) * 0.005 for _ in range(40_000)] + [rng.uniform(-1e6, 1e6) for _ in range(20_000)]
    from cutline.functions.rounding import exact_round

    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", exact_round(F.col("x"), 2).alias("r"), exact_round(F.col("x"), 0).alias("z"), F.bround("x", 2).alias("b")).collect()
    assert [(r.x, r.r, r.z) for r in got if (r.r, r.z) != (round(r.x, 2), round(r.x, 0))] == []
    assert sum(r.r != r.b for r in got) > 1000
    assert spark.createDataFrame([(None,), (float("nan"),)], "x double").select(exact_round(F.col("x"), 2).alias("r")).where("r is not null and not isnan(r)").count() == 0


def test_seconds_are_rounded_exactly(spark):
    """Half a millisecond goes where the double's exact value lies, as in printf()."""
    from cutline.operators.planning import seconds_text

    rng = random.Random(5)
    us = [35_116_503_500, 1_221_198_212_500, 182_437_229_500, 30_062_019_500, 62_500, 500, 1500, 0, *(rng.randrange(2 * 10**9) * 1000 + 500 for _ in range(2000)), *(rng.randrange(10**12) for _ in range(200))]
    got = spark.createDataFrame([(x,) for x in us], "us long").select("us", seconds_text(F.col("us")).alias("text")).collect()
    assert {r.us: r.text for r in got} == {x: f"{x / 1e6:.3f}" for x in us}


def test_packets_are_read_by_index(spark, tmp_path):
    from cutline.sources import packet_files

    n = 20_000
    rows = [(v, i, None if i % 11 == 3 else i * 1000 + v, i * 1000, i % 50 == 0) for v in (1, 2) for i in range(n)] + [(3, 0, None, None, True)]
    packets = spark.createDataFrame(rows, "video_id long, seq long, pts_us long, dts_us long, is_key boolean")
    path = f"{tmp_path}/packets"
    packet_files.write_packets(packets, path, block=500)
    files_ = [x for x in os.listdir(path) if not x.startswith((".", "_"))]
    assert sorted(files_) == ["1.packets", "2.packets", "3.packets"]
    whole = sum(os.path.getsize(f"{path}/{f}") for f in files_)

    def read(condition):
        trace = tmp_path / f"trace-{abs(hash(condition))}"
        df = packet_files.read_packets(spark, path, trace=str(trace))
        got = sorted(map(tuple, (df.where(condition) if condition else df).collect()), key=str)
        return got, sum(map(int, trace.read_text().split()))

    t = lambda p, d: d if p is None else p
    want = sorted([(str(v), i, p, d, t(p, d), k) for v, i, p, d, k in rows], key=str)
    got, size = read("")
    assert got == want and size >= 0.9 * whole
    got, size = read("is_key")
    assert got == [x for x in want if x[5]] and size < 0.05 * whole
    got, size = read("t_us >= 5000000 and t_us < 6000000")
    assert got == [x for x in want if x[4] is not None and 5_000_000 <= x[4] < 6_000_000] and size < 0.15 * whole
    got, size = read("is_key = true and t_us > 19000000")
    assert got == [x for x in want if x[5] and x[4] is not None and x[4] > 19_000_000] and size < 0.03 * whole
    got, _ = read("not is_key and seq < 5")
    assert got == [x for x in want if not x[5] and x[1] < 5]


def test_streams_in_any_order_equal_batches(spark, tmp_path):
    from cutline.operators import emission
    from cutline.streaming import stateful

    rng, rows = random.Random(4), []
    for v in (1, 2):
        t, pct = 0, 0.0
        for k in range(120):
            t += rng.choice([200_000, 1_000_000, 2_500_000])
            pct += rng.choice([-1.0, 0.5, 2.0])
            rows.append((v, t, k, pct, rng.choice(["a", "a", "b", None]), k // 9 % 3))
    schema = "video_id long, ts_us long, seq long, pct double, detail string, size long"
    batch = spark.createDataFrame(rows, schema)
    # shuffled within a few seconds, so across micro-batches; far events at the end let all others pass
    shuffled = sorted(rows, key=lambda r: r[1] + rng.randrange(8_000_000))
    parts = [shuffled[k : k + 40] for k in range(0, len(shuffled), 40)] + [[(v, 10**12, 999, 1e9, "end", 0) for v in (1, 2)]] + [[(3, 2 * 10**12, 1, 0.0, "x", 0)]]

    def stream(make, name):
        folder = tmp_path / name
        folder.mkdir()
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
        q = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-cp").start()
        for k, part in enumerate(parts):
            with open(f"{tmp_path}/part", "w") as f:
                f.writelines(json.dumps(dict(zip(("video_id", "ts_us", "seq", "pct", "detail", "size"), r, strict=True))) + "\n" for r in part)
            os.rename(f"{tmp_path}/part", folder / f"{k}.json")
            q.processAllAvailable()
        q.stop()
        return [r for r in spark.table(name).collect() if getattr(r, "seq", 0) != 999]

    got = stream(lambda s: stateful.previews(s, "pct", 3.0), "previews")
    want = emission.previews(batch, "pct", 3.0, ["ts_us", "seq"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 20
    got = stream(lambda s: stateful.presence(s, "detail", 15_000_000), "presence")
    want = emission.changed_or_due(batch, "detail", 15_000_000).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, want))
    got = stream(lambda s: stateful.stable(s.withColumnRenamed("seq", "i"), "size", 3), "stable")
    want = emission.stable(batch.withColumnRenamed("seq", "i"), "size", 3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 2
