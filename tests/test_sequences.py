"""Literal cases of sequence operators."""

import pytest
from pyspark.sql import functions as F

from cutline.functions import image
from cutline.operators import align, boundary, emission, runs, selection

S = 1_000_000


def us(*xs):
    return [round(x * S) for x in xs]


def one(spark, times, col="t_us"):
    return spark.createDataFrame([(1, t) for t in us(*times)], f"video_id long, {col} long")


@pytest.mark.parametrize(
    ("times", "least", "kept"),
    [((0, 0.1, 0.3, 0.5, 0.55, 1.0), 0.25, (0, 0.3, 0.55, 1.0)), ((0, 0.1), 0.5, (0, 0.1)), ((3,), 1, (3,))],
)
def test_greedy_merge(spark, times, least, kept):
    df = one(spark, times)
    for f in (boundary.greedy_merge,):
        assert sorted(r.t_us for r in f(df, round(least * S)).collect()) == us(*kept)


def test_greedy_merge_of_many_videos(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("video_id"), (F.xxhash64("id") % 10_000_000).alias("t_us")).distinct()
    want, last = [], {}
    for v, t in sorted(map(tuple, df.collect())):
        if v not in last or t - last[v] >= 40_000:
            last[v] = t
            want.append((v, t))
    assert sorted(map(tuple, boundary.greedy_merge(df, 40_000).collect())) == want


def test_one_long_video(spark):
    """200,000 points of one video: alignment, merging and throttling take one sorted pass each."""
    import time

    n = 200_000
    points = spark.range(n).select(F.lit(1).cast("long").alias("video_id"), (F.col("id") * 10).alias("t_us"), F.col("id").alias("seq"))
    keys = spark.range(n // 100).select(F.lit(1).cast("long").alias("video_id"), (F.col("id") * 1000 + 5).alias("t_us"))
    begin = time.perf_counter()
    near = align.neighbours(points, keys, ("seq",)).agg(F.sum("k_before"), F.count("k_after"), F.sum(F.col("k_at_or_after") - F.col("t_us"))).first()
    assert near[1] == n - 99 and boundary.greedy_merge(points, 25).count() == -(-n // 3)
    assert emission.throttled(points, 25, "t_us", "seq").count() == -(-n // 3)
    assert time.perf_counter() - begin < 60


def test_pack_scenes(spark):
    d = lambda x: spark.createDataFrame([(1, round(x * S))], "video_id long, duration_us long")
    got = boundary.pack_scenes(one(spark, (2, 5)), d(9), 500_000).orderBy("scene_index").collect()
    assert [(r.start_us, r.end_us) for r in got] == [tuple(us(0, 2)), tuple(us(2, 5)), tuple(us(5, 9))]
    got = boundary.pack_scenes(one(spark, ()), d(0), 250_000).collect()
    assert [(r.start_us, r.end_us) for r in got] == [(0, 250_000)]


def test_keyframe_cuts_drop_the_first(spark):
    assert sorted(r.t_us for r in boundary.keyframe_cuts(one(spark, (1, 2, 2.1, 4)), 500_000).collect()) == us(2, 4)


def test_score_scenes(spark):
    def scenes(scores):
        df = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(scores)], "video_id long, i long, score double")
        return [(r.start_frame, r.end_frame) for r in boundary.score_scenes(df, 0.5).orderBy("scene_index").collect()]

    assert scenes([0, 0, 1, 1, 0, 0, 0]) == [(0, 2), (4, 6)]
    assert scenes([1, 0, 0, 1]) == [(1, 3)]
    assert scenes([1, 1, 1]) == [(0, 2)]
    assert scenes([0]) == [(0, 0)]


@pytest.mark.parametrize("n", [1, 49, 50, 51, 100, 120, 149, 175, 230])
def test_sliding_windows(spark, n):
    df = spark.range(n).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("i"))
    rows = boundary.sliding_windows(df).collect()
    want = {(w, slot, max(0, min(n - 1, 50 * w - 25 + slot))) for w in range(-(-n // 50)) for slot in range(100)}
    assert {(r.w, r.slot, r.i) for r in rows} == want and len(rows) == len(want)
    assert sorted(r.i for r in rows if r.scored) == list(range(n))


def test_alignment_ties(spark):
    keys, points = one(spark, (4.9, 5.1)), one(spark, (5.0,)).withColumn("p", F.lit(1))
    near = align.neighbours(points, keys, ("p",))
    key, gap = align.snap(F.col("t_us"), F.col("k_before"), F.col("k_at_or_after"), 200_000)
    assert tuple(near.select(key, gap).first()) == (5_100_000, 100_000)
    near = align.neighbours(points, one(spark, (4, 6)), ("p",))
    assert near.select(align.earlier_snap(F.col("t_us"), F.col("k_at_or_before"), F.col("k_after"), 5 * S)).first()[0] == 4 * S
    near = align.neighbours(points, one(spark, (5,)), ("p",)).first()
    assert (near.k_at_or_before, near.k_before, near.k_at_or_after, near.k_after) == (5 * S, None, 5 * S, None)


def test_classify(spark):
    scenes = spark.createDataFrame([(1, 0, *us(0, 5)), (1, 1, *us(5.3, 10)), (1, 2, *us(10, 15))], "video_id long, scene_index long, start_us long, end_us long")
    got = align.classify(scenes, one(spark, (0, 5, 10, 15)), 200_000).orderBy("scene_index").collect()
    assert [r["mode"][:4] for r in got] == ["copy", "reen", "copy"] and got[1].start_diff_us == 300_000
    with pytest.raises(ValueError):
        align.classify(scenes, one(spark, (0,)), -1)


@pytest.mark.parametrize(("hevc", "cuda", "mode"), [(False, False, "smartcut"), (True, False, "snapped_copy"), (True, True, "reencode")])
def test_cut_mode(spark, hevc, cuda, mode):
    from cutline.plans.detect import plan_cuts

    scene = spark.createDataFrame([(1, 0, *us(5.3, 10))], "video_id long, scene_index long, start_us long, end_us long")
    got = plan_cuts(scene, one(spark, (0, 5, 6, 10)), hevc, cuda).first()
    assert got["mode"] == mode and got.start_us == (5 * S if mode == "snapped_copy" else 5_300_000)


def test_gop_trim(spark):
    df = spark.range(50).select(F.lit(1).alias("video_id"), F.col("id").alias("i"), F.col("id").isin(0, 24, 47).alias("is_key"))
    assert align.gop_trim(df).first().trim_to == 47


def kept(spark, text):
    return spark.createDataFrame([(1, i, c == "T") for i, c in enumerate(text)], "video_id long, i long, keep boolean")


@pytest.mark.parametrize(("before", "cadence", "after"), [("TFFTTTT", 3, "TTTTTTT"), ("TFFFT", 3, "TFFFT"), ("TFFFFT", 3, "TFFFFT"), ("TFT", 0, "TFT")])
def test_smoothing(spark, before, cadence, after):
    got = runs.smooth(kept(spark, before), cadence).orderBy("i").collect()
    assert "".join("T" if r.keep else "F" for r in got) == after


def test_ranges_and_segments(spark):
    seg = lambda t: [(r.start_sec, r.end_sec) for r in runs.keep_segments(kept(spark, t), 10.0).orderBy("segment_index").collect()]
    assert seg("TTFFTTT") == [(0.0, 0.2), (0.4, 0.7)] and seg("TTT") == [(0.0, 0.3)]
    assert [(r["first"], r["last"]) for r in runs.keep_ranges(kept(spark, "TTFFTTT")).orderBy("first").collect()] == [(0, 1), (4, 6)]


def test_calibration(spark):
    stats = spark.createDataFrame(list(zip([1] * 4, [1.0, 2.0, 0.5, 3.0], [0.2, 0.3, 0.1, 0.5])), "video_id long, mean_mag double, diff_fraction double")
    r = runs.calibrate(stats).first()
    assert abs(r.flow - 0.48) < 1e-12 and abs(r.area - 0.058) < 1e-12
    assert runs.calibrate(stats.limit(1)).first().flow == 0.5 and runs.calibrate(stats, lock_flow=True).first().flow == 0.5
    assert runs.calibrate(stats.limit(1)).first().area == 0.15


def test_dead_frame_outcome(spark):
    from cutline.plans import detect

    rows = [(v, i, t == "T") for v, text in ((1, "TTT"), (2, "TFFFT"), (3, "TFFFF"), (4, "T")) for i, t in enumerate(text)]
    df = spark.createDataFrame(rows, "video_id long, i long, keep boolean")
    got = {r.video_id: tuple(r[1:]) for r in detect.dead_frame_outcome(df, 10.0).collect()}
    assert got == {1: (3, 3, 0, True, 0.3), 2: (5, 2, 3, False, 0.2), 3: (5, 1, 4, True, 0.1), 4: (1, 1, 0, True, 0.1)}


def test_dead_rule_order(spark):
    def dead(m, d, i, f, **k):
        row = spark.createDataFrame([(m, d, i, f)], "m double, d double, i double, f double")
        return row.select(runs.dead(F.col("m"), F.col("d"), F.col("i"), F.col("f"), F.lit(0.5), F.lit(0.1), **k)).first()[0]

    assert dead(0.4, 1.0, 0.0, None) and not dead(0.5, 0.1, 0.0, None)
    assert dead(1.0, 1.0, 0.9, 1.1) and not dead(1.0, 0.0, 0.9, 1.1, parallax=True)
    assert not dead(1.0, 1.0, 0.9, 1.1, skip_homography=True) and not dead(1.0, 1.0, 0.9, 1.0)


def test_expand(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(4)], "video_id long, i long, score double")
    got = runs.expand(df, 3).orderBy("out_i").collect()
    assert len(got) == 10 and [round(r.score, 9) for r in got] == [round(k / 3, 9) for k in range(10)]
    model = runs.blend_slot(df, 3, lambda a, b, alpha: a * (1 - alpha) + b * alpha).orderBy("out_i").collect()
    assert [round(r.score, 9) for r in model] == [round(r.score, 9) for r in got]


def scene_rows(spark, durations):
    at, rows = 0, []
    for k, d in enumerate(durations):
        rows.append((1, k, round(at * S), round((at + d) * S)))
        at += d
    return spark.createDataFrame(rows, "video_id long, scene_index long, start_us long, end_us long")


def test_filter_and_remap(spark):
    out = selection.filter_reindex(scene_rows(spark, (2, 0.5, 3)), S).orderBy("start_us")
    assert [(r.scene_index, r.start_us, r.end_us) for r in out.collect()] == [(0, *us(0, 2)), (1, *us(2.5, 5.5))]
    pairs = spark.createDataFrame([(1, 0, 2), (1, 0, 1)], "video_id long, a long, b long")
    assert [tuple(r) for r in selection.remap_pairs(pairs, out).collect()] == [(1, 0, 1)]
    gap = scene_rows(spark, (2, 3)).withColumn("scene_index", F.col("scene_index") + 5)
    assert [r.scene_index for r in selection.filter_reindex(gap, S).collect()] == [5, 6]


def test_merge_similar_keeps_stale_numbers(spark):
    pairs = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "video_id long, a long, b long")
    scenes = scene_rows(spark, (1, 1, 1, 1))
    got = [(r.scene_index, r.start_us, r.end_us) for r in boundary.merge_similar(scenes, pairs).orderBy("start_us").collect()]
    assert got == [(0, *us(0, 2)), (2, *us(2, 3)), (3, *us(3, 4))]
    assert [r.scene_index for r in boundary.merge_similar(scenes, pairs, reindex=True).orderBy("start_us").collect()] == [0, 1, 2]


def test_selection(spark):
    pick = lambda t: spark.range(1).select(selection.selected_indices(F.lit(t), F.lit(3).cast("long"))).first()[0]
    assert pick("0,2,5-8") == [0, 2, 5, 6, 7, 8] and pick("") == pick(None) == [0, 1, 2, 3] and pick("10, ,10") == [10] and pick("4-2") == []


def test_batches(spark):
    df = spark.range(3200).select(F.lit(1).cast("long").alias("video_id"), (F.col("id") + 1).alias("t_us"))
    got = boundary.segment_batches(df).orderBy("chunk").collect()
    assert [r.n_cuts for r in got] == [1500, 1500, 200] and [r.start_us for r in got] == [0, 1500, 3000] and got[2].end_us is None and got[1].relative[0] == 1


def test_tracks(spark):
    order = lambda a, t, n: spark.range(1).select(selection.track_order(F.lit(a), F.lit(t).cast("long"), F.lit(n).cast("long"))).first()[0]
    assert order("aac", 2, 3) == [2, 0, 1] and order("aac", 0, 3) == [0, 1, 2] and order("none", 2, 3) == [] and order("aac", 3, 3) == [0, 1, 2] and order("aac", None, 0) == []


def test_emission(spark):
    ready = spark.createDataFrame([(1, p, t) for p, t in enumerate((5, 1, 9, 2))], "video_id long, pos long, ready_us long")
    assert [(r.a, r.emit_us) for r in emission.pair_emission(ready, 1).orderBy("a").collect()] == [(0, 5), (1, 9), (2, 9)]
    polls = spark.createDataFrame([(1, i, v) for i, v in enumerate((1, 2, 2, 3, 3, 3, 3))], "video_id long, i long, v long")
    assert emission.stable(polls, "v", 3).first().stable_at == 6


def test_presence_counts_from_the_last_one_sent(spark):
    rows = [(1, 10 * S * k, k, "same") for k in range(7)] + [(2, 10 * S * k, k, "a" if k != 3 else None) for k in range(5)]
    got = emission.changed_or_due(spark.createDataFrame(rows, "video_id long, ts_us long, seq long, kind string"), "kind", 15 * S).collect()
    assert sorted(r.seq for r in got if r.video_id == 1) == [0, 2, 4, 6] and sorted(r.seq for r in got if r.video_id == 2) == [0, 2, 3, 4]


def test_previews_alternate(spark):
    df = spark.createDataFrame([(1, k, float(k)) for k in range(7)], "video_id long, i long, pct double")
    assert [(r.i, r.number, r.slot) for r in emission.previews(df, "pct", 2.0, ["i"]).orderBy("i").collect()] == [(0, 1, 1), (2, 2, 0), (4, 3, 1), (6, 4, 0)]


def test_calibration_samples_and_locks(spark):
    stats = spark.createDataFrame([(1, k + 1, m, d) for k, (m, d) in enumerate(zip([1.0, 2.0, 0.5, 3.0, 9.0, 9.0], [0.2, 0.3, 0.1, 0.5, 0.9, 0.9]))], "video_id long, i long, mean_mag double, diff_fraction double")
    r = runs.calibrate(stats, sample=4).first()
    assert abs(r.flow - 0.48) < 1e-12 and abs(r.area - 0.058) < 1e-12
    locked = runs.calibrate(stats, flow=0.05, area=0.0).first()
    assert (locked.flow, locked.area) == (0.05, 0.0)


def test_slots_of_arrays(spark):
    frames = spark.createDataFrame([(1, k, [float(k)] * 6) for k in range(3)], "video_id long, i long, px array<double>")
    doubled = runs.frame_slot(frames, lambda x: x * 2).orderBy("i").collect()
    assert [r.px for r in doubled] == [[2.0 * k] * 6 for k in range(3)]
    seen = []

    def blend(a, b, alpha):
        assert a.shape[1:] == (8, 8) and (a[:, 2:] == 0).all() and (a[:, :, 3:] == 0).all()
        return a * (1 - alpha[:, None, None]) + b * alpha[:, None, None]

    got = runs.pair_slot(frames, 2, blend, 2, 3).orderBy("out_i").collect()
    assert [r.px for r in got] == [[k / 2] * 6 for k in range(5)] and not seen
    steps = [lambda df: runs.frame_slot(df, lambda x: x + 1), lambda df: runs.frame_slot(df, lambda x: x * 10)]
    assert [r.px[0] for r in runs.chain(frames, steps).orderBy("i").collect()] == [10.0, 20.0, 30.0]
    assert sorted((r.operation, r.px[0]) for r in runs.chain(frames, steps, keep=True).collect()) == [(0, 1.0), (0, 2.0), (0, 3.0), (1, 0.0), (1, 10.0), (1, 20.0)]


def test_places_of_images():
    one = image.whole(2, 3)
    assert one.quarter(1).cells == (2, 5, 1, 4, 0, 3) and one.quarter(4) == one and one.rotate(90) == one.quarter(-1)
    assert one.mirror().cells == (2, 1, 0, 5, 4, 3) and one.upside_down().cells == (3, 4, 5, 0, 1, 2)
    assert one.crop(1.4, 0.6, 2, 2).cells == (4, 5, None, None)
    turned = image.whole(8, 8).rotate(30)
    assert (turned.height, turned.width) == (12, 12) and set(turned.cells) - {None} <= set(range(64))
    assert [t.cells[0] for t in image.whole(4, 4).tiles(2)] == [0, 2, 8, 10]
    assert image.window_grid(0, 1, 5) == [0, 0.25, 0.5, 0.75, 1]
