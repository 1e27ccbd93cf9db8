"""Literal cases of scalar and array functions, files, registries and streams."""

import json

import pytest
from pyspark.sql import functions as F

from cutline.functions import image, media, text, vector
from cutline.sources import dims, files, raw_frames


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("f", "x", "want"),
    [
        (text.progress, "Interpolated 30/120 Frames", 25.0),
        (text.progress, "12.5 %", 12.5),
        (text.progress, "abc", None),
        (text.progress, "Interpolated 3/0 frames at 7%", 7.0),
        (text.strip_prefixes, "module.flownet.block1.conv0.weight", "block1.conv0.weight"),
        (text.fraction, "24000/1001", 24000 / 1001),
        (text.fraction, "25/0", None),
        (text.fraction, "25", None),
        (text.error, "RAN OUT OF MEMORY", "Out of memory"),
        (text.error, "fine", None),
        (text.path_stem, "a/b.c/d.tar.gz", "d.tar"),
        (text.path_stem, "/.hidden", ".hidden"),
        (text.path_suffix, "a/b.c/d", ""),
        (text.quote_concat, "it's", "file 'it'\\''s'"),
        (text.log_message, "[10:00] [N]: hi", "hi"),
        (text.segment_number, "x_0012.mp4", 12),
    ],
)
def test_text(spark, f, x, want):
    assert value(spark, f(F.lit(x))) == want


@pytest.mark.parametrize(
    ("f", "x", "want"),
    [
        (text.plain_seconds, 12_499_000, "12.499"),
        (text.plain_seconds, 0, "0"),
        (text.ms_text, 1500, "1.5"),
        (text.duration, 366_105, "1h 01m 01.05s"),
        (text.duration, 5_950, "59.50s"),
        (text.file_size, 1_572_864, "1.5 MB"),
        (text.file_size, 1000, "1000 B"),
        (text.bitrate, 2_500_000, "2.5 Mbps"),
        (text.bitrate, 0, "-"),
        (text.eta, 3661, "1:01:01"),
    ],
)
def test_formats(spark, f, x, want):
    assert value(spark, f(F.lit(x).cast("long"))) == want


def test_segment_times_are_early(spark):
    assert value(spark, text.segment_times(F.array(F.lit(12_500_000).cast("long"), F.lit(0).cast("long")))) == "12.499,0"


def test_names_and_noise(spark):
    assert value(spark, text.output_name(F.lit("ep_####"), F.lit(7), F.lit("mp4"))) == "ep_0007.mp4"
    assert value(spark, text.output_name(F.lit("ep"), F.lit(7), F.lit("mov"))) == "ep_0007.mov"
    assert value(spark, text.noise(F.lit("[segment @ 0x1] Opening 'a.mp4' for writing"))) and not value(spark, text.noise(F.lit("hello")))
    assert value(spark, text.gpu_session_error(F.lit("NVENC: No capable devices"))) and not value(spark, text.gpu_session_error(F.lit("device")))


def test_sizes(spark):
    w, h = media.fit(*[F.lit(x) for x in (1920, 1080, 2, 2560, 1440)])
    assert (value(spark, w), value(spark, h)) == (2560, 1440)
    rates = media.bitrate_budget(F.lit(10), F.lit(60), F.lit(192))
    assert tuple(value(spark, c) for c in rates.values()) == (1074, 1557, 2148)
    assert value(spark, media.bitrate_budget(F.lit(1), F.lit(900), F.lit(192))["video_kbps"]) is None
    assert value(spark, media.encode_threads(F.lit(3840), F.lit(2160), F.lit(16))) == 4


def test_vectors(spark):
    zero, v = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert value(spark, vector.cosine(zero, v)) == 1.0 and abs(value(spark, vector.cosine(v, v)) - 1) < 1e-12
    px = F.sequence(F.lit(0), F.lit(11))
    assert value(spark, vector.average_pool(px, 3, 4, 2)) == [2.5, 4.5]
    one = image.whole(3, 4)
    assert value(spark, one.quarter(1).take(px, 0))[:3] == [3, 7, 11]
    assert value(spark, one.quarter(1).quarter(3).take(px, 0)) == list(range(12))
    assert value(spark, one.mirror().take(px, 0))[:4] == [3, 2, 1, 0]
    grid = F.sequence(F.lit(0), F.lit(63))
    assert value(spark, vector.depth_to_space(vector.space_to_depth(grid, 8, 8, 2), 8, 8, 2)) == list(range(64))
    with pytest.raises(ValueError):
        vector.space_to_depth(grid, 8, 8, 3)
    inside = vector.bilinear(grid, 8, 8, F.lit(0.5), F.lit(0.5))
    assert value(spark, inside) == 4.5 and value(spark, vector.bilinear(grid, 8, 8, F.lit(-5.0), F.lit(0.0), border=False)) == 0.0


def test_registries(spark):
    c = lambda x: F.lit(x)
    assert value(spark, dims.compatible(c("prores_422"), c("mp4"))) is False and value(spark, dims.compatible(c("prores_422"), c("mov"))) is True
    assert value(spark, dims.family(c("who knows"))) == "h264" and value(spark, dims.normalise(c("h264"), dims.ALIASES)) == "h264_main"
    assert value(spark, dims.audio_copy_safe(c(None).cast("string"), c("mp4"))) and not value(spark, dims.audio_copy_safe(c("dts"), c("mp4")))
    assert value(spark, dims.use_gpu(c("h264"), c("gpu"), F.lit(False), F.array(F.lit("h264_nvenc")))) and not value(spark, dims.use_gpu(c("h264_high10"), c("gpu"), F.lit(True), F.array(F.lit("x"))))
    assert dims.codecs(spark).count() == 14


def test_manifests_and_presets(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.json").write_text(json.dumps([{"index": 3, "start": 1.0, "end": 2.0}]))
    (tmp_path / "m/b.json").write_text(json.dumps({"scenes": [{"scene_index": 4, "path": "p"}]}))
    got = files.read_manifest(spark, f"{tmp_path}/m")
    assert sorted(r.scene_index for r in got.collect()) == [3, 4]
    files.write_manifest(got, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    (tmp_path / "in.json").write_text(json.dumps(["a.mp4", {"input": "b.mp4", "start_sec": 0.0055, "end_sec": 2}, {"no": 1}, {"input": "c.mp4", "scene_index": 9, "start_sec": "x"}, {"input": ""}]))
    got = files.read_inputs(spark, f"{tmp_path}/in.json").collect()
    assert {(r.scene_index, r.input, r.seek_ms, r.dur_ms) for r in got} == {(0, "a.mp4", None, None), (1, "b.mp4", 6, 1994), (9, "c.mp4", None, None)}
    files.save_preset(spark, f"{tmp_path}/presets", "x", ["a", "b"], {"k": "v"})
    files.save_preset(spark, f"{tmp_path}/presets", "y", ["a"], {})
    assert {r.name: r.runnable for r in files.presets(spark, f"{tmp_path}/presets").collect()} == {"x": True, "y": False}
    assert files.delete_preset(spark, f"{tmp_path}/presets", "x") and files.presets(spark, f"{tmp_path}/presets").count() == 1


def test_cache(spark, tmp_path):
    cache = files.SceneCache(spark, f"{tmp_path}/cache")
    rows = spark.createDataFrame([("a", "keyframe", 0), ("b", "keyframe", 0)], "print string, method string, scene_index long")
    assert cache.split(rows)[1].count() == 2
    cache.add(rows)
    hit, miss = cache.split(spark.createDataFrame([("a",), ("c",)], "print string"))
    assert [r.print for r in hit.collect()] == ["a"] and [r.print for r in miss.collect()] == ["c"]
    assert {(r.print, r.n_scenes) for r in cache.listed().collect()} == {("a", 1), ("b", 1)}
    assert not cache.clear("edges") and cache.clear("keyframe")
    cache.clear()
    assert cache.read() is None and cache.listed() is None


def test_detect(spark):
    from cutline.plans.detect import detect_scenes, drop_dead_frames, export_jobs

    rows = [(1, i * 1_000_000, i % 4 == 1, i, 0.9 if i == 5 else 0.1) for i in range(12)]
    df = spark.createDataFrame(rows, "video_id long, t_us long, is_key boolean, i long, score double")
    assert [r.start_us for r in detect_scenes(df, "keyframe").orderBy("scene_index").collect()] == [0, 5_000_000, 9_000_000]
    assert detect_scenes(df, "scores").count() == 2 and detect_scenes(df, "edges", 0.5).count() == 3
    for bad in ({"method": "x"}, {"threshold": 0}):
        with pytest.raises(ValueError):
            detect_scenes(df, **bad)
    scenes = detect_scenes(df, "keyframe")
    clips = spark.createDataFrame([(1, 0, "c0", "copy"), (1, 1, "c1", "failed")], "video_id long, scene_index long, path string, mode string")
    assert {(r.scene_index, r.input, r.seek_ms) for r in export_jobs(scenes, clips, "0-1").collect()} == {(0, "c0", None), (1, "video_1", 5000)}
    stats = spark.createDataFrame([(1, i, 0.0 if i == 2 else 3.0, 0.5, 0.0, None) for i in range(1, 5)], "video_id long, i long, mean_mag double, diff_fraction double, inlier_ratio double, frob_norm double")
    assert [(r.start_sec, r.end_sec) for r in drop_dead_frames(stats, 1.0, cadence=1).orderBy("segment_index").collect()] == [(0.0, 2.0), (3.0, 5.0)]
    # a run shorter than three is an animation's own hold
    assert [(r.start_sec, r.end_sec) for r in drop_dead_frames(stats, 1.0).collect()] == [(0.0, 5.0)]


def stream(spark, tmp_path, rows, schema, op, name):
    """op over a stream of one file a batch, in order."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/{name}")
    q = op(df).writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    return spark.read.parquet(f"{tmp_path}/{name}-out").collect()


def test_streams(spark, tmp_path):
    from cutline.operators.boundary import greedy_merge
    from cutline.streaming import stateful

    parts = [[(1, t) for t in (0, 3, 5, 9)], [(1, t) for t in (10, 14, 20)]]
    got = stream(spark, tmp_path, parts, "video_id long, t_us long", lambda d: stateful.greedy(d, 5), "greedy")
    batch = greedy_merge(spark.createDataFrame(sum(parts, []), "video_id long, t_us long"), 5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))
    got = stream(spark, tmp_path, [[(1, 2), (1, 0)], [(1, 1), (1, 3)]], "video_id long, pos long", stateful.ordered_pairs, "order")
    assert sorted(r.a for r in got) == [0, 1, 2]


def test_detect_by_models_and_edges(spark):
    from cutline.plans import detect

    rows = [(1, i, float(i % 40 == 39)) for i in range(130)]
    df = spark.createDataFrame(rows, "video_id long, i long, feature double")
    scored = {r.i: r.score for r in detect.window_scores(df, lambda x: x * 0.9).collect()}
    assert scored == {i: 0.9 * f for _, i, f in rows}
    assert detect.detect_scenes(df, "scores", model=lambda x: x * 0.9).count() == 4
    edges = [[1.0, 0.0], [1.0, 0.0], [0.0, 0.0], [0.0, 1.0], [0.0, 1.0]]
    packets = spark.createDataFrame([(1, k * 1_000_000, k == 2, e) for k, e in enumerate(edges)], "video_id long, t_us long, is_key boolean, edges array<double>")
    assert [r.start_us for r in detect.detect_scenes(packets, "edges", 0.5).orderBy("scene_index").collect()] == [0, 3_000_000]
    good = [(1, k, k * 1_000_000) for k in range(4)] + [(2, 0, 5), (2, 1, 5)]
    p, d = (spark.createDataFrame(x, "video_id long, seq long, t_us long") for x in (good, [(2, 0, 7), (2, 1, 2_000_007), (3, 0, 9)]))
    assert sorted(map(tuple, detect.keyframe_times(p, d).collect())) == [(1, k * 1_000_000, False) for k in range(4)] + [(2, 7, True), (2, 2_000_007, True), (3, 9, True)]
    assert detect.keyframe_summary(p.where("video_id = 1")).first().average_gap == 1.0
    with pytest.raises(ValueError):
        detect.pipeline(df, [lambda x: x])


def test_videos(spark, tmp_path):
    from cutline.plans.videos import Videos
    from cutline.sources.files import SceneCache

    schema = "video_id long, path string, size long, mtime_ns long, rate string, dimensions string, seconds string, codec string"
    facts = spark.createDataFrame([(1, "/in/a.mkv", 10, 5, "25/1", "64x48", "12.5", "hevc"), (2, "/in/b.mkv", 10, 5, "x", "N/A", "N/A", None)], schema)
    packets = spark.createDataFrame([(1, k * 1_000_000, k % 4 == 0) for k in range(12)] + [(1, None, True)], "video_id long, t_us long, is_key boolean")
    v = Videos(facts, packets)
    cache = SceneCache(spark, f"{tmp_path}/cache")
    rows = {r.video_id: r for r in v.probe(cache).collect()}
    assert (rows[1].width, rows[1].n_frames, rows[1].hevc, rows[1].n_keys, rows[1].average_gap, rows[1].cached) == (64, 312, True, 3, 4.0, False)
    assert (rows[2].width, rows[2].fps, rows[2].n_frames, rows[2].duration_ms, rows[2].n_keys) == (None, None, None, None, 0)
    cache.add(v.with_prints().where("video_id = 1").selectExpr("print", "'keyframe' as method", "0 as scene_index"))
    assert {r.video_id: r.cached for r in v.probe(cache).collect()} == {1: True, 2: False}
    assert [(r.scene_index, r.start_us) for r in v.scenes(least_us=3_500_000).orderBy("scene_index").collect()] == [(0, 0), (1, 4_000_000)]
    cuts = spark.createDataFrame([(1, 0, 4_000_000, 8_000_000), (1, 1, 5_000_000, 8_000_000), (3, 0, 0, 9)], "video_id long, scene_index long, start_us long, end_us long")
    assert {(r.video_id, r.scene_index): (r.start_us, r.mode) for r in v.cuts(cuts).collect()} == {(1, 0): (4_000_000, "copy"), (1, 1): (4_000_000, "snapped_copy"), (3, 0): (0, "reencode")}
    at = spark.createDataFrame([(1, 2_500_000, "x"), (1, 99_000_000, "y")], "video_id long, t_us long, name string")
    assert [(r.name, r.frame_us) for r in v.frames_at(at).collect()] == [("x", 3_000_000)]
    assert v.segments(spark.createDataFrame([(1, 2_000_000, 5_000_000)], "video_id long, start_us long, end_us long"), 2_000_000).count() == 3
    s = "item long, clip string, thumbnail string, source string, start_us long, end_us long"
    items = [(0, "c", "t", None, None, None), (1, "c", None, None, None, None), (2, None, None, None, 0, 1), (3, None, None, "/in/z", 0, 1), (4, "", "t", "/in/a.mkv", 5, 5), (5, None, None, "/in/a.mkv", None, 5), (6, None, None, "/in/a.mkv", 5_000_000, 8_000_000), (7, None, None, "/in/b.mkv", 0, 9)]
    want = {0: ("copied", None, "there", None), 1: ("copied", None, "first_keyframe", None), 2: (None, None, None, "no source"), 3: (None, None, None, "unknown source"), 4: (None, None, None, "empty range"), 5: (None, None, None, "no range")}
    want |= {6: ("snapped_copy", 4_000_000, "first_keyframe", None), 7: ("reencode", 0, "first_frame", None)}
    assert {r[0]: tuple(r[1:]) for r in v.materialise(spark.createDataFrame(items, s)).collect()} == want
    assert v.materialise(spark.createDataFrame([], s)).count() == 0


def test_dead_frame_flags(spark):
    from cutline.plans.detect import dead_frames

    schema = "video_id long, i long, mean_mag double, diff_fraction double, inlier_ratio double, frob_norm double"
    rows = [(1, 0.5, 0.5, 0.9, 2.0), (2, 0.04, 0.5, 0.0, None), (3, 3.0, 0.05, 0.0, None), (4, 3.0, 0.5, 0.9, 2.0)]
    stats = spark.createDataFrame([(1, *r) for r in rows], schema)
    kept = lambda **o: [r.i for r in dead_frames(stats, **o).where("keep").orderBy("i").collect()]
    assert kept(auto=False) == [0]
    assert kept(auto=False, parallax=True) == [0, 1, 4]
    assert kept(auto=False, small_movements=0.01) == [0, 2]
    # calibrated: 0.6 x the 20 % percentile of 0.04, 0.5, 3, 3, and 0.4 x the 15 % percentile of 0.05 and 0.5
    assert kept(keep_camera=True) == [0, 1, 4]
    assert kept(safe=True) == [0, 1, 3, 4]
    assert kept(keep_talking=True, sample=1) == [0, 3]
    assert dead_frames(spark.createDataFrame([], schema)).count() == 0


def test_stream_windows_and_log_tail(spark, tmp_path):
    from cutline.operators.boundary import sliding_windows
    from cutline.streaming import stateful

    n = 23
    rows = [(1, i, float(i), i == n - 1) for i in range(n)]
    listener = stateful.ProgressListener()
    spark.streams.addListener(listener)
    got = stream(spark, tmp_path, [rows[:9], rows[9:11], rows[11:]], "video_id long, i long, value double, last boolean", lambda d: stateful.sliding_windows(d, 10, 4), "windows")
    spark.streams.removeListener(listener)
    want = {}
    for r in sliding_windows(spark.createDataFrame(rows, "video_id long, i long, value double, last boolean"), 10, 4).collect():
        want.setdefault(r.w, {})[r.slot] = r.value
    assert {r.w: list(r.frames) for r in got} == {w: [v[s] for s in range(10)] for w, v in want.items()}
    assert sum(r.scored for r in got) == n
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.log").write_text("[x] [y]: Interpolated 30/120 Frames\n\nInterpolation failed\n[Done]\n")
    q = stateful.log_tail(spark, f"{tmp_path}/logs").writeStream.format("parquet").option("path", f"{tmp_path}/tail").option("checkpointLocation", f"{tmp_path}/tail-cp").trigger(availableNow=True).start()
    q.awaitTermination(100)
    tail = spark.read.parquet(f"{tmp_path}/tail").collect()
    assert {(r.message, r.percent, r.done, r.error) for r in tail} == {("Interpolated 30/120 Frames", 25.0, False, None), ("Interpolation failed", None, False, "Interpolation failed"), ("[Done]", None, True, None)}


def test_raw_frames(spark, tmp_path):
    size = 2 * 3 * 3
    a, b = bytes(range(size)) * 5, bytes(size) * 2 + b"left behind"
    (tmp_path / "a.raw").write_bytes(a)
    (tmp_path / "b.raw").write_bytes(b)
    (tmp_path / "c.raw").write_bytes(b"")
    read = lambda path, **more: raw_frames.read_frames(spark, path, height=2, width=3, split=2 * size, **more)
    rows = read(str(tmp_path)).orderBy("path", "i").collect()
    assert [(r["path"][-5:], r["i"]) for r in rows] == [("a.raw", i) for i in range(5)] + [("b.raw", i) for i in range(2)]
    assert b"".join(r["px"] for r in rows) == a + b[: 2 * size]
    assert read(str(tmp_path)).rdd.getNumPartitions() == 4
    assert read(f"file://{tmp_path}/a.raw", limit=3).count() == 3
    assert read(f"{tmp_path}/c.raw").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        read(f"{tmp_path}/nowhere").count()


def test_posters(spark):
    from cutline.operators import selection

    rows = spark.createDataFrame([(1, 0, False, "a"), (1, 1, True, "b"), (2, 4, False, "c"), (2, 5, False, None)], "s long, i long, is_key boolean, note string")
    found = lambda copied: {r["s"]: (r["i"], r["note"]) for r in selection.posters(rows, ["s"], "i", F.lit(copied)).collect()}
    assert found(True) == {1: (1, "b"), 2: (4, "c")}
    assert found(False) == {1: (0, "a"), 2: (4, "c")}
    assert spark.range(1).select(media.height_at(F.lit(1920), F.lit(1080)), media.height_at(F.lit(5000), F.lit(1))).first()[:] == (540, 1)


def test_upscale_problems_name_model_scales_and_method(spark):
    from cutline.operators.planning import upscale_problem

    problem = lambda method, scales, scale: value(spark, upscale_problem(F.lit("m1"), F.lit(method), F.array(*map(F.lit, scales)), F.lit(scale)))
    assert problem("ml", (2, 4), 3) == "Model 'm1' supports 2x/4x, got 3x"
    assert problem("other", (2,), 4) == "Model 'm1' supports 2x, got 4x"
    assert problem("other", (2, 4), 4) == "Unknown method 'other' for model 'm1'"
    assert problem("onnx", (2, 4), 4) is None
