"""Queries of export plans, detector options and probed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media, text
from ..operators import align, planning, selection
from ..sources import dims, encoders
from ..sources.proxies import SQL_FRAMES, frames, table
from .export_queries import SQL_PARTS, parts
from .registry import query
from .sequence_queries import HOUR, SCENE_EVERY, SQL_KEYS, SQL_SCENES, clock, keys, scenes

MODES = (*encoders.AUDIO_ARGS, "no such")


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as exports: source, target, audio, seek_ms, dur_ms, track, count, single, gpu."""
    p = F.col("p_partkey")
    return parts(spark, sf).select(
        "p_partkey",
        "codec",
        "container",
        F.concat(F.lit("in"), p.cast("string"), F.lit(".mkv")).alias("source"),
        F.concat(F.lit("out."), F.col("container")).alias("target"),
        F.get(F.array(*map(F.lit, MODES)), (p % len(MODES)).cast("int")).alias("audio"),
        F.when(p % 3 > 0, (p % 3 - 1) * p * 7).alias("seek_ms"),
        F.when(p % 4 > 0, p * 13).alias("dur_ms"),
        F.when(p % 5 < 4, p % 5).alias("track"),
        (p % 4).alias("n"),
        (p % 7 == 0).alias("single"),
        (p % 2 == 0).alias("gpu"),
    )


_VALUES = ", ".join(f"('{k}', '{' '.join(c)}', {repr(' '.join(g)) if g else 'NULL'})" for k, (c, g) in encoders.VIDEO_ARGS.items())
_AUDIO = ", ".join(f"('{k}', '{' '.join(v)}')" for k, v in encoders.AUDIO_ARGS.items())
_SECONDS = "rtrim(rtrim(printf('%d.%03d', {0} // 1000, {0} % 1000), '0'), '.')"
SQL_JOBS = f"""{SQL_PARTS}, video(name, cpu, gpu_args) AS (VALUES {_VALUES}), sound(mode, args) AS (VALUES {_AUDIO}),
    j AS (SELECT p_partkey, codec, container, 'in' || p_partkey || '.mkv' AS source, 'out.' || container AS target, ['{"', '".join(MODES)}'][p_partkey % {len(MODES)} + 1] AS audio,
      CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 3 - 1) * p_partkey * 7 END AS seek_ms, CASE WHEN p_partkey % 4 > 0 THEN p_partkey * 13 END AS dur_ms, CASE WHEN p_partkey % 5 < 4 THEN p_partkey % 5 END AS track,
      p_partkey % 4 AS n, p_partkey % 7 = 0 AS single, p_partkey % 2 = 0 AS gpu FROM p),
    k AS (SELECT *, coalesce(audio <> 'none' AND track > 0 AND n > 1 AND track < n, false) AS moved FROM j),
    m AS (SELECT *, concat_ws(' ', '-y', CASE WHEN seek_ms > 0 THEN '-ss ' || {_SECONDS.format('seek_ms')} END, '-i ' || source || ' -map 0:v:0',
        CASE WHEN audio = 'none' THEN NULL WHEN single THEN '-map 0:a:' || coalesce(track, 0) || '?' WHEN moved THEN array_to_string(['-map 0:a:' || i for i in list_concat([track], [i for i in range(n) if i <> track])], ' ') ELSE '-map 0:a?' END,
        CASE WHEN dur_ms > 0 THEN '-t ' || {_SECONDS.format('dur_ms')} END) AS head,
      coalesce((SELECT args FROM sound WHERE mode = audio), (SELECT args FROM sound WHERE mode = 'aac')) AS sound_args,
      CASE WHEN moved AND NOT single THEN array_to_string(list_concat(['-disposition:a:0 default'], ['-disposition:a:' || i || ' 0' for i in range(1, n)]), ' ') END AS disposition,
      CASE WHEN container IN ('mp4', 'mov') THEN '-movflags +faststart' END AS fast,
      CASE codec WHEN 'h264' THEN 'h264_high' WHEN 'hevc' THEN 'h265_main' WHEN 'av1' THEN 'av1_main' WHEN 'copy' THEN 'h264_high' WHEN 'vp9' THEN 'h264_high' ELSE codec END AS name FROM k)"""


@query(
    f"""WITH {SQL_JOBS} SELECT p_partkey, concat_ws(' ', head, '-c:v copy', sound_args, disposition, CASE WHEN container IN ('mp4', 'mov') THEN NULL WHEN codec = 'h264' THEN '-bsf:v h264_mp4toannexb' WHEN codec = 'hevc' THEN '-bsf:v hevc_mp4toannexb' END, fast, target) AS args FROM m"""
)
def copy_args(spark: SparkSession, sf: str) -> DataFrame:
    """Arguments of copies."""
    c = F.col
    args = planning.copy_args(c("source"), c("target"), c("audio"), c("seek_ms"), c("dur_ms"), dims.stream_filter(c("codec"), c("container")), c("track"), c("n"), c("single"))
    return jobs(spark, sf).select("p_partkey", F.array_join(args, " ").alias("args"))


@query(
    f"""WITH {SQL_JOBS} SELECT p_partkey, concat_ws(' ', head, '-vf setpts=PTS-STARTPTS', CASE WHEN audio NOT IN ('none', 'copy') THEN '-af asetpts=PTS-STARTPTS,aresample=async=1:first_pts=0' END,
    '-c:v ' || coalesce(CASE WHEN gpu THEN gpu_args END, cpu), sound_args, disposition, '-fps_mode:v:0 cfr', fast,
    CASE WHEN container IN ('mp4', 'mov') AND codec IN ('hevc', 'h265_main12') THEN '-tag:v hvc1' WHEN container = 'mov' AND codec = 'av1' THEN '-tag:v av01' END, '-max_muxing_queue_size 1024', target) AS args FROM m JOIN video USING (name)"""
)
def encode_args(spark: SparkSession, sf: str) -> DataFrame:
    """Arguments of encodes."""
    c = F.col
    args = planning.encode_args(c("source"), c("target"), c("codec"), c("audio"), c("gpu"), c("seek_ms"), c("dur_ms"), c("track"), c("n"), c("single"))
    return jobs(spark, sf).select("p_partkey", F.array_join(args, " ").alias("args"))


@query(
    """WITH c AS (SELECT l_orderkey AS o_orderkey, l_quantity > 48 AS ranged, CASE WHEN l_tax < 0.08 THEN l_linestatus END AS codec, l_discount < 0.09 AND (CASE WHEN l_partkey % 20 = 0 THEN 0.5 ELSE 0 END) < 0.001 AS safe, CASE WHEN l_returnflag = 'R' THEN ['de', 'en'] ELSE ['en'] END AS langs FROM lineitem),
    g AS (SELECT o_orderkey, count(*) AS n, bool_or(ranged) AS ranges, count(DISTINCT codec) = 1 AND count(codec) = count(*) AS one, bool_and(safe) AS safe, count(DISTINCT langs) = 1 AS uniform, any_value(len(langs)) AS tracks FROM c GROUP BY 1),
    s AS (SELECT g.*, CASE WHEN o_orderkey % 3 = 0 THEN 'h265' ELSE 'copy' END AS codec, CASE WHEN o_orderkey % 2 = 0 THEN 'copy' ELSE 'opus' END AS audio, o_custkey % 4 AS given FROM g JOIN orders USING (o_orderkey)),
    d AS (SELECT *, codec = 'copy' AND NOT ranges AND one AND safe AS direct, codec = 'copy' AND ranges AS by_copy FROM s)
    SELECT o_orderkey, n, direct, CASE WHEN direct THEN NULL WHEN by_copy THEN 'copy' WHEN codec = 'copy' THEN 'h264_high' ELSE codec END AS segment_codec, CASE WHEN direct THEN NULL WHEN audio = 'copy' AND NOT by_copy THEN 'aac' ELSE audio END AS segment_audio,
    CASE WHEN NOT direct THEN NOT uniform END AS audio_single, CASE WHEN direct THEN NULL WHEN uniform THEN tracks ELSE given END AS segment_audio_count, CASE WHEN direct THEN CASE WHEN o_orderkey % 4 = 0 THEN given WHEN o_orderkey % 4 = 1 THEN coalesce(list_position(first, 'de') - 1, given) ELSE coalesce(list_position(first, 'en') - 1, given) END END::BIGINT AS direct_track,
    CASE WHEN direct THEN len(first) END AS direct_count, CASE WHEN direct OR by_copy THEN 'copy' ELSE 'reencode' END AS result FROM d
    JOIN (SELECT l_orderkey AS o_orderkey, arg_min(CASE WHEN l_returnflag = 'R' THEN ['de', 'en'] ELSE ['en'] END, l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey) AS first FROM lineitem GROUP BY 1) USING (o_orderkey)"""
)
def merge_plan(spark: SparkSession, sf: str) -> DataFrame:
    """How an order's clips are merged."""
    clips = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("pos"),
        F.when(F.col("l_quantity") > 48, F.col("l_linenumber") * 1000).alias("seek_ms"),
        F.when(F.col("l_tax") < 0.08, F.col("l_linestatus")).alias("codec"),
        (F.col("l_discount") < 0.09).alias("first_is_key"),
        F.when(F.col("l_partkey") % 20 == 0, 0.5).otherwise(0.0).alias("first_sec"),
        F.when(F.col("l_returnflag") == "R", F.array(F.lit("de"), F.lit("en"))).otherwise(F.array(F.lit("en"))).alias("languages"),
    )
    o = F.col("o_orderkey")
    settings = table(spark, sf, "orders").select("o_orderkey", F.when(o % 3 == 0, "h265").otherwise("copy").alias("codec"), F.when(o % 2 == 0, "copy").otherwise("opus").alias("audio"), (F.col("o_custkey") % 4).alias("audio_count"), (F.col("o_custkey") % 4).alias("audio_track"), F.when(o % 4 == 1, "de").when(o % 4 > 1, "EN").alias("audio_language"))
    return planning.merge_plan(clips, settings, "o_orderkey")


@query(
    """WITH f AS (SELECT p_partkey, p_partkey % 2 = 0 AS talk, p_partkey % 3 = 0 AS cam, p_partkey % 5 = 0 AS safe, p_partkey % 7 = 0 AS auto, CASE WHEN p_partkey % 11 = 0 THEN 0.07::DOUBLE END AS small, p_size FROM part), x AS (SELECT *, coalesce(small, CASE WHEN talk OR safe THEN 0.05::DOUBLE ELSE 0.5::DOUBLE END) AS flow, CASE WHEN talk OR safe THEN 0::DOUBLE ELSE 0.15::DOUBLE END AS area FROM f)
    SELECT p_partkey, flow, area, cam OR safe AS skip_homography, auto OR safe OR talk OR cam AS auto, flow < 0.1 AS lock_flow, area < 0.01 AS lock_area, round_even(greatest(0.1, least(1, 360 / greatest(1, p_size * 40)::DOUBLE)), 6) AS scale FROM x"""
)
def flag_derivation(spark: SparkSession, sf: str) -> DataFrame:
    """What a detector's flags come to."""
    p = F.col("p_partkey")
    every = lambda k: p % k == 0
    options = planning.detector_options(F.lit(0.5), F.lit(0.15), every(2), every(3), every(5), every(7), F.when(every(11), 0.07))
    scale = F.bround(planning.detector_scale(F.lit(1.0), F.col("p_size") * 40), 6)
    return table(spark, sf, "part").select("p_partkey", *[c.alias(n) for n, c in options.items()], scale.alias("scale"))


@query("SELECT p_partkey, ['yuv420p10le', 'yuv422p10le', 'yuva444p10le', 'gray'][p_partkey % 4 + 1] AS pixels, ['main10', 'main422-10', 'main444-10', 'main10'][p_partkey % 4 + 1] AS profile FROM part")
def x265_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles by pixel format."""
    pixels = F.get(F.array(*map(F.lit, ("yuv420p10le", "yuv422p10le", "yuva444p10le", "gray"))), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf, "part").select("p_partkey", pixels.alias("pixels"), planning.x265_profile(pixels).alias("profile"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_size % 6 <> 2 OR p_partkey % 3 > 0 AND p_size % 6 NOT IN (2, 4) THEN 'Model ''m' || p_partkey % 3 || ''' supports ' || CASE WHEN p_partkey % 3 = 0 THEN '2x' ELSE '2x/4x' END || ', got ' || p_size % 6 || 'x'
    WHEN p_partkey % 4 = 3 THEN 'Unknown method ''other'' for model ''m' || p_partkey % 3 || '''' END AS problem,
    CASE p_partkey % 5 WHEN 0 THEN '' WHEN 3 THEN 'Anime4K_Clamp_Highlights.glsl,Anime4K_Restore_CNN_VL.glsl,' ELSE 'Anime4K_Restore_CNN_M.glsl,' END || array_to_string(['Anime4K_Upscale_CNN_x2_' || CASE p_partkey % 5 WHEN 0 THEN 'S' WHEN 3 THEN 'VL' ELSE 'M' END || '.glsl' for i in range(greatest(1, p_size % 6 // 2))], ',') AS shaders FROM part"""
)
def shader_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a model runs at a scale, and the shaders of its mode."""
    p, scale = F.col("p_partkey"), (F.col("p_size") % 6).cast("int")
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), n.cast("int"))
    scales = F.when(p % 3 == 0, F.array(F.lit(2))).otherwise(F.array(F.lit(2), F.lit(4)))
    problem = planning.upscale_problem(F.concat(F.lit("m"), (p % 3).cast("string")), pick(("ml", "shader", "onnx", "other"), p % 4), scales, scale)
    chain = planning.shader_chain(pick(("light", "medium", "no such", "strong", "Medium"), p % 5), scale)
    return table(spark, sf, "part").select("p_partkey", problem.alias("problem"), F.array_join(chain, ",").alias("shaders"))


@query(
    """SELECT n_nationkey, n_name || k AS key, method, n_name || '.pth' AS file, CASE k WHEN 'a' THEN 'https://m.example/' || CASE WHEN n_regionkey = 1 THEN 'depth' ELSE 'upscale' END || '/' || n_name || '.pth' WHEN 'b' THEN 'https://o.example/' || n_name || '.pth' ELSE 'https://given.example/' || n_nationkey END AS url
    FROM nation CROSS JOIN (VALUES ('a', 'ml'), ('b', 'onnx'), ('c', 'ml')) AS t(k, method)"""
)
def registry_load(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of model registries, one registry for each nation."""
    f = lambda t: F.format_string(t.replace("NAME", "%1$s").replace("KEY", "%2$s"), "n_name", "n_nationkey")
    category = F.when(F.col("n_regionkey") == 1, ',"category":"depth"').otherwise("")
    json = F.concat(
        f('{"_source":{"ml":"https://m.example/","onnx":"https://o.example/"},"_note":{"file":"x"},"NAMEa":{"method":"ml","file":"NAME.pth"'),
        category,
        f('},"NAMEb":{"method":"onnx","file":"NAME.pth"},"NAMEc":{"method":"ml","file":"NAME.pth","url":"https://given.example/KEY"}}'),
    )
    return table(spark, sf, "nation").select("n_nationkey", F.inline(planning.registry(json)))


@query(
    """WITH x AS (SELECT o_orderkey, o_custkey % 4000 AS w, o_orderkey % 2000 AS h, o_orderkey % 5 AS c, o_custkey % 100000 AS cs FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 13 > 0 THEN w END AS width, CASE WHEN o_orderkey % 13 > 0 THEN h END AS height, c = 1 AS hevc, trunc(25 * 1000 / 1001.0::DOUBLE * (cs / 100.0::DOUBLE))::BIGINT AS n_frames, trunc((cs / 100.0::DOUBLE) * 1000)::BIGINT AS duration_ms FROM x"""
)
def probe_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Size, codec, frame count and duration from probed texts."""
    o = F.col("o_orderkey")
    cs = F.col("o_custkey") % 100_000
    size = F.when(o % 13 > 0, F.concat_ws("x", (F.col("o_custkey") % 4000).cast("string"), (o % 2000).cast("string"))).otherwise("N/A")
    codec = F.get(F.array(*map(F.lit, ("h264", " HEVC ", "hevc1", "", "av1"))), (o % 5).cast("int"))
    seconds = F.concat_ws(".", F.floor(cs / 100).cast("string"), F.lpad((cs % 100).cast("string"), 2, "0"))
    w, h = text.dimensions(size)
    return table(spark, sf, "orders").select(
        "o_orderkey",
        w.alias("width"),
        h.alias("height"),
        dims.is_hevc(codec).alias("hevc"),
        media.frame_count(text.fraction(F.lit("25000/1001")), seconds.cast("double")).alias("n_frames"),
        text.duration_ms(seconds).alias("duration_ms"),
    )


@query(f"WITH {SQL_SCENES}, r AS (SELECT video_id, scene_index FROM scenes WHERE (video_id * 3 + scene_index) % 4 = 0) SELECT s.video_id, s.scene_index, r.scene_index IS NOT NULL AS thumbnail_ready FROM scenes s LEFT JOIN r ON r.video_id = s.video_id AND r.scene_index = s.scene_index")
def thumbnail_readiness(spark: SparkSession, sf: str) -> DataFrame:
    """Which scenes have their thumbnail."""
    s = scenes(spark, sf).select("video_id", "scene_index")
    return selection.with_readiness(s, s.where((F.col("video_id") * 3 + F.col("scene_index")) % 4 == 0), ["video_id", "scene_index"])


@query(
    f"""WITH {SQL_SCENES}, c AS (SELECT video_id, count(*) AS n_keys FROM keys GROUP BY 1)
    SELECT s.video_id, s.scene_index, coalesce(n_keys, 0) AS n_keys, CASE WHEN s.video_id % 2 = 0 THEN 'hevc' ELSE 'h264' END AS codec FROM scenes s LEFT JOIN c USING (video_id) WHERE s.scene_index % 3 > 0"""
)
def source_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs with what is found out once for each of their sources."""
    jobs_ = scenes(spark, sf).where("scene_index % 3 > 0").select("video_id", "scene_index")
    facts = keys(spark, sf).groupBy("video_id").agg(F.count("*").alias("n_keys"))
    found = selection.per_source(jobs_, lambda sources: sources.join(facts, "video_id", "left").select("video_id", F.coalesce("n_keys", F.lit(0)).alias("n_keys"), F.when(F.col("video_id") % 2 == 0, "hevc").otherwise("h264").alias("codec")), "video_id")
    return found.select("video_id", "scene_index", "n_keys", "codec")


@query(f"WITH {SQL_PARTS} SELECT p_partkey, CASE WHEN codec = 'vp9' THEN 'codec' WHEN container = 'webm' THEN 'container' WHEN hardware = 'gpu' AND p_partkey % 5 = 0 THEN 'hardware' END AS rejected FROM p")
def settings_check(spark: SparkSession, sf: str) -> DataFrame:
    """The first setting that isn't one of those allowed."""
    p = parts(spark, sf).withColumn("hardware", F.when((F.col("hardware") == "gpu") & (F.col("p_partkey") % 5 == 0), "tpu").otherwise(F.col("hardware")))
    allowed = {"codec": (*encoders.VIDEO_ARGS, *dims.EXPORT_ALIASES, "copy"), "container": ("mp4", "mov", "mkv", "mxf"), "hardware": ("auto", "cpu", "gpu")}
    return p.select("p_partkey", planning.first_rejected(allowed).alias("rejected"))


# pieces of sequences

SQL_RANGES = f"{SQL_KEYS}, ranges AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t_us) - 1 AS segment, t_us AS start_us, t_us + {5 * HOUR} AS end_us FROM keys)"


@query(f"WITH {SQL_RANGES} SELECT r.video_id, r.segment, f.i FROM ranges r JOIN frames f ON f.video_id = r.video_id AND f.ts_us - 1704067200000000 >= r.start_us AND f.ts_us - 1704067200000000 < r.end_us")
def segment_copy(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of ranges of time, the end excluded."""
    from ..operators import boundary

    k = keys(spark, sf)
    ranges = k.select("video_id", (F.row_number().over(boundary.by_video("t_us")) - 1).cast("long").alias("segment"), F.col("t_us").alias("start_us"), (F.col("t_us") + 5 * HOUR).alias("end_us"))
    return boundary.frames_in(clock(frames(spark, sf)).select("video_id", "i", "t_us"), ranges, 5 * HOUR).select("video_id", "segment", "i")


@query(f"WITH {SQL_SCENES} SELECT s.video_id, s.scene_index, min(f.ts_us - 1704067200000000) AS first_us FROM scenes s JOIN frames f ON f.video_id = s.video_id AND f.ts_us - 1704067200000000 >= s.start_us + 3600000000 GROUP BY 1, 2")
def frame_at(spark: SparkSession, sf: str) -> DataFrame:
    """The first frame at or after a time, an hour into each scene: one sorted pass for all times."""
    points = scenes(spark, sf).select("video_id", "scene_index", (F.col("start_us") + HOUR).alias("t_us"))
    near = align.neighbours(points, clock(frames(spark, sf)).select("video_id", "t_us"), ("scene_index",))
    return near.where("k_at_or_after is not null").select("video_id", "scene_index", F.col("k_at_or_after").alias("first_us"))


@query(
    f"""WITH {SQL_FRAMES}, f AS (SELECT video_id, i // {SCENE_EVERY} AS scene_index, i, is_key, seq FROM frames),
    p AS (SELECT video_id, scene_index, coalesce(min(i) FILTER (WHERE is_key AND scene_index % 2 = 0), min(i)) AS i FROM f GROUP BY 1, 2)
    SELECT video_id, scene_index, i, is_key, greatest(1, 960 * (seq % 5) // (16 + seq % 100)) AS height FROM p JOIN f USING (video_id, scene_index, i)"""
)
def thumbnails(spark: SparkSession, sf: str) -> DataFrame:
    """The frame that stands for each scene, and its height at 960 columns; scenes of even number are copies."""
    rows = frames(spark, sf).select("video_id", F.floor(F.col("i") / SCENE_EVERY).alias("scene_index"), "i", "is_key", "seq")
    picked = selection.posters(rows, ["video_id", "scene_index"], "i", F.col("scene_index") % 2 == 0)
    return picked.select("video_id", "scene_index", "i", "is_key", media.height_at(F.col("seq") % 100 + 16, F.col("seq") % 5).alias("height"))


@query(
    """WITH k AS (SELECT user_id, event_id, (props::JSON->>'k')::BIGINT AS k FROM events), b AS (SELECT user_id, k % 4 AS block, max(32 + k) AS c FROM k GROUP BY 1, 2),
    g AS (SELECT user_id, max(block) AS last, count(*) AS n, list(c ORDER BY block) AS channels FROM b GROUP BY 1), w AS (SELECT user_id, max(k) + 8 AS second, max(4 * (k % 9)) AS out FROM k GROUP BY 1)
    SELECT user_id, CASE WHEN last + 1 <> n THEN 'blocks' END AS problem, CASE WHEN last + 1 = n THEN array_to_string(channels, ',') END AS channels, CASE WHEN last + 1 = n THEN out // 4 END AS out_channels,
    CASE WHEN last + 1 = n AND user_id % 3 > 0 THEN CASE WHEN user_id % 3 = 1 THEN 'head4' ELSE 'head2' END END AS encode, CASE WHEN last + 1 = n THEN second > CASE WHEN user_id % 3 > 0 THEN 20 ELSE 12 END END AS propagates FROM g JOIN w USING (user_id)"""
)
def architecture(spark: SparkSession, sf: str) -> DataFrame:
    """Architectures from names and shapes of tensors."""
    e = table(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    name = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    head = F.when(F.col("user_id") % 3 == 1, "encode.cnn0.weight").when(F.col("user_id") % 3 == 2, "encode.0.weight").otherwise("other")
    block = F.col("k") % 4
    shaped = [(name("block", block, ".conv0.1.0.weight"), 32 + F.col("k"), F.lit(0)), (F.lit("block0.lastconv.0.weight"), F.lit(0), 4 * (F.col("k") % 9)), (F.lit("block1.conv0.0.0.weight"), F.lit(0), F.col("k") + 8), (head, F.lit(0), F.lit(0))]
    rows = e.select("user_id", F.inline(F.array(*[F.struct(n.alias("name"), a.cast("long").alias("dim0"), b.cast("long").alias("dim1")) for n, a, b in shaped])))
    # one tensor for each name; blocks 0 and 1 are named by other tensors too
    once = rows.groupBy("user_id", "name").agg(F.max("dim0").alias("dim0"), F.max("dim1").alias("dim1"))
    made = planning.state_blocks(once, "user_id")
    return made.withColumn("channels", F.array_join(F.transform("channels", lambda c: c.cast("string")), ","))
