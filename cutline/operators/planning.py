"""Plans of exports and detections: what would be run, as columns. Nothing is encoded here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import exact_round
from ..functions.text import ms_text, path_suffix
from ..sources import dims, encoders
from .selection import hoisted, language_track, track_order


def words(*xs: str | Column) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])


def only(condition: Column, xs: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), xs).otherwise(F.array().cast("array<string>"))


def _listed(table: dict[str, tuple[str, ...] | None], key: Column) -> Column:
    """Arguments by key from a literal map; null for what it doesn't have."""
    pairs = [x for k, v in table.items() if v is not None for x in (F.lit(k), words(*v))]
    return F.try_element_at(F.create_map(*pairs), key)


def video_args(codec: Column, gpu: Column) -> Column:
    """An unknown codec counts as the default one; a codec without a GPU encoder is encoded on the CPU."""
    cpu = {k: v[0] for k, v in encoders.VIDEO_ARGS.items()}
    name = dims.normalise(codec)
    name = F.when(name.isin(*cpu), name).otherwise(encoders.DEFAULT_VIDEO)
    on_gpu = _listed({k: v[1] for k, v in encoders.VIDEO_ARGS.items()}, name)
    return F.concat(words("-c:v"), F.coalesce(F.when(gpu, on_gpu), _listed(cpu, name)))


def audio_args(mode: Column) -> Column:
    return F.coalesce(_listed(encoders.AUDIO_ARGS, mode), words(*encoders.AUDIO_ARGS[encoders.DEFAULT_AUDIO]))


def audio_maps(audio: Column, track: Column, count: Column, single: Column) -> Column:
    """Which audio tracks are taken, in order: one alone, or a chosen one first and the others after it, or all."""
    each = F.flatten(F.transform(track_order(audio, track, count), lambda i: words("-map", F.concat(F.lit("0:a:"), i.cast("string")))))
    one = words("-map", F.concat(F.lit("0:a:"), F.coalesce(track, F.lit(0)).cast("string"), F.lit("?")))
    return F.when(audio == "none", F.array().cast("array<string>")).when(single, one).when(hoisted(audio, track, count), each).otherwise(words("-map", "0:a?"))


def dispositions(audio: Column, track: Column, count: Column, single: Column) -> Column:
    """A track that was moved to the front becomes the default one."""
    rest = F.flatten(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(count, F.lit(2)) - 1), lambda i: words(F.concat(F.lit("-disposition:a:"), i.cast("string")), "0")))
    return only(~single & hoisted(audio, track, count), F.concat(words("-disposition:a:0", "default"), rest))


def _head(source: Column, audio: Column, seek_ms: Column, dur_ms: Column, track: Column, count: Column, single: Column) -> Column:
    return F.concat(
        words("-y"),
        only(seek_ms > 0, words("-ss", ms_text(seek_ms))),
        words("-i", source, "-map", "0:v:0"),
        audio_maps(audio, track, count, single),
        only(dur_ms > 0, words("-t", ms_text(dur_ms))),
    )


def copy_args(source: Column, target: Column, audio: Column, seek_ms: Column, dur_ms: Column, bsf: Column, track: Column, count: Column, single: Column) -> Column:
    """Arguments that copy a whole input or a range of it."""
    extension = F.lower(path_suffix(target))
    return F.concat(
        _head(source, audio, seek_ms, dur_ms, track, count, single),
        words("-c:v", "copy"),
        audio_args(audio),
        dispositions(audio, track, count, single),
        only(F.length(bsf) > 0, words("-bsf:v", bsf)),
        only(extension.isin(".mp4", ".mov"), words("-movflags", "+faststart")),
        words(target),
    )


def encode_args(source: Column, target: Column, codec: Column, audio: Column, gpu: Column, seek_ms: Column, dur_ms: Column, track: Column, count: Column, single: Column) -> Column:
    """Arguments that encode a whole input or a range of it; times are rebased to 0, of audio too where it is encoded."""
    extension = F.lower(path_suffix(target))
    tag = dims.codec_tag(codec, F.replace(extension, F.lit("."), F.lit("")))
    return F.concat(
        _head(source, audio, seek_ms, dur_ms, track, count, single),
        words("-vf", "setpts=PTS-STARTPTS"),
        only(~audio.isin("none", "copy"), words("-af", "asetpts=PTS-STARTPTS,aresample=async=1:first_pts=0")),
        video_args(codec, gpu),
        audio_args(audio),
        dispositions(audio, track, count, single),
        words("-fps_mode:v:0", "cfr"),
        only(extension.isin(".mp4", ".mov"), words("-movflags", "+faststart")),
        only(tag.isNotNull(), words("-tag:v", tag)),
        words("-max_muxing_queue_size", "1024", target),
    )


#: Seconds that a seek lands before an edge, and what edges are encoded with.
PRE_SEEK = 10.0
EDGE_CPU = ("-c:v", "libx264", "-preset", "ultrafast", "-crf", "16")
EDGE_GPU = ("-c:v", "h264_nvenc", "-preset", "p1", "-rc", "vbr", "-cq", "16", "-b:v", "0")


def seconds_text(us: Column) -> Column:
    """Microseconds as seconds with three places, rounded by the exact binary value (format_string() alone rounds halves of the decimal text up)."""
    return F.format_string("%.3f", exact_round(us / 1e6, 3))


def edge_args(source: Column, target: Column, start_us: Column, end_us: Column, cuda: Column) -> Column:
    """Arguments that encode an edge of a scene: a coarse seek before it, and the rest of the way frame by frame."""
    before = F.greatest(F.lit(0).cast("long"), start_us - int(PRE_SEEK * 1e6))
    return F.concat(
        words("-y"),
        only(before > 0, words("-ss", seconds_text(before))),
        words("-i", source, "-ss", seconds_text(start_us - before), "-t", seconds_text(end_us - start_us), "-map", "0:v:0", "-map", "0:a?", "-pix_fmt", "yuv420p"),
        F.when(cuda, words(*EDGE_GPU)).otherwise(words(*EDGE_CPU)),
        words("-c:a", "aac", "-b:a", "128k", target),
    )


def concat_args(listed: Column, target: Column, audio: Column, track: Column, count: Column, bsf: Column) -> Column:
    """Arguments that join the files of a list without encoding: the video and, unless there is to be none, the audio are copied."""
    extension = F.lower(path_suffix(target))
    return F.concat(
        words("-y", "-f", "concat", "-safe", "0", "-i", listed, "-map", "0:v:0"),
        audio_maps(audio, track, count, F.lit(False)),
        words("-c:v", "copy"),
        F.when(audio == "none", words("-an")).otherwise(words("-c:a", "copy")),
        dispositions(audio, track, count, F.lit(False)),
        only(F.length(bsf) > 0, words("-bsf:v", bsf)),
        only(extension.isin(".mp4", ".mov"), words("-movflags", "+faststart")),
        words("-max_muxing_queue_size", "1024", target),
    )


def smartcut_parts(cuts: DataFrame) -> DataFrame:
    """The three steps of each scene that is cut in two: its head is encoded up to the next keyframe, its tail copied from there, and both are joined.

    cuts (video_id, scene_index, start_us, end_us, next_us, mode) -> video_id, scene_index, part, how, start_us, end_us (null
    for the join).
    """
    step = lambda part, how, a, b: F.struct(F.lit(part).alias("part"), F.lit(how).alias("how"), a.alias("start_us"), b.alias("end_us"))
    none = F.lit(None).cast("long")
    steps = F.array(step(0, "encode", F.col("start_us"), F.col("next_us")), step(1, "copy", F.col("next_us"), F.col("end_us")), step(2, "concat", none, none))
    return cuts.where("mode = 'smartcut'").select("video_id", "scene_index", F.inline(steps))


def copy_concat_safe(first_is_key: Column, first_sec: Column) -> Column:
    """May a clip be joined without encoding: does it show a keyframe first, at once? A clip without frames may not."""
    return F.coalesce(first_is_key & (F.coalesce(first_sec, F.lit(0.0)) < 0.001), F.lit(False))


def merge_plan(clips: DataFrame, settings: DataFrame, key: str) -> DataFrame:
    """How the clips of each key are merged. One aggregation; all legs are minima, maxima and counts, so partial sums go through the shuffle.

    clips (key, pos, seek_ms, codec, first_is_key, first_sec, languages), settings (key, codec, audio, audio_count,
    audio_track, audio_language) -> key, n, direct (joined as they are), segment_codec, segment_audio, audio_single,
    segment_audio_count (null if direct), direct_track, direct_count (null if not: those of the first clip's languages, or
    else the settings'), result. Codecs and languages are compared by 64-bit hashes, so that the aggregation is by hash.
    """
    clips = clips.withColumns({"_codec": F.xxhash64("codec"), "_langs": F.xxhash64("languages"), "_none": F.col("codec").isNull().cast("int")})
    facts = clips.groupBy(key).agg(
        F.count("*").alias("n"),
        F.bool_or(F.col("seek_ms").isNotNull()).alias("ranges"),
        ((F.min("_codec") == F.max("_codec")) & (F.max("_none") == 0)).alias("one_codec"),
        F.bool_and(copy_concat_safe(F.col("first_is_key"), F.col("first_sec"))).alias("safe"),
        (F.min("_langs") == F.max("_langs")).alias("uniform"),
        F.min_by("languages", "pos").alias("first_languages"),
        F.max(F.size("languages")).cast("long").alias("tracks"),
    )
    rows = settings.join(facts, key)
    copies = F.col("codec") == "copy"
    direct = copies & ~F.col("ranges") & F.coalesce(F.col("one_codec"), F.lit(False)) & F.col("safe")
    by_copy = copies & F.col("ranges")
    codec = F.when(by_copy, "copy").when(copies, "h264_high").otherwise(F.col("codec"))
    audio = F.when(~by_copy & (F.col("audio") == "copy"), "aac").otherwise(F.col("audio"))
    segments = lambda x: F.when(~direct, x)
    return rows.select(
        key,
        "n",
        direct.alias("direct"),
        segments(codec).alias("segment_codec"),
        segments(audio).alias("segment_audio"),
        segments(~F.col("uniform")).alias("audio_single"),
        segments(F.when(F.col("uniform"), F.col("tracks")).otherwise(F.col("audio_count"))).alias("segment_audio_count"),
        F.when(direct, F.coalesce(language_track(F.col("first_languages"), F.col("audio_language")), F.col("audio_track"))).cast("long").alias("direct_track"),
        F.when(direct, F.when(F.size("first_languages") > 0, F.size("first_languages")).otherwise(F.col("audio_count"))).cast("long").alias("direct_count"),
        F.when(direct | by_copy, "copy").otherwise("reencode").alias("result"),
    )


def x265_profile(pixels: Column) -> Column:
    """The ten-bit profile that fits a pixel format."""
    return F.when(pixels.contains("444"), "main444-10").when(pixels.contains("422"), "main422-10").otherwise("main10")


def detector_options(flow: Column, area: Column, keep_talking: Column, keep_camera: Column, safe: Column, auto: Column, small_movements: Column) -> dict[str, Column]:
    """What a user's flags come to: thresholds, whether camera movement counts, whether thresholds are calibrated, and which of them are not."""
    talking, camera = keep_talking | safe, keep_camera | safe
    own_flow = F.coalesce(small_movements, F.when(talking, 0.05).otherwise(flow))
    own_area = F.when(talking, 0.0).otherwise(area)
    return {
        "flow": own_flow,
        "area": own_area,
        "skip_homography": camera,
        "auto": auto | safe | keep_talking | keep_camera,
        "lock_flow": own_flow < 0.1,
        "lock_area": own_area < 0.01,
    }


def detector_scale(scale: Column, height: Column) -> Column:
    """Frames are scaled to 360 rows unless a smaller scale was asked for; at least a tenth."""
    asked = F.when(scale >= 1.0, F.least(F.lit(1.0), 360.0 / F.greatest(F.lit(1), height))).otherwise(scale)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), asked))


def upscale_problem(model: Column, method: Column, scales: Column, scale: Column) -> Column:
    """Why a model can't be run at a scale (which scales it has, or which method is unknown), or null."""
    listed = F.array_join(F.transform(scales, lambda s: F.concat(s.cast("string"), F.lit("x"))), "/")
    wrong_scale = F.concat(F.lit("Model '"), model, F.lit("' supports "), listed, F.lit(", got "), scale.cast("string"), F.lit("x"))
    wrong_method = F.concat(F.lit("Unknown method '"), method, F.lit("' for model '"), model, F.lit("'"))
    return F.when(~F.array_contains(scales, scale), wrong_scale).when(~method.isin("ml", "shader", "onnx"), wrong_method)


def shader_chain(mode: Column, scale: Column) -> Column:
    """Shader files in order: those that restore, then the doubling one as often as the scale needs, once at least."""
    name = F.when(mode.isin(*encoders.SHADERS), mode).otherwise(encoders.DEFAULT_SHADERS)
    restore = F.create_map(*[x for k, v in encoders.SHADERS.items() for x in (F.lit(k), F.array(*map(F.lit, v[0])).cast("array<string>"))])
    upscale = dims.lookup({k: v[1] for k, v in encoders.SHADERS.items()}, name)
    return F.concat(F.try_element_at(restore, name), F.array_repeat(upscale, F.greatest(F.lit(1), F.floor(scale / 2)).cast("int")))


def first_rejected(allowed: dict[str, tuple[str, ...]]) -> Column:
    """Name of the first column whose value isn't one of those allowed, or null."""
    return F.coalesce(*[F.when(~F.coalesce(F.col(c).isin(*xs), F.lit(False)), c) for c, xs in allowed.items()])


def registry(text: Column) -> Column:
    """Entries of a model registry, a JSON object, as an array of structs (key, method, file, url). Keys that begin with an underscore are notes. Without a url, one is made of the source of the entry's method, its category, and its file."""
    entries = F.map_entries(F.from_json(text, "map<string,struct<method:string,file:string,category:string,url:string>>"))
    sources = F.from_json(F.get_json_object(text, "$._source"), "map<string,string>")
    models = F.filter(entries, lambda e: ~e["key"].startswith("_"))

    def entry(e: Column) -> Column:
        v = e["value"]
        base = F.coalesce(F.try_element_at(sources, v["method"]), F.lit(""))
        made = F.when(v["method"] == "ml", F.concat(base, F.coalesce(v["category"], F.lit("upscale")), F.lit("/"), v["file"])).when(v["method"] == "onnx", F.concat(base, v["file"])).otherwise(F.nullif(base, F.lit("")))
        return F.struct(e["key"].alias("key"), v["method"].alias("method"), v["file"].alias("file"), F.coalesce(v["url"], made).alias("url"))

    return F.transform(models, entry)


def state_blocks(keys: DataFrame, group: str) -> DataFrame:
    """Architecture of each model from the shapes of its named tensors, or why it has none.

    keys (group, name, dim0, dim1) -> group, problem, channels (of blocks 0..N), out_channels, encode, propagates.
    """
    block = F.regexp_extract("name", r"^block(\d+)\.", 1)
    number = F.when(block != "", block.cast("int"))
    at = lambda name, dim: F.max(F.when(F.col("name") == name, F.col(dim)))
    first = F.when(F.col("name").rlike(r"^block\d+\.conv0\.1\.0\.weight$"), F.struct(number.alias("b"), F.col("dim0").alias("c")))
    g = keys.groupBy(group).agg(
        F.max(number).alias("last"),
        F.count_distinct(number).alias("blocks"),
        F.array_sort(F.collect_set(first)).alias("firsts"),
        at("block0.lastconv.0.weight", "dim1").alias("out"),
        F.coalesce(F.bool_or(F.col("name") == "encode.cnn0.weight"), F.lit(False)).alias("head4"),
        F.coalesce(F.bool_or(F.col("name") == "encode.0.weight"), F.lit(False)).alias("head2"),
        at("block1.conv0.0.0.weight", "dim1").alias("second"),
    )
    encode = F.when(F.col("head4"), "head4").when(F.col("head2"), "head2")
    baseline = F.when(encode.isNotNull(), 6 + 2 * 4 + 1 + 1 + 4).otherwise(6 + 1 + 1 + 4)
    problem = (
        F.when(F.col("last").isNull() | (F.col("last") + 1 != F.col("blocks")), "blocks")
        .when(F.size("firsts") < F.col("blocks"), "conv0")
        .when(F.col("out").isNull(), "lastconv")
        .when(F.col("second").isNull(), "block1")
    )
    ok = lambda x: F.when(problem.isNull(), x)
    return g.select(group, problem.alias("problem"), ok(F.col("firsts")["c"]).alias("channels"), ok(F.floor(F.col("out") / 4)).alias("out_channels"), ok(encode).alias("encode"), ok(F.col("second") > baseline).alias("propagates"))
