"""Queries of selection, lookup and export planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import attempts, selection
from ..sources import dims
from ..sources.files import shared_folder
from ..sources.proxies import SQL_PACKETS, packets, table
from .registry import query
from .sequence_queries import HOUR, SQL_SCENES, scenes


@query(
    f"""WITH {SQL_SCENES}, sel AS (SELECT video_id, max(scene_index) AS last FROM scenes GROUP BY 1),
    picks AS (SELECT video_id, unnest(CASE video_id % 3 WHEN 0 THEN range(last + 1) WHEN 1 THEN [0, 2, 5, 6, 7, 8] ELSE [1, 999] END) AS p FROM sel)
    SELECT s.video_id, s.scene_index FROM scenes s SEMI JOIN picks ON s.video_id = picks.video_id AND s.scene_index = picks.p"""
)
def selection_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes that a list of numbers and ranges selects."""
    s = scenes(spark, sf)
    wanted = F.when(F.col("video_id") % 3 == 0, "").when(F.col("video_id") % 3 == 1, "0, 2,,5-8").otherwise("1,999")
    picks = s.groupBy("video_id").agg(F.max("scene_index").alias("last")).select("video_id", F.explode(selection.selected_indices(wanted, F.col("last"))).alias("scene_index"))
    return s.join(picks, ["video_id", "scene_index"], "left_semi").select("video_id", "scene_index")


SQL_CLIPS = f"""{SQL_SCENES}, clips AS (SELECT video_id, scene_index, 'clip_' || video_id || '_' || scene_index AS path, CASE WHEN scene_index % 5 = 1 THEN 'failed' ELSE 'copy' END AS mode FROM scenes WHERE scene_index % 3 > 0)"""


def clips(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("scene_index")
    return scenes(spark, sf).where(i % 3 > 0).select("video_id", "scene_index", F.concat_ws("_", F.lit("clip"), F.col("video_id").cast("string"), i.cast("string")).alias("path"), F.when(i % 5 == 1, "failed").otherwise("copy").alias("mode"))


@query(
    f"""WITH {SQL_CLIPS}, j AS (SELECT s.*, c.path, coalesce(c.mode <> 'failed', false) AS ok FROM scenes s LEFT JOIN clips c ON s.video_id = c.video_id AND s.scene_index = c.scene_index)
    SELECT video_id, scene_index, CASE WHEN ok THEN path ELSE 'video_' || video_id END AS input, CASE WHEN NOT ok THEN round_even(start_us / 1000::DOUBLE, 0)::BIGINT END AS seek_ms, CASE WHEN NOT ok THEN round_even((end_us - start_us) / 1000::DOUBLE, 0)::BIGINT END AS dur_ms FROM j"""
)
def job_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """The source of each exported scene."""
    return selection.resolve_jobs(scenes(spark, sf), clips(spark, sf))


@query(f"WITH {SQL_CLIPS} SELECT s.video_id, s.scene_index, coalesce(c.path, '') AS path, coalesce(c.mode, 'failed') AS mode FROM scenes s LEFT JOIN clips c ON s.video_id = c.video_id AND s.scene_index = c.scene_index")
def cut_results(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes with what became of them."""
    return selection.with_results(scenes(spark, sf).select("video_id", "scene_index"), clips(spark, sf), ["video_id", "scene_index"])


@query(f"WITH {SQL_CLIPS} SELECT video_id, count(*) > 1 AND bool_and(rn = scene_index) AND count(*) FILTER (mode IS NOT NULL AND mode = 'failed') = 0 AS eligible FROM (SELECT s.video_id, s.scene_index, c.mode, row_number() OVER (PARTITION BY s.video_id ORDER BY s.scene_index) - 1 AS rn FROM scenes s LEFT JOIN clips c ON s.video_id = c.video_id AND s.scene_index = c.scene_index) GROUP BY 1")
def segmenter_eligible(spark: SparkSession, sf: str) -> DataFrame:
    """May a video be cut in one go: several scenes, numbered by place, none failed?"""
    from ..operators.boundary import by_video

    rows = scenes(spark, sf).join(clips(spark, sf), ["video_id", "scene_index"], "left").withColumn("rn", F.row_number().over(by_video("scene_index")) - 1)
    return rows.groupBy("video_id").agg(((F.count("*") > 1) & F.bool_and(F.col("rn") == F.col("scene_index")) & (F.count_if(F.col("mode") == "failed") == 0)).alias("eligible"))


@query("SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linestatus) = 1 AS same_codec, count(DISTINCT l_returnflag) = 1 AS uniform_audio FROM lineitem GROUP BY 1")
def uniform_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Do an order's clips share codec and audio layout?"""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linestatus", F.array("l_returnflag").alias("langs"))
    return selection.layout(items, "l_orderkey", "l_linestatus", "langs")


SQL_ITEMS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(
    f"""SELECT {SQL_ITEMS}, row_number() OVER w - 1 AS ordinal, coalesce(sum(l_quantity::BIGINT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"""
)
def ordered_concat_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Where each clip begins in the whole."""
    items = table(spark, sf, "lineitem").select(*SQL_ITEMS.split(", "), F.col("l_quantity").cast("long").alias("q"))
    return selection.concat_offsets(items, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "q").drop("q")


SQL_CODEC = "CASE p_partkey % 8 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' WHEN 2 THEN 'av1' WHEN 3 THEN 'prores_422' WHEN 4 THEN 'h265_main12' WHEN 5 THEN 'h264_high10' WHEN 6 THEN 'copy' ELSE 'vp9' END"
SQL_BOX = "CASE p_size % 5 WHEN 0 THEN 'mp4' WHEN 1 THEN 'mov' WHEN 2 THEN 'mkv' WHEN 3 THEN 'mxf' ELSE 'webm' END"


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """p_partkey, codec, container, hardware: parts as export settings."""
    pick = lambda n, xs: F.get(F.array(*map(F.lit, xs)), n.cast("int"))
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey",
        pick(p % 8, ["h264", "hevc", "av1", "prores_422", "h265_main12", "h264_high10", "copy", "vp9"]).alias("codec"),
        pick(F.col("p_size") % 5, ["mp4", "mov", "mkv", "mxf", "webm"]).alias("container"),
        pick(p % 3, ["auto", "gpu", "cpu"]).alias("hardware"),
    )


SQL_PARTS = f"p AS (SELECT p_partkey, {SQL_CODEC} AS codec, {SQL_BOX} AS container, CASE p_partkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'gpu' ELSE 'cpu' END AS hardware FROM part), q AS (SELECT *, CASE codec WHEN 'hevc' THEN 'h265' WHEN 'h265_main12' THEN 'h265' WHEN 'av1' THEN 'av1' WHEN 'prores_422' THEN 'prores' ELSE 'h264' END AS family FROM p)"


@query(
    f"""WITH {SQL_PARTS} SELECT p_partkey, codec, container, family, CASE container WHEN 'mp4' THEN family <> 'prores' WHEN 'mxf' THEN family = 'prores' ELSE true END AS fits, CASE WHEN family = 'prores' THEN 'mov' ELSE 'mp4' END AS recommended,
    CASE WHEN container IN ('mp4', 'mov') AND family = 'h265' THEN 'hvc1' WHEN container = 'mov' AND family = 'av1' THEN 'av01' END AS tag,
    CASE WHEN container IN ('mp4', 'mov') THEN NULL WHEN codec = 'h264' THEN 'h264_mp4toannexb' WHEN codec = 'hevc' THEN 'hevc_mp4toannexb' END AS bsf FROM q"""
)
def codec_container_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Does a codec fit a container, and what else goes with the two?"""
    c, b = F.col("codec"), F.col("container")
    return parts(spark, sf).select("p_partkey", "codec", "container", dims.family(c).alias("family"), dims.compatible(c, b).alias("fits"), dims.recommended_container(c).alias("recommended"), dims.codec_tag(c, b).alias("tag"), dims.stream_filter(c, b).alias("bsf"))


@query(
    f"""WITH {SQL_PARTS}, a AS (SELECT *, CASE p_partkey % 6 WHEN 0 THEN ' AAC ' WHEN 1 THEN 'opus' WHEN 2 THEN 'pcm_s16le' WHEN 3 THEN '' WHEN 4 THEN 'dts' END AS audio FROM p)
    SELECT p_partkey, coalesce(trim(audio), '') = '' OR CASE container WHEN 'mp4' THEN lower(trim(audio)) IN ('aac', 'opus') WHEN 'mov' THEN lower(trim(audio)) IN ('aac', 'pcm_s16le') ELSE true END AS safe, CASE WHEN container IN ('mkv', 'webm') THEN 'copy' ELSE 'aac' END AS fallback FROM a"""
)
def audio_copy_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """May an audio track be copied into a container?"""
    n = F.col("p_partkey") % 6
    audio = F.when(n == 0, " AAC ").when(n == 1, "opus").when(n == 2, "pcm_s16le").when(n == 3, "").when(n == 4, "dts")
    return parts(spark, sf).select("p_partkey", dims.audio_copy_safe(audio, F.col("container")).alias("safe"), dims.fallback_audio(F.col("container")).alias("fallback"))


@query(f"WITH {SQL_PARTS} SELECT p_partkey, coalesce(codec IN ('h264', 'hevc') AND (hardware = 'gpu' OR hardware = 'auto' AND p_partkey % 2 = 0), false) AS gpu FROM p")
def gpu_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Is a GPU used, with two encoders installed, and CUDA for half of the parts?"""
    encoders = F.array(F.lit("h264_nvenc"), F.lit("hevc_nvenc"))
    return parts(spark, sf).select("p_partkey", dims.use_gpu(F.col("codec"), F.col("hardware"), F.col("p_partkey") % 2 == 0, encoders).alias("gpu"))


@query(f"WITH {SQL_PARTS} SELECT p_partkey, codec, CASE codec WHEN 'h264' THEN 'h264_high' WHEN 'hevc' THEN 'h265_main' WHEN 'av1' THEN 'av1_main' ELSE codec END AS for_export, CASE codec WHEN 'h264' THEN 'h264_main' WHEN 'hevc' THEN 'h265_main' ELSE codec END AS elsewhere FROM p")
def codec_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Full names of codecs under both sets of aliases."""
    return parts(spark, sf).select("p_partkey", "codec", dims.normalise(F.col("codec")).alias("for_export"), dims.normalise(F.col("codec"), dims.ALIASES).alias("elsewhere"))


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 14 WHEN 2 THEN 20 WHEN 3 THEN 22 WHEN 4 THEN 26 ELSE 17 END AS crf, CASE p_partkey % 6 WHEN 2 THEN 'medium' WHEN 3 THEN 'veryfast' WHEN 4 THEN 'ultrafast' ELSE 'slow' END AS x264 FROM part"""
)
def registry_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Quality presets by name; an unknown one counts as high."""
    named = table(spark, sf, "part").select("p_partkey", F.get(F.array(*map(F.lit, ["archival", "high", "balanced", "fast", "draft", "no such"])), (F.col("p_partkey") % 6).cast("int")).alias("preset"))
    high = dims.PRESETS["high"]
    out = named.join(F.broadcast(dims.presets(spark)), "preset", "left")  # five literal rows
    return out.select("p_partkey", F.coalesce("crf", F.lit(high[0])).alias("crf"), F.coalesce("x264", F.lit(high[1])).alias("x264"))


@query(f"WITH {SQL_PARTS} SELECT p_partkey, CASE WHEN codec = 'copy' AND p_partkey % 7 > 0 THEN 'copy' WHEN p_partkey % 11 > 0 THEN 'reencode' WHEN p_partkey % 2 = 0 THEN 'reencode_cpu' ELSE 'failed' END AS how FROM p")
def fallback_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """The first way of exporting that works: copy, encode, encode without GPU."""
    def copy(row: dict) -> str:
        if row["p_partkey"] % 7 == 0:
            raise ValueError("parameters don't match")
        return "copy"

    def on_gpu(row: dict) -> str:
        if row["p_partkey"] % 11 == 0:
            raise RuntimeError("NVENC: no capable devices found" if row["p_partkey"] % 2 == 0 else "disk full")
        return "reencode"

    rungs = [("copy", copy, F.col("codec") == "copy"), ("reencode", on_gpu, None), ("reencode_cpu", lambda row: "reencode", text.gpu_session_error(F.col("error")))]
    tried = attempts.ladder(parts(spark, sf).select("p_partkey", "codec"), rungs, shared_folder(spark, "ladder"))
    return tried.select("p_partkey", F.coalesce("how", F.lit("failed")).alias("how"))


@query(
    """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE 'aac' END AS audio, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey % 5 END AS track, o_orderkey % 4 AS n FROM orders),
    y AS (SELECT *, coalesce(audio <> 'none' AND track > 0 AND n > 1 AND track < n, false) AS h FROM x)
    SELECT o_orderkey, h AS hoisted, CASE WHEN audio = 'none' THEN '' ELSE array_to_string(CASE WHEN h THEN list_concat([track], [i for i in range(n) if i <> track]) ELSE range(n) END, ',') END AS track_list FROM y"""
)
def track_hoist(spark: SparkSession, sf: str) -> DataFrame:
    """The order of audio tracks with a chosen one first."""
    o = F.col("o_orderkey")
    x = table(spark, sf, "orders").select("o_orderkey", F.when(o % 5 == 0, "none").otherwise("aac").alias("audio"), F.when(o % 7 > 0, F.col("o_custkey") % 5).alias("track"), (o % 4).alias("n"))
    a = (F.col("audio"), F.col("track"), F.col("n"))
    return x.select("o_orderkey", selection.hoisted(*a).alias("hoisted"), F.array_join(F.transform(selection.track_order(*a), lambda i: i.cast("string")), ",").alias("track_list"))


@query("WITH l AS (SELECT doc_id // 8 AS file, list(lang ORDER BY doc_id) AS langs FROM documents GROUP BY 1) SELECT file, (list_position(langs, 'de') - 1)::BIGINT AS track, len(langs) AS n FROM l")
def language_track(spark: SparkSession, sf: str) -> DataFrame:
    """The first track of a language; each eight documents are the streams of a file."""
    listed = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 8).alias("file")).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "lang"))), lambda x: x["lang"]).alias("langs"))
    return listed.select("file", selection.language_track(F.col("langs"), F.lit("DE")).alias("track"), F.size("langs").cast("long").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_files_anti(spark: SparkSession, sf: str) -> DataFrame:
    """What is required and not there."""
    present = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return selection.missing(table(spark, sf, "orders").select("o_orderkey"), present, ["o_orderkey"])


@query("SELECT o_orderkey, bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R') AS hit FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING hit IS NOT NULL AND hit")
def cache_hit_split(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of which both parts are cached."""
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    both = items.groupBy("o_orderkey").agg((F.bool_or(F.col("l_returnflag") == "A") & F.bool_or(F.col("l_returnflag") == "R")).alias("hit"))
    return table(spark, sf, "orders").select("o_orderkey").join(both, "o_orderkey").where("hit")


@query("SELECT user_id, count(*) AS files, sum((props::JSON->>'k')::BIGINT)::BIGINT AS bytes, count(*) FILTER (event_type <> 'view') AS unpaired FROM events GROUP BY 1")
def cache_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Files, bytes and files without a partner in a cache."""
    rows = table(spark, sf, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.groupBy("user_id").agg(F.count("*").alias("files"), F.sum("k").alias("bytes"), F.count_if(F.col("event_type") != "view").alias("unpaired"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS scene_index, '{\"scene_index\":' || (props::JSON->>'k') || ',\"kind\":\"' || event_type || '\"}' AS manifest FROM events")
def json_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest rows read under either key, and written."""
    parsed = F.from_json("props", "scene_index long, index long, k long")
    rows = table(spark, sf, "events").select("event_id", "event_type", parsed.alias("m"))
    index = F.coalesce(F.col("m")["scene_index"], F.col("m")["index"], F.col("m")["k"])
    return rows.select("event_id", index.alias("scene_index"), F.to_json(F.struct(index.alias("scene_index"), F.col("event_type").alias("kind"))).alias("manifest"))


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS passed, count(*) FILTER (event_type = 'error') AS failed, bool_and(event_type <> 'error' OR value < 150) AS healthy FROM events GROUP BY 1")
def env_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Checks passed and failed."""
    bad = F.col("event_type") == "error"
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(~bad).alias("passed"), F.count_if(bad).alias("failed"), F.bool_and(~bad | (F.col("value") < 150)).alias("healthy"))


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') SELECT k, k IN (SELECT k FROM b) AS in_both FROM a")
def set_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of one set, and whether another has them too."""
    o = table(spark, sf, "orders")
    a, b = (o.where(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("k")) for x in "FO")
    both = a.intersect(b).withColumn("in_both", F.lit(True))
    only = a.distinct().exceptAll(a.intersect(b)).withColumn("in_both", F.lit(False))
    return both.unionByName(only)


@query("SELECT source, lang, min(doc_id) AS first_at FROM documents GROUP BY 1, 2")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of each source in order of appearance."""
    return selection.dedup_first(table(spark, sf, "documents"), "source", "lang", "doc_id")


@query(f"WITH {SQL_PACKETS} SELECT video_id, arg_max(seq, ts_us) AS newest FROM packets WHERE kind IN ('view', 'click') AND value > 5 AND ts_us >= {1_704_067_200_000_000 + 48 * HOUR} - 2000000 GROUP BY 1")
def newest_output(spark: SparkSession, sf: str) -> DataFrame:
    """The newest media file that isn't empty, from two seconds before a start on."""
    rows = packets(spark, sf).where(F.col("kind").isin("view", "click") & (F.col("value") > 5) & (F.col("ts_us") >= 1_704_067_200_000_000 + 48 * HOUR - 2_000_000))
    return rows.groupBy("video_id").agg(F.max_by("seq", "ts_us").alias("newest"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_quantity > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def present_files(spark: SparkSession, sf: str) -> DataFrame:
    """Boundary rows whose clip exists and isn't empty."""
    there = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").where("l_quantity > 0").join(there, "l_orderkey", "left_semi").select(*SQL_ITEMS.split(", "))


@query("SELECT o_orderkey, count(*) AS n_streams, count(*) FILTER (l_returnflag = 'A') AS n_audio, min_by(l_linestatus, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey) AS first_codec FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def stream_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Streams of each file: how many, how many with audio, and the first one's codec."""
    items = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    order = F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")
    found = items.groupBy("o_orderkey").agg(F.count("*").alias("n_streams"), F.count_if(F.col("l_returnflag") == "A").alias("n_audio"), F.min_by("l_linestatus", order).alias("first_codec"))
    return table(spark, sf, "orders").select("o_orderkey").join(found, "o_orderkey")


@query(f"WITH {SQL_PACKETS} SELECT seq, split_part('EVENT|' || kind || '|' || value, '|', 1) AS tag, kind AS a, value::VARCHAR AS b FROM packets")
def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an event protocol, split into fields."""
    line = F.concat_ws("|", F.lit("EVENT"), F.col("kind"), F.col("value").cast("string"))
    f = F.split(line, r"\|")
    return packets(spark, sf).select("seq", F.get(f, 0).alias("tag"), F.get(f, 1).alias("a"), F.get(f, 2).alias("b"))


