"""Queries over details of files and exports: packets by index, streams, parts of a cut, encoders, panels, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import image, media, text, vector
from ..operators import planning
from ..sources import dims, packet_files
from ..sources.files import shared_folder
from ..sources.proxies import SQL_FRAMES, SQL_PACKETS, frames, packets, table
from .image_queries import H, WIDTH
from .registry import query
from .sequence_queries import HOUR, SQL_SNAPPED, START, align, keys, scenes
from .vector_queries import SQL_IMAGES, cells, images

LOW, HIGH = START + 100 * HOUR, START + 400 * HOUR


@query(
    f"""WITH {SQL_PACKETS} SELECT video_id::VARCHAR AS video, seq, coalesce(CASE WHEN value >= 5 THEN ts_us END, ts_us - 40000) AS t_us FROM packets
    WHERE is_key AND coalesce(CASE WHEN value >= 5 THEN ts_us END, ts_us - 40000) BETWEEN {LOW} AND {HIGH}"""
)
def packet_scan_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Keyframes of a range of time from files of packets: the filter is answered from the files' index."""
    path = shared_folder(spark, "packets")
    rows = packets(spark, sf).select("video_id", "seq", F.when(F.col("value") >= 5, F.col("ts_us")).alias("pts_us"), (F.col("ts_us") - 40_000).alias("dts_us"), "is_key")
    packet_files.write_packets(rows, path, block=16)
    found = packet_files.read_packets(spark, path).where(F.col("is_key") & F.col("t_us").between(LOW, HIGH))
    return found.select("video", "seq", "t_us")


@query(f"WITH {SQL_FRAMES} SELECT video_id, count(*) AS n_packets, array_to_string(list(i ORDER BY i) FILTER (is_key), ',') AS positions FROM frames GROUP BY 1")
def key_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Where in each video its keyframes stand."""
    at = F.array_sort(F.collect_list(F.when(F.col("is_key"), F.col("i"))))
    g = frames(spark, sf).groupBy("video_id").agg(F.count("*").alias("n_packets"), at.alias("at"))
    return g.select("video_id", "n_packets", F.when(F.size("at") > 0, F.array_join("at", ",")).alias("positions"))


@query(
    """WITH s AS (SELECT o_orderkey, o_totalprice, l_linenumber AS i, l_partkey AS p, l_suppkey AS u, l_returnflag AS f, l_quantity AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT o_orderkey, i AS index, CASE f WHEN 'A' THEN 'audio' WHEN 'R' THEN 'video' END AS type, CASE f WHEN 'A' THEN 'aac' ELSE 'h264' END AS codec, CASE WHEN f = 'R' THEN p::INT END AS width, CASE WHEN f = 'R' THEN u::INT END AS height,
    CASE WHEN f = 'R' THEN CASE WHEN q = 7 THEN 0 ELSE round_even(24000 / (1000 + q), 3) END END AS fps, CASE WHEN f = 'A' THEN 48000 END AS sample_rate, CASE WHEN f = 'A' THEN (q::INT % 6) END AS channels,
    CASE WHEN q::INT % 2 = 0 THEN (p * 10)::BIGINT END AS bit_rate FROM s WHERE f IN ('A', 'R')"""
)
def stream_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Streams of probed files as rows, from nested JSON: video and audio, each with what it has."""
    line, part, supplier, kind, q = (F.col(f"l_{c}") for c in ("linenumber", "partkey", "suppkey", "returnflag", "quantity"))
    video, audio = kind == "R", kind == "A"
    stream = F.struct(
        line.alias("index"),
        F.when(audio, "audio").when(video, "video").otherwise("subtitle").alias("codec_type"),
        F.when(audio, "aac").otherwise("h264").alias("codec_name"),
        F.when(video, part).alias("width"),
        F.when(video, supplier).alias("height"),
        F.when(video, F.when(q == 7, "0/0").otherwise(F.concat(F.lit("24000/"), (1000 + q).cast("int").cast("string")))).alias("avg_frame_rate"),
        F.when(audio, "48000").alias("sample_rate"),
        F.when(audio, q.cast("int") % 6).alias("channels"),
        F.when(q.cast("int") % 2 == 0, (part * 10).cast("string")).alias("bit_rate"),
    )
    probed = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_json(F.struct(F.collect_list(stream).alias("streams"))).alias("probe"))
    rows = table(spark, sf, "orders").select("o_orderkey").join(probed, "o_orderkey").select("o_orderkey", F.inline(media.streams(F.col("probe"))))
    return rows.where("type in ('video', 'audio')").withColumn("fps", F.bround("fps", 3))


SQL_SMART = f"""{SQL_SNAPPED}, smart AS (SELECT * FROM snapped WHERE end_us > start_us AND NOT (coalesce(start_us - b <= {HOUR}, false) OR coalesce(f - start_us <= {HOUR}, false)) AND video_id % 2 = 1 AND u < end_us AND (u - start_us) / (end_us - start_us)::DOUBLE < 0.9),
    parts AS (SELECT video_id, scene_index, 0 AS part, 'encode' AS how, start_us, u AS end_us FROM smart UNION ALL SELECT video_id, scene_index, 1, 'copy', u, end_us FROM smart UNION ALL SELECT video_id, scene_index, 2, 'concat', NULL, NULL FROM smart)"""


@query(
    f"""WITH {SQL_SMART} SELECT video_id, scene_index, part, how, start_us, end_us, CASE part
    WHEN 0 THEN concat_ws(' ', '-y', CASE WHEN start_us > 10000000 THEN '-ss ' || printf('%.3f', (start_us - 10000000) / 1e6::DOUBLE) END, '-i in.mkv -ss ' || printf('%.3f', least(start_us, 10000000) / 1e6::DOUBLE) || ' -t ' || printf('%.3f', (end_us - start_us) / 1e6::DOUBLE),
      '-map 0:v:0 -map 0:a? -pix_fmt yuv420p', CASE WHEN video_id % 3 = 0 THEN '-c:v h264_nvenc -preset p1 -rc vbr -cq 16 -b:v 0' ELSE '-c:v libx264 -preset ultrafast -crf 16' END, '-c:a aac -b:a 128k head.mp4')
    WHEN 2 THEN '-y -f concat -safe 0 -i parts.txt -map 0:v:0 -map 0:a? -c:v copy -c:a copy -movflags +faststart -max_muxing_queue_size 1024 out.mp4' END AS args FROM parts"""
)
def smartcut_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The steps of scenes that are cut in two, with the arguments of those that run an encoder or join."""
    points = scenes(spark, sf).select("video_id", "scene_index", "end_us", F.col("start_us").alias("t_us"))
    near = align.neighbours(points, keys(spark, sf), ("scene_index", "end_us"))
    t, v = F.col("t_us"), F.col("video_id")
    on_key = F.coalesce(t - F.col("k_before") <= HOUR, F.lit(False)) | F.coalesce(F.col("k_at_or_after") - t <= HOUR, F.lit(False))
    snap = align.earlier_snap(t, F.col("k_at_or_before"), F.col("k_after"), 8 * HOUR, F.col("end_us"))
    mode = align.cut_mode(t, F.col("end_us"), on_key, snap, F.col("k_after"), v % 2 == 0, F.lit(False))
    steps = planning.smartcut_parts(near.select("video_id", "scene_index", t.alias("start_us"), "end_us", F.col("k_after").alias("next_us"), mode.alias("mode")))
    none = F.lit(None).cast("long")
    encode = planning.edge_args(F.lit("in.mkv"), F.lit("head.mp4"), F.col("start_us"), F.col("end_us"), v % 3 == 0)
    join = planning.concat_args(F.lit("parts.txt"), F.lit("out.mp4"), F.lit("copy"), none, none, F.lit(""))
    return steps.withColumn("args", F.array_join(F.when(F.col("part") == 0, encode).when(F.col("part") == 2, join), " "))


@query(
    """WITH x AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'gpu' ELSE 'cpu' END AS hardware FROM part)
    SELECT p_partkey, array_to_string(CASE p_partkey % 4 WHEN 0 THEN ['h264_nvenc', 'hevc_nvenc'] WHEN 1 THEN ['av1_nvenc'] WHEN 2 THEN ['h264_nvenc'] ELSE [] END, ',') AS encoders, hardware <> 'cpu' AND p_partkey % 4 IN (0, 2) AS cuda FROM x"""
)
def encoder_listing(spark: SparkSession, sf: str) -> DataFrame:
    """GPU encoders out of a listing, and whether edges of scenes are encoded with CUDA."""
    p = F.col("p_partkey")
    line = lambda name: F.lit(f" V....D {name}  an encoder\n")
    listing = F.concat(line("libx264"), F.when(p % 4 == 0, F.concat(line("h264_nvenc"), line("hevc_nvenc"))).when(p % 4 == 1, line("av1_nvenc")).when(p % 4 == 2, line("h264_nvenc")).otherwise(""))
    hardware = F.when(p % 3 == 0, "auto").when(p % 3 == 1, "gpu").otherwise("cpu")
    found = table(spark, sf, "part").select("p_partkey", dims.listed_encoders(listing).alias("found"), hardware.alias("hardware"))
    return found.select("p_partkey", F.array_join("found", ",").alias("encoders"), dims.use_cuda(F.col("hardware"), F.col("found")).alias("cuda"))


_CHANNEL = "CASE " + " ".join(f"WHEN x <= {b}::DOUBLE THEN floor({{0}}_low_{i} + (x - {a}::DOUBLE) / ({b}::DOUBLE - {a}::DOUBLE) * ({{0}}_high_{i} - {{0}}_low_{i}))" for i, ((a, _), (b, _)) in enumerate(zip(image.JET, image.JET[1:], strict=False))) + " END"


def _jet_sql(c: int) -> str:
    out = _CHANNEL
    for i, ((_, low), (_, high)) in enumerate(zip(image.JET, image.JET[1:], strict=False)):
        out = out.replace(f"{{0}}_low_{i}", f"{low[c]}::DOUBLE").replace(f"{{0}}_high_{i}", f"{high[c]}::DOUBLE")
    return out


MARGIN = 2


@query(
    f"""WITH {SQL_IMAGES}, lo AS (SELECT vec_id, px, list_min(px) AS lo, list_max(px) AS hi FROM images), d AS (SELECT vec_id, cell, CASE WHEN hi > lo THEN floor((px[cell + 1] - lo) / (hi - lo) * 255) ELSE 0 END AS level FROM (SELECT *, unnest(range(64)) AS cell FROM lo)),
    c AS (SELECT vec_id, cell, level, [{_jet_sql(0)}, {_jet_sql(1)}, {_jet_sql(2)}] AS rgb FROM (SELECT *, level / 255.0::DOUBLE AS x FROM d)),
    cells AS (SELECT vec_id, cell // 8 AS y, cell % 8 * 3 + k AS pos, level AS v FROM (SELECT *, unnest(range(3)) AS k FROM c)
      UNION ALL SELECT DISTINCT vec_id, cell // 8, 24 + k, 255 FROM (SELECT *, unnest(range({3 * MARGIN})) AS k FROM c)
      UNION ALL SELECT vec_id, cell // 8, {24 + 3 * MARGIN} + cell % 8 * 3 + k, rgb[k + 1] FROM (SELECT *, unnest(range(3)) AS k FROM c))
    SELECT vec_id, y::INT AS row, sum((pos + 1) * v)::BIGINT AS checked, count(*) AS n FROM cells GROUP BY 1, 2"""
)
def depth_panel(spark: SparkSession, sf: str) -> DataFrame:
    """A map of levels in colours beside the picture itself, with a margin between: a weighted sum of each row."""
    lo, hi = F.array_min("px"), F.array_max("px")
    level = F.transform("px", lambda x: F.coalesce(F.floor((x - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 255), F.lit(0)))
    levels = images(spark, sf).select("vec_id", "px", lo.alias("lo"), hi.alias("hi")).select("vec_id", level.alias("level"))
    gray = F.flatten(F.transform("level", lambda v: F.array(v, v, v)))
    made = levels.select("vec_id", image.panel(gray, image.coloured(F.col("level")), H, WIDTH, MARGIN).alias("p"))
    wide = 3 * (2 * WIDTH + MARGIN)
    at = made.select("vec_id", F.posexplode("p").alias("at", "v"))
    return at.groupBy("vec_id", F.floor(F.col("at") / wide).cast("int").alias("row")).agg(F.sum((F.col("at") % wide + 1) * F.col("v")).cast("long").alias("checked"), F.count("*").alias("n"))


@query(f"WITH {SQL_IMAGES} SELECT vec_id, cell, CASE WHEN px[cell + 1] > 0.05 THEN 255.0 ELSE 0 END::DOUBLE AS v FROM (SELECT vec_id, px, unnest(range(64)) AS cell FROM images)")
def image_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels above a level as white, all others black."""
    return cells(images(spark, sf).select("vec_id", image.above(F.col("px"), 0.05).alias("v")), "v")


@query(f"WITH {SQL_IMAGES}, n AS (SELECT vec_id, px, unnest(range(64)) AS cell FROM images) SELECT vec_id, cell, round_even(0.1::DOUBLE + exp(0.3::DOUBLE) * px[cell + 1], 6) AS v FROM n")
def gaussian_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels as noise of a normal distribution."""
    return cells(images(spark, sf).select("vec_id", F.transform("px", lambda x: vector.gaussian_sample(x, F.lit(0.1), F.lit(0.3))).alias("v")), "v")


@query(
    """WITH x AS (SELECT event_id, event_id * 7919 % 1000000 AS us, event_id % 9 AS k, (event_id % 121)::DOUBLE AS elapsed FROM events), y AS (SELECT *, CASE WHEN k > 0 THEN us END AS read FROM x), z AS (SELECT *, read / 10000.0::DOUBLE AS pct FROM y),
    s AS (SELECT *, CASE WHEN pct > 0 AND pct < 100 AND elapsed > 0 THEN elapsed / pct * (100 - pct) ELSE 0 END AS rest FROM z)
    SELECT event_id, read AS out_us, round_even(pct, 6) AS percent, round_even(rest, 6) AS seconds_left, CASE WHEN rest >= 3600 THEN printf('%d:%02d:%02d', floor(rest)::BIGINT // 3600, floor(rest)::BIGINT % 3600 // 60, floor(rest)::BIGINT % 60) ELSE printf('%02d:%02d', floor(rest)::BIGINT // 60, floor(rest)::BIGINT % 60) END AS eta FROM s"""
)
def progress_eta(spark: SparkSession, sf: str) -> DataFrame:
    """From lines of an encoder's progress to the time that is left; videos have a second, and time has passed."""
    e = F.col("event_id")
    line = F.when(e % 9 > 0, F.concat(F.lit("out_time_ms="), (e * 7919 % 1_000_000).cast("string"))).otherwise("speed=1.0x")
    rows = table(spark, sf, "events").select("event_id", text.out_time_us(line).alias("out_us"), (e % 121).cast("double").alias("elapsed")).withColumn("percent", F.col("out_us") / 10_000)
    rest = text.seconds_left(F.col("elapsed"), F.col("percent"))
    return rows.withColumn("rest", rest).select("event_id", "out_us", F.bround("percent", 6).alias("percent"), F.bround("rest", 6).alias("seconds_left"), text.eta(F.col("rest")).alias("eta"))
