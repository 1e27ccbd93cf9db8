"""Queries of scalar functions: parsing, formatting, hashing, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media, text
from ..sources.proxies import SQL_PACKETS, packets, table
from .registry import query

SQL_LOG = f"""{SQL_PACKETS}, logs AS (SELECT seq, CASE seq % 9 WHEN 0 THEN 'Interpolated ' || seq % 50 || '/' || seq % 80 || ' Frames' WHEN 1 THEN 'at ' || seq % 100 || '.5 %' WHEN 2 THEN 'Error occured in ' || kind
    WHEN 3 THEN 'GPU RAN OUT OF MEMORY' WHEN 4 THEN '[Done] all' WHEN 5 THEN '[a] [b]: note ' || seq WHEN 6 THEN '  ' WHEN 7 THEN '[segment @ 0x' || seq || '] Opening ''out_' || printf('%04d', seq) || '.mp4'' for writing' ELSE 'NVENC: no capable devices' END AS line FROM packets)"""


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a log, made from the packets."""
    n = F.col("seq")
    s = lambda x: x.cast("string")
    made = (
        F.when(n % 9 == 0, F.concat(F.lit("Interpolated "), s(n % 50), F.lit("/"), s(n % 80), F.lit(" Frames")))
        .when(n % 9 == 1, F.concat(F.lit("at "), s(n % 100), F.lit(".5 %")))
        .when(n % 9 == 2, F.concat(F.lit("Error occured in "), F.col("kind")))
        .when(n % 9 == 3, "GPU RAN OUT OF MEMORY")
        .when(n % 9 == 4, "[Done] all")
        .when(n % 9 == 5, F.concat(F.lit("[a] [b]: note "), s(n)))
        .when(n % 9 == 6, "  ")
        .when(n % 9 == 7, F.concat(F.lit("[segment @ 0x"), s(n), F.lit("] Opening 'out_"), F.lpad(s(n), F.greatest(F.lit(4), F.length(s(n))), F.lit("0")), F.lit(".mp4' for writing")))
        .otherwise("NVENC: no capable devices")
    )
    return packets(spark, sf).select("seq", made.alias("line"))


@query(
    f"""WITH {SQL_LOG} SELECT seq, round_even(coalesce(CASE WHEN regexp_matches(line, '^Interpolated') AND split_part(split_part(line, '/', 2), ' ', 1)::INT > 0 THEN split_part(split_part(line, ' ', 2), '/', 1)::DOUBLE / split_part(split_part(line, '/', 2), ' ', 1)::DOUBLE * 100 END,
    CASE WHEN line LIKE 'at %' THEN split_part(line, ' ', 2)::DOUBLE END), 6) AS pct FROM logs"""
)
def log_progress_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Percent done from log lines."""
    return logs(spark, sf).select("seq", F.bround(text.progress(F.col("line")), 6).alias("pct"))


@query(f"WITH {SQL_LOG} SELECT seq, CASE WHEN line LIKE 'Error occured%' THEN 'Error occurred' WHEN line LIKE 'GPU RAN%' THEN 'Out of memory' END AS error, line LIKE '[Done]%' AS done, line LIKE 'NVENC%' AS gpu_fault FROM logs")
def log_error_match(spark: SparkSession, sf: str) -> DataFrame:
    """Errors, completion and GPU faults from log lines."""
    line = F.col("line")
    return logs(spark, sf).select("seq", text.error(line).alias("error"), text.completed(line).alias("done"), text.gpu_session_error(line).alias("gpu_fault"))


@query(f"WITH {SQL_LOG} SELECT seq, CASE WHEN line LIKE '[a] [b]: %' THEN substr(line, 10) ELSE line END AS message FROM logs WHERE seq % 9 NOT IN (6, 7)")
def log_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines that say something, without their prefix."""
    return logs(spark, sf).where(~text.noise(F.col("line"))).select("seq", text.log_message(F.col("line")).alias("message"))


@query(f"WITH {SQL_LOG} SELECT seq, 'out_' || printf('%04d', seq) || '.mp4' AS path, seq AS number FROM logs WHERE seq % 9 = 7")
def segment_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Files that a log says were opened, and their numbers."""
    found = logs(spark, sf).select("seq", text.opened_path(F.col("line")).alias("path")).where("path is not null")
    return found.select("seq", "path", text.segment_number(F.col("path")).alias("number"))


@query("SELECT o_orderkey, (o_custkey % 60000 * 1001)::VARCHAR || '/' || (o_orderkey % 1001)::VARCHAR AS fps, round_even((o_custkey % 60000 * 1001) / nullif(o_orderkey % 1001, 0)::DOUBLE, 6) AS rate FROM orders")
def fraction_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Frame rates written as fractions."""
    made = F.concat_ws("/", (F.col("o_custkey") % 60000 * 1001).cast("string"), (F.col("o_orderkey") % 1001).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", made.alias("fps")).withColumn("rate", F.bround(text.fraction(F.col("fps")), 6))


@query(
    """WITH x AS (SELECT o_orderkey, o_orderkey * 7919 % 2000000 AS cs FROM orders), y AS (SELECT *, cs // 100 AS s FROM x)
    SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%dh %02dm %02d.%02ds', s // 3600, s % 3600 // 60, s % 60, cs % 100) WHEN s >= 60 THEN printf('%dm %02d.%02ds', s // 60, s % 60, cs % 100) ELSE printf('%d.%02ds', s, cs % 100) END AS duration,
    CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS eta FROM y"""
)
def duration_format(spark: SparkSession, sf: str) -> DataFrame:
    """Durations and times left as text."""
    x = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 2_000_000).alias("cs"))
    return x.select("o_orderkey", text.duration(F.col("cs")).alias("duration"), text.eta(F.col("cs") / 100).alias("eta"))


@query(
    """WITH x AS (SELECT o_orderkey, o_orderkey * 104729 % 5000000 AS n FROM orders)
    SELECT o_orderkey, CASE WHEN n >= 1048576 THEN printf('%d.%d MB', round_even(n / 1048576.0::DOUBLE * 10, 0)::BIGINT // 10, round_even(n / 1048576.0::DOUBLE * 10, 0)::BIGINT % 10) WHEN n >= 1024 THEN printf('%d.%d KB', round_even(n / 1024.0::DOUBLE * 10, 0)::BIGINT // 10, round_even(n / 1024.0::DOUBLE * 10, 0)::BIGINT % 10) ELSE n || ' B' END AS size,
    CASE WHEN n = 0 THEN '-' WHEN n >= 1000000 THEN printf('%d.%d Mbps', round_even(n / 1e6::DOUBLE * 10, 0)::BIGINT // 10, round_even(n / 1e6::DOUBLE * 10, 0)::BIGINT % 10) ELSE round_even(n / 1e3::DOUBLE, 0)::BIGINT || ' kbps' END AS rate FROM x"""
)
def size_format(spark: SparkSession, sf: str) -> DataFrame:
    """File sizes and bit rates as text."""
    x = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 104_729 % 5_000_000).alias("n"))
    return x.select("o_orderkey", text.file_size(F.col("n")).alias("size"), text.bitrate(F.col("n")).alias("rate"))


@query("SELECT doc_id, substr(sha1(source || '|' || doc_id || '|' || n_chars), 1, 12) AS print FROM documents")
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Short fingerprints of path, size and time."""
    return table(spark, sf, "documents").select("doc_id", text.fingerprint(F.col("source"), F.col("doc_id"), F.col("n_chars")).alias("print"))


@query("SELECT doc_id, sha256(text) AS digest, sha256(text) = sha256(CASE WHEN doc_id % 3 = 0 THEN text ELSE text || ' ' END) AS verified FROM documents")
def hash_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Digests, compared with expected ones."""
    expected = F.sha2(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" "))), 256)
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), (F.sha2("text", 256) == expected).alias("verified"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'module.flownet.' WHEN 1 THEN 'flownet.' WHEN 2 THEN 'module.' ELSE 'flownet.module.' END || event_type || '.conv' || event_id % 5 || '.weight' AS raw,
    CASE WHEN event_id % 4 = 3 THEN 'module.' ELSE '' END || event_type || '.conv' || event_id % 5 || '.weight' AS key FROM events"""
)
def key_prefix_strip(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of a state table without their prefixes, which are stripped in order."""
    n = F.col("event_id") % 4
    prefix = F.when(n == 0, "module.flownet.").when(n == 1, "flownet.").when(n == 2, "module.").otherwise("flownet.module.")
    raw = F.concat(prefix, F.col("event_type"), F.lit(".conv"), (F.col("event_id") % 5).cast("string"), F.lit(".weight"))
    return table(spark, sf, "events").select("event_id", raw.alias("raw"), text.strip_prefixes(raw).alias("key"))


@query(
    """WITH k AS (SELECT user_id, (props::JSON->>'k')::INT % 6 AS block FROM events)
    SELECT user_id, max(block) + 1 AS blocks, max(block) + 1 = count(DISTINCT block) AS contiguous FROM k GROUP BY 1"""
)
def architecture_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered blocks of a state table, and whether none is missing."""
    key = F.concat(F.lit("block"), (F.get_json_object("props", "$.k").cast("int") % 6).cast("string"), F.lit(".conv.weight"))
    block = F.regexp_extract("key", r"^block(\d+)\.", 1).cast("int")
    rows = table(spark, sf, "events").select("user_id", key.alias("key")).withColumn("block", block)
    return rows.groupBy("user_id").agg((F.max("block") + 1).alias("blocks"), ((F.max("block") + 1) == F.count_distinct("block")).alias("contiguous"))


@query(
    """WITH x AS (SELECT p_partkey, p_size * 40 AS w, p_size * 22 AS h, 2 + p_partkey % 3 AS k, CASE WHEN p_partkey % 4 > 0 THEN 2560 ELSE 0 END AS fw, 1440 AS fh FROM part),
    y AS (SELECT *, w * k AS ow, h * k AS oh FROM x), z AS (SELECT *, fw > 0 AND (ow > fw OR oh > fh) AS o, least(fw / ow::DOUBLE, fh / oh::DOUBLE) AS r FROM y)
    SELECT p_partkey, (CASE WHEN o THEN greatest(2, floor(floor(ow * r) / 2) * 2) ELSE ow END)::BIGINT AS out_w, (CASE WHEN o THEN greatest(2, floor(floor(oh * r) / 2) * 2) ELSE oh END)::BIGINT AS out_h, ((32 - w % 32) % 32)::INT AS pad_w FROM z"""
)
def fit_dims(spark: SparkSession, sf: str) -> DataFrame:
    """Scaled sizes that fit a box."""
    p = F.col("p_partkey")
    x = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 40).alias("w"), (F.col("p_size") * 22).alias("h"), (p % 3 + 2).alias("k"), F.when(p % 4 > 0, 2560).otherwise(0).alias("fw"), F.lit(1440).alias("fh"))
    w, h = media.fit(F.col("w"), F.col("h"), F.col("k"), F.col("fw"), F.col("fh"))
    return x.select("p_partkey", w.alias("out_w"), h.alias("out_h"), media.pad_to(F.col("w"), 32).alias("pad_w"))


@query(
    """WITH x AS (SELECT o_orderkey, 1 + o_orderkey % 40 AS mb, (o_custkey % 900)::INT AS s, 64 + o_orderkey % 200 AS a FROM orders), y AS (SELECT *, mb * 8 * 1000000 * 0.95::DOUBLE - a * 1000 * s AS bits FROM x),
    z AS (SELECT *, CASE WHEN bits > 0 AND s > 0 AND floor(bits / 1000 / s) >= 100 THEN least(floor(bits / 1000 / s), 100000)::BIGINT END AS v FROM y)
    SELECT o_orderkey, v AS video_kbps, CASE WHEN v IS NOT NULL THEN floor(least(v * 1.45::DOUBLE, 120000))::BIGINT END AS max_kbps, CASE WHEN v IS NOT NULL THEN least(v * 2, 200000) END AS buffer_kbps FROM z"""
)
def bitrate_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Rates for a file size."""
    x = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 40 + 1).alias("mb"), (F.col("o_custkey") % 900).cast("int").alias("s"), (F.col("o_orderkey") % 200 + 64).alias("a"))
    rates = media.bitrate_budget(F.col("mb"), F.col("s"), F.col("a"))
    return x.select("o_orderkey", *[c.alias(n) for n, c in rates.items()])


@query("SELECT page_id, 'd' || page_id || '.e/name' || page_id || CASE page_id % 3 WHEN 0 THEN '.tar.gz' WHEN 1 THEN '' ELSE '.MP4' END AS path, 'name' || page_id || CASE page_id % 3 WHEN 0 THEN '.tar' ELSE '' END AS stem, CASE page_id % 3 WHEN 0 THEN '.gz' WHEN 1 THEN '' ELSE '.MP4' END AS suffix FROM pages")
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Stem and suffix of paths."""
    p = F.col("page_id")
    s = p.cast("string")
    path = F.concat(F.lit("d"), s, F.lit(".e/name"), s, F.when(p % 3 == 0, ".tar.gz").when(p % 3 == 1, "").otherwise(".MP4"))
    return table(spark, sf, "pages").select("page_id", path.alias("path")).select("page_id", "path", text.path_stem(F.col("path")).alias("stem"), text.path_suffix(F.col("path")).alias("suffix"))


@query("SELECT p_partkey, 'file ''' || replace(replace(p_name, ' ', ''''), '''', '''\\''''') || '''' AS entry FROM part")
def concat_quote(spark: SparkSession, sf: str) -> DataFrame:
    """Paths with quotes, quoted for a list of files."""
    return table(spark, sf, "part").select("p_partkey", text.quote_concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("'"))).alias("entry"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'bt709' END AS primaries, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS transfer FROM orders"""
)
def color_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Colour tags from key=value lines, without those that say nothing."""
    lines = F.concat(F.lit("color_primaries="), F.when(F.col("o_orderkey") % 3 > 0, "bt709").otherwise("unknown"), F.lit("\nnoise\ncolor_transfer="), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).otherwise(" N/A "))
    tags = table(spark, sf, "orders").select("o_orderkey", text.color_tags(lines).alias("m"))
    return tags.select("o_orderkey", F.try_element_at("m", F.lit("color_primaries")).alias("primaries"), F.try_element_at("m", F.lit("color_transfer")).alias("transfer"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'ep_' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') ELSE 'ep_' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') END || '.mp4' AS name, CASE WHEN o_orderkey % 1000 = 0 THEN (o_orderkey // 1000)::VARCHAR ELSE rtrim(printf('%d.%03d', o_orderkey // 1000, o_orderkey % 1000), '0') END AS seconds FROM orders")
def output_names(spark: SparkSession, sf: str) -> DataFrame:
    """File names from a template or a stem, and milliseconds as seconds."""
    stem = F.when(F.col("o_orderkey") % 2 == 0, "ep_####").otherwise("ep")
    return table(spark, sf, "orders").select("o_orderkey", text.output_name(stem, F.col("o_orderkey") % 10_000, F.lit("mp4")).alias("name"), text.ms_text(F.col("o_orderkey")).alias("seconds"))


@query("SELECT event_id, round_even(value / 7, 4) AS half_even, trunc(value)::BIGINT AS truncated, greatest(10.0::DOUBLE, least(60.0::DOUBLE, value)) AS clamped, round_even(0.299::DOUBLE * value + 0.587::DOUBLE * (event_id % 256) + 0.114::DOUBLE * (user_id % 256), 6) AS luma FROM events")
def numeric_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Rounding, truncation, clamping and luma."""
    v = F.col("value")
    y = media.luma(v, F.col("event_id") % 256, F.col("user_id") % 256)
    return table(spark, sf, "events").select("event_id", F.bround(v / 7, 4).alias("half_even"), v.cast("long").alias("truncated"), media.clamp(v, 10.0, 60.0).alias("clamped"), F.bround(y, 6).alias("luma"))
