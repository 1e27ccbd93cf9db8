"""Parsing and formatting of numbers, times, paths and log lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a line of a log shows, and the message for it; the first that matches counts.
ERRORS = (
    ("Failed to initialize MediaFile", "Failed to initialize MediaFile"),
    ("No frames left", "No frames left"),
    ("Interpolation failed", "Interpolation failed"),
    ("Error occured", "Error occurred"),
    ("ran out of memory", "Out of memory"),
    ("vkAllocateMemory failed", "Vulkan out of memory"),
    ("vkWaitForFences failed", "Vulkan device lost"),
    ("No valid AI model has been selected", "No valid AI model selected"),
)
#: What a log says at the end, when a GPU encoder fails, and when nothing happened.
COMPLETION = r"(?i)Done interpolating|Interpolation done|Frame interpolation (?:took|done)|Output video|Encoding finished|\[Done\]"
GPU_PARTS = ("nvenc", "openencodesessionex", "cuda", "_amf", "qsv")
GPU_FAULTS = ("openencodesessionex failed", "no capable devices", "cannot load", "error while opening encoder", "failed to initialise", "failed to initialize", "device", "not found", "function not implemented", "invalid argument")
NOISE = r"(?i)track\s+\d+:\s+codec frame size is not set|^\[segment\s+@\s+[^\]]+\]\s+Opening\s+'.+'\s+for writing$"


def fraction(x: Column) -> Column:
    """"num/den" as a number; null without a denominator or with 0."""
    parts = F.split(x, "/")
    return F.try_divide(F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double"))


def dimensions(x: Column) -> tuple[Column, Column]:
    """Width and height of "WxH"; null if it isn't of that form."""
    ok = x.rlike(r"^\s*\d+x\d+\s*$")
    w, h = (F.when(ok, F.trim(F.get(F.split(x, "x"), i)).cast("int")) for i in (0, 1))
    return w, h


def duration_ms(seconds: Column) -> Column:
    """A text of seconds as whole milliseconds, cut off."""
    return (seconds.try_cast("double") * 1000).cast("long")


def out_time_us(line: Column) -> Column:
    """The number of a line of progress; null for other lines."""
    return F.nullif(F.regexp_extract(line, r"^out_time_ms=(\d+)", 1), F.lit("")).cast("long")


def seconds_left(elapsed: Column, percent: Column) -> Column:
    """What is left at the speed so far; 0 before the start and after the end."""
    return F.when((percent > 0) & (percent < 100) & (elapsed > 0), elapsed / percent * (100 - percent)).otherwise(0.0)


def plain_seconds(us: Column) -> Column:
    """Microseconds as seconds, without trailing zeros."""
    whole, part = F.floor(us / 1_000_000), us % 1_000_000
    text = F.concat(whole.cast("string"), F.lit("."), F.lpad(part.cast("string"), 6, "0"))
    return F.regexp_replace(text, r"\.?0*$", "")


def segment_times(ts_us: Column) -> Column:
    """Cut times an epsilon of 1 ms early, comma-joined."""
    return F.array_join(F.transform(ts_us, lambda t: plain_seconds(F.greatest(F.lit(0).cast("long"), t - 1000))), ",")


def ms_text(ms: Column) -> Column:
    return plain_seconds(ms * 1000)


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def duration(cs: Column) -> Column:
    """Hundredths of a second as h, m and s."""
    s = F.floor(cs / 100)
    h, m, sec = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    hundredths = F.concat(F.lit("."), _two(cs % 100), F.lit("s"))
    return (
        F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), _two(m), F.lit("m "), _two(sec), hundredths))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), _two(sec), hundredths))
        .otherwise(F.concat(sec.cast("string"), hundredths))
    )


def one_decimal(x: Column) -> Column:
    """Rounded half to even, with one decimal."""
    tenths = F.bround(x * 10, 0).cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def bitrate(bps: Column) -> Column:
    return F.when(F.coalesce(bps, F.lit(0)) == 0, "-").when(bps >= 1_000_000, F.concat(one_decimal(bps / 1_000_000), F.lit(" Mbps"))).otherwise(F.concat(F.bround(bps / 1000, 0).cast("long").cast("string"), F.lit(" kbps")))


def file_size(n: Column) -> Column:
    return F.when(n >= 1 << 20, F.concat(one_decimal(n / (1 << 20)), F.lit(" MB"))).when(n >= 1024, F.concat(one_decimal(n / 1024), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def eta(seconds: Column) -> Column:
    s = F.floor(seconds)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(seconds.isNull(), "--:--").when(h > 0, F.concat(h.cast("string"), F.lit(":"), _two(m), F.lit(":"), _two(s % 60))).otherwise(F.concat(_two(m), F.lit(":"), _two(s % 60)))


def output_name(stem: Column, index: Column, container: Column) -> Column:
    number = F.lpad(index.cast("string"), 4, "0")
    name = F.when(stem.contains("####"), F.replace(stem, F.lit("####"), number)).otherwise(F.concat(stem, F.lit("_"), number))
    return F.concat(name, F.lit("."), container)


def fingerprint(*parts: Column) -> Column:
    """First 12 hex digits of the SHA-1 of the parts, joined by a bar."""
    return F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12)


def strip_prefixes(key: Column) -> Column:
    return F.regexp_replace(key, r"^(module\.)?(flownet\.)?", "")


def progress(line: Column) -> Column:
    """Percent from "Interpolated a/b Frames", else from "x%"; null without either."""
    frames = r"(?i)Interpolated\s+(\d+)\s*/\s*(\d+)\s*Frames?"
    done, all_ = (F.nullif(F.regexp_extract(line, frames, k), F.lit("")).cast("double") for k in (1, 2))
    share = F.when(all_ > 0, done / F.nullif(all_, F.lit(0.0)) * 100)
    return F.coalesce(share, F.nullif(F.regexp_extract(line, r"(\d+(?:\.\d+)?)\s*%", 1), F.lit("")).cast("double"))


def completed(line: Column) -> Column:
    return F.coalesce(line.rlike(COMPLETION), F.lit(False))


def error(line: Column) -> Column:
    return F.coalesce(*[F.when(line.rlike(f"(?i){p}"), m) for p, m in ERRORS])


def gpu_session_error(line: Column) -> Column:
    low = F.lower(line)
    any_of = lambda xs: reduce(lambda a, b: a | b, [low.contains(x) for x in xs])
    return any_of(GPU_PARTS) & any_of(GPU_FAULTS)


def noise(line: Column) -> Column:
    return line.isNull() | (F.trim(line) == "") | F.trim(line).rlike(NOISE)


def log_message(line: Column) -> Column:
    """Without "[..] [..]: " in front."""
    return F.regexp_replace(line, r"^\[[^\]]*\] \[[^\]]*\]: ", "")


def opened_path(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, "Opening '(.+?)' for writing", 1), F.lit(""))


def segment_number(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(\d+)\.[A-Za-z0-9]+$", 1), F.lit("")).cast("long")


def path_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_suffix(path: Column) -> Column:
    return F.regexp_extract(path_name(path), r"[^.](\.[^.]+)$", 1)


def path_stem(path: Column) -> Column:
    return F.regexp_replace(path_name(path), r"(?<=[^.])\.[^.]+$", "")


def quote_concat(path: Column) -> Column:
    return F.concat(F.lit("file '"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def color_tags(lines: Column) -> Column:
    """key=value lines as a map, without unknown, reserved and empty values."""
    pairs = F.filter(F.split(lines, "\n"), lambda x: x.contains("="))
    entries = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("value")))
    good = F.filter(entries, lambda e: ~F.lower(e["value"]).isin("unknown", "n/a", "reserved", ""))
    return F.map_from_entries(good)
