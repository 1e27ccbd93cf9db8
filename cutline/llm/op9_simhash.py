"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has 64 bits, from hashes of 4-word shingles. Fingerprints that differ in at most RADIUS = 4 bits are linked.
With the bits in 6 blocks, linked ones agree on at least two of them, so every fingerprint goes under 15 keys of two
blocks, and only those of a key are compared: none is lost. Distinct fingerprints are compared, with the least id of each.

Within a key the comparison is bit-sliced: bit planes of 64 fingerprints stand vertically in one word, so that one word
operation updates 64 distances, kept in carry-save counters of three bits. Words in which every distance is beyond the
radius are abandoned. Links are merged into a spanning forest tile by tile, so a dense group of m fingerprints holds at
most ROWS x 64 links at a time and gives at most m. Keys with more than HOT fingerprints are split into blocks, and each
pair of blocks is a group of its own. Components go back to the rows by look_up(), so a third of all rows may have one
fingerprint.

Texts of any length are hashed whole. Columns of `keep` must not be called doc_id, fp, component_id or cls; others are ignored.
Null texts count as empty and have fingerprint zero, which links like any other. Rows without an id take part but can't
be the least; a component of such rows alone has a null component_id. Rows of one id with different texts link only by
their fingerprints, and may have different components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import look_up, map_rows, small, table, text_or_empty, write_shared
from .components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
BLOCKS = (11, 11, 11, 11, 10, 10)
HOT, SPLIT = 4096, 2048
#: Fingerprints that are compared with a tile of 64 at a time.
ROWS = 1 << 14
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    # bytes.lower() changes A-Z alone, and bytes.split() splits at the six blanks alone
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [h(joined, SEED)]
    ends = list(accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends)]
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)]


def simhash(hashes: list[int], chunk: int = 1 << 17) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    if not hashes:
        return 0
    h = np.array(hashes, "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), chunk):
        counts += np.unpackbits(h[at : at + chunk].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep (longs), fp (the 64 bits as a signed long)."""

    def make():
        return lambda *cols: (*cols[:-1], [x - (1 << 64) if (x := simhash(shingle_hashes(t))) >> 63 else x for t in cols[-1]])

    return map_rows(docs.select(F.col(id_col).cast("long"), *keep, text_or_empty(text_col)), make, "".join(f"{c} long, " for c in ("doc_id", *keep, "fp"))[:-2])


def block_keys(fp: Column) -> Column:
    """The 15 keys of two blocks each; bits above say which two."""
    at = [0, *accumulate(BLOCKS)]
    part = lambda i: F.shiftrightunsigned(fp, at[i]).bitwiseAND(F.lit((1 << BLOCKS[i]) - 1))
    return F.array(*[F.shiftleft(part(i), BLOCKS[j]).bitwiseOR(part(j)).bitwiseOR(F.lit(n << 24).cast("long")) for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))])


def close_pairs(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices a < b with group[a] == group[b] and at most `radius` (of 4 to 7) bits between fp[a] and fp[b], ROWS x 64 at most at a time. group: sorted."""
    n = len(fp)
    if n < 2:
        return
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    tiles = -(-n // 64)
    padded = np.zeros(tiles * 64, np.uint64)
    padded[:n] = fp
    planes = np.empty((64, tiles), np.uint64)
    for b in range(64):
        planes[b] = np.packbits((padded >> np.uint64(b) & np.uint64(1)).astype(bool), bitorder="little").view("<u8")
    rows = np.flatnonzero(ends - np.arange(n) > 1)
    d = 0
    while True:
        rows = rows[rows // 64 + d <= (ends[rows] - 1) // 64]
        if not len(rows):
            return
        for at in range(0, len(rows), ROWS):
            yield _against(fp, planes, rows[at : at + ROWS], ends, d, radius)
        d += 1


def _against(fp, planes, rows, ends, d, radius):
    """Each row against the 64 fingerprints of the d-th tile from its own."""
    tile = rows // 64 + d
    low = np.maximum(rows + 1 - 64 * tile, 0)
    high = np.minimum(ends[rows] - 64 * tile, 64)
    ok = low < high
    rows, tile, low, high = rows[ok], tile[ok], low[ok].astype(np.uint64), high[ok].astype(np.uint64)
    lanes = (ONES >> (np.uint64(64) - high)) & (ONES << low)
    own = fp[rows]
    over = ~lanes
    c0, c1, c2 = (np.zeros(len(rows), np.uint64) for _ in range(3))
    beyond = {4: lambda: c2 & (c0 | c1), 5: lambda: c2 & c1, 6: lambda: c2 & c1 & c0, 7: lambda: c2 & ~c2}[radius]
    zero, one = np.uint64(0), np.uint64(1)
    for b in range(0, 64, 2):
        x = planes[b][tile] ^ (zero - (own >> np.uint64(b) & one))
        y = planes[b + 1][tile] ^ (zero - (own >> np.uint64(b + 1) & one))
        u = x ^ y
        carry = (x & y) | (c0 & u)
        c0 ^= u
        up = c1 & carry
        c1 ^= carry
        over |= c2 & up
        c2 ^= up
        if b % 8 == 6:
            over |= beyond()
            live = over != ONES
            if live.sum() < 0.75 * len(live):
                rows, tile, own, over, c0, c1, c2 = (v[live] for v in (rows, tile, own, over, c0, c1, c2))
                if not len(rows):
                    break
    over |= beyond()
    hit = over != ONES
    rows, tile, word = rows[hit], tile[hit], ~over[hit]
    bits = np.unpackbits(word.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    r, lane = np.nonzero(bits)
    return rows[r], 64 * tile[r] + lane


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (for each node the least node that it is known to reach) with the links (a, b) too."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def links_within(rows: DataFrame, at_once: int = 1 << 16) -> DataFrame:
    """rows (g, fp), dealt by g and sorted by it within partitions -> links (u, v) between fingerprints."""

    def task(batches):
        import pyarrow as pa

        held = [np.empty(0, np.int64)] * 2

        def work(g, fp):
            label = np.arange(len(fp))
            for a, b in close_pairs(fp.view(np.uint64), g):
                label = forest(label, a, b)
            i = np.flatnonzero(label != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[label[i]])], names=["u", "v"])

        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            if len(held[0]) >= at_once:
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
                if cut:
                    yield work(*(h[:cut] for h in held))
                    held = [h[cut:] for h in held]
        if len(held[0]):
            yield work(*held)

    return rows.select("g", "fp").mapInArrow(task, "u long, v long")


def near_duplicates(found: DataFrame) -> DataFrame:
    """found (doc_id, fp, ...), a table -> its columns, component_id, and cls, a fingerprint that all of the component share."""
    spark = found.sparkSession
    nodes, _ = write_shared(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints")
    keyed = nodes.select("fp", F.explode(block_keys(F.col("fp"))).alias("key"))
    hot = keyed.groupBy(F.col("key").alias("_k")).agg(F.count("*").alias("m")).where(F.col("m") > HOT)
    rows = small(hot, 10_000)
    if rows == []:
        grouped = keyed.withColumn("g", F.col("key"))
    else:
        hot = F.broadcast(spark.createDataFrame(rows, hot.schema)) if rows else hot
        blocks = F.coalesce(F.ceil(F.col("m") / SPLIT), F.lit(1)).cast("int")
        own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        grouped = (
            keyed.join(hot, F.col("key") == F.col("_k"), "left")
            .withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumn("g", F.when(F.col("m").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))))
        )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = grouped.select("g", "fp").repartition(parts, "g").sortWithinPartitions("g")
    same = components(links_within(dealt))
    linked = same.select(F.explode(F.array("node", "component")).alias("_f")).distinct()
    shared = nodes.join(linked, F.col("fp") == F.col("_f"), "left").where("n > 1 or _f is not null")
    classes = shared.join(same, F.col("fp") == F.col("node"), "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("cls"))
    ids = classes.groupBy(F.col("cls").alias("_c")).agg(F.min("least").alias("component_id"))
    known, _ = write_shared(classes.join(ids, F.col("cls") == F.col("_c")).select(F.col("fp").alias("k"), "n", "cls", "component_id"), "components")
    columns = found.columns
    # a fingerprint that stands once and is linked to none is a component of its own
    alone = F.col("found").isNull()
    rows = look_up(found, "fp", known, columns)
    return rows.select(*columns, F.when(alone, F.col("doc_id")).otherwise(F.col("found")["component_id"]).alias("component_id"), F.when(alone, F.col("fp")).otherwise(F.col("found")["cls"]).alias("cls"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found, _ = write_shared(fingerprints(table(spark, sf_dir, "documents")), "simhash")
    return near_duplicates(found).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
