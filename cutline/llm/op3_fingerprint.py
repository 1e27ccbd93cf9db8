"""Lempel-Ziv phrase fingerprints.

A text is parsed into LZ78 phrases (each the longest known phrase and one more character). The set of its phrases is
hashed and kept as a minimum-hash signature: 128 bins, each with 16 bits of the least hash that falls into it. The
share of equal bins among the bins that either text fills estimates how far the phrase sets, and so what a compressor
would learn from the texts, coincide.

fingerprint_with_neighbour() also fingerprints an edited text, whose last quarter comes from the next document. The
parse up to the cut is shared. Documents are dealt to ranges of the id; each range also gets the first document of the
range after it, so that every neighbour is found without a second pass over the texts. What the driver gets is one
pair of ids for each range.

Ranges are dealt to tasks by their number, one to each. A text of any length is parsed whole, in one task. Other columns
aren't read.

Null texts count as empty; two empty texts have likeness 1, an empty and a filled one 0. Equal ids are ordered by text,
null ids come first. Equal texts have equal fingerprints. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

BINS, HEX = 128, 4
EMPTY = "." * HEX


def parse(text: str, known: set[str], cur: str = "") -> tuple[list[str], str]:
    """The new phrases of text, in order, and the rest; known grows by them. cur: the rest of what came before."""
    new = []
    add, keep = known.add, new.append
    for ch in text:
        cur += ch
        if cur not in known:
            add(cur)
            keep(cur)
            cur = ""
    return new, cur


def hashes(phrases: list[str]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.array([h(p) for p in phrases], np.uint64)


def signature(h: np.ndarray) -> np.ndarray:
    """For each bin the low 16 bits of its least hash, -1 where the bin is empty. The bin is given by the top 7 bits."""
    out = np.full(BINS, -1, np.int32)
    h = np.sort(h)
    bins = (h >> np.uint64(57)).astype(np.int64)
    at, first = np.unique(bins, return_index=True)
    out[at] = (h[first] & np.uint64(0xFFFF)).astype(np.int32)
    return out


def as_text(sig: np.ndarray) -> str:
    return "".join(EMPTY if v < 0 else f"{v:04x}" for v in sig.tolist())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = int(((a >= 0) | (b >= 0)).sum())
    return float(((a == b) & (a >= 0)).sum() / filled) if filled else 1.0


def fingerprint(text: str) -> np.ndarray:
    phrases, rest = parse(text, set())
    return signature(hashes(phrases or ([rest] if rest else [])))


def both(text: str, head: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Signatures of the text and of its edited form, and the edited text."""
    n = len(text) // 4
    cut = len(text) - n
    known: set[str] = set()
    first, cur = parse(text[:cut], known)
    h = hashes(first)
    tail, _ = parse(text[cut:], known, cur)
    known.difference_update(tail)
    other, _ = parse(head[:n], known, cur)
    return signature(np.concatenate([h, hashes(tail)])), signature(np.concatenate([h, hashes(other)])), text[:cut] + head[:n]


def splits(ids: DataFrame, col: str, parts: int) -> list[int]:
    """At most parts - 1 ids that deal the rows into ranges of about equal numbers of rows."""
    if parts < 2:
        return []
    found = ids.select(F.percentile_approx(col, [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    return sorted({x for x in found or [] if x is not None})


def range_of(col: F.Column, at: list[int], step: int = 64) -> F.Column:
    """How many of the sorted values `at` are <= col (0 for null), by a search in two levels."""
    if not at:
        return F.lit(0)
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= col))
    block = F.greatest(below(F.array(*map(F.lit, at[::step]))) - 1, F.lit(0)) * step
    return F.when(col.isNull(), 0).otherwise(block + below(F.slice(F.array(*map(F.lit, at)), block + 1, step)))


class _Walk:
    """Takes the rows of a range in order, and gives a row's result once the next two are known."""

    def __init__(self):
        self.last = self.waits = None

    def take(self, p: int, extra: int, i, text: str) -> list[tuple]:
        done = []
        if self.last is not None and self.last[0] == p:
            own, edited, changed = both(self.last[2], text)
            done += self._end(own)
            self.waits = (self.last[1], len(self.last[2]), hashlib.sha256(changed.encode()).hexdigest(), own, edited)
            if extra:
                done += self._end(fingerprint(text))
        self.last = None if extra else (p, i, text)
        return done

    def _end(self, following: np.ndarray) -> list[tuple]:
        if self.waits is None:
            return []
        i, n, sha, own, edited = self.waits
        self.waits = None
        return [(i, n, sha, as_text(own), as_text(edited), likeness(own, edited), likeness(own, following))]


def _task(batches):
    import pyarrow as pa

    walk = _Walk()
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            rows = [r for x in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True) for r in walk.take(*x)]
            cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=NAMES)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def fingerprint_with_neighbour(docs: DataFrame, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    parts: number of ranges, by default the number of shuffle partitions.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("long").alias("i"))
    place = range_of(F.col("i"), splits(ids, "i", parts))
    firsts = {r["p"]: None if r["nulls"] else r["least"] for r in ids.withColumn("p", place).groupBy("p").agg(F.min("i").alias("least"), F.count_if(F.col("i").isNull()).alias("nulls")).collect()}
    order = sorted(firsts)
    before = {p: q for q, p in pairwise(order)} | ({order[0]: order[-1]} if order else {})
    to = F.array(*[F.lit(before.get(p)).cast("int") for p in range((order or [0])[-1] + 1)])
    head = F.array(*[F.lit(firsts.get(p)).cast("long") for p in range((order or [0])[-1] + 1)])
    dealt = (
        docs.select(F.col(id_col).cast("long").alias("i"), text_or_empty(text_col).alias("t"))
        .withColumn("p", place)
        .withColumn("q", F.when(F.get(head, F.col("p")).eqNullSafe(F.col("i")), F.get(to, F.col("p"))))
        .select("i", "t", F.inline(F.filter(F.array(F.struct(F.col("p").alias("range"), F.lit(0).alias("extra")), F.struct(F.col("q").alias("range"), F.lit(1).alias("extra"))), lambda x: x["range"].isNotNull())))
        .repartitionById(parts, F.pmod("range", F.lit(parts)))
        .sortWithinPartitions("range", "extra", "i", "t")
        .select("range", "extra", "i", "t")
    )
    return dealt.mapInArrow(_task, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike neighbours are."""
    return fingerprint_with_neighbour(table(spark, sf_dir, "documents"))
