"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is what a task reads until it has SHARD words, whole documents only. Its words become symbols, each document ends
with a symbol of its own, and the index is: the suffix array's order (sorted by several words at once, then by doubling, of
what is still tied), the Burrows-Wheeler transform as a wavelet matrix with ranks, and the suffix array's values at
every SAMPLE-th place of the text. Test phrases are the windows of WINDOW consecutive words of the benchmark's items (an item
of fewer words is one window). All windows are searched backward at once, by two ranks a word; where one occurs, each row of
its interval walks back to a sampled place. Occurrences are merged to spans of words, and to spans of characters that can be
removed.

Indexing and search run within the tasks of the scan: no shuffle, no text moves, and a lost task indexes its own split again.
The benchmark goes to tasks in blocks of at most BLOCK characters. There is one as a rule; each more is another pass over the
texts, whose spans are merged by row.

Null texts have no words, and items without words no windows. Repeated items of an id are one item with several texts; an item
without an id counts as the empty string. Repeated rows are searched as often as they come. A text of any length is in one
shard, which then is as large as the text. Extra columns are not read. An empty table gives no rows; with an empty benchmark
nothing is contaminated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

WINDOW = 10
#: Words of a shard, at least, if there are as many.
SHARD = 1 << 19
SAMPLE = 8
#: Characters of the benchmark that the driver and each task hold at a time.
BLOCK = 8_000_000
#: Occurrences that are located at a time.
AT_ONCE = 1 << 19
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: ASCII letters to lower case, other ASCII signs but digits to blanks; bytes of longer characters stay.
PLAIN = bytes(ord(chr(b).lower()) if b > 127 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
SCHEMA = "row long, doc_id long, n_words long, first array<int>, last array<int>, start array<int>, end array<int>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()


def _sorted(key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys below 2 ** width, and where in it a key differs from the one before."""
    n = len(key)
    shift = max(1, n.bit_length())
    if width + shift <= 63:
        # sorting keys with their places is several times faster than argsort
        both = np.sort(key << shift | np.arange(n))
        order, key = both & ((1 << shift) - 1), both >> shift
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    new = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return order, new


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Places of a text's suffixes in order. text: symbols below 2 ** bits, the last one found nowhere else."""
    n = len(text)
    b = n.bit_length()
    h = max(1, (63 - b) // bits)
    padded = np.concatenate([text, np.zeros(h, np.int64)])
    key = padded[:n].copy()
    for k in range(1, h):
        key = key << bits | padded[k : k + n]
    sa, new = _sorted(key, h * bits)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))

    def tied(new: np.ndarray) -> np.ndarray:
        out = ~new
        out[:-1] |= ~new[1:]
        return out

    slots = np.flatnonzero(tied(new))
    while len(slots):
        # a tied suffix shares its first h symbols, so it is longer than h
        at = sa[slots]
        order, new = _sorted(rank[at] << b | rank[at + h], 2 * b)
        at = at[order]
        sa[slots] = at
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[tied(new)]
        h *= 2
    return sa


class Plane:
    """Bits with ranks."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        packed[: (n + 7) // 8] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = n - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many bits before each place are set."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Index:
    """FM-index of symbols below 2 ** bits; the last one is found nowhere else."""

    def __init__(self, text: np.ndarray, bits: int, sample: int = SAMPLE):
        self.n, self.bits = len(text), bits
        sa = suffix_array(text, bits)
        bwt = text[sa - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        self.planes = []
        for b in range(bits - 1, -1, -1):
            on = (bwt >> b & 1).astype(bool)
            self.planes.append(Plane(on))
            bwt = np.concatenate([bwt[~on], bwt[on]])
        self.first = np.zeros(1 << bits, np.int64)
        starts = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.first[bwt[starts]] = starts
        known = sa % sample == 0
        self.known, self.places = Plane(known), sa[known]

    def ranks(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        for level, plane in enumerate(self.planes):
            ones = plane.ones(i)
            i = np.where(symbol >> (self.bits - 1 - level) & 1, plane.zeros + ones, i - ones)
        return i - self.first[symbol]

    def back(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one symbol longer."""
        symbol = np.zeros(len(i), np.int64)
        for plane in self.planes:
            ones, bit = plane.ones(i), plane[i]
            symbol = symbol << 1 | bit
            i = np.where(bit, plane.zeros + ones, i - ones)
        return self.less[symbol] + i - self.first[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows (from, to) of each pattern. patterns: a row of symbols each, with -1 before shorter ones."""
        lo, hi = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, k]
            on = symbol >= 0
            at, symbol = live[on], symbol[on]
            if k == patterns.shape[1] - 1:
                lo[at], hi[at] = self.less[symbol], self.less[symbol + 1]
            else:
                both = self.ranks(np.concatenate([symbol, symbol]), np.concatenate([lo[at], hi[at]]))
                lo[at], hi[at] = self.less[symbol] + both[: len(at)], self.less[symbol] + both[len(at) :]
            live = at[lo[at] < hi[at]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of rows begin."""
        out, open_, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(open_):
            known = self.known[rows]
            out[open_[known]] = self.places[self.known.ones(rows[known])] + steps
            open_, rows, steps = open_[~known], self.back(rows[~known]), steps + 1
        return out


class Phrases:
    """The distinct windows of some items: numbers of their words, and which items have them."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            own = [number.setdefault(w, len(number)) for w in words_of(text)]
            for at in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(tuple(own[at : at + window]), set()).add("" if item is None else str(item))
        self.words = list(number)
        self.names = sorted(set().union(*owners.values())) if owners else []
        place = {name: k for k, name in enumerate(self.names)}
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.windows = np.full((len(owners), window), -1, np.int64)
        for row, w in zip(self.windows, owners, strict=True):
            row[window - len(w) :] = w
        self.owner = np.array([place[x] for own in owners.values() for x in sorted(own)], np.int64)
        self.owned = np.concatenate([[0], np.cumsum([len(own) for own in owners.values()], dtype=np.int64)]).astype(np.int64)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def hits(shard: list[np.ndarray], vocabulary: dict[bytes, int], phrases: Phrases) -> tuple[np.ndarray, list[set[int]]]:
    """Documents as numbers of words -> which words of all documents, one after the other (each with one place more at its end), stand in an occurrence of a window, and for each document the items."""
    number = np.array([vocabulary.get(w, -1) for w in phrases.words] or [-1], np.int64)
    patterns = np.where(phrases.windows < 0, -1, number[phrases.windows])
    # a window with a word that the shard hasn't can't occur
    usable = np.flatnonzero((patterns >= 0).sum(axis=1) == phrases.lengths)
    sizes = np.array([len(d) + 1 for d in shard], np.int64)
    ends = np.cumsum(sizes)
    text = np.empty(ends[-1], np.int64)
    for k, d in enumerate(shard):
        text[ends[k] - sizes[k] : ends[k] - 1] = d
        text[ends[k] - 1] = len(vocabulary) + k
    change, found = np.zeros(len(text) + 1, np.int64), [set() for _ in shard]
    if len(usable):
        index = Index(text, max(1, (len(vocabulary) + len(shard)).bit_length()))
        lo, hi = index.search(patterns[usable])
        for at in range(0, len(usable), 1024):
            few_lo, few_hi, few = lo[at : at + 1024], hi[at : at + 1024], usable[at : at + 1024]
            rows, which = _ranges(few_lo, few_hi - few_lo), np.repeat(few, few_hi - few_lo)
            for a in range(0, len(rows), AT_ONCE):
                place, window = index.locate(rows[a : a + AT_ONCE]), which[a : a + AT_ONCE]
                np.add.at(change, place, 1)
                np.add.at(change, place + phrases.lengths[window], -1)
                pairs = np.unique(np.searchsorted(ends, place, side="right") * len(phrases.lengths) + window)
                doc, window = pairs // len(phrases.lengths), pairs % len(phrases.lengths)
                n = phrases.owned[window + 1] - phrases.owned[window]
                owner = phrases.owner[_ranges(phrases.owned[window], n)]
                for pair in np.unique(np.repeat(doc, n) * len(phrases.names) + owner).tolist():
                    found[pair // len(phrases.names)].add(pair % len(phrases.names))
    return np.cumsum(change)[:-1] > 0, found


def searched(docs: DataFrame, items: list[tuple[str | None, str | None]], id_col: str, text_col: str, window: int = WINDOW, shard_words: int = SHARD) -> DataFrame:
    """Every row against one block of items: SCHEMA."""
    shared = docs.sparkSession.sparkContext.broadcast(Phrases(items, window))

    def task(batches) -> Iterator:
        import pyarrow as pa

        phrases = shared.value
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int32())] * 4 + [pa.list_(pa.string())]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        vocabulary: dict[bytes, int] = {}
        rows: list[tuple] = []
        shard: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal held
            hit, found = hits(shard, vocabulary, phrases)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8)))
            first, last = edge[::2], edge[1::2]
            cols: list[list] = [[] for _ in kinds]
            at = 0
            for (row, doc, text), d, own in zip(rows, shard, found, strict=True):
                a, b = np.searchsorted(first, [at, at + len(d)])
                f, t = first[a:b] - at, last[a:b] - at
                spans = [m.span() for m in WORD.finditer(text)] if b > a else []
                values = (row, doc, len(d), f, t, [spans[i][0] for i in f], [spans[i - 1][1] for i in t], [phrases.names[i] for i in sorted(own)])
                for col, v in zip(cols, values, strict=True):
                    col.append(v)
                at += len(d) + 1
            rows.clear(), shard.clear(), vocabulary.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = words_of(text)
                for w in set(own).difference(vocabulary):
                    vocabulary[w] = len(vocabulary)
                shard.append(np.fromiter(map(vocabulary.__getitem__, own), np.int32, len(own)))
                rows.append((row, doc, text))
                held += len(own) + 1
                if held >= shard_words:
                    yield flush()
        if rows:
            yield flush()

    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t"))
    return slim.mapInArrow(task, SCHEMA)


def _merged(spans: Column) -> Column:
    """Spans in order, those that meet made one."""

    def add(done, x):
        before = F.try_element_at(done, F.lit(-1))
        meets = F.coalesce(x["first"] <= before["last"], F.lit(False))
        longer = F.struct(before["first"].alias("first"), F.greatest(before["last"], x["last"]).alias("last"), before["start"].alias("start"), F.greatest(before["end"], x["end"]).alias("end"))
        return F.when(meets, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), add)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block: int = BLOCK, shard_words: int = SHARD) -> DataFrame:
    """Every row of docs -> doc_id, n_words, spans (array of structs: first word, last word (excluded), and start and end in code points), items (whose windows occur, sorted).

    The benchmark is read in blocks by a hash of the item, one block at a time.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col("text").alias("t"))
    blocks = -(-int(items.agg(F.sum(F.length("t"))).first()[0] or 0) // block) or 1
    mine = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    passes = [searched(docs, [tuple(r) for r in items.where(mine == k).collect()], id_col, text_col, window, shard_words) for k in range(blocks)]
    zipped = F.arrays_zip("first", "last", "start", "end")
    if blocks == 1:
        return passes[0].select("doc_id", "n_words", zipped.alias("spans"), "items")
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p.where("size(items) > 0"))
    by_row = every.withColumn("s", zipped).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
    return by_row.select("doc_id", "n_words", _merged(F.col("s")).alias("spans"), F.array_sort(F.array_distinct("i")).alias("items"))


def without(text: Column, spans: Column) -> Column:
    """The text without its spans."""
    starts = F.concat(spans["start"], F.array(F.length(text)))
    ends = F.concat(F.array(F.lit(0)), spans["end"])
    return F.when(text.isNotNull(), F.array_join(F.zip_with(ends, starts, lambda a, b: F.substr(text, a + 1, b - a)), ""))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document stand in ten words of the benchmark, and in which items'."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
