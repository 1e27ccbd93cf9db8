"""Merkle manifest of a dataset: a digest for each row, a tree of them for each group, a tree of the groups, and proofs.

A tree has arity ARITY: while several nodes remain, each run of three (the last one may be shorter) becomes the digest of
its nodes' digests. Leaves of a group ascend by an order, so the tree depends on the rows and not on how Spark deals them.

Rows are range-sorted by group and order, as digests only (texts are read once and never shuffled). Rows are counted by
group and partition, and the running sums of these few counts tell each row its place in its group. With its place known,
each task builds the complete aligned subtrees of the rows it happens to hold: of LOCAL levels, or smaller ones at the
ragged ends of its runs. Their roots alone are shuffled, by coordinate (group, aligned block of the leaf's place), and rise
LEVELS levels in each round, so 10^10 leaves of one group need three rounds. Paths then go down the same way, by equi-joins
on coordinates, of which each has a bounded number of nodes: a group with a third of all rows is many blocks. Every round is
a table in the shared folder.

The operator takes any digests, groups and orders, and returns whole proofs: for each level, from the leaf up, what stands
left and right of the node in its run. fold() and proof_digest() are Columns over them.

Nulls in a leaf's columns are `-`; a null group comes first and isn't the empty one; null ids come before others. Equal ids
are ordered by their digests; of repeated rows each has its own leaf, in any order, as they are equal. Rows whose id is null
are not tampered with. Texts of any length are one digest. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if, table, write_shared

ARITY = 3
#: Levels of the subtrees that tasks build from the rows they hold, and levels that a round adds.
LOCAL, LEVELS = 5, 7
#: Most rows (partitions and groups; paths) that are broadcast.
BROADCAST_OFFSETS, BROADCAST_PATHS = 50_000, 4_000
#: Leaves of a batch that leaves a task.
BATCH = 4096


def digest(*cols: Column) -> Column:
    """H of the columns one after the other: each as UTF-8 bytes behind their number and a colon, or `-` if null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in cols]
    return F.sha2(F.concat(*parts), 256)


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def subtrees(first: int, end: int, n: int, most: int) -> Iterator[tuple[int, int, int]]:
    """The largest complete aligned subtrees, of at most `most` levels, of the leaves first .. end - 1 of a tree of n: (level, first, end). A subtree at the tree's own end may have fewer leaves."""
    top = min(most, height(n))
    while first < end:
        level = 0
        while level < top and first % ARITY ** (level + 1) == 0 and min(first + ARITY ** (level + 1), n) <= end:
            level += 1
        after = min(first + ARITY**level, n)
        yield level, first, after
        first = after


def climb(nodes: list[tuple[int, int, str]], target: int) -> tuple[list[tuple[list[str], list[str]]], str]:
    """nodes (level, coordinate, digest): all that make up one node of level `target`, in order -> for each of them what stands left and right of it at each level from its own up, and that node's digest."""
    left: list[list[str]] = [[] for _ in nodes]
    right: list[list[str]] = [[] for _ in nodes]
    # (coordinate, digest, the given nodes below)
    now: list[tuple[int, str, list[int]]] = []
    for level in range(target):
        now = sorted(now + [(c, h, [k]) for k, (own, c, h) in enumerate(nodes) if own == level], key=lambda x: x[0])
        above = []
        for parent, run in groupby(now, key=lambda x: x[0] // ARITY):
            run = list(run)
            hashes = [h for _, h, _ in run]
            for at, (_, _, below) in enumerate(run):
                before, behind = "".join(hashes[:at]), "".join(hashes[at + 1 :])
                for k in below:
                    left[k].append(before)
                    right[k].append(behind)
            above.append((parent, _hash(hashes), [k for _, _, below in run for k in below]))
        now = above
    now += [(c, h, [k]) for k, (own, c, h) in enumerate(nodes) if own == target]
    ((_, root, _),) = now
    return list(zip(left, right, strict=True)), root


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (grp, leaf, ...) with their place `idx` in their group and its size `n`, in sorted runs."""
    spark = rows.sparkSession
    rows, _ = write_shared(rows.withColumn("salt", F.monotonically_increasing_id()), "leaves")
    by = ["grp", *order, "leaf", "salt"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("salt").withColumn("mid", F.monotonically_increasing_id())
    dealt, _ = write_shared(dealt, "sorted")
    part = F.shiftright("mid", 33)
    counts = dealt.groupBy("grp", part.alias("part")).agg(F.count("*").alias("held"), F.min("mid").alias("first"))
    before = F.coalesce(F.sum("held").over(W.partitionBy("grp").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets, _ = write_shared(counts.select(F.col("grp").alias("_g"), F.col("part").alias("_p"), (before - F.col("first")).alias("shift"), F.sum("held").over(W.partitionBy("grp")).alias("n")), "offsets")
    few = offsets.limit(BROADCAST_OFFSETS + 1).count() <= BROADCAST_OFFSETS
    found = dealt.join(F.broadcast(offsets) if few else offsets, (F.col("grp") == F.col("_g")) & (part == F.col("_p")))
    found = found.withColumn("idx", F.col("mid") + F.col("shift")).drop("mid", "shift", "_g", "_p")
    return found if few else found.sortWithinPartitions("grp", "idx")


def _local(placed_: DataFrame, keep: list[str]) -> DataFrame:
    """The subtrees of the runs that tasks hold: grp, n, level, coord, hash, and lists of the leaves and of the kept columns."""
    fields = dict(placed_.dtypes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None

        def build(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
            """The subtrees of all complete blocks, and the rows of the open one."""
            rows = rows.combine_chunks()
            grp, idx, n, leaf = (rows.column(c).to_pylist() for c in ("grp", "idx", "n", "leaf"))
            cuts = [0] + [i for i in range(1, len(idx)) if idx[i] != idx[i - 1] + 1 or grp[i] != grp[i - 1] or idx[i] % ARITY**LOCAL == 0] + [len(idx)]
            if not last:
                cuts.pop()
            found, offsets = [], [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for level, first, end in subtrees(idx[a], idx[a] + b - a, n[a], LOCAL):
                    own = leaf[a + first - idx[a] : a + end - idx[a]]
                    now = own
                    for _ in range(level):
                        now = [_hash(now[i : i + ARITY]) for i in range(0, len(now), ARITY)]
                    found.append((grp[a], n[a], level, first // ARITY**level, now[0]))
                    offsets.append(offsets[-1] + len(own))
            rest = rows.slice(cuts[-1])
            if not found:
                return None, rest
            whole = rows.slice(0, cuts[-1])
            lists = []
            for c in ("leaf", *keep):
                values = whole.column(c).combine_chunks()
                lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values if isinstance(values, pa.Array) else pa.concat_arrays(values.chunks)))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
            cols = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*cols, *lists], names=["grp", "n", "level", "coord", "hash", "leaf", *keep]), rest

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            made, open_ = build(rows if open_ is None else pa.concat_tables([open_, rows]), False)
            if made is not None:
                yield made
        if open_ is not None and open_.num_rows:
            yield build(open_, True)[0]

    schema = "grp string, n long, level int, coord long, hash string, leaf array<string>" + "".join(f", `{c}` array<{fields[c]}>" for c in keep)
    return placed_.select("grp", "idx", "n", "leaf", *keep).mapInArrow(task, schema)


def _round(nodes: DataFrame, target: int) -> DataFrame:
    """Nodes (grp, n, level, coord, hash) that rise to level `target` or their tree's top -> grp, n, level, coord, left, right (by level), to, to_coord, top (that node), head (of the nodes of one such: is it the first?)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["grp", "n", "level", "coord", "left", "right", "to", "to_coord", "top", "head"]
        strings = pa.list_(pa.string())
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), strings, strings, pa.int32(), pa.int64(), pa.string(), pa.bool_()]
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held.clear()
            return batch

        for (grp, block, n), run in groupby(rows, key=lambda r: r[:3]):
            own = [r[3:6] for r in run]
            to = min(target, height(n))
            paths, top = climb(own, to)
            held += [(grp, n, level, coord, a, b, to, block, top, k == 0) for k, ((level, coord, _), (a, b)) in enumerate(zip(own, paths, strict=True))]
            if len(held) >= BATCH:
                yield out()
        if held:
            yield out()

    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the block is the node that is risen to: above its tree's top there is none, so those of a top all have coordinate 0
    at = F.col("coord") * F.pow(F.lit(ARITY), F.col("level")).cast("long")
    nodes = nodes.withColumn("at", at).withColumn("block", F.expr(f"at div {ARITY**target}"))
    dealt = nodes.repartition(parts, "grp", "block").sortWithinPartitions("grp", "block", "at").select("grp", "block", "n", "level", "coord", "hash")
    return dealt.mapInArrow(task, "grp string, n long, level int, coord long, left array<string>, right array<string>, to int, to_coord long, top string, head boolean")


def _rise(rows: DataFrame, order: list[str], keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows (grp, leaf, ...) -> their subtrees, and for each subtree the path to its tree's top: grp, level, coord, left, right, top."""
    local, _ = write_shared(_local(placed(rows, order), keep), "subtrees")
    most = local.agg(F.max("n")).first()[0] or 0
    now, rounds, target = local.select("grp", "n", "level", "coord", "hash"), [], LOCAL + LEVELS
    while True:
        done, _ = write_shared(_round(now, target), "rise")
        rounds.append(done)
        if target >= height(most):
            break
        now, target = done.where("head").select("grp", "n", F.col("to").alias("level"), F.col("to_coord").alias("coord"), F.col("top").alias("hash")), target + LEVELS
    paths = rounds.pop().select("grp", "level", "coord", "left", "right", "top")
    while rounds:
        below = rounds.pop()
        up = paths.select(F.col("grp").alias("_g"), F.col("level").alias("_v"), F.col("coord").alias("_c"), F.col("left").alias("_l"), F.col("right").alias("_r"), F.col("top").alias("_t"))
        below = below.drop("top").join(up, (F.col("grp") == F.col("_g")) & (F.col("to") == F.col("_v")) & (F.col("to_coord") == F.col("_c")))
        paths, _ = write_shared(below.select("grp", "level", "coord", F.concat("left", "_l").alias("left"), F.concat("right", "_r").alias("right"), F.col("_t").alias("top")), "paths")
    return local, paths


def _unfold(local: DataFrame, paths: DataFrame, keep: list[str]) -> DataFrame:
    """Subtrees with the paths of their roots -> a row for each leaf: the kept columns, leaf, left, right, and the other columns of paths."""
    more = [c for c in paths.columns if c not in ("grp", "level", "coord", "left", "right")]
    kinds = dict(local.dtypes)
    up = paths.select(F.col("grp").alias("_g"), F.col("level").alias("_v"), F.col("coord").alias("_c"), F.col("left").alias("_l"), F.col("right").alias("_r"), *more)
    up = broadcast_if(up, BROADCAST_PATHS)
    both = local.join(up, (F.col("grp") == F.col("_g")) & (F.col("level") == F.col("_v")) & (F.col("coord") == F.col("_c")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.list_(pa.string())
        for batch in batches:
            kept = [batch.column(4 + k) for k in range(len(keep))]
            sent = 0
            lefts: list[list[str]] = []
            rights: list[list[str]] = []
            repeated: list[list[str]] = [[] for _ in more]
            for k in range(batch.num_rows):
                level, leaves, above_l, above_r = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                paths_, _ = climb([(0, i, h) for i, h in enumerate(leaves)], level)
                for a, b in paths_:
                    lefts.append(a + above_l)
                    rights.append(b + above_r)
                for x, c in zip(repeated, range(4 + len(keep), 4 + len(keep) + len(more)), strict=True):
                    x += [batch.column(c)[k].as_py()] * len(leaves)
                at = k + 1
                if len(lefts) >= BATCH or at == batch.num_rows:
                    own = [c.slice(sent, at - sent).flatten() for c in (batch.column(1), *kept)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(lefts, strings), pa.array(rights, strings), *[pa.array(x, pa.string()) for x in repeated]], names=["leaf", *keep, "left", "right", *more])
                    lefts, rights, repeated, sent = [], [], [[] for _ in more], at

    schema = "leaf string" + "".join(f", `{c}` {kinds[c][6:-1]}" for c in keep) + ", left array<string>, right array<string>" + "".join(f", `{c}` string" for c in more)
    return both.select("level", "leaf", "_l", "_r", *keep, *more).mapInArrow(task, schema)


def manifest(rows: DataFrame, group: Column, leaf: Column, order: list[Column], keep: dict[str, Column]) -> DataFrame:
    """A tree for each group, and one of their roots -> the columns of `keep`, leaf, subroot (its group's root), root, and the proof: left, right (arrays, a string of digests for each level from the leaf up, through subroot to root)."""
    own = {f"_o{i}": c for i, c in enumerate(order)}
    # a null group sorts before all, and isn't the empty one
    slim = rows.select(F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("")).alias("grp"), leaf.alias("leaf"), *[c.alias(k) for k, c in (own | keep).items()])
    local, paths = _rise(slim, list(own), list(keep))
    tops = paths.groupBy("grp").agg(F.min("top").alias("leaf"))
    above = _unfold(*_rise(tops.select(F.lit("").alias("grp"), "leaf", F.col("grp").alias("own")), ["own"], ["own"]), ["own"])
    above, _ = write_shared(above.select(F.col("own").alias("_own"), F.col("left").alias("_al"), F.col("right").alias("_ar"), F.col("top").alias("root")), "groups")
    paths = paths.join(broadcast_if(above, BROADCAST_PATHS), F.col("grp") == F.col("_own"))
    paths, _ = write_shared(paths.select("grp", "level", "coord", F.concat("left", "_al").alias("left"), F.concat("right", "_ar").alias("right"), F.col("top").alias("subroot"), "root"), "proofs")
    return _unfold(local, paths, list(keep)).select(*keep, "leaf", "subroot", "root", "left", "right")


def fold(leaf: Column, left: Column, right: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(F.arrays_zip(left.alias("l"), right.alias("r")), leaf, lambda h, x: F.sha2(F.concat(x["l"], h, x["r"]), 256))


def proof_digest(left: Column, right: Column) -> Column:
    """H of the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), ""), 256)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether it still verifies where some lose their line feeds."""
    docs = table(spark, sf_dir, "documents")
    doc_id, text = F.col("doc_id"), F.col("text")
    leaf = lambda t: digest(doc_id, F.col("source"), F.col("lang"), F.col("n_chars"), t)
    tampered = F.when((F.crc32(doc_id.cast("string")) % 2 == 0) & text.contains("\n"), leaf(F.replace(text, F.lit("\n"), F.lit(""))))
    found = manifest(docs, F.col("source"), leaf(text), [doc_id], {"doc_id": doc_id, "tampered": tampered})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("left"), F.col("right"))
    out = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("left"), F.col("right")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
