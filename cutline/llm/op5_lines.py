"""Line dedup by a segment-partition edit join (PassJoin: Li et al., 2011), in DataFrame functions only.

Lines that are equal, or within as many edits of each other as the shorter one allows, are linked; of each class of
lines that are linked, directly or through others, the first by (doc_id, line number) stays and the others go. A line
allows one edit for each PER_EDIT characters, and TAU at most: two from 24 characters, one from 12, none below, where
two edits would make one word of another. Blank lines are never touched. The query and the pipeline take every other
line; a caller of `removed_lines` or `dedup_lines` may leave lines of less than min_chars alone, and by default leaves
those of less than MIN_CHARS.

A line of length L is split into TAU + 1 even segments; TAU edits leave one untouched. So a line is indexed under
(L, segment number, segment), and probes the indexes of lengths L - TAU .. L with the substrings that multi-match-aware
selection leaves (12 for two edits; the three of its own length and places are the index entries, so they are emitted
once). Lines that share a key, one of them by its index entry, are candidates. A key's lines are dealt to blocks of
BLOCK, and each SUPER blocks to a superblock. Pairs of blocks are joined by (key, pair of superblocks), so the pairs of a
frequent segment are dealt to as many groups as it has pairs of superblocks, and there is no row for each pair of lines.
A key's lines are numbered for that in one task, but for hot keys: of those, which a sample by hash of one different
line in SAMPLED shows HOT_SAMPLED times or more (about 16,000 lines), the most frequent HOT_KEYS have their lines dealt to
blocks by hash before the shuffle. The sample only decides where lines are put, never whether they are compared. Within a
pair of blocks, candidates are first held against a 64-bit parity signature of their bigrams (an edit flips at most four
bits) and then verified by banded bit-parallel edit distance (Myers' recurrence on a band of 2 TAU + 1 rows,
which moves down the diagonal with the column); only links leave. Lines that allow fewer edits are indexed in as many
fewer segments: a pair's edits are those of its shorter line, whose length is part of the key.

Equal lines are aggregated (within tasks before the shuffle) before they are indexed. Links are closed to classes by
stars of least nodes, with each round in the shared folder. Lines are identified by a 64-bit hash: of 10^11 different
lines, about 270 pairs can be expected to share one. The verdicts on lines go back to the documents by look_up(), which
deals blank lines and those of the most frequent lines by document.

Null texts count as empty. Lines and texts of any length are compared whole. Rows with equal ids are one document. A null id comes first. An empty table gives no rows.
Columns of any other names pass dedup_lines() unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, broadcast_if, fresh, look_up, table, text_or_empty, write_shared
from .components import components

TAU, MIN_CHARS, BLOCK, SUPER = 2, 24, 32, 64
SAMPLED, HOT_SAMPLED, HOT_KEYS = 256, 64, 10_000
#: Characters of a line for each edit that it allows; and the min_chars that takes every line that isn't blank.
PER_EDIT, EVERY_LINE = 12, 1
#: Documents that lose lines, up to which they are broadcast (with ten lines each at most on average).
BROADCAST_DOCS = 500_000


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, line_no (from 0), line, h for each line; h is null for lines that are blank or short."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("line_no", "line"))
    long_enough = (F.length("line") >= min_chars) & (F.btrim("line", F.lit(BLANKS)) != "")
    return each.withColumn("h", F.when(long_enough, F.xxhash64("line")))


def probes(tau: int) -> list[tuple[int, int, int]]:
    """(d, i, shift): a line looks for segment i of lines that are shorter by d, `shift` places from where they have it.

    Multi-match-aware selection: i edits at most lie to the left of the segment, and tau - i to the right.
    """
    return [(d, i, shift) for d in range(tau + 1) for i in range(tau + 1) for shift in range(max(-i, d - (tau - i)), min(i, d + (tau - i)) + 1)]


def keys(texts: DataFrame, tau: int = TAU, per_edit: bool = False) -> DataFrame:
    """texts (h, line, len) -> h, k, idx: the keys that a line probes; idx: it is indexed there too.

    With per_edit, a line allows one edit for each PER_EDIT characters, tau at most; else tau. Of a length, the last (length mod tau + 1) of tau + 1 segments are longer by one. The probes are rows of a literal, so
    that one short expression is compiled for all. Four bytes a character let a segment be found without counting.
    """
    places = []
    for t in range(1, tau + 1):
        low = t * PER_EDIT if per_edit else 0 if t == tau else None
        high = (t + 1) * PER_EDIT if per_edit and t < tau else 1 << 30
        if low is not None:
            places += [F.struct(*[F.lit(x).alias(n) for n, x in zip("tdisab", (t, d, i, shift, low, high), strict=True)]) for d, i, shift in probes(t)]
    rows = texts.select("h", "len", F.encode("line", "UTF-32").alias("chars")).select("h", "len", "chars", F.inline(F.array(*places))).where("len - d >= a and len - d < b")
    rows = rows.withColumn("q", F.expr("cast((len - d) div (t + 1) as int)")).withColumn("longer", F.expr("(len - d) % (t + 1) - (t + 1) + i"))
    rows = rows.withColumn("size", F.expr("q + if(longer >= 0, 1, 0)")).withColumn("place", F.expr("i * q + greatest(longer, 0) + s + 1"))
    fits = rows.where("place >= 1 and place + size - 1 <= len")
    return fits.select("h", F.expr("xxhash64(len - d, i, substring(chars, place * 4 - 3, size * 4))").alias("k"), F.expr("d = 0 and s = 0").alias("idx"))


def bound(x: Column, f) -> Column:
    """f of a value that is computed once: inside of a lambda an expression would be computed again for each element."""
    return F.element_at(F.transform(F.array(x), f), 1)


def bigram_parity(line: Column) -> Column:
    """64 bits; each the parity of how many bigrams hash to it."""
    return bound(F.split(line, ""), _parity)


def _parity(chars: Column) -> Column:
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(F.get(chars, i), F.get(chars, i + 1)), F.lit(64)).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 2), F.lit(0).cast("long"), lambda s, i: s.bitwiseXOR(bit(i)))


def banded_distance(long_: Column, short: Column, tau: int = TAU) -> Column:
    """Edit distance of two arrays of characters whose lengths differ by 0..tau, if it is at most tau; else some number above tau.

    Bit b of column j stands for row j - tau + b. Along the diagonal that ends in the last cell, the distance grows by one
    in each column where the diagonal difference isn't zero.
    """
    band = 2 * tau + 1
    full = (1 << band) - 1
    long_lit = lambda x: F.lit(x).cast("long")
    behind = F.size(long_) - F.size(short)
    invert = lambda x: x.bitwiseXOR(long_lit(full))

    def step(s: Column, j: Column) -> Column:
        ch = F.get(short, j)
        same = None
        for b in range(band):
            hit = F.when((j - tau + b >= 0) & (F.get(long_, j - tau + b) == ch), long_lit(1 << b)).otherwise(long_lit(0))
            same = hit if same is None else same.bitwiseOR(hit)
        return bound(same, lambda x: _column(s, x, behind, tau, full, invert))

    first = long_lit(full - ((1 << tau) - 1))
    start = F.struct(first.alias("vp"), long_lit(0).alias("vn"), behind.cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(0), F.size(short) - 1), start, step, lambda s: s["d"])


def _column(s: Column, x: Column, behind: Column, tau: int, full: int, invert) -> Column:
    vp, vn = s["vp"], s["vn"]
    d0 = ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full).cast("long"))

    def rest(d: Column) -> Column:
        hp = vn.bitwiseOR(invert(d.bitwiseOR(vp)))
        hn = d.bitwiseAND(vp)
        down = F.shiftright(d, 1)
        at = F.call_function("shiftright", d, (behind + tau).cast("int")).bitwiseAND(F.lit(1).cast("long"))
        return F.struct(
            hn.bitwiseOR(invert(down.bitwiseOR(hp))).alias("vp"),
            down.bitwiseAND(hp).alias("vn"),
            (s["d"] + 1 - at).alias("d"),
        )

    return bound(d0, rest)


def within(a: Column, b: Column, tau: int = TAU) -> Column:
    """Are the texts of structs a, b (line, len, sig) as many edits apart as the shorter allows, tau at most?"""
    chars = lambda e: F.split(e["line"], "")

    def distance(x: Column, y: Column) -> Column:
        return bound(F.struct(chars(x).alias("p"), chars(y).alias("t")), lambda z: banded_distance(z["p"], z["t"], tau))

    most = F.least(F.lit(tau), F.floor(F.least(a["len"], b["len"]) / PER_EDIT).cast("int"))
    near = (F.abs(a["len"] - b["len"]) <= most) & (F.bit_count(a["sig"].bitwiseXOR(b["sig"])) <= 4 * most)
    return F.when(~near, F.lit(False)).when(a["len"] >= b["len"], distance(a, b) <= most).otherwise(distance(b, a) <= most)


def hot_keys(texts: DataFrame, tau: int = TAU) -> DataFrame:
    """texts (line, ...) -> _k, blocks: the most frequent keys, by a sample of the lines, and how many blocks each needs; HOT_KEYS rows at most."""
    # a condition on the line, and not on its hash, stays above the aggregate of lines, whose shuffle is then used twice
    sample = texts.where(F.pmod(F.xxhash64(F.lit(5), "line"), F.lit(SAMPLED)) == 0)
    found = keys(sample, tau, per_edit=True).groupBy(F.col("k").alias("_k")).agg(F.count("*").alias("m")).where(F.col("m") >= HOT_SAMPLED)
    return found.orderBy(F.desc("m"), "_k").limit(HOT_KEYS).select("_k", F.ceil(F.col("m") * SAMPLED / BLOCK).alias("blocks"))


def line_links(each: DataFrame, tau: int = TAU) -> DataFrame:
    """each (line, h) -> links (u, v) between the hashes of different lines within tau edits."""
    from pyspark.sql import Window as W

    texts = each.where((F.col("h").isNotNull()) & (F.length("line") >= PER_EDIT)).groupBy("h").agg(F.first("line").alias("line")).withColumn("len", F.length("line"))
    keyed = keys(texts, tau, per_edit=True).join(F.broadcast(hot_keys(texts, tau)), F.col("k") == F.col("_k"), "left")
    # number of blocks and own block of a hot key's line; 0 for the others
    deal = F.coalesce(F.shiftleft(F.col("blocks"), 32).bitwiseOR(F.pmod(F.xxhash64(F.lit(7), "h"), F.col("blocks"))), F.lit(0).cast("long"))
    group = W.partitionBy("k", "deal")
    is_hot = F.col("deal") > 0
    members = (
        keyed.select("k", deal.alias("deal"), "h", "idx")
        .select("k", "deal", "h", "idx", F.min("h").over(group).alias("lo"), F.max("h").over(group).alias("hi"), F.max("idx").over(group).alias("any_idx"))
        .where(is_hot | ((F.col("lo") < F.col("hi")) & F.col("any_idx")))
        .groupBy("k", "deal", "h")
        .agg(F.max("idx").alias("idx"))
        .withColumn("block", F.when(is_hot, F.col("deal").bitwiseAND(F.lit((1 << 32) - 1))).otherwise(F.floor((F.row_number().over(group.orderBy("h")) - 1) / BLOCK)))
        .withColumn("supers", F.floor(F.when(is_hot, F.shiftright("deal", 32) - 1).otherwise(F.max("block").over(group)) / SUPER) + 1)
    )
    full = members.join(texts.withColumnRenamed("h", "_h"), F.col("h") == F.col("_h"))
    full = full.select("k", "block", "supers", F.struct("h", "idx", "line", "len", bigram_parity(F.col("line")).alias("sig")).alias("m"))
    blocks = full.groupBy("k", "block").agg(F.collect_list("m").alias("ms"), F.first("supers").alias("supers"))
    own = F.floor(F.col("block") / SUPER)
    dealt = blocks.select("k", "block", "ms", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("supers") - 1)).alias("other"))
    dealt = dealt.select("k", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "block", "ms")
    left = dealt.where("own = lo").drop("own")
    right = dealt.where("own = hi").select(F.col("k").alias("_k"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("block").alias("_b"), F.col("ms").alias("others"))
    pairs = left.join(right, (F.col("k") == F.col("_k")) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")) & (F.col("block") <= F.col("_b")))

    def partners(a: Column) -> Column:
        other = F.filter("others", lambda b: ((F.col("block") < F.col("_b")) | (a["h"] < b["h"])) & (a["idx"] | b["idx"]) & within(a, b, tau))
        return F.transform(other, lambda b: F.struct(a["h"].alias("u"), b["h"].alias("v")))

    return pairs.select(F.inline(F.flatten(F.transform("ms", partners)))).distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near (removed, and not equal to the line that stays), removed (line numbers), classes (of the removed lines, in their order), n_links (near lines that the document's lines are linked to, over all of its lines)."""
    each = lines(docs, id_col, text_col, min_chars)
    links, _ = write_shared(line_links(each, tau), "line-links")
    same = components(links)
    degrees = links.select(F.explode(F.array("u", "v")).alias("_d")).groupBy("_d").agg(F.count("*").alias("degree"))
    firsts = each.where("h is not null").groupBy("h").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    firsts = firsts.join(same, F.col("h") == F.col("node"), "left").join(degrees, F.col("h") == F.col("_d"), "left")
    # a line that stands once and is linked to none has no effect
    firsts = firsts.where("n > 1 or degree is not null").select("h", "n", "first", F.coalesce("component", "h").alias("cls"), F.coalesce("degree", F.lit(0)).alias("degree"))
    best = firsts.groupBy(F.col("cls").alias("_c")).agg(F.min_by(F.struct("first", "h"), F.struct("first", "h")).alias("best"))
    known = firsts.join(best, F.col("cls") == F.col("_c")).select(F.col("h").alias("k"), "n", "cls", "degree", F.col("best")["first"].alias("first"), (F.col("best")["h"] != F.col("h")).alias("near"))
    known, _ = write_shared(known, "line-classes")
    found = look_up(each.select("doc_id", "line_no", "h"), "h", known, ["doc_id", "line_no"]).select("doc_id", "line_no", "found.*")
    gone = F.col("first").isNotNull() & ~F.struct("doc_id", "line_no").eqNullSafe(F.col("first"))
    counted = found.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"),
        F.count_if(gone).alias("n_removed"),
        F.count_if(gone & F.col("near")).alias("n_near"),
        F.sort_array(F.collect_list(F.when(gone, F.struct("line_no", "cls")))).alias("gone"),
        F.coalesce(F.sum("degree"), F.lit(0)).alias("n_links"),
    )
    return counted.select("doc_id", "n_lines", "n_removed", "n_near", F.col("gone.line_no").alias("removed"), F.col("gone.cls").alias("classes"), "n_links")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs without the lines that go; documents that lose lines and have only blank ones left go too."""
    columns = docs.columns
    key, removed, left = fresh(columns, "gone_id", "removed", "left")
    gone, _ = write_shared(removed_lines(docs, id_col, text_col, min_chars=min_chars).where("n_removed > 0").select(F.col("doc_id").alias(key), F.col("removed").alias(removed)), "lines")
    gone = broadcast_if(gone, BROADCAST_DOCS) if gone.agg(F.coalesce(F.sum(F.size(removed)), F.lit(0))).first()[0] <= 10 * BROADCAST_DOCS else gone
    text = F.col(f"`{text_col}`")
    stays = lambda xs: F.array_except(F.sequence(F.lit(0), F.size(xs) - 1), F.col(removed))
    rest = bound(F.split(text, "\n"), lambda xs: F.array_join(F.transform(stays(xs), lambda i: F.get(xs, i)), "\n"))
    out = docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(key)), "left").withColumn(left, F.when(F.col(removed).isNotNull(), rest))
    out = out.where(F.col(removed).isNull() | (F.btrim(left, F.lit(BLANKS)) != ""))
    return out.select(*[F.coalesce(F.col(left), text).alias(c) if c == text_col else F.col(f"`{c}`") for c in columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of every document go, which, of which classes, and how many links its lines have."""
    found = removed_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=EVERY_LINE)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select("doc_id", "n_lines", "n_removed", "n_near", joined("removed"), joined("classes"), "n_links")
