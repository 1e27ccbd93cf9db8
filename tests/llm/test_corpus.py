"""Packing, mixing, quality rules, importance resampling and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.llm import op4_packing as packing
from cutline.llm import op7_mixing as mixing
from cutline.llm import op8_quality as quality
from cutline.llm import op10_importance as importance

from corpus_data import prose, write


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# packing


@cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def plain_ids(t):
    return tokenizer().encode(t or "", add_special_tokens=False).ids + [0]


def test_encoder_equals_the_tokenizer():
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "don't", "É ", "\U0001f600", "<|endoftext|>", "12", "!!", "\0", "　", "\r\n", "\x1c"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + ["", " ", "a" * 5000]
    encoder = packing.Encoder(packing.tokenizer_path(), most=50)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for t, got in zip(part, encoder.encode(part), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == plain_ids(t)[:-1], repr(t)


@pytest.mark.parametrize("capacity", [(64, 5, 64), (64, 100, 20), (64, 2, 31)])
def test_pack_keeps_limits(capacity):
    rng = random.Random(2)
    items = [(n := rng.choice([1, 2, 5, 30, 64, 65, 200]), rng.randint(0, n)) for _ in range(300)]
    got = packing.pack(items, capacity)
    seen = defaultdict(list)
    for row in got:
        loss = 0
        for k, start, n in row:
            seen[k].append((start, n))
            first = items[k][0] - items[k][1]
            loss += max(0, start + n - max(start, first))
        assert sum(p[2] for p in row) <= capacity[0] and len(row) <= capacity[1] and loss <= capacity[2]
    for k, (n, _) in enumerate(items):
        at = 0
        for start, m in sorted(seen[k]):
            assert start == at and m > 0
            at += m
        assert at == n


@pytest.mark.parametrize("segments", [128, 3])
def test_packing_is_a_round_trip(spark, rows, sf, segments):
    got = packing.pack_texts(spark.read.parquet(f"{sf}/documents.parquet"), packing.tokenizer_path(), segments=segments, keep_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, tuple(r.ids), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == packing.LENGTH or packing.open_length(at)
        assert len(parts) <= segments
    for i in {r[0] for r in rows}:
        texts = [t for j, t, *_ in rows if j == i]
        ids = plain_ids(texts[0])
        covered = Counter(p for start, part, n in pieces[i] for p in range(start, start + len(part)))
        assert covered == {p: len(texts) for p in range(len(ids))}
        assert all(list(part) == ids[start : start + len(part)] and n == len(ids) for start, part, n in pieces[i])


def test_every_limit_binds():
    rng = random.Random(4)
    items = [(n := int(rng.lognormvariate(4.7, 1.2)) + 1, n - n // 4) for _ in range(2000)]
    full = packing.pack(items)
    wide = {"segments": (packing.LENGTH, 10**6, packing.LOSS), "loss": (packing.LENGTH, packing.SEGMENTS, packing.LENGTH), "tokens": (2 * packing.LENGTH, packing.SEGMENTS, packing.LOSS)}
    assert all(packing.pack(items, c) != full for c in wide.values())
    assert max(map(len, full)) == packing.SEGMENTS and max(map(len, packing.pack(items, wide["segments"]))) > packing.SEGMENTS
    # but for the segments, little is left free
    assert sum(n for n, _ in items) > 0.98 * packing.LENGTH * len(packing.pack(items, wide["segments"]))


def plain_first(items, capacity):
    """The first sequence by the dot-product rule, for items that all fit whole."""
    free, row, left = [capacity[0], capacity[2]], [], list(range(len(items)))
    for _ in range(capacity[1]):
        fits = [k for k in left if items[k][0] <= free[0] and items[k][1] <= free[1]]
        if not fits:
            break
        k = max(fits, key=lambda k: items[k][0] * free[0] / capacity[0] ** 2 + items[k][1] * free[1] / capacity[2] ** 2)
        left.remove(k)
        row.append(items[k])
        free = [free[0] - items[k][0], free[1] - items[k][1]]
    return row


def test_pack_follows_the_dot_product():
    rng = random.Random(6)
    for _ in range(60):
        items = list({(n := rng.randint(60, 400), rng.randint(0, n)) for _ in range(9)})
        want = plain_first(items, (1024, 100, 500))
        got = [items[k] for k, start, n in packing.pack(items, (1024, 100, 500))[0] if not start and n == items[k][0]]
        assert got[: len(want)] == want


def test_packing_nothing(spark, empty):
    assert packing.op4_vector_packing(spark, empty).count() == 0


# mixing


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(i % 3 + 1) for i, s in enumerate(order)}
    cap = {s: Fraction(3 * n) for s, n in sizes.items()}
    fixed = {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in sizes if s not in fixed]
        target = fixed | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > cap[s]]
        if not over:
            return target
        fixed |= {s: cap[s] for s in over}


def test_mixing(spark, rows, sf):
    got = mixing.op7_source_mixing(spark, sf).collect()
    sizes, source, n = defaultdict(int), {}, {}
    for i, t, _, s in rows:
        sizes[s] += len(words(t))
        source[i], n[i] = s, len(words(t))
    target = plain_targets(sizes)
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r.size == n[r.doc_id] and r.source_size == sizes[s] and abs(r.target - float(target[s])) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and r.taken >= math.floor(round(r.target) / max(1, sizes[s])) * r.size
        taken[s] += r.taken
    for s, x in target.items():
        assert abs(taken[s] - x) <= 3, s
    assert sorted(map(str, mixing.op7_source_mixing(spark, sf).collect())) == sorted(map(str, got))


def test_mixing_takes_by_key_and_budget(spark, rows, sf):
    """The selection recomputed: whole epochs, then by falling key until the budget is full."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    measured = docs.select("doc_id", "source", *[c.alias(k) for k, c in mixing.statistics(F.coalesce("text", F.lit(""))).items()])
    weight = mixing.learned_quality(measured, spark.read.parquet(f"{sf}/labels.parquet"))
    keyed = measured.select("doc_id", "source", F.col("words").alias("n"), F.pow(mixing.uniform(F.col("doc_id")), 1 / weight).alias("u")).collect()
    sizes = defaultdict(int)
    for r in keyed:
        sizes[r.source] += r.n
    want = Counter()
    for s, target in plain_targets(dict(sizes)).items():
        epochs, room = divmod(round(target), sizes[s]) if sizes[s] else (0, 0)
        for r in sorted((r for r in keyed if r.source == s), key=lambda r: (-r.u, r.doc_id is not None, r.doc_id or 0, r.n)):
            take = min(r.n, room)
            room -= take
            want[r.doc_id, r.n] += epochs * r.n + take
    got = Counter()
    for r in mixing.op7_source_mixing(spark, sf).collect():
        got[r.doc_id, r.size] += r.taken
    # copies of one row share what is left at the cut evenly, rounded down
    assert all(abs(got[x] - want[x]) <= 1 for x in want) and sum(got.values()) >= sum(want.values()) - 3


def test_mixing_prefers_weight_and_caps(spark):
    rows = [(i, "a", 10, 1.0 if i % 2 else 0.25) for i in range(4000)] + [(10_000 + i, "b", 10, 1.0) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n int, w double")
    got = mixing.mix(docs, F.col("n").cast("long"), F.col("w")).collect()
    assert sum(r.taken for r in got if r.source == "b") == 3000
    part = [r for r in got if r.source == "a"]
    assert sum(r.taken for r in part) == 41000 - 3000
    light, heavy = (sum(r.taken for r in part if r.w == w) for w in (0.25, 1.0))
    assert heavy > 1.02 * light and all(r.taken <= 10 for r in part)


def plain_bins(t):
    t = t or ""
    w = words(t)
    share = lambda x, of, bins: min(bins - 1, math.floor(x * (bins - 1) / of)) if of else 0
    return {
        "plain": share(sum(c.isalpha() or c.isnumeric() or c == " " for c in t), len(t), 21),
        "distinct": share(len(set(w)), len(w), 11),
        "capital": share(5 * sum(c.isupper() for c in t), len(t), 11),
        "length": min(12, len(t) // len(w)) if w else 0,
    }


def test_learned_quality_is_naive_bayes(spark, rows, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null")
    measured = docs.select("doc_id", *[c.alias(k) for k, c in mixing.statistics(F.coalesce("text", F.lit(""))).items()])
    labels = [(i, i % 3 and 1) for i, _, _, _ in rows if i is not None and i % 4] + [(1, 0), (2, None), (777_777, 1)]
    weight = mixing.learned_quality(measured, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r for r in measured.withColumn("w", weight).collect()}
    good = {}
    for i, q in labels:
        if q is not None:
            good[i] = good.get(i, True) and q > 0
    held = [(plain_bins(t), good[i]) for i, t, _, _ in rows if i in good]
    n = Counter(g for _, g in held)
    for i, t, _, _ in rows:
        if i is None:
            continue
        own = plain_bins(t)
        assert {k: got[i][k] for k in own} == own and got[i].words == len(words(t))
        odds = math.log((n[True] + 1) / (n[False] + 1))
        for f, bins in mixing.FEATURES.items():
            a, b = (sum(g == kind and x[f] == own[f] for x, g in held) for kind in (True, False))
            odds += math.log((a + 1) / (n[True] + bins)) - math.log((b + 1) / (n[False] + bins))
        assert abs(got[i].w - max(mixing.LEAST_WEIGHT, 1 / (1 + math.exp(-odds)))) < 1e-9
    one = mixing.learned_quality(measured, spark.createDataFrame([(3, 1)], "doc_id long, quality int"))
    assert measured.select(one.alias("w")).distinct().collect() == [(1.0,)]


def test_mixing_takes_good_documents_first(spark):
    """Labels of half of the given documents teach the weight; of the other half, those labelled good are taken more often than bad ones of about the same size."""
    given = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{given}/{t}.parquet") for t in ("documents", "labels"))
    held = F.xxhash64("doc_id") % 2 == 0
    measured = docs.select("doc_id", "source", *[c.alias(k) for k, c in mixing.statistics(F.coalesce("text", F.lit(""))).items()])
    weight = mixing.learned_quality(measured, labels.where(~held))
    got = mixing.mix(measured.withColumn("w", weight), F.col("words"), F.col("w")).join(labels.where(held & F.col("quality").isNotNull()), "doc_id")
    # of each document's words, how many are taken beyond the epochs that all have
    part = F.col("taken") / F.col("size") - F.floor(F.round("target") / F.col("source_size"))
    rows = got.where("size > 0").select(F.floor(F.log2("size") / 2).alias("k"), "quality", part.alias("part"), "w").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    mean = lambda xs: sum(xs) / len(xs)
    assert len(bad) > 100 and mean([r.w for r in good]) > 2 * mean([r.w for r in bad])
    assert mean([r.part for r in good]) > 1.3 * mean([r.part for r in bad])
    for k in {r.k for r in bad}:
        if min(sum(r.k == k for r in x) for x in (good, bad)) >= 40:
            assert mean([r.part for r in good if r.k == k]) > mean([r.part for r in bad if r.k == k])


def test_mixing_nothing(spark, empty):
    assert mixing.op7_source_mixing(spark, empty).count() == 0


# quality rules


def plain_features(t):
    t = t or ""
    w = words(t)
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_features(spark, rows, sf):
    extra = [(900 + i, " ".join(random.Random(i).choice(["a", "b"]) for _ in range(60)) + "\nx\nx\n \n \n", "en", "s") for i in range(20)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "n_words").unionByName(spark.createDataFrame([(i, t, "c") for i, t, *_ in extra], "doc_id long, text string, n_words string"))
    got = sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in quality.features(docs, F.coalesce("text", F.lit(""))).collect())
    assert got == sorted(str((i, *plain_features(t))) for i, t, *_ in rows + extra)


def test_quality_query(spark, rows, sf, empty):
    got = quality.op8_risk_controlled_quality(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.op8_risk_controlled_quality(spark, empty).count() == 0


def test_binomial_tail(spark):
    cases = [(n, k) for n in (1, 5, 200, 3000) for k in (0, 1, 3, 10, 60) if k <= n]
    df = spark.createDataFrame(cases, "n long, k long")
    for r in df.select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.03).alias("p")).collect():
        want = sum(math.comb(r.n, i) * Fraction(3, 100) ** i * Fraction(97, 100) ** (r.n - i) for i in range(r.k + 1))
        assert abs(r.p - float(want)) < 1e-9 if r.k <= 0.03 * r.n else r.p == 1.0


def test_every_stratum_has_its_own_cutoffs(spark):
    """Many strata: none is pooled for being small, and none without labels has a guarantee of its own."""
    rows = [(f"s{i:03}", k % 2 == 0, 100, 500, 0 if k % 2 == 0 else 90, 0, 0, 5) for i in range(400) for k in range(6000 if i == 399 else 2)]
    schema = "stratum string, good boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    held = spark.createDataFrame(rows, schema)
    cutoffs = quality.write_shared(quality.calibrate(held), "cutoffs")[0]
    got = {r.stratum: r.cutoffs for r in cutoffs.collect()}
    assert len(got) == 400 and got["s399"][0] is not None and set(got["s000"]) == {None}
    new = spark.createDataFrame([("s399", True, 100, 500, 90, 0, 0, 5), ("s000", True, 100, 500, 90, 0, 0, 5), ("new", True, 100, 500, 90, 0, 0, 5), (None, True, 100, 500, 90, 0, 0, 5)], schema)
    assert {r.stratum: r.kept for r in quality.with_verdict(new, cutoffs).collect()} == {"s399": False, "s000": True, "new": True, None: True}


def test_quality_query_where_the_method_rejects(spark):
    """Against its SQL, at a scale at which cutoffs are certified."""
    import duckdb

    from cutline.llm.oracle import QUALITY

    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    rel = con.sql(QUALITY)
    got = quality.op8_risk_controlled_quality(spark, sf).select(*rel.columns).collect()
    assert sum(not r.kept and not r.base_failed for r in got) > 100
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())


def test_thresholds_are_certified(spark):
    rng = random.Random(6)
    rows = []
    for stratum, n in (("en", 6000), ("de", 60), (None, 40)):
        for _ in range(n):
            good = rng.random() < 0.8
            rows.append((stratum, good, 100, 500, 0 if good and rng.random() > 0.001 else rng.randint(30, 120), 0, 0, 5))
    held = spark.createDataFrame(rows, "stratum string, good boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    cutoffs = quality.write_shared(quality.calibrate(held), "cutoffs")[0]
    got = {r.stratum: r.cutoffs for r in cutoffs.collect()}
    en = dict(zip(quality.RULES, got["en"], strict=True))
    assert en["symbols"] is not None and en["symbols"] < 0.5
    assert all(v is None for k, v in en.items() if k != "symbols") and set(got["de"]) == {None} and set(got[None]) == {None}
    kept = quality.with_verdict(held, cutoffs)
    assert kept.where("good and not kept").count() <= 0.03 * 4800
    assert kept.where("not good and kept and stratum = 'en'").count() < 300


# importance resampling


def test_kth_key(spark, monkeypatch):
    monkeypatch.setattr(importance, "NARROW", 20)
    rng = random.Random(9)
    rows = [(rng.choice([1.0, 2.5, rng.random(), -1e6, rng.gauss(0, 1e-9)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "key double, doc_id long").cache()
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    for k in (5, 450, 899):
        assert tuple(importance.kth_key(df, k)) == order[k - 1], k
    assert importance.kth_key(df, 900) is None


def test_kth_id_among_equal_keys(spark, monkeypatch):
    monkeypatch.setattr(importance, "NARROW", 10)
    rng = random.Random(10)
    ids = [None] * 30 + [rng.choice([rng.randrange(50), rng.randrange(1 << 62), -(1 << 60)]) for _ in range(300)]
    df = spark.createDataFrame([(1.0, i) for i in ids], "key double, doc_id long")
    order = sorted(ids, key=lambda i: (i is not None, i or 0))
    for k in (1, 30, 31, 100, 200, 329):
        assert importance.kth_key(df, k) == (1.0, order[k - 1]), k


def plain_log_weights(texts, good, buckets=importance.BUCKETS):
    """By the docstring: hashed words and pairs, two smoothed models, sums of log ratios."""
    import xxhash

    half = buckets // 2

    def grams(t):
        h = [xxhash.xxh3_64_intdigest(w) >> 1 for w in (t or "").lower().encode().split()]
        signed = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
        pairs = [signed((signed(a * 3) ^ (b >> 7)) * 0x2545F4914F6CDD1D) >> 20 for a, b in zip(h, h[1:])]
        return [x % half for x in h] + [half + x % half for x in pairs]

    raw, target = Counter(), Counter()
    for i, t in texts:
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    total = {part: (sum(n for b, n in c.items() if (b >= half) == part) + half * importance.SMOOTHING) for part in (False, True) for c in [raw]}
    wanted = {part: (sum(n for b, n in target.items() if (b >= half) == part) + half * importance.SMOOTHING) for part in (False, True)}
    ratio = lambda b: math.log((target[b] + importance.SMOOTHING) / wanted[b >= half]) - math.log((raw[b] + importance.SMOOTHING) / total[b >= half])
    return [sum(map(ratio, grams(t))) for _, t in texts]


def test_resampling_against_brute_force(spark, rows, sf):
    got = {}
    for r in importance.op10_importance_resampling(spark, sf).collect():
        got.setdefault(r.doc_id, []).append(r)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("doc_id is not null").collect()
    good = {r.doc_id for r in labels if r.quality and not r.toxic}
    want = plain_log_weights([(i, t) for i, t, *_ in rows], good)
    noise = {r.doc_id: r.g for r in spark.createDataFrame([(i,) for i in {r[0] for r in rows}], "doc_id long").withColumn("g", importance.gumbel(F.col("doc_id"))).collect()}
    for (i, t, *_), w in zip(rows, want, strict=True):
        assert any(abs(r.log_weight - w) < 1e-6 * max(1, abs(w)) and abs(r.sample_key - w - noise[i]) < 1e-6 * max(1, abs(w)) for r in got[i]), i
    everything = sorted((r for rs in got.values() for r in rs), key=lambda r: (-r.sample_key, r.doc_id is not None, r.doc_id or 0))
    k = round(len(good) / len({r.doc_id for r in labels}) * len(rows))
    end = everything[k - 1]
    assert {str(r) for r in everything[:k]} <= {str(r) for r in everything if r.kept}
    assert all((r.sample_key, r.doc_id) == (end.sample_key, end.doc_id) for r in everything[k:] if r.kept)


def test_resampling_separates_held_out(spark, tmp_path):
    rng = random.Random(12)
    good = [" ".join(rng.choice("sun moon star sky light dawn dusk night".split()) for _ in range(60)) for _ in range(200)]
    bad = [" ".join(rng.choice("buy now cheap pills spam click here win moon".split()) for _ in range(60)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(good + bad)) + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(0, 400, 4)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in importance.resample(docs, labels).collect()}
    held = [got[i].kept == (i < 200) for i in range(400) if i % 4]
    assert sum(held) / len(held) > 0.95
    assert sum(r.kept for r in got.values()) == 201 and got[1000].log_weight == 0
    assert all(r.kept for r in importance.resample(docs, labels.limit(0)).collect())


def test_resampling_counts_everything(spark, rows, sf, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "coalesce(text, '') t")
    raw, good = importance.counts(docs, [0, 2], 1 << 10)
    assert raw.sum() == sum(n + max(0, n - 1) for n in (len((t or "").lower().encode().split()) for _, t, *_ in rows)) and 0 < good.sum() < raw.sum()
    assert importance.op10_importance_resampling(spark, sf).count() == len(rows)
    assert importance.op10_importance_resampling(spark, empty).count() == 0


# pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    texts = [prose(rng, rng.choice([60, 200, 500]), "abcdefghijklmnop") for _ in range(80)]
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[0], "en", "s1") for i in range(5)] + [(200, "too short", "en", "s1"), (201, None, None, None), (202, "same words here now " * 40, "en", "s0")]
    sf = write(spark, rows, tmp_path)
    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), None
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf)
        made.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen[name] = docs.collect()
        if k < 4:
            assert docs.columns == columns
    ids = {n: {r.doc_id for r in seen[n]} for n in seen}
    assert ids["quality rules"] == set(range(80)) | set(range(100, 105))
    assert ids["line dedup"] == set(range(80))
    assert ids["near-duplicates"] == set(range(80))
    before, after = Counter(), Counter()
    for r in seen["near-duplicates"]:
        before[r.source] += len(words(r.text))
    for r in seen["mixing"]:
        after[r.source] += len(words(r.text))
        assert r.n_chars == len(r.text)
    for s, x in plain_targets(dict(before)).items():
        assert abs(after[s] - x) <= 3
    assert sum(len(r.ids) for r in seen["packing"]) == sum(len(plain_ids(r.text)) for r in seen["mixing"])
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_on_any_rows(spark, rows, sf, empty, tmp_path):
    """Nulls, ties, repeated rows, clashing column names, and nothing at all."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns, name
            got = docs.collect()
            assert got and all(r[c] == "clash" for r in got for c in columns[5:]), name
            assert all(r.n_chars == len(r.text) for r in got if r.text), name
    assert docs.count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_one_of_each_keeps_every_text(spark):
    import corpus_pipeline

    rng = random.Random(21)
    a, b, c, d = (prose(rng, 150, "abcdefghijklmnop") for _ in range(4))
    rows = [(5, a), (9, a), (5, b), (3, b), (7, c), (7, c), (7, d), (None, a), (None, d), (None, d + " zz"), (None, None), (None, ""), (4, None), (4, "")]
    rows += [(None, "lone " * 3 + x) for x in ("", "")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text or "") for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()), key=str)
    assert got == sorted([(5, a), (3, b), (7, c), (7, d), (4, ""), (None, "lone " * 3)], key=str)


def test_packing_under_a_loss_limit(spark):
    docs = spark.createDataFrame([(i, "one two three four five six " * (5 + i % 40), 20 if i % 3 else 25 + i % 40) for i in range(200)], "doc_id long, text string, lossy int")
    got = packing.pack_texts(docs.coalesce(1), packing.tokenizer_path(), loss_col="lossy", loss_tokens=100).collect()
    lossy = {r.doc_id: r.lossy for r in docs.collect()}
    held, tokens, covered = {}, {}, {}
    for r in got:
        first = r.doc_tokens - min(lossy[r.doc_id], r.doc_tokens)
        held[r.sequence_id] = held.get(r.sequence_id, 0) + max(0, min(r.length, r.start + r.length - first))
        tokens[r.sequence_id] = tokens.get(r.sequence_id, 0) + r.length
        covered.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert max(held.values()) <= 100 and max(tokens.values()) <= 1024
    for pieces in covered.values():
        at = 0
        for start, n, _ in sorted(pieces):
            assert start == at
            at += n
        assert at == pieces[0][2]
    assert len(covered) == 200
