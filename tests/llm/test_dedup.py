"""Fingerprints, line dedup, SimHash."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cutline.llm import components as stars
from cutline.llm import op3_fingerprint as lz
from cutline.llm import op5_lines as lines
from cutline.llm import op9_simhash as sim


def classes(n, near):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


# fingerprints


def plain_phrases(t):
    seen, cur = [], ""
    for ch in t:
        cur += ch
        if cur not in seen:
            seen.append(cur)
            cur = ""
    return set(seen) or ({cur} if cur else set())


def test_fingerprint_shares_the_parse():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 5, 40, 300):
        for m in (0, 1, 7, 200):
            t, head = ("".join(rng.choice("ab c") for _ in range(k)) for k in (n, m))
            own, edited, changed = lz.both(t, head)
            assert (own == lz.fingerprint(t)).all() and (edited == lz.fingerprint(changed)).all()
            assert changed == t[: n - n // 4] + head[: n // 4]
            assert set(lz.parse(t, set())[0]) == plain_phrases(t) or n < 2


def test_likeness_estimates_jaccard():
    rng = random.Random(5)
    a = "".join(rng.choice("abcdef ") for _ in range(4000))
    b = a[:3000] + "".join(rng.choice("uvwxyz ") for _ in range(1000))
    x, y = plain_phrases(a), plain_phrases(b)
    assert abs(lz.likeness(lz.fingerprint(a), lz.fingerprint(b)) - len(x & y) / len(x | y)) < 0.15
    assert lz.likeness(lz.fingerprint(""), lz.fingerprint("")) == 1 and lz.likeness(lz.fingerprint("a"), lz.fingerprint("")) == 0


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_fingerprint_query(spark, rows, sf, parts):
    got = sorted(tuple(r) for r in lz.fingerprint_with_neighbour(spark.read.parquet(f"{sf}/documents.parquet"), parts).collect() if r.doc_id is not None)
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        changed = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        a, b, c = lz.fingerprint(t), lz.fingerprint(changed), lz.fingerprint(nxt)
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), lz.as_text(a), lz.as_text(b), lz.likeness(a, b), lz.likeness(a, c)))
    assert got == sorted(w for w in want if w[0] is not None)


def test_fingerprint_of_nothing_and_of_one(spark, empty):
    assert lz.op3_lz_fingerprint(spark, empty).count() == 0
    one = lz.fingerprint_with_neighbour(spark.createDataFrame([(7, "abcabc")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


# lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_distance_and_keys(spark, tau):
    rng = random.Random(tau)
    pairs = []
    for _ in range(250):
        a = "".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(tau + 1, 30)))
        b = list(a)
        for _ in range(rng.randint(0, tau + 2)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.choice([0, 1])] = rng.choice(["", "a", "é", "c"])
        b = "".join(b)
        if len(a) < len(b):
            a, b = b, a
        if b and len(a) - len(b) <= tau:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    d = lines.banded_distance(F.split("a", ""), F.split("b", ""), tau)
    bits = lambda c: lines.bigram_parity(F.col(c))
    flips = F.when((F.length("a") > 1) & (F.length("b") > 1), F.bit_count(bits("a").bitwiseXOR(bits("b")))).otherwise(0)
    texts = sorted({x for p in pairs for x in p})
    keyed = {}
    for r in lines.keys(spark.createDataFrame([(k, x, len(x)) for k, x in enumerate(texts)], "h long, line string, len int"), tau).collect():
        keyed.setdefault((texts[r.h], r.idx), set()).add(r.k)
    for r in df.select("a", "b", d.alias("d"), flips.alias("flips")).collect():
        real = edits(r.a, r.b)
        assert (r.d == real) if real <= tau else r.d > tau, (r.a, r.b, r.d, real)
        if real <= tau:
            probed = keyed.get((r.a, True), set()) | keyed.get((r.a, False), set())
            assert r.flips <= 4 * tau and (keyed.get((r.b, True), set()) & probed or len(r.b) <= tau), (r.a, r.b)


def plain_removed(rows, tau=2, least=24):
    found = {}
    for i, t, *_ in rows:
        for k, x in enumerate((t or "").split("\n")):
            if len(x) >= least and x.strip(" \t\n\x0b\x0c\r"):
                at = (i is not None, i or 0, k)
                found[x] = min(found.get(x, at), at)
    texts = sorted(found)
    label = classes(len(texts), lambda a, b: abs(len(texts[a]) - len(texts[b])) <= tau and edits(texts[a], texts[b]) <= tau)
    first = {}
    for x, c in zip(texts, label, strict=True):
        first[c] = min(first.get(c, found[x]), found[x])
    stays = {x: first[c] for x, c in zip(texts, label, strict=True)}
    out = {}
    for i, t, *_ in rows:
        out.setdefault(i, set()).update(k for k, x in enumerate((t or "").split("\n")) if x in stays and (i is not None, i or 0, k) != stays[x])
    return out


@pytest.fixture(scope="module")
def line_rows(rows):
    rng = random.Random(8)
    hot = "this line is a hot one and stands in very many documents indeed"
    near = [hot[:k] + rng.choice("xyz") * 3 + hot[k + 3 :] for k in range(3, 60, 1)]
    return [r for r in rows if r[1] is None or len(r[1]) < 5000] + [(500 + i, f"{hot}\n{x}\n{hot.replace('hot', 'hat', i % 2)}", "en", "s1") for i, x in enumerate(near)]


def test_line_dedup(spark, line_rows):
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t, *_ in line_rows], "doc_id long, text string, h string, line string")
    want = plain_removed(line_rows)
    got = {r.doc_id: set(r.removed) for r in lines.removed_lines(df).collect()}
    assert got == want and sum(map(len, want.values())) > 60
    kept = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    for i, t, *_ in line_rows:
        left = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in want[i])
        if want[i] and not left.strip(" \t\n\x0b\x0c\r"):
            assert i not in kept
        elif i is not None and [r[0] for r in line_rows].count(i) == 1:
            assert (kept[i] or "") == left


@pytest.mark.parametrize(("hot", "sampled"), [(3, (256, 64)), (10_000, (256, 64)), (10_000, (1, 20)), (10_000, (2, 1))])
def test_frequent_lines_and_segments(spark, monkeypatch, hot, sampled):
    """Several superblocks of one segment, more known lines than are broadcast, and hot segments whose lines are dealt by hash."""
    from cutline.llm import common

    monkeypatch.setattr(lines, "SAMPLED", sampled[0])
    monkeypatch.setattr(lines, "HOT_SAMPLED", sampled[1])

    monkeypatch.setattr(common, "HOT_KEYS", hot)
    monkeypatch.setattr(lines, "BLOCK", 2)
    monkeypatch.setattr(lines, "SUPER", 3)
    rng = random.Random(17)
    head = "one and the same beginning of a line "
    own = [head + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(120)]
    rows = [(i, f"{rng.choice(own)}\n{rng.choice(own)}\n\n \n{head * 2}", None, None) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, a string, b string")
    assert {r.doc_id: set(r.removed) for r in lines.removed_lines(df).collect()} == plain_removed(rows)


def test_line_dedup_query(spark, sf, empty, rows):
    assert lines.op5_line_dedup(spark, sf).count() == len({r[0] for r in rows})
    assert lines.op5_line_dedup(spark, empty).count() == 0


def test_line_dedup_is_native(spark, sf):
    plan = lines.line_links(lines.lines(spark.read.parquet(f"{sf}/documents.parquet")))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_every_line(docs):
    """id -> (removed line numbers, links of its lines)"""
    found = {}
    for i, t in docs:
        for k, x in enumerate(t.split("\n")):
            if x.strip():
                found.setdefault(x, (i, k))
    texts = sorted(found)
    near = lambda a, b: edits(a, b) <= min(2, min(len(a), len(b)) // 12)
    label = classes(len(texts), lambda a, b: near(texts[a], texts[b]))
    first = {}
    for x, c in zip(texts, label, strict=True):
        first[c] = min(first.get(c, found[x]), found[x])
    stays = {x: first[c] for x, c in zip(texts, label, strict=True)}
    links = {x: sum(near(x, y) for y in texts if y != x) for x in texts}
    return {i: ([k for k, x in enumerate(t.split("\n")) if x in stays and stays[x] != (i, k)], sum(links.get(x, 0) for x in t.split("\n"))) for i, t in docs}


def test_line_dedup_takes_short_lines(spark, tmp_path):
    rng = random.Random(11)
    base = ["".join(rng.choice("abc ") for _ in range(n)) + "." for n in (0, 1, 2, 5, 10, 11, 12, 13, 20, 22, 23, 24, 25, 40)]
    docs = []
    for i in range(40):
        own = []
        for x in rng.sample(base, 5):
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(len(x) + 1)
                x = x[:at] + rng.choice(["", "a", "z"]) + x[at + rng.choice([0, 1]) :]
            own.append(x)
        docs.append((i, "\n".join([*own, " ", "x"])))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, got = plain_every_line(docs), lines.op5_line_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: ([int(k) for k in r.removed.split(",") if k], r.n_links) for r in got} == want
    assert all(len(r.classes.split(",")) == r.n_removed for r in got if r.n_removed)
    by_class = {}
    for r in got:
        for k, c in zip(r.removed.split(","), r.classes.split(","), strict=True):
            by_class.setdefault(c, set()).add(docs[r.doc_id][1].split("\n")[int(k)] if k else "")
    assert {"x"} in by_class.values()


# SimHash


def plain_simhash(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [False, True])
def test_simhash_query(spark, rows, sf, monkeypatch, hot):
    if hot:
        from cutline.llm import common

        monkeypatch.setattr(common, "HOT_KEYS", 1)
        monkeypatch.setattr(sim, "ROWS", 3)
        monkeypatch.setattr(sim, "HOT", 3)
        monkeypatch.setattr(sim, "SPLIT", 2)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in sim.op9_simhash_near_dedup(spark, sf).collect()}
    prints = sorted({(plain_simhash(t), i) for i, t, *_ in rows}, key=lambda x: (x[1] is None, x[1] or 0))
    label = classes(len(prints), lambda a, b: (prints[a][0] ^ prints[b][0]).bit_count() <= 4)
    assert got == {(i, f"{f:016x}"): prints[c][1] for (f, i), c in zip(prints, label, strict=True)}


def test_simhash_of_nothing(spark, empty):
    assert sim.op9_simhash_near_dedup(spark, empty).count() == 0


def test_close_pairs_loses_none():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.concatenate([base[rng.integers(0, 40, 700)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (700, 4), dtype=np.uint64), axis=1) * rng.integers(0, 2, 700).astype(np.uint64), base])
    for groups in (1, 5, 300):
        g = np.sort(rng.integers(0, groups, len(fp)))
        for radius in (4, 5, 7):
            a, b = map(np.concatenate, zip(*sim.close_pairs(fp, g, radius), strict=True))
            i, j = np.triu_indices(len(fp), 1)
            ok = (g[i] == g[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= radius)
            assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(zip(i[ok].tolist(), j[ok].tolist(), strict=True))


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(90)]
    got = {r.node: r.component for r in stars.components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = sorted({x for p in links for x in p})
    at = {x: k for k, x in enumerate(nodes)}
    pairs = {(at[a], at[b]) for a, b in links} | {(at[b], at[a]) for a, b in links}
    label = classes(len(nodes), lambda a, b: (a, b) in pairs)
    assert got == {nodes[k]: nodes[c] for k, c in enumerate(label) if k != c}


def test_dense_groups_hold_few_pairs():
    """8.4 million pairs within the radius; what is held of them at a time is bounded."""
    rng = np.random.default_rng(5)
    fp = np.unique(np.uint64(0x1234567) ^ (np.uint64(1) << rng.integers(0, 64, 9000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 9000, dtype=np.uint64)))
    label, most, total = np.arange(len(fp)), 0, 0
    for a, b in sim.close_pairs(fp, np.zeros(len(fp), np.int64)):
        most, total = max(most, len(a)), total + len(a)
        label = sim.forest(label, a, b)
    assert total > 1_000_000 and most <= 64 * sim.ROWS and not label.any()
