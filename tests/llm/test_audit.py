"""Manifest, decontamination, filter audit."""

import hashlib
import itertools
import random
import re
import threading
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_data import prose
from cutline.llm import common
from cutline.llm import op11_merkle as merkle
from cutline.llm import op12_decontaminate as fm
from cutline.llm import op13_audit as audit


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# manifest


def plain_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """root, and for each leaf the (left, right) of each level."""
    paths = [[] for _ in leaves]
    now = [(h, [k]) for k, h in enumerate(leaves)]
    while len(now) > 1:
        above = []
        for i in range(0, len(now), 3):
            run = now[i : i + 3]
            for at, (_, own) in enumerate(run):
                for k in own:
                    paths[k].append(("".join(h for h, _ in run[:at]), "".join(h for h, _ in run[at + 1 :])))
            above.append((sha("".join(h for h, _ in run)), [k for _, own in run for k in own]))
        now = above
    return now[0][0], paths


def plain_manifest(rows):
    """rows (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for r in rows:
        i, t, lang, src, n = r
        groups[src].append((plain_leaf(i, src, lang, n, t), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[s] = plain_tree([h for h, _ in groups[s]])
    root, above = plain_tree([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, above, strict=True):
        for (leaf, (i, t, lang, src, n)), path in zip(groups[s], trees[s][1], strict=True):
            path = path + up
            h = leaf
            if i is not None and t is not None and zlib.crc32(str(i).encode()) % 2 == 0:
                h = plain_leaf(i, src, lang, n, t.replace("\n", ""))
            for a, b in path:
                h = sha(a + h + b)
            out.append((i, leaf, trees[s][0], root, sha("".join(a + b for a, b in path)), h, h == root))
    return Counter(out)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest(spark, folder):
    return Counter(tuple(r[c] for c in COLUMNS) for r in merkle.op11_merkle_manifest(spark, folder).collect())


def test_manifest_of_odd_rows(spark, sf, rows):
    got = manifest(spark, sf)
    assert got == plain_manifest([(i, t, lang, src, len(t) if t else None) for i, t, lang, src in rows])
    assert {k[-1] for k in got} == {True, False}


def test_manifest_in_many_rounds(spark, tmp_path, monkeypatch):
    """Small subtrees and rounds of one level, so that paths are joined several times; one source has most rows; each size ends raggedly."""
    monkeypatch.setattr(merkle, "LOCAL", 1)
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BROADCAST_OFFSETS", 0)
    monkeypatch.setattr(merkle, "BROADCAST_PATHS", 0)
    rows = [(i, f"t\n{i}", "en", "hot" if i % 7 else f"s{i % 49}", 3) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert manifest(spark, str(tmp_path)) == plain_manifest(rows)


@pytest.mark.parametrize("rows", [[], [(1, "a\nb", None, None, 3)], [(1, "x", "en", "s", 1)] * 4])
def test_manifest_of_few_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert manifest(spark, str(tmp_path)) == (plain_manifest(rows) if rows else Counter())


def test_subtrees_are_aligned_and_complete():
    for n in (1, 2, 3, 4, 26, 27, 28, 100):
        for a, b in ((0, n), (n // 3, n), (0, n // 2), (n // 4, n - n // 5)):
            at = a
            for level, first, end in merkle.subtrees(a, b, n, 5):
                assert first == at and first % 3**level == 0 and end == min(first + 3**level, n) and level <= merkle.height(n)
                at = end
            assert at == max(a, b)
    assert len(list(merkle.subtrees(0, 81, 81, 5))) == 1


# decontamination


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_hits(text, items, window):
    w, hit, names = plain_words(text), set(), set()
    for item, t in items:
        own = plain_words(t)
        for at in range(max(1, len(own) - window + 1) if own else 0):
            p = own[at : at + window]
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    names.add("" if item is None else str(item))
    return len(w), sorted(hit), sorted(names)


def test_suffix_array_and_index():
    rng = random.Random(4)
    for n, letters in ((1, 2), (5, 1), (300, 2), (1000, 3), (700, 40)):
        text = np.array([rng.randrange(letters) for _ in range(n)] + [letters], np.int64)
        if n == 1000:
            text[300:600] = text[:300]
        bits = max(1, letters.bit_length())
        assert fm.suffix_array(text, bits).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        index = fm.Index(text, bits, sample=5)
        patterns = np.full((60, 4), -1, np.int64)
        for row in patterns:
            k = rng.randint(1, 4)
            row[4 - k :] = [rng.randrange(letters) for _ in range(k)]
        lo, hi = index.search(patterns)
        for row, a, b in zip(patterns.tolist(), lo, hi, strict=True):
            p = [x for x in row if x >= 0]
            want = [i for i in range(len(text)) if text[i : i + len(p)].tolist() == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def planted(rows, seed=2):
    """Items, and rows that hold passages of them in other case and with other signs between words."""
    rng = random.Random(seed)
    items = [(k, prose(rng, n)) for k, n in enumerate((40, 25, 12, 10, 9, 3, 1))] + [(7, None), (8, " .,; "), (None, "İı ÉÀ ünique Ωmega"), (40, "same words " * 12), (40, prose(rng, 30))]
    docs = [(i, t) for i, t, _, _ in rows]
    for k in range(30):
        own = plain_words(items[rng.choice([0, 1, 2, 3, 4, 5, 9, 10, 11])][1])
        at = rng.randrange(max(1, len(own) - 9))
        passage = " -- ".join(w.upper() if w.isascii() else w for w in own[at : at + rng.choice([9, 10, 14])])
        docs.append((1000 + k, f"{prose(rng, rng.choice([0, 5, 60]))} ({passage}) {prose(rng, 4)}"))
    return items, docs + [docs[-1]] * 40


@pytest.mark.parametrize(("window", "block", "shard"), [(10, 10**6, 1 << 19), (10, 300, 200), (4, 10**6, 1)])
def test_contaminated(spark, rows, window, block, shard):
    items, docs = planted(rows)
    d = spark.createDataFrame([(*r, "x", "y") for r in docs], "doc_id long, text string, row string, items string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    # searched once; each block is another search
    got = fm.contaminated(d, b, window=window, block=block, shard_words=shard).collect()
    known = {t: plain_hits(t, items, window) for _, t in docs}
    have = Counter((r.doc_id, r.n_words, tuple(w for s in r.spans for w in range(s["first"], s["last"])), tuple(r["items"])) for r in got)
    assert have == Counter((i, known[t][0], tuple(known[t][1]), tuple(known[t][2])) for i, t in docs)
    assert sum(n for k, n in have.items() if k[2]) > 20
    text = dict(docs)
    for r in got:
        for s in r.spans:
            assert plain_words(text[r.doc_id][s["start"] : s["end"]]) == plain_words(text[r.doc_id])[s["first"] : s["last"]]


def test_contaminated_spans_are_removed(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven")]
    docs = [(1, "Before. One, two three four five six seven eight nine TEN eleven! after"), (2, "clean text"), (3, None)]
    found = fm.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = found.join(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id").select("doc_id", fm.without(F.col("text"), F.col("spans")).alias("t")).collect()
    assert dict(got) == {1: "Before. ! after", 2: "clean text", 3: None}


def test_contaminated_query_on_empty_tables(spark, empty, sf, tmp_path):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert fm.contaminated(spark.read.parquet(f"{empty}/documents.parquet"), some).count() == 0
    assert fm.contaminated(docs, none).where("size(spans) > 0 or size(items) > 0").count() == 0


# filter audit


def plain_audit(rows, labels):
    """rows (doc_id, text, lang)."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and least[t] < i,
        }
        parts[lang or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, own in parts.items():
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                alone = sum(x[0][f] and sum(x[0].values()) == 1 for x in own)
                out[part, "".join(order), step] = [len(left), len(gone), sum(x[0][f] for x in own) - len(gone), alone, sum(x[1] for x in gone), sum(x[2] for x in gone)]
                total[f] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def capitals(rows):
    rng = random.Random(6)
    more = [(2000 + k, prose(rng, rng.choice([20, 150])).upper() + rng.choice(["", " #", " 100% | x"]), rng.choice(["en", "fr", ""]), "s1") for k in range(25)]
    return rows + more + [(3000 + k, more[k % 5][1], "en", "s2") for k in range(12)]


@pytest.mark.parametrize("hot", [10_000, 1])
def test_audit_of_odd_rows(spark, rows, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    rows = capitals(rows)
    spark.createDataFrame([(i, t, lang, "x", "y") for i, t, lang, _ in rows], "doc_id long, text string, lang string, part string, done string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    ids = sorted({r[0] for r in rows if r[0] is not None})
    labels = [(i, i % 2, int(i % 5 == 0)) for i in ids[::2]] + [(ids[0], 1, None), (ids[2], None, 1), (None, 1, 1), (77777, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = audit.op13_filter_audit(spark, str(tmp_path)).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in got} == plain_audit([(i, t, lang) for i, t, lang, _ in rows], labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_audit_shares_states(spark):
    """31 sets of filters have edges, 80 in all; each is counted once."""
    rows = spark.createDataFrame([("p", *(k >> i & 1 == 1 for i in range(5))) for k in range(32)], "part string, " + ", ".join(f"{f} boolean" for f in audit.FILTERS))
    found = audit.edges(rows, audit.FILTERS).collect()
    assert len(found) == len({(r.done, r.filter) for r in found}) == 80
    for r in found:
        assert r.survivors == 2 ** (5 - bin(r.done).count("1")) and r.removed * 2 == r.survivors


def test_audit_of_an_empty_table(spark, empty):
    assert audit.op13_filter_audit(spark, empty).count() == 0


# shared tables


def test_scratch_leaves_tables_of_other_threads(spark):
    df, inside, made = spark.range(10), threading.Event(), {}
    done = threading.Event()

    def other():
        inside.wait(60)
        with common.scratch(spark):
            made["table"], _ = common.write_shared(df, "other")
            done.set()
            left.wait(60)
            made["count"] = made["table"].count()

    left = threading.Event()
    thread = threading.Thread(target=other)
    thread.start()
    with common.scratch(spark):
        own, path = common.write_shared(df, "own")
        inside.set()
        assert done.wait(60)
    left.set()
    thread.join()
    assert made["count"] == 10
    with pytest.raises(Exception, match="(?i)not.exist"):
        spark.read.parquet(path).count()
