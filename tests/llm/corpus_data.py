"""Rows for the tests of this folder."""

import random

#: Columns that operators use within.
CLASHING = ("words", "size", "h", "k", "n_words", "row", "spans", "_w", "_t", "end", "epochs", "removed", "_left", "key", "target", "kept", "digest", "found", "own", "c0", "stratum", "fp")
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def prose(rng, n, alphabet="abcdefgh"):
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(60)]
    out = []
    for _ in range(n):
        out.append(rng.choice(words))
        if rng.random() < 0.08:
            out.append("\n")
    return " ".join(out).replace(" \n ", "\n")


def make_rows(seed=1):
    """(doc_id, text, lang, source): nulls, empty and long texts, ties, copies, near copies, repeated rows, odd characters."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([3, 30, 120, 300])) for _ in range(40)]
    base = prose(rng, 200)
    texts += [base] * 4 + [base[:50] + "x" + base[50:], base.replace("a", "e", 1), base + " end"]
    lines = [prose(rng, 12).replace("\n", " ") for _ in range(12)]
    for _ in range(12):
        own = rng.sample(lines, 4)
        line = own[0]
        at = rng.randrange(len(line))
        own[0] = line[:at] + rng.choice(["", "z", "zz"]) + line[at + rng.choice([0, 1]) :]
        texts.append("\n".join(own))
    texts += [None, "", "   \n\t ", "one", "éè \U0001f600\U0001f600 café İI", "a" * 9000, "w " * 6000, "#*$%&|<> " * 30]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", None])) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "no id at all " * 8, "en", "s2"), (10_000_000_000, texts[0], "en", "é")]
    rng.shuffle(rows)
    return rows


def write(spark, rows, folder, parts=3):
    df = spark.createDataFrame([(i, t, lang, src, len(t) if t else None, *["clash"] * len(CLASHING)) for i, t, lang, src in rows], FIELDS)
    df.repartition(parts).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1 if t and "#" not in t else 0, 0) for i, t, _, _ in rows if i is not None and i % 2 == 0] + [(None, 1, 0), (5, None, None), (999, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)
