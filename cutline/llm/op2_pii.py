"""Personal data: patterns, and information-theoretic sanitisation of what surrounds them.

Protected entities are the values that the patterns find (an address, a number). A term discloses an entity as far as
seeing it tells that the entity is near: with document frequencies over the whole corpus,

    disclosure(c, t) = PMI(c; t) / IC(c) = ln(N p(c|t) / n(c)) / ln(N / n(c))

where p(c|t) is n(c,t) / n(t), and n(c,t) counts documents in which t stands within WINDOW words of c. It is 1 for a
term that only ever comes with the entity. For pairs that aren't seen in different contexts of different documents,
p(c|t) is the lower bound of that share (Wilson's, with Z), at most 1 / (1 + Z ** 2 / n(t)). Terms of at least GENERALISE are
replaced by their class, wherever they stand in a document that holds the entity. They are taken out if their disclosure is
at least REMOVE of the most that as many sightings can show: of 1, or where the bound counts, of the disclosure of a term
that is seen as often and only with the entity. So what the bound costs a rare pair decides whether it is sanitised at all,
and not how; a term that stands once, beside an entity of that document alone, goes from SMALLEST documents on, whatever
other documents there are. Every pair counts, also those seen once or in copies of one passage. Documents without
an entity are left alone.

Plan: one scan finds spans, the terms near them, and where each term of a document with an entity stands, and is written
as a table without texts; one scan counts the documents of each term, summed within tasks before the shuffle; pairs are
summed and meet the counts of their term and of their entity by look_up(), so that a frequent term, or an address that a
third of the documents holds, isn't one task. Places are first held against the terms that disclose any entity (Spark may
split a frequent one), and then joined with their document's entities and the pairs. Only N is collected.

Null texts count as empty. Repeated rows are documents of their own. Of equal disclosures the action is the same; a term
that one entity generalises and another removes is removed. Spans are code points of the whole text, however long. Columns
of `keep` must not be called base, entities, near, terms or row; other columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import look_up, map_rows, table, text_or_empty, write_shared

KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
WINDOW = 10
GENERALISE, REMOVE = 0.6, 0.85
#: Two-sided 99 % of the normal distribution.
Z = 2.5758
#: Documents (for each that holds the entity) from which on a pair that is seen once is sanitised: ln(1 + Z ** 2) / ln N is 1 - GENERALISE there.
SMALLEST = 162
#: Terms held in a task before their counts are passed on.
HELD = 300_000

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]+(?:['-][^\W_]+)*")


def emails(text: str) -> list[tuple[int, int, str]]:
    """Each match has one @, so they are found from it: the local part is the run before it that no earlier match took."""
    found, taken, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken:  # in steps, so that a long run is read once
            low = max(taken, start - 64)
            cut = [m.end() for m in NOT_LOCAL.finditer(text, low, start)]
            if cut:
                start = low = cut[-1]
                break
            start = low
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), "email"))
            taken = m.end()
        else:
            taken = max(taken, at + 1)
        at = text.find("@", max(taken, at + 1))
    return found


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = emails(text) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def entity(text: str, span: tuple[int, int, str]) -> str:
    value = text[span[0] : span[1]].lower()
    return f"{span[2]}:{value if span[2] in ('email', 'ip') else re.sub('[^0-9]', '', value)}"


def free_terms(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of the terms outside of all spans, which are sorted."""
    found, k, taken = [], 0, 0
    for m in TERM.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            taken = max(taken, spans[k][1])
            k += 1
        if taken <= m.start():
            found.append((m.start(), m.end(), m[0].lower()))
    return found


def near_terms(text: str, spans: list[tuple[int, int, str]], free: list[tuple[int, int, str]], window: int = WINDOW) -> list[tuple[str, str, int]]:
    """Distinct (entity, term, context): the free terms within `window` words of an entity; the context is a hash of the terms in the window."""
    import zlib
    from bisect import bisect_left

    starts, out = [a for a, _, _ in free], set()
    for span in spans:
        i = bisect_left(starts, span[0])
        around = [w for _, _, w in free[max(0, i - window) : i + window]]
        context = zlib.crc32(" ".join(around).encode("utf-8", "surrogatepass"))
        out.update((entity(text, span), w, context) for w in around)
    return sorted(out)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, keep (strings), base (array of spans), entities, near (entity, term, context), terms (each with all its places); the last three are empty in documents without an entity."""

    def make():
        def each(ids, *cols):
            bases, entities, nears, terms = [], [], [], []
            for t in cols[-1]:
                spans = base_spans(t)
                free = free_terms(t, spans) if spans else []
                places: dict[str, list] = {}
                for a, b, w in free:
                    places.setdefault(w, []).append({"start": a, "end": b})
                bases.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
                entities.append(sorted({entity(t, span) for span in spans}))
                nears.append([{"entity": c, "term": w, "context": x} for c, w, x in near_terms(t, spans, free)])
                terms.append([{"term": w, "places": x} for w, x in places.items()])
            return ids, *cols[:-1], bases, entities, nears, terms

        return each

    return map_rows(
        docs.select(F.col(id_col).cast("long"), *keep, text_or_empty(text_col)),
        make,
        "doc_id long, " + "".join(f"`{c}` string, " for c in keep) + "base array<struct<kind string, start int, end int>>, entities array<string>, near array<struct<entity string, term string, context long>>, terms array<struct<term string, places array<struct<start int, end int>>>>",
        rows=512,
    )


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term, docs: in how many documents each term stands."""

    def task(batches):
        import pyarrow as pa

        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])
            held.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                held.update({w.lower() for w in set(TERM.findall(t.as_py()))})
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    return docs.select(text_or_empty(text_col)).mapInArrow(task, "term string, n long").groupBy("term").agg(F.sum("n").alias("docs"))


def disclosure(found: DataFrame, terms: DataFrame, n_docs: int, generalise: float = GENERALISE, remove: float = REMOVE, z: float = Z) -> DataFrame:
    """entity, term, action for the pairs beyond the thresholds. found: rows (row, entity, term, context)."""
    by_row = found.groupBy("entity", "term", "row").agg(F.min("context").alias("lo"), F.max("context").alias("hi"))
    pairs = by_row.groupBy("entity", "term").agg(F.count("*").alias("together"), (F.min("lo") != F.max("hi")).alias("varied"))
    entities = found.select("entity", "row").distinct().groupBy("entity").agg(F.count("*").alias("of_entity"))
    n = F.lit(float(max(n_docs, 1)))
    seen, share = F.col("docs").cast("double"), F.col("together") / F.col("docs")
    low = (share + z * z / (2 * seen) - z * F.sqrt(share * (1 - share) / seen + z * z / (4 * seen * seen))) / (1 + z * z / seen)
    known = F.when(F.col("varied") & (F.col("together") > 1), share).otherwise(low)
    told = lambda p: F.coalesce(F.try_divide(F.log(n * p / F.col("of_entity")), F.log(n / F.col("of_entity"))), F.lit(0.0))
    most = told(F.when(F.col("varied") & (F.col("together") > 1), 1.0).otherwise(1 / (1 + z * z / seen)))
    pairs, _ = write_shared(pairs, "pii-pairs")
    by_entity, _ = write_shared(pairs.groupBy(F.col("entity").alias("k")).agg(F.count("*").alias("n")).join(entities.withColumnRenamed("entity", "k"), "k"), "pii-entities")
    by_term, _ = write_shared(pairs.groupBy(F.col("term").alias("k")).agg(F.count("*").alias("n")).join(terms.withColumnRenamed("term", "k"), "k"), "pii-terms")
    counted = look_up(pairs, "entity", by_entity, ["term"]).withColumn("of_entity", F.col("found")["of_entity"]).drop("found")
    counted = look_up(counted, "term", by_term, ["entity"]).withColumn("docs", F.col("found")["docs"]).drop("found")
    return (
        counted.withColumn("disclosure", told(known))
        .where(F.col("disclosure") >= generalise)
        .select("entity", "term", F.when(F.col("disclosure") >= remove * most, "remove").otherwise("generalise").alias("action"))
    )


def sanitisation_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep, base, spans: all spans of every row, those of disclosing terms included."""
    found, _ = write_shared(find_spans(docs, id_col, text_col, keep).withColumn("row", F.monotonically_increasing_id()), "pii")
    near = found.select("row", F.inline("near"))
    policy, _ = write_shared(disclosure(near, term_counts(docs, text_col), found.count()), "pii-policy")
    # a term discloses few entities, while a row may have many terms and many entities: never all pairs of a row's
    places = found.where(F.size("terms") > 0).select("row", F.inline("terms")).join(policy.select("term").distinct(), "term", "left_semi")
    goes = (
        places.select("row", "term")
        .join(policy, "term")
        .join(found.select("row", F.explode("entities").alias("entity")), ["row", "entity"], "left_semi")
        .groupBy("row", "term")
        .agg(F.max("action").alias("kind"))
    )
    added = (
        places.join(goes, ["row", "term"])
        .groupBy("row")
        .agg(F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(F.col("kind").alias("kind"), p["start"].alias("start"), p["end"].alias("end"))))).alias("added"))
    )
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    ordered = lambda xs: F.transform(
        F.sort_array(F.transform(xs, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return found.select("row", "doc_id", *keep, "base").join(added, "row", "left").select("doc_id", *keep, ordered("base").alias("base"), ordered(F.concat("base", F.coalesce("added", none))).alias("spans"))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced: patterns and generalised terms by their class, removed ones by nothing."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a < at:
            continue
        term = text[a:b]
        name = kind.upper() if kind in KINDS[:4] else "NUMBER" if any(c.isdigit() for c in term) else "NAME" if term[0].isupper() else "TERM"
        out += [text[at:a], "" if kind == "remove" else f"[{name}]"]
        at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: the texts that change, sanitised, a row for each such row of docs. Texts are joined with their spans by id and digest: rows with equal ids and texts have equal spans."""
    key = [F.col(id_col).cast("long").alias("doc_id"), F.sha2(text_or_empty(text_col), 256).alias("digest")]
    spans = sanitisation_spans(docs.select(*key, text_or_empty(text_col).alias("text")), keep=("digest",)).where(F.size("spans") > 0)
    once = spans.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.first("spans").alias("spans"))
    rows = docs.select(*key, F.col(text_col).alias("text")).join(once, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))

    def make():
        return lambda ids, texts, spans: (ids, [redact(t, [(s["start"], s["end"], s["kind"]) for s in x]) for t, x in zip(texts, spans, strict=True)])

    return map_rows(rows.select("doc_id", "text", "spans"), make, "doc_id long, text string")


def op2_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans of every document, and all its spans."""
    found = sanitisation_spans(table(spark, sf_dir, "documents"))
    n = lambda kind, xs="base": F.size(F.filter(xs, lambda s: s["kind"] == kind)).cast("long")
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[n(k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(text("base"), 256).alias("base_sha256"),
        text("spans").alias("spans"),
        *[n(k, "spans").alias(f"n_{k}d") for k in KINDS[4:]],
    )
