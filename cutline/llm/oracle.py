"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import op8_quality as quality

_WORD = r"[^\x20\x09-\x0D]+"
_SCORES = " ".join(f"WHEN '{r}' THEN {e.replace(' / ', '::DOUBLE / nullif(') + ', 0)' if ' / ' in e else e}" for r, (e, _) in quality.RULES.items())
_TESTS = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, (_, cs) in quality.RULES.items() for i, c in enumerate(cs))
_RISK = quality.RISK / len(quality.RULES)

QUALITY = f"""
WITH d AS (SELECT doc_id, lang, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
    [l for l in string_split(coalesce(text, ''), chr(10)) if regexp_matches(l, '{_WORD}')] AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(8)) AS k FROM twice) GROUP BY 1),
f AS (SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
good AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
held AS (SELECT f.*, good FROM f JOIN good USING (doc_id)),
named AS (SELECT lang AS own FROM held WHERE lang IS NOT NULL GROUP BY 1),
tests(rule, step, cutoff) AS (VALUES {_TESTS}),
rules AS (SELECT DISTINCT rule FROM tests),
tried AS (SELECT own, rule, step, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND s > cutoff) AS k, count(*) FILTER (NOT good AND s > cutoff) AS bad
    FROM (SELECT h.*, own, rule, step, cutoff, CASE WHEN n_words > 0 THEN CASE rule {_SCORES} END END AS s FROM held h LEFT JOIN named ON lang = own CROSS JOIN tests) GROUP BY 1, 2, 3, 4),
passed AS (SELECT *, CASE WHEN k > n * {_RISK} THEN 1 ELSE list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RISK}) + (n - i) * ln(1 - {_RISK})) for i in range(k + 1)]) END
    <= {quality.DELTA / len(quality.RULES)} / (SELECT count(DISTINCT coalesce(own, chr(1))) FROM tried) AS ok FROM tried),
certified AS (SELECT *, bool_and(ok) OVER (PARTITION BY own, rule ORDER BY step) AS sure FROM passed),
cuts AS (SELECT own, rule, arg_max(cutoff, bad * 1000 - step) AS cutoff FROM certified WHERE sure AND bad > 0 GROUP BY 1, 2),
fails AS (SELECT DISTINCT f.doc_id FROM (SELECT f.*, own FROM f LEFT JOIN named ON lang = own) f CROSS JOIN rules r JOIN cuts c ON c.rule = r.rule AND c.own IS NOT DISTINCT FROM f.own
    WHERE n_words > 0 AND CASE r.rule {_SCORES} END > c.cutoff),
base AS (SELECT *, n_words < {quality.BASE_WORDS} OR 100 * n_repeat_words > {quality.BASE_REPEAT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM fails) AS kept FROM base
"""


# the least bit of CRC-32 (polynomial 0xEDB88320) of the id's decimal digits
_CRC = "list_reduce([4294967295::BIGINT] || [ascii(c)::BIGINT for c in string_split(doc_id::VARCHAR, '') if c <> ''], lambda a, x: list_reduce([xor(a, x)] || range(8), lambda r, k: xor(r >> 1, 3988292384 * (r & 1))))"
_LEAF = "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}))::VARCHAR || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}")) + ")"

MERKLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '') AS grp, {_LEAF.format(text="text")} AS leaf, CASE WHEN {_CRC} & 1 = 1 THEN {_LEAF.format(text="replace(text, chr(10), '')")} END AS tampered FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
lv AS (SELECT grp, 0 AS level, idx, leaf AS h FROM leaves
  UNION ALL SELECT grp, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS m FROM lv) WHERE m > 1 GROUP BY grp, level, idx // 3),
tops AS (SELECT grp, max(level) AS top, arg_max(h, level) AS subroot FROM lv GROUP BY grp),
groups AS (SELECT grp, top, subroot, row_number() OVER (ORDER BY grp) - 1 AS idx FROM tops),
up AS (SELECT 0 AS level, idx, subroot AS h FROM groups UNION ALL SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS m FROM up) WHERE m > 1 GROUP BY level, idx // 3),
root AS (SELECT max(level) AS top, arg_max(h, level) AS root FROM up),
own AS (SELECT l.doc_id, l.leaf, l.idx, l.grp, coalesce(l.tampered, l.leaf) AS start, unnest(range(g.top)) AS level, g.top, g.idx AS g FROM leaves l JOIN groups g USING (grp)),
steps AS (
  SELECT o.grp, o.idx, o.level, string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx < o.idx // (3 ** o.level)::BIGINT) AS l, string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx > o.idx // (3 ** o.level)::BIGINT) AS r
    FROM (SELECT * REPLACE (level::BIGINT AS level) FROM own) o JOIN lv s ON s.grp = o.grp AND s.level = o.level AND s.idx // 3 = (o.idx // (3 ** o.level)::BIGINT) // 3 GROUP BY ALL
  UNION ALL
  SELECT o.grp, o.idx, o.top + o.level, string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx < o.g // (3 ** o.level)::BIGINT), string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx > o.g // (3 ** o.level)::BIGINT)
    FROM (SELECT l.grp, l.idx, g.idx AS g, g.top, unnest(range(root.top))::BIGINT AS level FROM leaves l JOIN groups g USING (grp) CROSS JOIN root) o JOIN up s ON s.level = o.level AND s.idx // 3 = (o.g // (3 ** o.level)::BIGINT) // 3 GROUP BY o.grp, o.idx, o.top, o.level, o.g),
fold AS (SELECT grp, idx, 0 AS level, coalesce(tampered, leaf) AS h FROM leaves
  UNION ALL SELECT f.grp, f.idx, f.level + 1, sha256(coalesce(s.l, '') || f.h || coalesce(s.r, '')) FROM fold f JOIN steps s ON s.grp = f.grp AND s.idx = f.idx AND s.level = f.level),
folded AS (SELECT grp, idx, arg_max(h, level) AS h FROM fold GROUP BY ALL),
proofs AS (SELECT grp, idx, string_agg(coalesce(l, '') || coalesce(r, ''), '' ORDER BY level) AS p FROM steps GROUP BY ALL)
SELECT l.doc_id, l.leaf, g.subroot, root, sha256(coalesce(p, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaves l JOIN groups g USING (grp) JOIN folded f ON f.grp = l.grp AND f.idx = l.idx LEFT JOIN proofs q ON q.grp = l.grp AND q.idx = l.idx CROSS JOIN root
"""

_LATIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({_LOWER.format("text")}, ''), '{_LATIN}') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(coalesce({_LOWER.format("text")}, ''), '{_LATIN}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
found AS (SELECT r, i, n, item FROM grams JOIN win USING (n, s)),
hit AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, unnest(range(n)) AS k FROM found) GROUP BY 1),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

AUDIT = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
first AS (SELECT t, min(doc_id) AS least FROM t GROUP BY 1),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * len(regexp_extract_all(t.t, '[A-Z]')) > 10 * length(t.t) AS c,
    regexp_matches(t.t, '[#$%&*|]') AS d, coalesce(t.doc_id > least, false) AS e FROM t JOIN first USING (t) LEFT JOIN marks ON marks.doc_id = t.doc_id),
kinds AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(range(5)) AS i), parts AS (SELECT DISTINCT part FROM f),
o AS (SELECT [p.i, q.i, r.i, s.i, t.i] AS o FROM l p, l q, l r, l s, l t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
steps AS (SELECT array_to_string([chr((65 + x)::INT) for x in o], '') AS filter_order, k AS step, o[k] AS i, coalesce(list_sum([(1::BIGINT << x) for x in o[1:k - 1]]), 0)::BIGINT AS before FROM (SELECT o, unnest(range(1, 6)) AS k FROM o)),
counts AS (SELECT part, filter_order, step, i,
    coalesce(sum(n) FILTER (fails & (before | (1 << i)) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails & before = 0 AND fails & (1 << i) > 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails & before > 0 AND fails & (1 << i) > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = 1 << i), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (fails & before = 0 AND fails & (1 << i) > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & (1 << i) > 0), 0)::BIGINT AS toxic_lost
    FROM kinds CROSS JOIN steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley FROM counts
"""

ORACLE_SQL = {"op8_risk_controlled_quality": QUALITY, "op11_merkle_manifest": MERKLE, "op12_benchmark_decontamination": CONTAMINATION, "op13_filter_audit": AUDIT}
