"""DuckDB SQL of the queries that SQL can state. Op5, op7 and op10 have none: links in html that are resolved against their page,
hashes of Spark's own and trained weights are out of its reach or its bearable cost."""

from __future__ import annotations

import math

import numpy as np

from . import licenses, quality, secrets

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PRINTED, _LETTERS = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(table: str, key: str, lower: bool, pattern: str) -> str:
    """(key, p, w, n): the words of each text by place from 0, and how many it has."""
    text = _LOWER.format("text") if lower else "text"
    listed = f"SELECT {key}, regexp_extract_all(coalesce({text}, ''), '{pattern}') AS ws FROM {table}"
    return f"SELECT {key}, unnest(range(len(ws))) AS p, unnest(ws) AS w, len(ws) AS n FROM ({listed})"


def _following(key: str, k: int) -> tuple[str, str]:
    """The k words from each on, joined by a space, which none holds, and the window that this takes."""
    return " || ' ' || ".join(["w", *(f"lead(w, {i}) OVER o" for i in range(1, k))]), f"WINDOW o AS (PARTITION BY {key} ORDER BY p)"


_window, _over = _following("doc_id", 20)
OP1 = f"""
WITH words AS ({_words("documents", "doc_id", False, _PRINTED)}),
windows AS (SELECT doc_id, p, w, {_window} AS g FROM words {_over}),
again AS (SELECT doc_id, p, w, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1 AS later FROM windows),
marked AS (SELECT doc_id, p, w, max(later::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM again),
totals AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(w, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN totals t ON d.doc_id = t.doc_id
"""

_window, _over = _following("doc_id", 5)
OP3 = f"""
WITH RECURSIVE words AS ({_words("documents", "doc_id", True, _PRINTED)}),
shingles AS (
  SELECT DISTINCT doc_id, g FROM (SELECT doc_id, {_window} AS g FROM words {_over}) WHERE g IS NOT NULL
  UNION ALL SELECT doc_id, string_agg(w, ' ' ORDER BY p) FROM words WHERE n < 5 GROUP BY doc_id
),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS sig FROM shingles GROUP BY doc_id),
firsts AS (SELECT sig, min(doc_id) AS class_id, any_value(n) AS n FROM sets GROUP BY sig),
links AS (
  SELECT a.class_id AS a, b.class_id AS b
  FROM (SELECT x.doc_id AS i, y.doc_id AS j, count(*) AS o FROM shingles x JOIN shingles y USING (g)
        WHERE x.doc_id <> y.doc_id AND x.doc_id IN (SELECT class_id FROM firsts) AND y.doc_id IN (SELECT class_id FROM firsts) GROUP BY ALL) m
  JOIN firsts a ON a.class_id = i JOIN firsts b ON b.class_id = j WHERE 100 * o >= 75 * (a.n + b.n - o)
),
reach AS (SELECT class_id AS a, class_id AS b FROM firsts UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(least.component_id, d.doc_id) AS component_id, coalesce(f.class_id, d.doc_id) AS class_id
FROM documents d LEFT JOIN sets s ON s.doc_id = d.doc_id LEFT JOIN firsts f ON f.sig = s.sig LEFT JOIN least ON least.a = f.class_id
"""

_BITS = "(" + " + ".join(f"(substr(bits, 5 * i + {k + 1}, 1) = '1')::INT * {16 >> k}" for k in range(5)) + " + 1)"
OP6 = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
digests AS (SELECT *, unhex(sha1(payload))::BIT::VARCHAR AS bits, min(page_id) OVER (PARTITION BY payload) AS first_id FROM payloads)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {_BITS}, 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(first_id, page_id) AS refers_to, TRUE AS verified
FROM digests
"""

_next = ", ".join(["w", *(f"lead(w, {i}) OVER o" for i in range(1, 13))])
OP8 = f"""
WITH words AS ({_words("documents", "doc_id", True, _LETTERS)}),
terms AS ({_words("benchmark", "item_id", True, _LETTERS)}),
wanted AS (
  SELECT DISTINCT item_id, l, g FROM (
    SELECT item_id, p, n, least(n, 13) AS l, array_to_string(list_slice([{_next}], 1, least(n, 13)), ' ') AS g FROM terms WINDOW o AS (PARTITION BY item_id ORDER BY p)
  ) WHERE p + l <= n
),
lengths AS (SELECT DISTINCT l FROM wanted),
ahead AS (SELECT doc_id, p, n, [{_next}] AS ws FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
found AS (
  SELECT doc_id, p, c.l, item_id FROM (SELECT doc_id, p, l, array_to_string(list_slice(ws, 1, l), ' ') AS g FROM ahead, lengths WHERE p + l <= n) c
  JOIN wanted USING (l, g)
),
hits AS (SELECT doc_id, count(DISTINCT q) AS h FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM (SELECT DISTINCT doc_id, p, l FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS k, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id),
totals AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
parts AS (SELECT g, unnest(range(l)) AS offs, unnest(string_split(g, ' ')) AS w FROM (SELECT DISTINCT l, g FROM wanted)),
counts AS (SELECT w, count(*) AS c FROM words WHERE w IN (SELECT w FROM parts) GROUP BY w),
rare AS (SELECT g, w, offs, coalesce(c, 0) AS c, row_number() OVER (PARTITION BY g ORDER BY coalesce(c, 0), offs, w) AS o FROM parts LEFT JOIN counts USING (w)),
pairs AS (SELECT a.g, a.w AS w1, a.offs AS o1, b.w AS w2, b.offs AS o2 FROM rare a JOIN rare b ON a.g = b.g AND a.o = 1 AND b.o = 2 WHERE a.c > 0),
near AS (
  SELECT x.doc_id, count(*) AS near FROM pairs JOIN words x ON x.w = w1 JOIN words y ON y.w = w2 AND y.doc_id = x.doc_id AND y.p - o2 - (x.p - o1) IN (-2, -1, 1, 2) GROUP BY x.doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(h, 0)::BIGINT AS n_hit, coalesce(k, 0)::BIGINT AS n_items, coalesce(near, 0)::BIGINT AS n_near,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(h, 0) > 0 AND 20 * coalesce(h, 0) >= coalesce(n, 0) AS contaminated
FROM documents d LEFT JOIN totals t ON t.doc_id = d.doc_id LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id LEFT JOIN near ON near.doc_id = d.doc_id
"""

_TERMS = [(label, sorted(set(t.split())), math.floor(len(t.split()) / 0.9 + 1e-9)) for label, t in licenses.TEMPLATES.items()]
_PHRASE = " ".join(f"WHEN {_following('doc_id', len(p.split()))[0]} = '{p}' THEN '{label}'" for p, label in licenses.PHRASES.items())
OP2 = f"""
WITH words AS ({_words("documents", "doc_id", True, _LETTERS)}),
places AS (SELECT * FROM (SELECT doc_id, p, CASE {_PHRASE} END AS label FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)) WHERE label IS NOT NULL),
base AS (SELECT doc_id, count(*) AS k, min(p) AS a, max(p) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM places GROUP BY doc_id),
templates (label, term, size, need, width) AS (VALUES {", ".join(f"('{k}', '{w}', {len(ws)}, {max(1, math.ceil(0.9 * len(ws) - 1e-9))}, {width})" for k, ws, width in _TERMS for w in ws)}),
hits AS (SELECT doc_id, p, label, term, size, need, width FROM words JOIN templates ON w = term),
met AS (SELECT a.doc_id, a.label, count(DISTINCT b.term) / any_value(a.size) AS share FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.label = b.label AND b.p BETWEEN a.p AND a.p + a.width - 1
        GROUP BY a.doc_id, a.label, a.p HAVING count(DISTINCT b.term) >= any_value(a.need)),
every AS (SELECT doc_id, label, 1.0::DOUBLE AS share FROM places UNION ALL SELECT doc_id, label, share FROM met),
found AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS ls, max(share) AS score FROM every GROUP BY doc_id),
totals AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(k, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
  coalesce(base.ls, '') AS base_labels, coalesce(found.ls, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM documents d LEFT JOIN totals t ON t.doc_id = d.doc_id LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id
"""


def _spans(kind: str, ord_: int, pattern: str, group: int, least: int) -> str:
    """(doc_id, ord, kind, s, e): spans from the lengths of the matches and of what lies between them."""
    p = pattern.replace("'", "''")
    total = lambda a: f"coalesce(list_sum([length(x) for x in {a}]), 0)"
    return f"""SELECT doc_id, {ord_} AS ord, '{kind}' AS kind, s::BIGINT AS s, (s + length(ms[i]))::BIGINT AS e FROM (
    SELECT *, {total("gaps[1:i]")} + {total("ms[1:i - 1]")} AS s FROM (
      SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {group}) AS cs, string_split_regex(t, '{p}') AS gaps FROM texts WHERE regexp_matches(t, '{p}')
      )
    )
  ) WHERE length(cs[i]) >= {least}"""


def _shown(where: str) -> str:
    return f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER ({where}), '')"


OP9 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_spans(k, i, *rule) for i, (k, rule) in enumerate(secrets.RULES.items()))}),
found AS (SELECT doc_id, {", ".join(f"count(*) FILTER (ord = {i}) AS n_{k}" for i, k in enumerate(secrets.BASE))}, {_shown(f"ord < {len(secrets.BASE)}")} AS base, {_shown("TRUE")} AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id
"""


def _below(by: tuple[str, ...], above: str) -> str:
    """Counts of `by`, joined by PRIOR documents' worth of what is above; whole numbers."""
    own, up = ", ".join(by), " AND ".join(["s.metric = a.metric", *(f"s.{c} IS NOT DISTINCT FROM a.{c}" for c in by[:-1])])
    same = " AND ".join(f"s.{c} IS NOT DISTINCT FROM o.{c}" for c in by)
    listed = ", ".join(f"s.{c}" for c in by)
    return f"""SELECT {listed}, s.metric, a.bucket, coalesce(o.n, 0) * a.total + {quality.PRIOR} * a.w AS w, (s.size + {quality.PRIOR}) * a.total AS total
  FROM (SELECT {own}, metric, sum(n)::HUGEINT AS size FROM sketch GROUP BY ALL) s JOIN {above} a ON {up}
  LEFT JOIN (SELECT {own}, metric, bucket, sum(n)::HUGEINT AS n FROM sketch GROUP BY ALL) o ON {same} AND o.metric = s.metric AND o.bucket = a.bucket"""


_SPREAD = " ".join(f"WHEN '{m}' THEN q75 + {s} * (q75 - q25) + {x}" for m, (_, s, x) in quality.RULES.items())
_window, _over = _following("doc_id", 5)
_METRICS = {m: f"coalesce({a.partition(' / ')[0]}::DOUBLE / nullif({a.partition(' / ')[2]}, 0), 0)" for m, (a, _, _) in quality.RULES.items()}
OP4 = f"""
WITH words AS ({_words("documents", "doc_id", False, _PRINTED)}),
windows AS (SELECT doc_id, p, w, {_window} AS g FROM words {_over}),
again AS (SELECT doc_id, p, w, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS twice FROM windows),
marked AS (SELECT doc_id, w, max(twice::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM again),
totals AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS c, sum(hit) AS r FROM marked GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dups FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
          WHERE regexp_matches(line, '{_PRINTED}') GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, lang, source, coalesce(n, 0)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS n_upper
  FROM documents d LEFT JOIN totals t ON t.doc_id = d.doc_id LEFT JOIN lines l ON l.doc_id = d.doc_id
),
metrics AS (SELECT *, {", ".join(f"{x} AS {m}" for m, x in _METRICS.items())} FROM counts),
buckets AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, CASE WHEN {m} <= 1e-9 THEN -1000 ELSE ceil(ln({m}) / {float(np.log(quality.GAMMA))!r}::DOUBLE)::INT END AS bucket FROM metrics WHERE n_words > 0" for m in quality.RULES)}),
sketch AS (SELECT lang, source, metric, bucket, count(*)::HUGEINT AS n FROM buckets GROUP BY ALL),
every AS (SELECT metric, bucket, sum(n)::HUGEINT AS w, (sum(sum(n)) OVER (PARTITION BY metric))::HUGEINT AS total FROM sketch GROUP BY metric, bucket),
langs AS ({_below(("lang",), "every")}),
own AS ({_below(("lang", "source"), "langs")}),
seen AS (SELECT *, CASE WHEN bucket = -1000 THEN 0 ELSE 2 * pow({quality.GAMMA!r}::DOUBLE, bucket) / ({quality.GAMMA!r}::DOUBLE + 1) END AS middle, sum(w) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS seen FROM own),
quartiles AS (SELECT lang, source, metric, min(middle) FILTER (4 * seen >= total) AS q25, min(middle) FILTER (4 * seen >= 3 * total) AS q75 FROM seen GROUP BY ALL),
fences AS (SELECT lang, source, {", ".join(f"max(CASE WHEN metric = '{m}' THEN fence END) AS f_{m}" for m in quality.RULES)} FROM (SELECT *, CASE metric {_SPREAD} END AS fence FROM quartiles) GROUP BY lang, source),
judged AS (
  SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, concat_ws(',', {", ".join(f"CASE WHEN m.{m} > f.f_{m} THEN '{m}' END" for m in quality.RULES)}) AS failed
  FROM metrics m LEFT JOIN fences f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM judged
"""

#: Reflected CRC-32, a nibble at a time: what each of the 16 nibbles adds.
def _nibble(x: int) -> int:
    for _ in range(4):
        x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
    return x


_TABLE = "[" + ", ".join(str(_nibble(i)) for i in range(16)) + "]::BIGINT[]"
#: Hex digits of the bytes, the low one of each first.
_DIGITS = "[strpos('0123456789ABCDEF', d) - 1 for d in string_split(regexp_replace(hex(encode(k)), '(.)(.)', '\\2\\1', 'g'), '')]"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_DIGITS}), lambda c, d: xor(({_TABLE})[((xor(c, d) & 15) + 1)], c >> 4)), 4294967295::BIGINT)"
OP11 = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
),
counted AS (SELECT id || ':' || run AS k, run, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, c, {_CRC} AS h FROM counted),
typed AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
places AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words),
gaps AS MATERIALIZED (SELECT word, n, p, left(word, p - 1) || substring(word, p + 1) AS gap FROM places),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.p = b.p AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.gap = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.gap = w.word
),
best AS (SELECT word, other, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM near),
formed AS MATERIALIZED (
  SELECT w.word, CASE WHEN b.n >= 2 * w.n THEN other END AS form, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b.n >= 2 * w.n THEN b.n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND r = 1
),
paths AS (SELECT word, word AS root FROM formed UNION ALL SELECT p.word, f.form FROM paths p JOIN formed f ON f.word = p.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n
FROM formed f JOIN paths p ON p.word = f.word JOIN formed e ON e.word = p.root AND e.form IS NULL
"""

_VECTORS = """SELECT vec_id AS id, label, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"""
OP12 = f"""
WITH vectors AS MATERIALIZED (
  SELECT id, CASE WHEN id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM ({_VECTORS}) WHERE label IS NOT NULL
),
scores AS MATERIALIZED (
  SELECT a.id AS anchor, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM vectors a JOIN vectors b ON b.id <> a.id WHERE a.id % 50 = 0
),
positives AS (SELECT anchor, id, s FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY s DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.s DESC, n.id))::INT AS rank, n.id AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s
QUALIFY rank <= 3
"""
OP13 = f"""
WITH vectors AS MATERIALIZED ({_VECTORS}),
scores AS (SELECT q.id AS query_id, c.id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM vectors q JOIN vectors c ON c.id <> q.id WHERE q.id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scores QUALIFY rank <= 5
"""
