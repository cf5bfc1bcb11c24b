"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import licenses, mixing, pii
from .warc import REVISIT_BYTES

OP2 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

_ESC = "replace(replace(replace(replace({0}, '\\', '\\0'), '[', '\\1'), '<', '\\2'), ']', '\\3')"
OP3 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT *, CASE role WHEN 'user' THEN '[INST] ' || text || ' [/INST]' WHEN 'assistant' THEN '<s>' || text || '</s>'
    ELSE '[SYS:' || role || '] ' || text || ' [/SYS]' END AS plain,
  CASE role WHEN 'user' THEN '[INST] ' || {_ESC.format("text")} || ' [/INST]' WHEN 'assistant' THEN '<s>' || {_ESC.format("text")} || '</s>'
    ELSE '[SYS:' || {_ESC.format("role")} || '] ' || {_ESC.format("text")} || ' [/SYS]' END AS escaped FROM c),
k AS (SELECT *, list_min(list_filter([strpos(plain, ' [/INST]') + 8, strpos(plain, '</s>') + 4, strpos(plain, ' [/SYS]') + 7], lambda x, i: x > [8, 4, 7][i])) = length(plain) + 1
    AND NOT regexp_matches(text || chr(10) || role, '\\\\[0-3]') AND (role IN ('user', 'assistant') OR strpos(role, '] ') = 0) AS safe FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(CASE WHEN safe THEN plain ELSE escaped END)) AS BIGINT) AS formatted_chars
FROM k GROUP BY conv_id
"""

OP6 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || ':7'), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)
      / CASE WHEN length(text) > 0 THEN 0.25 + 0.75 * length(regexp_replace(text, '[\\x21-\\x40\\x5B-\\x60\\x7B-\\x7E]+', '', 'g')) / length(text) ELSE 0.25 END AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n, CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS DOUBLE) AS w FROM d GROUP BY source),
fill AS (
  SELECT source, n, w, false AS full_, 0 AS round FROM s
  UNION ALL
  SELECT source, n, w, full_ OR left_ * w / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () > 3 * n, round + 1
  FROM (SELECT *, sum(n) OVER () - sum(CASE WHEN full_ THEN 3 * n ELSE 0 END) OVER () AS left_ FROM fill) WHERE round < 40),
t AS (
  SELECT source, n, CASE WHEN full_ THEN 3 * n ELSE (sum(n) OVER () - sum(CASE WHEN full_ THEN 3 * n ELSE 0 END) OVER ()) * w / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () END AS target
  FROM fill WHERE round = 40),
e AS (
  SELECT d.*, t.n, t.target, CASE WHEN n > 0 THEN least(floor(target / n), {mixing.MAX_EPOCHS}) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target,
  CAST(size * (epochs + CASE WHEN size > 0 AND target - epochs * n > 0 AND upto - size / 2.0 <= target - epochs * n THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e
"""

def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TEMPLATES = ", ".join(f"('{label}', {_list(sorted(set(licenses.words_of(t))))}, {licenses.need(t)}, {licenses.step_of(t)})" for label, t in licenses.TEMPLATES)
OP7 = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, list_filter(string_split(regexp_replace(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT *, list_filter(range(len(w)), lambda i: w[i+1] = 'cc' AND w[i+2] = 'by') AS a,
    list_filter(range(len(w)), lambda i: w[i+1] = 'general' AND w[i+2] = 'public' AND w[i+3] = 'license') AS g,
    list_filter(range(len(w)), lambda i: w[i+1] = 'all' AND w[i+2] = 'rights' AND w[i+3] = 'reserved') AS r FROM d),
t(label, own, need, step) AS (VALUES {_TEMPLATES}),
steps AS (SELECT DISTINCT step FROM t),
blocks AS (SELECT k, step, unnest(list_transform(range(greatest(1, CAST(ceil((len(w) - step) / step) AS BIGINT))), lambda i: w[i*step+1 : i*step+2*step])) AS block FROM d, steps),
hits AS (SELECT k, label, len(list_intersect(own, block)) / len(own) AS contained FROM blocks JOIN t USING (step)
  WHERE len(list_intersect(own, block)) >= need),
found AS (SELECT k, list(DISTINCT label) AS labels, max(contained) AS contained FROM hits GROUP BY k),
o AS (SELECT b.*, found.labels AS more, contained, list_concat(a, list_concat(g, r)) AS spots,
  list_concat(CASE WHEN len(a) > 0 THEN ['cc-by'] ELSE [] END, list_concat(CASE WHEN len(g) > 0 THEN ['gpl'] ELSE [] END, CASE WHEN len(r) > 0 THEN ['reserved'] ELSE [] END)) AS own
  FROM b LEFT JOIN found USING (k))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(spots) AS BIGINT) AS n_base, list_min(spots) AS first_word, list_max(spots) AS last_word,
  array_to_string(own, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(own, coalesce(more, [])))), ',') AS labels,
  CASE WHEN len(spots) > 0 THEN 1.0 ELSE coalesce(contained, 0.0) END AS score
FROM o
"""

OP8 = """
WITH RECURSIVE n AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS (SELECT * FROM n WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM v a JOIN v b ON a.id <> b.id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.9),
c AS (SELECT id AS x, id AS y FROM n UNION SELECT c.x, p.y FROM c JOIN p ON c.y = p.x),
r AS (SELECT c.x, min(n.vec_id) AS component FROM c JOIN n ON n.id = c.y GROUP BY c.x),
k AS (SELECT x, count(*) AS links FROM p GROUP BY x)
SELECT vec_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links, component AS component_id, coalesce(component = vec_id, true) AS kept
FROM n JOIN r ON r.x = n.id LEFT JOIN k ON k.x = n.id
"""

# SQL has no CRC-32: bytes are taken in one by one, each followed by eight shifts (-1).
_CRC32 = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split({0}, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END), 4294967295)"""
_OP11_LEAF = "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
OP11 = f"""
WITH RECURSIVE l AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('1' || source, '0') AS k, {_OP11_LEAF.format(text="text")} AS leaf,
    CASE WHEN {_CRC32.format("CAST(doc_id AS VARCHAR)")} % 5 = 0
      THEN {_OP11_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM l),
-- Nodes of each group, level by level; a run's digests are joined in order.
t AS (
  SELECT k, 0 AS lvl, pos, leaf AS digest, n FROM p
  UNION ALL
  SELECT k, lvl + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM t WHERE n > 1 GROUP BY k, lvl, pos // 16),
s AS (SELECT k, digest AS subroot, row_number() OVER (ORDER BY encode(k)) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, pos, subroot AS digest, n FROM s
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM u WHERE n > 1 GROUP BY lvl, pos // 16),
-- What stands left and right of each node in its run.
sides AS (
  SELECT a.k, a.lvl, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM t a JOIN t b ON a.k = b.k AND a.lvl = b.lvl AND a.pos // 16 = b.pos // 16 AND a.n > 1 GROUP BY ALL
  UNION ALL
  SELECT NULL, a.lvl, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), ''), coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '')
  FROM u a JOIN u b ON a.lvl = b.lvl AND a.pos // 16 = b.pos // 16 AND a.n > 1 GROUP BY ALL),
step AS (
  SELECT id, lvl AS step_no, l, r FROM p JOIN sides ON p.k = sides.k AND sides.pos = p.pos // (16 ** lvl)::BIGINT
  UNION ALL
  SELECT id, 100 + lvl, l, r FROM p JOIN s USING (k) JOIN sides ON sides.k IS NULL AND sides.pos = s.pos // (16 ** lvl)::BIGINT),
path AS (SELECT id, list(l ORDER BY step_no) AS l, list(r ORDER BY step_no) AS r, string_agg(l || r, '' ORDER BY step_no) AS sibs FROM step GROUP BY id),
f AS (
  SELECT p.id, 1 AS i, coalesce(other, leaf) AS node, l, r FROM p LEFT JOIN path USING (id)
  UNION ALL
  SELECT id, i + 1, sha256(l[i] || node || r[i]), l, r FROM f WHERE i <= len(l)),
top AS (SELECT digest AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(sibs, '')) AS proof_sha256, node AS folded_root, node = root AS verified
FROM p JOIN s USING (k) LEFT JOIN path USING (id) JOIN f USING (id) CROSS JOIN top WHERE i = coalesce(len(f.l), 0) + 1
"""


def _assigned(centroids: str) -> str:
    """Each vector with its nearest centroid and the squared distance."""
    far = "CAST(list_sum(list_transform(list_zip(e, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    return f"SELECT id, c, d FROM (SELECT id, c, {far} AS d FROM v, {centroids}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1"


def _moved(before: str, assigned: str) -> str:
    """The floor of the mean of each centroid's vectors; an empty one stays."""
    return f"""SELECT {before}.c, coalesce(new.m, {before}.m) AS m FROM {before} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m
    FROM (SELECT c, i, sum(e[i]) AS s, count(*) AS n FROM {assigned} JOIN v USING (id), range(1, 65) t(i) GROUP BY c, i) GROUP BY c) new USING (c)"""


OP12 = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS c, e AS m FROM v QUALIFY c < 16),
a0 AS MATERIALIZED ({_assigned("m0")}), m1 AS MATERIALIZED ({_moved("m0", "a0")}),
a1 AS MATERIALIZED ({_assigned("m1")}), m2 AS MATERIALIZED ({_moved("m1", "a1")}),
a2 AS MATERIALIZED ({_assigned("m2")}), m3 AS MATERIALIZED ({_moved("m2", "a2")}),
a3 AS MATERIALIZED ({_assigned("m3")})
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a3 JOIN v USING (id) JOIN m3 USING (c)
"""


_LUHN = """list_sum(list_transform(range(1, length(d) + 1), lambda i:
    CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INTEGER) ELSE (2 * CAST(d[i] AS INTEGER)) // 10 + (2 * CAST(d[i] AS INTEGER)) % 10 END)) % 10 = 0"""
_MOD97 = """list_reduce(list_concat([0::BIGINT], list_transform(string_split(substr(replace(s, ' ', ''), 5) || substr(replace(s, ' ', ''), 1, 4), ''), lambda c:
    CAST(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT))),
    lambda acc, x: (acc * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97) = 1"""
#: What holds of a valid span ``s``, with its digits ``d``.
_VALID = {
    "ip": "list_max(list_transform(string_split(s, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 256))) <= 255",
    "card": f"length(d) BETWEEN 13 AND 19 AND {_LUHN}",
    "phone": "length(d) BETWEEN 9 AND 15",
    "iban": _MOD97,
    "ssn": "substr(s, 1, 3) NOT IN ('000', '666') AND s[1] <> '9' AND substr(s, 5, 2) <> '00' AND substr(s, 8) <> '0000'",
}


def _found(rank: int, kind: str) -> str:
    """A row a valid span: a text is cut at the pattern's matches, so lengths of what is between and of the matches give the places."""
    pattern, group = pii.PATTERNS[kind].replace("'", "''"), 2 if kind in pii.CUES else 0
    return f"""SELECT id, {rank} AS rank, '{kind}' AS kind, upto - length(s) AS a, upto AS b FROM (
    SELECT id, s, regexp_replace(s, '[^0-9]', '', 'g') AS d, CAST(list_sum(list_transform(gap[1:i], lambda x: length(x))) + list_sum(list_transform(hit[1:i], lambda x: length(x))) AS BIGINT) AS upto
    FROM (SELECT id, gap, hit, unnest(own) AS s, unnest(range(1, len(own) + 1)) AS i FROM (
      SELECT id, string_split_regex(text, '{pattern}') AS gap, regexp_extract_all(text, '{pattern}') AS hit, regexp_extract_all(text, '{pattern}', {group}) AS own FROM t)))
  WHERE {_VALID.get(kind, "true")}"""


_LISTED = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY rank, a){0}, '')"
OP13 = f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_found(k, kind) for k, kind in enumerate((*pii.BASE, *pii.MORE)))})
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)},
  sha256({_LISTED.format(f" FILTER (rank < {len(pii.BASE)})")}) AS base_sha256, {_LISTED.format("")} AS spans
FROM t LEFT JOIN s USING (id) GROUP BY id, doc_id
"""
