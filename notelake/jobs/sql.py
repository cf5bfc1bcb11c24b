"""DuckDB SQL with the results of ``queries``; each text is whole and stands by itself."""

from __future__ import annotations

from ..functions import chunking as C
from ..functions import text as T
from ..operators import graph, scan, similarity
from . import views

_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_TOKENS = lambda c: f"regexp_extract_all(lower({c}), '{T.TOKEN}')"
_TAGS = r"""list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '(?s)```.*?(?:```|\z)', '', 'g'), '(?:^|\s)#([A-Za-z][A-Za-z0-9_/\-]*)', 1)))"""

_STRIP = lambda c: f"trim({c}, '{C.BLANK}')"
_UPTO = "OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)"
_BEFORE = "OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _chunk_parts(c: str, fence: str, head: str, others: str, begins: str) -> dict[str, str]:
    """Lines with what they are, runs numbered where one begins, a row a run; ``k`` of a blank line is null."""
    return {
        f"{c}_fenced": f"SELECT *, coalesce(sum(CAST(fence AS INT)) {_BEFORE}, 0) % 2 = 1 AS inside FROM (SELECT *, {fence} AS fence FROM note_lines)",
        f"{c}_kinds": f"""SELECT *, CASE WHEN fence OR inside THEN 'code' WHEN bare = '' THEN NULL WHEN regexp_matches({head}, '{C.HEADING}') THEN 'head' {others} END AS k FROM {c}_fenced""",
        f"{c}_before": f"SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY i) AS k1, last_value(k IGNORE NULLS) {_BEFORE} AS k2 FROM {c}_kinds",
        f"{c}_numbered": f"SELECT *, sum(CAST(coalesce((fence AND NOT inside) OR {begins}, false) AS INT)) {_UPTO} AS run FROM {c}_before",
        f"{c}_runs": f"""SELECT doc_id, run AS i, arg_min(k, i) AS k, string_agg(line, chr(10) ORDER BY i) AS t, min({head}) FILTER (k = 'head') AS h
          FROM {c}_numbered GROUP BY doc_id, run""",
    }


#: Name -> what a text may read by it.
_PARTS = {
    "vault_notes": views.SQL_NOTES,
    "first_notes": views.SQL_NOTES,
    "raw_docs": views.SQL_RAW,
    "live": views.SQL_LIVE,
    "paragraphs": views.SQL_PARAGRAPHS,
    "queries": views.SQL_QUERIES,
    "names": r"SELECT path, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '')) AS base, regexp_replace(lower(path), '\.md$', '') AS full_ FROM vault_notes",
    "raw_links": r"SELECT path, trim(target) AS target FROM (SELECT path, unnest(regexp_extract_all(text, '\[\[([^\]|#]+)', 1)) AS target FROM vault_notes) WHERE trim(target) <> ''",
    "links": f"SELECT path, target, regexp_replace(lower(target), '\\.md$', '') AS k FROM raw_links WHERE NOT regexp_matches(target, '{graph.NO_LINK}')",
    "found": "SELECT k, min(n.path) AS dst, count(DISTINCT n.path) AS n FROM (SELECT DISTINCT k FROM links) JOIN names n ON k = n.base OR k = n.full_ GROUP BY k",
    "edges": "SELECT DISTINCT path AS src, dst FROM links JOIN found USING (k) WHERE dst <> path",
    "degree": "SELECT path, (SELECT count(*) FROM edges WHERE src = path) AS n_out, (SELECT count(*) FROM edges WHERE dst = path) AS n_in FROM vault_notes",
    "broken": "SELECT path, target FROM links WHERE k NOT IN (SELECT k FROM found)",
    "ends": "SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges",
    "reach": "SELECT path AS a, path AS b FROM vault_notes UNION SELECT reach.a, ends.b FROM reach JOIN ends ON reach.b = ends.a",
    "components": "SELECT a AS path, min(b) AS component FROM reach GROUP BY a",
    "note_lines": f"""SELECT doc_id, i, l[i] AS line, {_STRIP('l[i]')} AS bare FROM
      (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM vault_notes))""",
    **_chunk_parts(
        "sem", "(starts_with(bare, '```') OR starts_with(bare, '~~~'))", "bare",
        f"WHEN regexp_matches(bare, '{C.ROW}') THEN 'table' WHEN regexp_matches(line, '{C.ITEM}') THEN 'list' ELSE 'prose'",
        "k = 'head' OR (k IS NOT NULL AND k IS DISTINCT FROM k2)",
    ),
    "sem_headed": f"""SELECT doc_id, i, k, {_STRIP('t')} AS t, coalesce(last_value({_STRIP(f"regexp_extract(h, '{C.HEADING}', 2)")} IGNORE NULLS) {_UPTO}, '') AS heading,
      coalesce(last_value(length(regexp_extract(h, '{C.HEADING}', 1)) IGNORE NULLS) {_UPTO}, 0) AS hlevel FROM sem_runs""",
    "sem_long": f"SELECT doc_id, i, string_split(t, chr(10)) AS l FROM sem_headed WHERE k = 'code' AND length(t) > {C.LONG_CODE}",
    "sem_cut": f"""SELECT doc_id, i, l, 1 AS j, length(l[1]) + 1 AS n, 0 AS part FROM sem_long
      UNION ALL SELECT doc_id, i, l, j + 1, CASE WHEN n >= {C.CODE_PART} THEN 0 ELSE n END + length(l[j + 1]) + 1, part + CAST(n >= {C.CODE_PART} AS INT) FROM sem_cut WHERE j < len(l)""",
    "sem_all": f"""SELECT doc_id, i, 0 AS part, k, t, heading, hlevel FROM sem_headed WHERE k <> 'head' AND t <> '' AND (doc_id, i) NOT IN (SELECT (doc_id, i) FROM sem_long)
      UNION ALL SELECT c.doc_id, c.i, c.part, 'code', {_STRIP('c.t')}, heading, hlevel
      FROM (SELECT doc_id, i, part, string_agg(l[j], chr(10) ORDER BY j) AS t FROM sem_cut GROUP BY doc_id, i, part) c JOIN sem_headed h ON c.doc_id = h.doc_id AND c.i = h.i""",
    "sem_ranked": "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, part) AS r FROM sem_all",
    "sem_merged": """SELECT doc_id, r, r AS first_r, k, length(t) AS n FROM sem_ranked WHERE r = 1
      UNION ALL SELECT c.doc_id, c.r, CASE WHEN m.k = 'prose' AND c.k = 'prose' AND m.n < 80 THEN m.first_r ELSE c.r END, c.k,
        CASE WHEN m.k = 'prose' AND c.k = 'prose' AND m.n < 80 THEN m.n + 2 ELSE 0 END + length(c.t)
      FROM sem_merged m JOIN sem_ranked c ON c.doc_id = m.doc_id AND c.r = m.r + 1""",
    "sem_joined": """SELECT doc_id, first_r AS r, min_by(c.heading, c.r) AS heading, min_by(c.hlevel, c.r) AS hlevel, any_value(c.k) AS k, string_agg(c.t, chr(10) || chr(10) ORDER BY c.r) AS t
      FROM sem_merged m JOIN sem_ranked c USING (doc_id, r) GROUP BY doc_id, first_r""",
    "sem_short": f"SELECT doc_id, {_STRIP('text')} AS t FROM vault_notes WHERE length({_STRIP('text')}) < 80",
    "sem_none": f"SELECT doc_id, left({_STRIP('text')}, 2000) AS t FROM vault_notes WHERE doc_id NOT IN (SELECT doc_id FROM sem_joined) AND length({_STRIP('text')}) >= 80",
    "sem_chunks": """SELECT doc_id, r, heading, hlevel, k, t FROM sem_joined WHERE doc_id NOT IN (SELECT doc_id FROM sem_short)
      UNION ALL SELECT doc_id, 1, '', 0, 'prose', t FROM sem_short UNION ALL SELECT doc_id, 1, '', 0, 'prose', t FROM sem_none""",
    **_chunk_parts(
        "idx", "starts_with(bare, '```')", "line",
        f"WHEN starts_with(bare, '|') THEN 'table' WHEN regexp_matches(line, '{C.INDEX_ITEM}') THEN 'list' ELSE 'plain'",
        "k IN ('head', 'table', 'list') OR (k = 'plain' AND (k1 IS NULL OR k1 = 'code'))",
    ),
    "idx_headed": f"""SELECT doc_id, i, t, last_value({_STRIP(f"regexp_extract(h, '{C.HEADING}', 2)")} IGNORE NULLS) {_UPTO} AS heading,
      coalesce(last_value(length(regexp_extract(h, '{C.HEADING}', 1)) IGNORE NULLS) {_UPTO}, 0) AS hlevel,
      CASE WHEN k = 'code' THEN k ELSE coalesce(last_value(CASE k WHEN 'code' THEN 'prose' WHEN 'head' THEN 'prose' WHEN 'table' THEN k WHEN 'list' THEN k END IGNORE NULLS) {_UPTO}, 'prose') END AS k
      FROM idx_runs""",
    "idx_long": f"SELECT doc_id, i, string_split(t, chr(10)) AS l FROM idx_headed WHERE k = 'code' AND length(t) > {C.CODE_PART}",
    "idx_cut": f"""SELECT doc_id, i, l, 1 AS j, length(l[1]) AS n, 0 AS part FROM idx_long
      UNION ALL SELECT doc_id, i, l, j + 1, CASE WHEN n > {C.CODE_PART} AND j > 1 THEN 0 ELSE n END + length(l[j + 1]), part + CAST(n > {C.CODE_PART} AND j > 1 AS INT) FROM idx_cut WHERE j < len(l)""",
    "idx_chunks": f"""SELECT doc_id, i, part, heading, hlevel, k, {_STRIP('t')} AS t FROM
      (SELECT doc_id, i, 0 AS part, heading, hlevel, k, t FROM idx_headed WHERE (doc_id, i) NOT IN (SELECT (doc_id, i) FROM idx_long)
       UNION ALL SELECT c.doc_id, c.i, c.part, heading, hlevel, k, c.t
       FROM (SELECT doc_id, i, part, string_agg(l[j], chr(10) ORDER BY j) AS t FROM idx_cut GROUP BY doc_id, i, part) c JOIN idx_headed h ON c.doc_id = h.doc_id AND c.i = h.i)
      WHERE {_STRIP('t')} <> ''""",
    "edited": "SELECT doc_id, 'n' || CAST(doc_id AS VARCHAR) || '.md' AS path, text FROM vault_notes",
    "filed": views.SQL_FILED,
    "wording": views.SQL_WORDING,
    "words": f"SELECT path, ord, {_TOKENS('text')} AS w FROM wording",
    "shingles": """SELECT path, ord, CAST('0x' || substr(md5(s), 1, 8) AS BIGINT) AS h
        FROM (SELECT path, ord, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0))""",
    "counts": "SELECT path, ord, h % 256 AS dim, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS FLOAT) AS c FROM shingles GROUP BY ALL",
    # Single floats as the embedder has them.
    "chunk_unit": "SELECT path, ord, dim, CAST(c / CAST(sqrt(sum(c * c) OVER (PARTITION BY path, ord)) AS FLOAT) AS DOUBLE) AS v FROM counts WHERE c <> 0",
    "mean": "SELECT path, dim, sum(v) / (SELECT count(*) FROM words w WHERE w.path = u.path) AS v FROM chunk_unit u GROUP BY path, dim",
    "unit": """SELECT path, dim, coalesce(v, 0) / sqrt(sum(v * v) OVER (PARTITION BY path)) AS v
        FROM (SELECT path, CAST(dim AS BIGINT) AS dim FROM (SELECT DISTINCT path FROM mean), range(256) t(dim)) LEFT JOIN mean USING (path, dim)""",
    "unit_list": "SELECT path, list(v ORDER BY dim) AS v FROM unit GROUP BY path",
    "pairs": "SELECT x.path AS a, y.path AS b, round(list_inner_product(x.v, y.v), 9) AS score FROM unit_list x JOIN unit_list y ON x.path < y.path",
    "known": r"""SELECT DISTINCT l.path AS src, n.path AS dst FROM raw_links l JOIN names n ON regexp_replace(lower(target), '\.md$', '') = n.base
        WHERE l.path <> n.path AND l.path IN (SELECT path FROM filed) AND n.path IN (SELECT path FROM filed)""",
    "payloads": """SELECT doc_id, path, size_, body, CASE WHEN doc_id % 31 = 0 THEN 'Note not found' WHEN doc_id % 29 = 0 THEN '' WHEN ends_with(path, '.pdf') THEN body
        WHEN doc_id % 7 = 0 THEN substr(body, 1, 1000) ELSE body END AS content FROM (SELECT *, octet_length(encode(body)) AS size_ FROM live)""",
    "verified": """SELECT path, size_ AS expected, CASE WHEN bad THEN NULL ELSE n END AS got,
        CASE WHEN bad THEN 'unreadable' WHEN size_ > 0 AND (n - size_) / size_ < -0.1 THEN 'short' WHEN size_ > 0 AND (n - size_) / size_ > 0.1 THEN 'inflated' ELSE 'ok' END AS status
        FROM (SELECT path, size_, octet_length(encode(content)) AS n, starts_with(content, 'Note not found') OR (content = '' AND size_ > 0) AS bad FROM payloads)""",
    "snaps": "SELECT printf('202401%02d-030000', d) AS snapshot, path, size_ AS size FROM payloads, range(1, 13) t(d) WHERE (doc_id + d) % 13 <> 0",
    "versions": """SELECT path, CASE WHEN doc_id % 14 = 0 THEN 'Note not found: x' WHEN doc_id % 7 = 0 THEN text || ' x' ELSE text END AS now, text AS was, doc_id % 10 AS m FROM vault_notes""",
    "terms": f"SELECT qid, list_sort(list_distinct(flatten([t, list_transform(flatten(list_transform(t, lambda x: coalesce(s[x], []))), lambda y: y)]))) AS terms, query FROM (SELECT *, {_TOKENS('query')} AS t, MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {_list(v)}' for k, v in T.SYNONYMS.items())}}} AS s FROM queries)",
    "asked": f"SELECT qid, unnest(list_distinct(CASE WHEN len(k) > 0 THEN k ELSE t END)) AS term FROM (SELECT qid, {_TOKENS('query')} AS t, list_filter({_TOKENS('query')}, lambda x: length(x) > 1 AND NOT list_contains({_list(T.STOP_WORDS)}, x)) AS k FROM queries)",
    "tokens": f"SELECT path, ord, unnest({_TOKENS('text')}) AS term FROM paragraphs",
    "lexical": "SELECT qid, path, ord, count(*) / 100 AS score, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, path, ord) AS rank FROM tokens JOIN asked USING (term) GROUP BY qid, path, ord",
    "named": r"""SELECT qid, path, terms, (length(query) > 0 AND contains(name, lower(query))) OR (len(terms) > 0 AND contains(name, array_to_string(terms, ' '))) AS whole,
        len(list_intersect(list_distinct(regexp_extract_all(name, '[a-z0-9]+')), terms)) AS n,
        len(list_filter(terms, lambda t: length(t) > 2 AND contains(low, t))) > 0 AS inside
        FROM terms, (SELECT path, lower(regexp_extract(path, '([^/]*)$', 1)) AS name, lower(text) AS low FROM vault_notes)""",
    "staged": """SELECT qid, path, n, CASE WHEN whole AND row_number() OVER (PARTITION BY qid, whole ORDER BY path) <= 20 THEN 1 WHEN n > 0 THEN 2 WHEN inside THEN 3 END AS stage FROM named""",
    "candidates": """SELECT qid, path, stage, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY stage, CASE WHEN stage = 2 THEN n ELSE 0 END DESC, path) AS rank
        FROM staged WHERE stage IS NOT NULL) WHERE rank <= 60""",
    "cand_chunks": f"SELECT qid, path, ord, {_TOKENS('text')} AS toks, terms FROM candidates JOIN paragraphs USING (path) JOIN terms USING (qid)",
    "hits": "SELECT qid, path, ord, term, len(toks) AS m, len(terms) AS nt, count(*) AS c FROM (SELECT *, unnest(toks) AS term FROM cand_chunks) WHERE list_contains(terms, term) GROUP BY ALL",
    "idf": "SELECT qid, term, ln(1 + (SELECT count(*) FROM cand_chunks x WHERE x.qid = h.qid) / (1 + count(*))) AS idf FROM hits h GROUP BY qid, term",
    "eops": "SELECT 'n' || CAST(user_id AS VARCHAR) || '.md' AS path, event_type AS op, coalesce(CAST(props AS VARCHAR), '') AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events",
    "fold": """SELECT path, CAST(0 AS BIGINT) AS k, max(text) AS text FROM (SELECT path, text FROM edited UNION ALL SELECT DISTINCT path, NULL FROM eops) GROUP BY path
        UNION ALL SELECT f.path, e.k, CASE op WHEN 'signup' THEN c WHEN 'view' THEN coalesce(text, '') || c WHEN 'click' THEN c || coalesce(text, '')
        WHEN 'purchase' THEN CASE WHEN strpos(text, '1') > 0 THEN substr(text, 1, strpos(text, '1') - 1) || c || substr(text, strpos(text, '1') + 1) ELSE text END ELSE NULL END
        FROM fold f JOIN eops e ON e.path = f.path AND e.k = f.k + 1""",
    "moving": """SELECT path, text, CASE doc_id % 10 WHEN 0 THEN 'm/n' || doc_id || '.md' WHEN 1 THEN 'n' || (doc_id + 1) || '.md' WHEN 2 THEN 'n' || (doc_id + 1) || '.md'
        WHEN 3 THEN 'n' || (doc_id + 1) || '.md' WHEN 5 THEN 'n' || (doc_id + 1) || '.md' WHEN 6 THEN 'n' || (doc_id - 1) || '.md'
        WHEN 7 THEN 'c/' || (doc_id // 20) || '.md' WHEN 8 THEN 'n' || (doc_id - 1) || '.md' WHEN 9 THEN 'n' || (doc_id + 1) || '.md' END AS target FROM edited""",
    "refused": """SELECT path, target FROM moving WHERE target IN (SELECT target FROM moving WHERE target IS NOT NULL GROUP BY target HAVING count(*) > 1)
        OR target IN (SELECT path FROM moving WHERE target IS NULL)
        UNION SELECT m.path, m.target FROM moving m JOIN refused r ON m.target = r.path""",
    "lines": r"SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, i AS line, p[i] AS content FROM (SELECT source, doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT source, doc_id, string_split(text, chr(10)) AS p FROM documents))",
}


def _sql(body: str, **other: str) -> str:
    """``body`` with the parts that it reads, and those that they read; ``other`` are parts in the place of those of that name."""
    import re

    parts = _PARTS | other
    used: dict[str, None] = {}

    def add(text: str) -> None:
        for name in parts:
            if name not in used and re.search(rf"\b{name}\b", re.sub(r"'[^']*'", "", text)):
                used[name] = None
                add(parts[name])
                used[name] = used.pop(name)  # after what it reads

    add(body)
    return ("WITH RECURSIVE " + ", ".join(f"{n} AS ({parts[n]})" for n in used) + " " if used else "") + body


def _scan() -> str:
    rules = [r for r in scan.load_rules(scan.GENERIC_RULES + "\nemail:[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\n")]
    hit = ", ".join(f"CASE WHEN regexp_matches(content, '{p}') THEN '{c}' END" for c, p, _ in rules)
    shown = "content"
    for _, p, _ in rules:
        shown = f"regexp_replace({shown}, '{p}', '{scan.HIDDEN}', 'g')"
    return f"SELECT path, line, list_sort(list_distinct(list_filter([{hit}], lambda x: x IS NOT NULL))) AS cats, substr({shown}, 1, 160) AS shown FROM lines WHERE len(list_filter([{hit}], lambda x: x IS NOT NULL)) > 0 AND NOT regexp_matches(path || ':' || content, '^src3/')"


_STATS = """SELECT count(*) AS notes, count(*) FILTER (n_out > 0) AS linking, count(*) FILTER (n_in > 0) AS receiving, count(*) FILTER (n_out = 0) AS orphans,
  count(*) FILTER (n_out = 0 AND n_in = 0) AS islands, (SELECT count(DISTINCT component) FROM components) AS components, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM broken) AS broken FROM degree"""
_PROPOSED = """SELECT CASE WHEN one THEN a ELSE b END AS src, CASE WHEN one THEN b ELSE a END AS dst, round(score, 6) AS score FROM (
  SELECT least(s, t) AS a, greatest(s, t) AS b, max(score) AS score, length(regexp_extract(least(s, t), '([^/]*)$', 1)) <= length(regexp_extract(greatest(s, t), '([^/]*)$', 1)) AS one FROM (
    SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, t) AS r FROM (SELECT a AS s, b AS t, score FROM pairs WHERE score >= 0.78 UNION ALL SELECT b, a, score FROM pairs WHERE score >= 0.78)
    WHERE (s, t) NOT IN (SELECT (src, dst) FROM known)) WHERE r <= 4 GROUP BY 1, 2)"""
_base = lambda c: f"lower(regexp_replace(regexp_extract({c}, '([^/]*)$', 1), '\\.[^.]*$', ''))"
_canonical = lambda c: f"((SELECT count(*) FROM known WHERE dst = {c}) - 1.5 * len(list_filter({_list(similarity.DERIVED)}, lambda w: contains({_base(c)}, w))) - greatest(0, length({_base(c)}) - 20) / 40)"
_NEAR = "SELECT a, b, score FROM pairs WHERE score >= 0.80 AND (a, b) NOT IN (SELECT (src, dst) FROM known) AND (b, a) NOT IN (SELECT (src, dst) FROM known)"

_BODIES = {
    "s2_live_docs": "SELECT path, CAST(size AS BIGINT) AS size, CAST(mtime AS BIGINT) AS mtime FROM live",
    "s3_clean_note_text": "SELECT path, md5(text) AS clean FROM vault_notes",
    "s4_decode_payload": """SELECT path, ends_with(path, '.pdf') AS is_binary, CASE WHEN doc_id % 31 = 0 AND ends_with(path, '.pdf') THEN md5(from_base64('Notenotfound')) ELSE md5(content) END AS decoded FROM payloads""",
    "n1_list_notes": f"SELECT path FROM vault_notes WHERE starts_with(path, 'src5/') AND list_contains({_TAGS}, 'en')",
    "n2_list_folders": "SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM vault_notes WHERE contains(path, '/')",
    "n3_list_tags": f"SELECT tag, count(*) AS n FROM (SELECT unnest({_TAGS}) AS tag FROM vault_notes) GROUP BY tag",
    "n4_note_metadata": f"SELECT path, length(text) AS size, strftime(mtime, '%Y-%m-%dT%H:%M:%S') AS mtime, array_to_string({_TAGS}, ',') AS tags, (SELECT count(*) FROM edges WHERE dst = path) AS backlinks FROM vault_notes",
    "n5_search_names": "SELECT qid, path, CAST(rank AS INTEGER) AS rank FROM (SELECT item_id AS qid, path, row_number() OVER (PARTITION BY item_id ORDER BY path) AS rank FROM benchmark, vault_notes WHERE contains(lower(path), 'n' || CAST(item_id % 30 AS VARCHAR))) WHERE rank <= 10",
    "n6_vault_inventory": r"""SELECT kind, CASE WHEN kind = 'live' THEN lower(regexp_extract(path, '\.([^./]+)$', 1)) ELSE '' END AS extension, count(*) AS n, CAST(sum(coalesce(size, 0)) AS BIGINT) AS bytes FROM (
        SELECT *, CASE WHEN starts_with(_id, 'h:') THEN 'block' WHEN starts_with(_id, '_') THEN 'system' WHEN deleted THEN 'tombstone' WHEN coalesce(path, '') <> '' THEN 'live' ELSE 'other' END AS kind FROM raw_docs) GROUP BY 1, 2""",
    "e_apply_edits": "SELECT path, md5(text) AS text FROM (SELECT path, arg_max(k, k) AS k, max(k) AS top FROM fold GROUP BY path) m JOIN fold USING (path, k) WHERE text IS NOT NULL",
    "e4_move_notes": """SELECT CASE WHEN target IS NULL OR path IN (SELECT path FROM refused) THEN path ELSE target END AS path, md5(text) AS text FROM moving""",
    "c1_chunk_notes": """SELECT path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS INTEGER) AS ord, heading, CAST(hlevel AS INTEGER) AS hlevel, k AS ctype, t AS text
      FROM sem_chunks JOIN vault_notes USING (doc_id)""",
    "c2_chunk_notes_index": f"""SELECT path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, part) - 1 AS INTEGER) AS ord, heading, CAST(hlevel AS INTEGER) AS hlevel, k AS ctype, t AS text
      FROM idx_chunks JOIN vault_notes USING (doc_id) WHERE length({_STRIP('vault_notes.text')}) >= 20""",
    "c3_tokens": f"SELECT path, md5(array_to_string(t, ' ')) AS tokens, CAST(CASE WHEN len(k) > 0 THEN len(k) ELSE len(t) END AS BIGINT) AS n_key_terms, sha1(text) AS hash, md5(substr(text, 1, 600)) AS excerpt FROM (SELECT path, text, {_TOKENS('text')} AS t, list_filter({_TOKENS('text')}, lambda x: length(x) > 1 AND NOT list_contains({_list(T.STOP_WORDS)}, x)) AS k FROM vault_notes)",
    "c5_expand_query": _PARTS["terms"].replace("SELECT qid, list_sort", "SELECT qid, array_to_string(list_sort").replace(" AS terms, query FROM", ", ' ') AS terms FROM").replace("FROM queries)", "FROM (SELECT qid, query || CASE WHEN qid % 2 = 0 THEN ' docker backup Tarea' ELSE '' END AS query FROM queries))"),
    "c7_doc_freq": f"SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({_TOKENS('text')})) AS term FROM paragraphs) GROUP BY term",
    "m4_cosine": "SELECT x.vec_id, round(least(1.0, greatest(0.0, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])))), 6) AS cosine FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1",
    "r1_candidates": "SELECT qid, path, stage, CAST(rank AS INTEGER) AS rank FROM candidates",
    "r2_tfidf": "SELECT c.qid, c.path, c.ord, round(coalesce(s, 0), 6) AS tfidf FROM cand_chunks c LEFT JOIN (SELECT qid, path, ord, sum(c / m * idf) / any_value(nt) AS s FROM hits JOIN idf USING (qid, term) GROUP BY qid, path, ord) USING (qid, path, ord)",
    "r9_lexical_search": "SELECT qid, CAST(rank AS INTEGER) AS rank, path, ord, round(score, 6) AS score FROM lexical WHERE rank <= 5",
    "r9_postings_search": "SELECT qid, CAST(rank AS INTEGER) AS rank, path, ord, round(score, 6) AS score FROM lexical WHERE rank <= 5",
    "i1_diff_notes": "SELECT path, sha1(now) AS hash, CASE WHEN starts_with(now, 'Note not found') THEN 'failed' WHEN m = 0 THEN 'new' WHEN now <> was THEN 'changed' ELSE 'same' END AS status FROM versions WHERE m <> 1",
    "i2_stale_notes": "SELECT path FROM versions WHERE m = 1",
    "g1_note_bodies": "SELECT path, md5(string_agg(text, chr(10) ORDER BY ord)) AS text FROM paragraphs GROUP BY path",
    "g2_extract_links": "SELECT path, target, count(*) AS n FROM links GROUP BY path, target",
    "g3_resolve_links": "SELECT src, dst FROM edges",
    "g4_broken_links": "SELECT path, target FROM broken",
    "g4_ambiguous_links": "SELECT path, target, n FROM links JOIN found USING (k) WHERE n > 1",
    "g5_degrees": "SELECT path, n_out, n_in FROM degree",
    "g6_roles": "SELECT path, 'orphan' AS kind FROM degree WHERE n_out = 0 UNION ALL SELECT path, 'island' FROM degree WHERE n_out = 0 AND n_in = 0 UNION ALL SELECT path, 'leaf' FROM degree WHERE n_in = 0",
    "g7_connected_components": "SELECT path, component FROM components",
    "g8_graph_stats": f"SELECT *, CAST(floor(100 * linking / notes) AS BIGINT) AS pct_linking, components < notes / 2 AND linking > notes / 2 AS healthy FROM ({_STATS})",
    "g9_density_by_folder": f"SELECT folder, notes, linking, CAST(floor(100 * linking / notes) AS BIGINT) AS pct, floor(100 * linking / notes) < 20 AND notes >= 2 AS sparse FROM (SELECT CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '{graph.ROOT}' END AS folder, count(*) AS notes, count(*) FILTER (n_out > 0) AS linking FROM degree GROUP BY 1)",
    "l1_note_vectors": "SELECT path, CAST(dim AS INTEGER) AS dim, round(v, 6) AS value FROM unit",
    "l2_eligible_notes": "SELECT path FROM vault_notes WHERE doc_id % 6 > 1",
    "l6_rank_proposals": f"""SELECT *, max(score) OVER (PARTITION BY src) AS best, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS INTEGER) AS link_rank FROM ({_PROPOSED})""",
    "l3_current_links": r"SELECT DISTINCT l.path AS src, n.path AS dst FROM raw_links l JOIN names n ON regexp_replace(lower(target), '\.md$', '') = n.base WHERE l.path <> n.path",
    "l4_similar_pairs": "SELECT a, b, round(score, 6) AS score FROM pairs WHERE score >= 0.78",
    "l4_similar_pairs_by_cells": "SELECT a, b, round(score, 6) AS score FROM pairs WHERE score >= 0.78",
    "l5_propose_links": _PROPOSED,
    "l8_near_duplicates": f"SELECT a, b, round(score, 6) AS score FROM ({_NEAR})",
    "l9_pick_canonical": f"""SELECT round(score, 6) AS score, CASE WHEN one THEN a ELSE b END AS canonical, CASE WHEN one THEN b ELSE a END AS duplicate FROM
        (SELECT *, {_canonical('a')} >= {_canonical('b')} AS one FROM ({_NEAR}))""",
    "l7_apply_links": rf"""SELECT path, regexp_replace(text, '\s+$', '') || chr(10) || chr(10) || '## {similarity.SECTION}' || chr(10) || chr(10) || lines || chr(10) AS text
  FROM filed JOIN (
    SELECT path, max(score) AS best, string_agg('- [[' || name || ']]', chr(10) ORDER BY score DESC, dst) AS lines FROM (
      SELECT path, text, score, dst, regexp_replace(regexp_extract(dst, '([^/]*)$', 1), '\.md$', '') AS name
      FROM filed JOIN ({_PROPOSED.replace("round(score, 6) AS score", "score")}) ON path = src)
    WHERE NOT contains(text, '{similarity.SECTION}') AND NOT contains(text, '[[' || name || ']]')
      AND NOT contains(text, '[[' || regexp_replace(dst, '\.md$', '') || ']]')
    GROUP BY path ORDER BY best DESC, path LIMIT 50) USING (path)""",
    "n6_note_blocks": f"""SELECT path, count(DISTINCT child) AS blocks, count(DISTINCT child) FILTER (child NOT IN (SELECT _id FROM raw_docs WHERE starts_with(_id, 'h:'))) AS missing
  FROM (SELECT path, unnest(list_transform(range(0, doc_id % 3 + 1), lambda k: 'h:' || CAST(doc_id - doc_id % 4 + 4 * k AS VARCHAR))) AS child FROM live) GROUP BY path""",
    "b6_restore_check": """SELECT '20240112-030000' AS snapshot, restored, exported, restored = exported AS complete FROM
  (SELECT count(DISTINCT path) AS restored FROM snaps WHERE snapshot = '20240112-030000'), (SELECT count(*) FILTER (status <> 'unreadable') AS exported FROM verified)""",
    "b1_verify_payloads": "SELECT path, expected, got, status FROM verified",
    "b2_snapshot_manifest": "SELECT '20240112-030000' AS snapshot, count(*) AS files_in_vault, count(*) FILTER (status <> 'unreadable') AS exported, CAST(coalesce(sum(got), 0) AS BIGINT) AS bytes, count(*) FILTER (status = 'unreadable') AS n_errors, count(*) FILTER (status IN ('short', 'inflated')) AS n_truncated, bool_and(status = 'ok') AS ok FROM verified",
    "b2_snapshot_failures": "SELECT '20240112-030000' AS snapshot, path, status AS reason, expected, got FROM verified WHERE status <> 'ok'",
    "b3_verify_snapshot": """SELECT snapshot, files, live_files, bytes, live_bytes, files = live_files AS count_ok, bytes >= 0.9 * live_bytes AS bytes_ok, true AS age_ok FROM
        (SELECT snapshot, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM snaps WHERE snapshot = '20240112-030000' GROUP BY 1), (SELECT count(*) AS live_files, CAST(sum(size_) AS BIGINT) AS live_bytes FROM payloads)""",
    "b4_missing_files": "SELECT path, 'not saved' AS side FROM payloads WHERE path NOT IN (SELECT path FROM snaps WHERE snapshot = '20240112-030000')",
    "b4_changed_files": """SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change
      FROM (SELECT path, list_sort(list(size)) AS s FROM snaps WHERE snapshot = '20240111-030000' GROUP BY path) o
      FULL JOIN (SELECT path, list_sort(list(size + CAST(length(path) % 5 = 0 AS INT))) AS s FROM snaps WHERE snapshot = '20240112-030000' GROUP BY path) n ON o.path = n.path
      WHERE o.s IS DISTINCT FROM n.s""",
    "b5_retention": "SELECT DISTINCT snapshot, 'notes' AS kind FROM snaps WHERE snapshot < '20240106-000000' UNION ALL SELECT snapshot, 'manifest' FROM (SELECT DISTINCT snapshot FROM snaps) WHERE snapshot < '20240104-000000'",
    "b6_restore": "SELECT path, max(snapshot) AS snapshot, arg_max(size, snapshot) AS size FROM snaps GROUP BY path",
    "p2_scan": f"SELECT path, line, array_to_string(cats, ',') AS categories, shown FROM ({_scan()})",
    "p2_scan_many": f"SELECT path, line, array_to_string(cats, ',') AS categories, shown FROM ({_scan()})",
    "p6_scan_summary": f"SELECT category, count(*) AS n FROM (SELECT unnest(cats) AS category FROM ({_scan()})) GROUP BY category",
}

ORACLE_SQL = {name: _sql(body) for name, body in _BODIES.items()}

ORACLE_SQL["g7_kept_graph"] = _sql("SELECT path, n_out, n_in, component FROM degree JOIN components USING (path)", vault_notes=views.SQL_CHANGED)

_METRICS = ["notes", "linking", "receiving", "orphans", "islands", "components", "edges", "broken", "pct_linking"]


def _metrics(name: str, notes: str) -> str:
    """``(metric, name)`` of the graph of other notes."""
    stats = _sql(f"SELECT *, CAST(floor(100 * linking / notes) AS BIGINT) AS pct_linking FROM ({_STATS})", vault_notes=notes)
    return f"SELECT unnest({_list(_METRICS)}) AS metric, unnest([{', '.join(_METRICS)}]) AS {name} FROM ({stats})"


_OLD = "SELECT doc_id, path, text FROM first_notes WHERE doc_id % 10 <> 0"
_NEW = """SELECT doc_id, path, CASE WHEN doc_id % 14 = 0 THEN 'Note not found: x' WHEN doc_id % 7 = 0 THEN text || ' x' ELSE text END AS text
  FROM first_notes WHERE doc_id % 10 <> 1"""
ORACLE_SQL["g10_compare_graphs"] = f"SELECT metric, before, after FROM ({_metrics('before', _OLD)}) JOIN ({_metrics('after', _NEW)}) USING (metric)"
