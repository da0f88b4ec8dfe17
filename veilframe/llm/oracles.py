"""The rows of those queries that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

from veilframe.llm.secrets import BASE, MORE

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END)) AS sh FROM w),
 k AS (SELECT min(doc_id) AS rep, sh FROM s WHERE len(sh) > 0 GROUP BY sh),
 e AS MATERIALIZED (SELECT rep, len(sh) AS n, unnest(sh) AS g FROM k),
 links AS MATERIALIZED (SELECT a.rep AS x, b.rep AS y FROM e a JOIN e b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
 r AS (SELECT rep AS id, rep AS c FROM k UNION SELECT l.y, r.c FROM r JOIN links l ON l.x = r.id),
 m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id, coalesce(m.c, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN k ON k.sh = s.sh LEFT JOIN m ON m.id = k.rep
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(embedding) > 0"

VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_FINITE} AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
 r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.y, r.c FROM r JOIN links l ON l.x = r.id),
 m AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, m.c = vec_id AS kept FROM embeddings JOIN m ON m.id = vec_id LEFT JOIN n ON n.x = vec_id
"""

TOP_K = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE {_FINITE})
SELECT a.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.q, b.q) DESC, b.vec_id) AS INTEGER) AS rank, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q) QUALIFY rank <= 20
"""


def _rule(k: int, r) -> str:
    p = r.pattern.replace("'", "''")
    starts = "list_transform(range(1, len(h) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))"
    parts = f"SELECT doc_id, string_split_regex(text, '{p}') AS p, regexp_extract_all(text, '{p}', 0) AS h, regexp_extract_all(text, '{p}', {r.group}) AS g FROM documents WHERE regexp_matches(text, '{p}')"
    each = f"SELECT doc_id, unnest({starts}) AS s, unnest(list_transform(h, lambda x: length(x))) AS n, unnest(list_transform(g, lambda x: length(x))) AS m FROM ({parts})"
    return f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM ({each}) WHERE m >= {r.least}"


_JOINED = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e)"

SECRETS = f"""
WITH m AS ({' UNION ALL '.join(_rule(k, r) for k, r in enumerate(BASE + MORE))}),
 a AS (SELECT doc_id, {', '.join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))}, coalesce({_JOINED} FILTER (k < {len(BASE)}), '') AS base, {_JOINED} AS spans FROM m GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN a USING (doc_id)
"""

_ASSIGN = "SELECT x.id, x.p, arg_min(b.e, (x.xx + b.bb - 2 * list_dot_product(x.x, b.b), b.e)) AS e, min(x.xx + b.bb - 2 * list_dot_product(x.x, b.b)) AS far FROM x JOIN b{k} b ON b.p = x.p GROUP BY x.id, x.p"
_UPDATE = """SELECT b.p, b.e, coalesce(m.b, b.b) AS b, list_dot_product(coalesce(m.b, b.b), coalesce(m.b, b.b)) AS bb FROM b{k} b LEFT JOIN
 (SELECT p, e, list(floor(s / n) ORDER BY i) AS b FROM (SELECT a.p, a.e, i, sum(x.x[i]) AS s, count(*) AS n FROM a{k} a JOIN x USING (id, p), range(1, 1 + len(x.x)) t(i) GROUP BY a.p, a.e, i) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e"""
_ROUNDS = ",\n ".join(f"a{k} AS MATERIALIZED ({_ASSIGN.format(k=k)}), b{k + 1} AS MATERIALIZED ({_UPDATE.format(k=k)})" for k in range(4))

CODES = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE {_FINITE}),
 x AS MATERIALIZED (SELECT id, vec_id, p, q[1 + p * (len(q) // 4):(p + 1) * (len(q) // 4)] AS x, list_dot_product(q[1 + p * (len(q) // 4):(p + 1) * (len(q) // 4)], q[1 + p * (len(q) // 4):(p + 1) * (len(q) // 4)]) AS xx FROM v, range(4) t(p)),
 b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS b, xx AS bb FROM x QUALIFY e < 256),
 {_ROUNDS},
 a4 AS MATERIALIZED ({_ASSIGN.format(k=4)}),
 c AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a4 GROUP BY id),
 s AS (SELECT sha256(string_agg(array_to_string(list_transform(b, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (id), s
"""

_WORDS = "list_filter(string_split_regex({text}, '{between}'), lambda x: x <> '')"
_SPACES = r"[\x20\x09-\x0D]+"
_FAILS = {"A": "len(w) < 50", "B": "100 * len(list_distinct(w)) < 65 * len(w)", "C": "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t)", "D": "regexp_matches(t, '[#$%&*|]')", "E": "doc_id > first_id"}

INTERACTIONS = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')", between=_SPACES)} AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
 f AS (SELECT doc_id, part, {" || ".join(f"CASE WHEN {x} THEN '{k}' ELSE '' END" for k, x in _FAILS.items())} AS fails FROM d),
 l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
 p AS MATERIALIZED (SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
 x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS mine, left(filter_order, step - 1) AS earlier FROM o, range(1, 6) t(step)),
 r AS MATERIALIZED (SELECT part, filter_order, step, mine, sum(n) FILTER (length(translate(fails, earlier || mine, '')) = length(fails)) AS kept,
  sum(n) FILTER (contains(fails, mine) AND length(translate(fails, earlier, '')) = length(fails)) AS removed, sum(n) FILTER (contains(fails, mine) AND length(translate(fails, earlier, '')) < length(fails)) AS redundant,
  sum(n) FILTER (fails = mine) AS unique_fails, sum(good) FILTER (contains(fails, mine) AND length(translate(fails, earlier, '')) = length(fails)) AS good_lost,
  sum(toxic) FILTER (contains(fails, mine) AND length(translate(fails, earlier, '')) = length(fails)) AS toxic_lost FROM p, s GROUP BY ALL)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
 CAST(coalesce(sum(removed) OVER (PARTITION BY part, mine), 0) AS BIGINT) AS shapley FROM r
"""

_BENCH_WORDS = _WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')", between=r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")

WINDOWS = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_BENCH_WORDS} AS w FROM benchmark),
 i AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s FROM b, range(1, 2 + len(w) - least(len(w), 10)) t(k) WHERE len(w) > 0),
 m AS MATERIALIZED (SELECT doc_id, k, q.n, s FROM d, (SELECT DISTINCT n FROM i) q, LATERAL (SELECT k, array_to_string(w[k:k + q.n - 1], ' ') AS s FROM range(1, 2 + len(w) - q.n) t(k)) SEMI JOIN i USING (s)),
 h AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM m, range(0, m.n) t(j) GROUP BY doc_id),
 e AS (SELECT DISTINCT doc_id, item_id FROM m JOIN i USING (s)),
 g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM e GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)
"""
