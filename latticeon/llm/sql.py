"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality import BASE_FAILED, RULES, STOP_WORDS, SYMBOLS, WINDOW
from .secrets import RULES as SECRET_RULES


def _secrets() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for order, r in enumerate(SECRET_RULES):
        p = q(r.pattern)
        parts.append(
            f"SELECT n, {q(r.kind)} AS kind, {order} AS ord, {str(r.base).lower()} AS base, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS l, length(g[i]) AS gl "
            f"FROM (SELECT n, m, p, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT n, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS p, regexp_extract_all(t, {p}, {r.group}) AS g FROM d WHERE regexp_matches(t, {p}))) WHERE length(g[i]) >= {r.min_len}"
        )
    spans = "string_agg(kind || ':' || s || ':' || (s + l), ',' ORDER BY s, ord)"
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)}),
a AS (SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {spans} FILTER (base) AS b, {spans} AS spans FROM f GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (n)"""


def _hamming(k: int = 10) -> str:
    return f"""WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: coalesce(x > 0 AND NOT isnan(x), false)) AS code FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, b.vec_id AS found_id, list_sum(list_transform(list_zip(q.code, b.code), lambda x: (x[1] <> x[2])::INT))::BIGINT AS distance FROM b q, b WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, found_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, found_id) AS rank FROM p) WHERE rank <= {k}"""


def _quality() -> str:
    stop = ", ".join("'" + v + "'" for v in sorted({v for w in STOP_WORDS for v in (w, w.capitalize())}))
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
v AS (SELECT n, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT n, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
r AS (SELECT n, i, count(*) OVER (PARTITION BY n, k) AS c FROM v),
c AS (SELECT n, count(DISTINCT i + j) AS n_repeat_words FROM r, range(0, {WINDOW}) t(j) WHERE c > 1 GROUP BY n),
a AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[{SYMBOLS}]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, len(list_filter(ws, lambda x: x IN ({stop})))::BIGINT AS n_stop, len(regexp_extract_all(t, '!!'))::BIGINT AS n_bang FROM w LEFT JOIN c USING (n)),
b AS (SELECT *, {BASE_FAILED} AS base_failed FROM a)
SELECT *, NOT base_failed AND {' AND '.join(r.sql() for r in RULES)} AS kept FROM b"""


def _near_duplicates() -> str:
    return """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s), u AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n_shingles + y.n_shingles - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a)
SELECT doc_id, n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept FROM n LEFT JOIN c USING (doc_id)"""


SQL: dict[str, str] = {"op1_secret_scan": _secrets(), "op3_hamming_topk": _hamming(), "op6_quality_rules": _quality(), "op8_near_duplicates": _near_duplicates()}
