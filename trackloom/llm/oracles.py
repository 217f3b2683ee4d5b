"""The queries that SQL can express, as SQL for another engine."""

from __future__ import annotations

from trackloom.llm.secrets import ACCESS, ASSIGN, BASE_RULES, HEX, JWT, PEM, RULES

_PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "pem": PEM, "jwt": JWT}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _rule(order: int, kind: str) -> str:
    p = _quoted(_PATTERNS[kind])
    kept = "regexp_extract_all(t, " + p + ", 2)" if kind == "assign" else "NULL"
    return (
        f"SELECT doc_id, {order} AS ord, '{kind}' AS kind, string_split_regex(t, {p}) AS pieces, "
        f"regexp_extract_all(t, {p}) AS found, {kept} AS kept FROM d"
    )


OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(_rule(i, r.kind) for i, r in enumerate(RULES))}),
u AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m WHERE len(found) > 0),
s AS (SELECT doc_id, ord, kind, kept[i] AS value, found[i] AS hit,
  CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM u),
g AS (SELECT *, kind || ':' || a || ':' || (a + length(hit)) AS span FROM s WHERE kind <> 'assign' OR length(value) >= 8),
c AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)},
  string_agg(span, ',' ORDER BY a, ord) FILTER (ord < {len(BASE_RULES)}) AS base, string_agg(span, ',' ORDER BY a, ord) AS spans FROM g GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans FROM d LEFT JOIN c ON c.doc_id IS NOT DISTINCT FROM d.doc_id"""

# Vectors of one length, as the given tables hold them.
_VALID = """
v AS (SELECT DISTINCT vec_id, embedding AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, q.e AS a, v.e AS b FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)"""

OP3 = f"""
WITH {_VALID},
s AS (SELECT query_id, vec_id, list_reduce(list_transform(list_zip(a, b), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)), lambda t, x: t + x) AS score FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

OP4 = f"""
WITH {_VALID},
s AS (SELECT query_id, vec_id, CAST(list_sum(list_transform(list_zip(a[1:64], b[1:64]), lambda x: CAST((x[1] > 0) <> (x[2] > 0) AS INTEGER))) AS BIGINT) AS distance FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM s) WHERE rank <= 20"""

_HASH = "sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), ''))"
_H = ", ".join(f"CAST('0x' || substr({_HASH}, {1 + 8 * i}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))

OP12 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, {_H} FROM documents),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n FROM d),
e AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
s AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM s"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
t AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
g AS (SELECT count(DISTINCT r) AS docs, count(*) AS total FROM t),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
x AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM f, g WHERE term IN (SELECT term FROM i) GROUP BY term),
s AS (SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM i JOIN x USING (term) JOIN f USING (term), g GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0) WHERE rank <= 50"""

ORACLES: dict[str, str] = {"op3_nearest_vectors": OP3, "op4_nearest_codes": OP4, "op5_scan_secrets": OP5, "op12_fill_in_middle": OP12, "op13_rank_documents": OP13}
