"""DuckDB SQL that says what the queries say, where SQL can."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other),
roots AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN roots USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

# base 32 from hexadecimal digits: their bits in one line, then five at a time
ARCHIVES = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, b, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', (instr('0123456789abcdef', sha1(b)[i]) - 1) * 4 + 1, 4)), '') AS bits FROM p),
e AS (SELECT page_id, n, min(page_id) OVER (PARTITION BY b) AS f, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(bits[j*5+1] AS INT) * 16 + CAST(bits[j*5+2] AS INT) * 8 + CAST(bits[j*5+3] AS INT) * 4 + CAST(bits[j*5+4] AS INT) * 2 + CAST(bits[j*5+5] AS INT) + 1, 1)), '') AS payload_digest FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM e
"""


def secrets(rules) -> str:
    """Spans by what lies between matches: running lengths give the places."""
    parts = []
    for order, r in enumerate(rules):
        regex = r.regex.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {order} AS o, '{r.kind}' AS kind, string_split_regex(t, '{regex}') AS gaps, regexp_extract_all(t, '{regex}', 0) AS m, regexp_extract_all(t, '{regex}', {r.value_group}) AS v, {r.min_value} AS least FROM docs"
        )
    base = ", ".join(f"'{r.kind}'" for r in rules if r.base)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base)
    one = "kind || ':' || CAST(a AS VARCHAR) || ':' || CAST(a + n AS VARCHAR)"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
flat AS (SELECT doc_id, o, kind, least, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'i': i, 'a': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(m[1:i-1], lambda g: length(g))), 0), 'n': length(m[i]), 'v': length(v[i])}})) AS x FROM found WHERE len(m) > 0),
spans AS (SELECT doc_id, o, kind, CAST(x.a AS BIGINT) AS a, x.n AS n FROM flat WHERE x.v >= least),
sums AS (SELECT doc_id, {counts}, string_agg({one}, ',' ORDER BY a, o) FILTER (kind IN ({base})) AS base, string_agg({one}, ',' ORDER BY a, o) AS spans FROM spans GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules if r.base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN sums USING (doc_id)
"""
