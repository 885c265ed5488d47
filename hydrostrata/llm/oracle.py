"""DuckDB SQL of the corpus queries that SQL can express."""

NEAR_DUPLICATES = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM w),
 n AS (SELECT doc_id, len(s) AS n FROM s),
 c AS (SELECT doc_id, unnest(s) AS sh FROM s),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM c a JOIN c b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
 both_ways AS (SELECT x AS a, y AS b FROM e UNION ALL SELECT y, x FROM e),
 r(a, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.c FROM r JOIN both_ways l ON r.a = l.a)
SELECT n.doc_id, n AS n_shingles, min(c) AS component_id, n.doc_id = min(c) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n
"""

REPEATED_SPANS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i FROM d)),
 f AS (SELECT k, min(doc_id) AS f FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)),
 o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM w JOIN f USING (k) WHERE f < doc_id),
 g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM o),
 sp AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, grp),
 seg AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM sp),
 t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM seg JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


def _vector_codes(rounds: int = 2, parts: int = 16, entries: int = 64) -> str:
    """Codes by nearest entry, ties to the lower index: distance and entry in one integer. Floors of negative quotients go down."""
    steps = [
        "k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS (SELECT vec_id, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM k, (SELECT unnest(range({parts})) AS part))",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < {entries})",
        "b0 AS (SELECT part, entry, x AS c FROM p JOIN f USING (vec_id))",
    ]
    for k in range(rounds + 1):
        apart = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
        steps.append(f"a{k} AS (SELECT vec_id, part, min({apart} * 256 + entry) AS m FROM p JOIN b{k} USING (part) GROUP BY vec_id, part)")
        if k < rounds:
            steps.append(f"s{k} AS (SELECT part, m % 256 AS entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT a{k}.part, m, x, unnest(range(1, len(x) + 1)) AS i FROM a{k} JOIN p ON p.vec_id = a{k}.vec_id AND p.part = a{k}.part) GROUP BY part, m % 256, i)")
            steps.append(f"n{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY part, entry)")
            steps.append(f"b{k + 1} AS (SELECT b{k}.part, b{k}.entry, coalesce(n{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN n{k} ON n{k}.part = b{k}.part AND n{k}.entry = b{k}.entry)")
    steps.append(f"o AS (SELECT vec_id, string_agg(printf('%02x', m % 256), '' ORDER BY part) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})")
    return "WITH " + ",\n ".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN k USING (vec_id), h\n"


VECTOR_CODES = _vector_codes()

#: crc32 is written out bit by bit: 0xEDB88320 is its polynomial. Each node adds to the nodes of all its prefixes.
PREFIX_TRIE = """
WITH t AS (SELECT conv_id, turn, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
 l AS (SELECT conv_id, list(x ORDER BY turn NULLS FIRST, x) AS x FROM t GROUP BY conv_id),
 c AS (SELECT conv_id, x, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 4 AS h FROM l),
 r AS (SELECT c.conv_id, list_concat(coalesce(b.x[1 : c.h], []), c.x[c.h + 1 :]) AS x FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
 p AS (SELECT conv_id, x, unnest(range(0, len(x) + 1)) AS depth FROM r),
 n AS (SELECT x[1 : depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(x[depth].t), '[^\\x20\\x09-\\x0D]+')) END AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(x) = depth), '')) AS ends_sha256 FROM p GROUP BY x[1 : depth], depth),
 u AS (SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id FROM n LEFT JOIN n m ON m.depth = n.depth - 1 AND m.k = n.k[1 : n.depth - 1]),
 w AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY 1, 2),
 f AS (SELECT n.*, u.parent_conv_id, coalesce(w.n_children, 0) AS n_children FROM n JOIN u USING (conv_id, depth) LEFT JOIN w USING (conv_id, depth)),
 a AS (SELECT k[1 : up] AS k, up AS depth, sum(saved) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves FROM (SELECT k, saved, n_children, unnest(range(0, depth + 1)) AS up FROM f) GROUP BY k[1 : up], up)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, CAST(a.leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, f.ends_sha256 FROM f JOIN a ON a.depth = f.depth AND a.k = f.k
"""
