"""DuckDB twins of the queries that SQL can express over whole tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

#: A-Z to a-z and nothing else
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"

ORACLE["op3_minhash_neardup"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                               WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.d)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT d, min(c) AS c FROM reach GROUP BY d) r ON r.d = d.doc_id
"""

ORACLE["op2_fair_queue_mixing"] = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD}))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight, 3 * source_size / [5, 2, 1][rank % 3 + 1] AS full_at FROM s),
f AS (SELECT *, sum(source_size) OVER () AS total,
        coalesce(sum(3 * source_size) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
        coalesce(sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, sum(weight) OVER () AS all_weight FROM w),
a AS (SELECT *, (total - taken)::BIGINT / (all_weight - gone)::BIGINT AS lvl FROM f),
v AS (SELECT lvl AS level FROM a WHERE full_at >= lvl ORDER BY full_at, rank LIMIT 1),
q AS (SELECT d.*, a.rank, a.weight, a.source_size, a.total::BIGINT AS total, least((3 * a.source_size)::DOUBLE, a.weight * v.level) AS target,
        sum(size) OVER (PARTITION BY a.rank ORDER BY digest, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
      FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source, v),
i AS (SELECT q.*, e, sum(size) OVER (ORDER BY (e * source_size + upto) / weight, rank, digest, doc_id, e ROWS UNBOUNDED PRECEDING) AS used FROM q, range(3) AS p(e))
SELECT doc_id, size, source_size, target, sum(CASE WHEN used <= total THEN size ELSE 0 END)::BIGINT AS taken
FROM i GROUP BY doc_id, size, source_size, target
"""

_SEP = r"'[\x20\x09-\x0D]+'"

ORACLE["op11_line_frequency"] = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
g AS (SELECT doc_id, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d),
f AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), {_SEP}, ' ', 'g')) AS norm, len(regexp_extract_all(line, {_WORD})) AS words
      FROM l WHERE regexp_matches(line, {_WORD})),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM f GROUP BY doc_id),
hosts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
often AS (SELECT o.source, norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS n FROM f GROUP BY source, norm) o
          JOIN hosts h ON h.source IS NOT DISTINCT FROM o.source WHERE o.n > 10 AND 100 * o.n > h.n),
gone AS (SELECT doc_id, count(*) AS lines, sum(words) AS words FROM f JOIN often o ON o.norm = f.norm AND o.source IS NOT DISTINCT FROM f.source GROUP BY doc_id),
r AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, {_SEP}, '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
        coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.lines, 0)::BIGINT AS removed_lines, coalesce(gone.words, 0)::BIGINT AS removed_words
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r)
SELECT *, NOT base_failed AND 100 * removed_words <= 50 * n_words AND n_words - removed_words >= 50 AS kept FROM v
"""

#: floor division of a sum by a positive count (SQL's integer division cuts towards zero)
_FLOOR = "((s - ((s % n) + n) % n) // n)"


def _codes_twin(rounds: int = 4) -> str:
    steps = [f"""
x AS MATERIALIZED (SELECT vec_id, label, (p - 1) // 16 AS part, (p - 1) % 16 AS pos, floor(1024 * embedding[p]::DOUBLE)::BIGINT AS v
      FROM (SELECT *, unnest(range(1, 65)) AS p FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)),
xp AS MATERIALIZED (SELECT vec_id, label, part, list(v ORDER BY pos) AS v FROM x GROUP BY ALL),
b0 AS MATERIALIZED (SELECT part, rank AS entry, v FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS rank FROM xp) WHERE rank < 256)"""]
    square = "+".join(f"(x.v[{i}] - b.v[{i}]) * (x.v[{i}] - b.v[{i}])" for i in range(1, 17))
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, label, part, any_value(v) AS v, min(e * 256 + entry) % 256 AS entry, min(e * 256 + entry) // 256 AS e
      FROM (SELECT x.vec_id, x.label, x.part, x.v, b.entry, {square} AS e FROM xp x JOIN b{r} b USING (part)) GROUP BY vec_id, label, part)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT part, entry, list({_FLOOR}::BIGINT ORDER BY pos) AS v FROM (SELECT part, entry, pos, sum(c)::BIGINT AS s, count(*)::BIGINT AS n
      FROM (SELECT part, entry, unnest(v) AS c, unnest(range(16)) AS pos FROM a{r}) GROUP BY part, entry, pos) GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (part, entry))""")
    return "WITH " + ",".join(steps) + f""",
c AS (SELECT vec_id, label, string_agg(lower(printf('%02x', entry::INTEGER)), '' ORDER BY part) AS code, sum(e)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM c
"""


def _centroids_twin(rounds: int = 3) -> str:
    steps = ["""
x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
b0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM x QUALIFY c < 16)"""]
    square = "+".join(f"(x.v[{i}] - b.v[{i}]) * (x.v[{i}] - b.v[{i}])" for i in range(1, 65))
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(e * 16 + c) % 16 AS c, min(e * 16 + c) // 16 AS e FROM (SELECT x.vec_id, x.v, b.c, {square} AS e FROM x, b{r} b) GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT c, list({_FLOOR}::BIGINT ORDER BY pos) AS v FROM (SELECT c, pos, sum(u)::BIGINT AS s, count(*)::BIGINT AS n
      FROM (SELECT c, unnest(v) AS u, unnest(range(64)) AS pos FROM a{r}) GROUP BY c, pos) GROUP BY c),
b{r + 1} AS MATERIALIZED (SELECT b.c, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (c))""")
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, a.c::INTEGER AS cluster, e::BIGINT AS distance, sum(e) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(e) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(b.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN b{rounds} b USING (c)
"""


ORACLE["op12_pivot_vector_codes"] = _codes_twin()
ORACLE["op13_pivot_centroids"] = _centroids_twin()
