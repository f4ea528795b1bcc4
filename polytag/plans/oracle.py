"""Second-engine SQL for the registered queries (run by DuckDB on the raw tables).

Each entry is self-contained: ``WITH`` + the view CTEs + the operator in SQL.
"""

from __future__ import annotations

from polytag.plans.sql_views import VIEW_L, long_cte, with_views

ORACLE: dict[str, str] = {}


def pair_ctes(view: str) -> str:
    """CTEs lng, tot, n1, n11, pt(i, j, N, n1i, n1j, n11) for every label pair of a view."""
    return f""",{long_cte(view, 'lng')},
tot AS (SELECT count(*) AS N FROM {view}),
n1 AS (SELECT j, CAST(sum(coalesce(t, 0)) AS BIGINT) AS n1 FROM lng GROUP BY j),
n11 AS (SELECT a.j AS i, b.j AS j, count(*) AS n11 FROM lng a JOIN lng b ON a.id = b.id AND a.t = 1 AND b.t = 1 GROUP BY a.j, b.j),
pt AS (
  SELECT x.j AS i, y.j AS j, N, x.n1 AS n1i, y.n1 AS n1j, CAST(coalesce(n11.n11, 0) AS BIGINT) AS n11
  FROM n1 x CROSS JOIN n1 y CROSS JOIN tot LEFT JOIN n11 ON n11.i = x.j AND n11.j = y.j
),
phi AS (
  SELECT i, j, N,
    CASE WHEN den <> 0 THEN (CAST(a AS DOUBLE) * CAST(d AS DOUBLE) - CAST(b AS DOUBLE) * CAST(c AS DOUBLE)) / den END AS phi
  FROM (
    SELECT i, j, N, a, b, c, d,
      sqrt(CAST(a + b AS DOUBLE) * CAST(c + d AS DOUBLE) * CAST(a + c AS DOUBLE) * CAST(b + d AS DOUBLE)) AS den
    FROM (SELECT i, j, N, N - n1i - n1j + n11 AS a, n1i - n11 AS b, n1j - n11 AS c, n11 AS d FROM pt) q
  ) r
)"""


def sql(name: str, text: str) -> None:
    ORACLE[name] = text


# ---------------------------------------------------------------- 2.3 statistics

sql("labelset_counts", with_views("v_order") + """
SELECT array_to_string(list_transform(y, lambda x: coalesce(CAST(x AS VARCHAR), '?')), '') AS bits,
       CAST(list_sum(list_transform(y, lambda x: coalesce(x, 0))) AS INTEGER) AS n_labels,
       count(*) AS count
FROM v_order GROUP BY y""")

sql("label_cardinality", with_views("v_userday") + """
SELECT count(*) AS n_examples,
       round(avg(list_sum(list_transform(y, lambda x: coalesce(x, 0)))), 6) AS cardinality,
       round(avg(list_sum(list_transform(y, lambda x: coalesce(x, 0)))) / 5, 6) AS density
FROM v_userday""")

sql("label_priors", with_views("v_tree") + "," + long_cte("v_tree", "lng") + """,
nat AS (SELECT CAST(n_nationkey AS INTEGER) AS j, n_name AS label FROM nation)
SELECT lng.j, nat.label, CAST(sum(coalesce(t, 0)) AS BIGINT) AS n,
       round(sum(coalesce(t, 0)) / count(*), 6) AS prior
FROM lng JOIN nat ON lng.j = nat.j GROUP BY lng.j, nat.label""")

sql("cardinality_histogram", with_views("v_tree") + """,
c AS (SELECT CAST(list_sum(list_transform(y, lambda x: coalesce(x, 0))) AS INTEGER) AS c, count(*) AS n FROM v_tree GROUP BY 1)
SELECT CAST(g.c AS INTEGER) AS c, CAST(coalesce(n, 0) AS BIGINT) AS n FROM range(26) g(c) LEFT JOIN c ON c.c = g.c""")

sql("ml_summary", with_views("v_order") + """
SELECT count(*) AS n_examples, 5 AS n_predictors, 2 AS n_nominal, 3 AS n_numeric, 6 AS n_labels,
       round(avg(list_sum(list_transform(y, lambda x: coalesce(x, 0)))), 6) AS cardinality,
       round(avg(list_sum(list_transform(y, lambda x: coalesce(x, 0)))) / 6, 6) AS density,
       count(DISTINCT y) AS n_labelsets
FROM v_order""")

sql("label_cooccurrence", with_views("v_tree") + pair_ctes("v_tree") + """
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, n11 AS n FROM pt WHERE i < j""")

sql("label_phi", with_views("v_userday") + pair_ctes("v_userday") + """
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(phi, 6) AS phi FROM phi""")

sql("phi_histogram", with_views("v_tree") + pair_ctes("v_tree") + """
SELECT CAST(least(floor((phi + 1) * 10.0), 19) AS INTEGER) AS bin, count(*) AS n
FROM phi WHERE i < j AND phi IS NOT NULL GROUP BY 1""")

sql("uncorrelated_labels", with_views("v_order") + pair_ctes("v_order") + """
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM phi WHERE abs(phi) <= 0.05""")

sql("top_correlated_labels", with_views("v_tree") + pair_ctes("v_tree") + """
SELECT CAST(i AS INTEGER) AS i, CAST(pos AS INTEGER) AS pos, CAST(j AS INTEGER) AS j FROM (
  SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY abs(phi) DESC NULLS LAST, j DESC) AS pos FROM phi
) WHERE pos <= 3
UNION ALL
SELECT CAST(g.i AS INTEGER), 4, 25 FROM range(25) g(i)""")

sql("phi_diagram", with_views("v_tree") + pair_ctes("v_tree") + """
SELECT CAST(k AS INTEGER) AS step_idx, round(CAST(k * 0.05 AS DOUBLE), 6) AS bound,
       round((625 - count(CASE WHEN abs(phi) <= k * 0.05 THEN 1 END)) / 25.0, 6) AS avg_correlated
FROM phi CROSS JOIN range(21) g(k) GROUP BY k""")

sql("chi2_pairs", with_views("v_order") + pair_ctes("v_order") + """
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(coalesce(phi * phi * N, 0.0001), 6) AS score,
       coalesce(phi * phi * N, 0.0001) > 6.635 AS dependent
FROM phi WHERE i < j""")

sql("label_mutual_information", with_views("v_userday") + pair_ctes("v_userday") + """,
cells AS (
  SELECT i, j, CAST(N AS DOUBLE) AS n, n11, n1i - n11 AS n10, n1j - n11 AS n01, N - n1i - n1j + n11 AS n00,
         n1i / CAST(N AS DOUBLE) AS px1, n1j / CAST(N AS DOUBLE) AS py1
  FROM pt WHERE i < j
)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(
    (CASE WHEN n11 > 0 THEN (n11 / n) * ln((n11 / n) / (px1 * py1)) ELSE 0.0 END)
  + (CASE WHEN n10 > 0 THEN (n10 / n) * ln((n10 / n) / (px1 * (1 - py1))) ELSE 0.0 END)
  + (CASE WHEN n01 > 0 THEN (n01 / n) * ln((n01 / n) / ((1 - px1) * py1)) ELSE 0.0 END)
  + (CASE WHEN n00 > 0 THEN (n00 / n) * ln((n00 / n) / ((1 - px1) * (1 - py1))) ELSE 0.0 END), 3) AS mi
FROM cells""")

sql("label_cosine_distance", with_views("v_order") + pair_ctes("v_order") + """,
c AS (SELECT i, j, 1.0 - 2.0 * (n1i + n1j - 2 * n11) / N AS cos FROM pt),
c0 AS (SELECT i, j, CASE WHEN cos = 0 THEN 4.9e-324 ELSE cos END AS cos FROM c)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(-ln(abs(cos)), 6) AS d, round(cos, 6) AS cos FROM c0""")


# ---------------------------------------------------------------- helpers shared by later sections

M = 2147483647


def h_sql(key: str, seed: int = 0) -> str:
    """SQL twin of labelsets.stable_hash."""
    k = f"((CAST({key} AS BIGINT) + {seed * 7919 + 1}) % {M})"
    h1 = f"(({k} * 48271) % {M})"
    return f"(({h1} * 48271) % {M})"


def h2_sql(key: str, j: str, seed: int = 0) -> str:
    """SQL twin of labelsets.stable_hash2."""
    return h_sql(f"(({h_sql(key, seed)} + CAST({j} AS BIGINT) * 104729) % {M})", seed)


def u_sql(key: str, seed: int = 0) -> str:
    return f"(CAST({h_sql(key, seed)} AS DOUBLE) / CAST({M} AS DOUBLE))"


def u2_sql(key: str, j: str, seed: int = 0) -> str:
    return f"(CAST({h2_sql(key, j, seed)} AS DOUBLE) / CAST({M} AS DOUBLE))"


def bits_sql(arr: str) -> str:
    return f"array_to_string(list_transform({arr}, lambda x: coalesce(CAST(x AS VARCHAR), '?')), '')"


def size_sql(arr: str) -> str:
    return f"CAST(list_sum(list_transform({arr}, lambda x: coalesce(x, 0))) AS INTEGER)"


SCORE_LONG = """
sc AS (
  SELECT id, CAST(g.j AS INTEGER) AS j, y[g.j + 1] AS t, ((id * 31 + g.j * 17) % 10) / 10.0 AS s
  FROM v_userday CROSS JOIN range(5) g(j)
)"""

# ---------------------------------------------------------------- 2.2

sql("label_columns", with_views("v_order") + """
SELECT name, CAST(pos AS INTEGER) AS pos, role, n_nonnull FROM (
  SELECT 'id' AS name, 0 AS pos, 'id' AS role, count(id) AS n_nonnull FROM v_order
  UNION ALL SELECT 'f_prio', 1, 'feature', count(f_prio) FROM v_order
  UNION ALL SELECT 'f_status', 2, 'feature', count(f_status) FROM v_order
  UNION ALL SELECT 'f_lines', 3, 'feature', count(f_lines) FROM v_order
  UNION ALL SELECT 'f_qty', 4, 'feature', count(f_qty) FROM v_order
  UNION ALL SELECT 'f_price', 5, 'feature', count(f_price) FROM v_order
  UNION ALL SELECT 'AF', 6, 'label', count(y[1]) FROM v_order
  UNION ALL SELECT 'AO', 7, 'label', count(y[2]) FROM v_order
  UNION ALL SELECT 'NF', 8, 'label', count(y[3]) FROM v_order
  UNION ALL SELECT 'NO', 9, 'label', count(y[4]) FROM v_order
  UNION ALL SELECT 'RF', 10, 'label', count(y[5]) FROM v_order
  UNION ALL SELECT 'RO', 11, 'label', count(y[6]) FROM v_order
)""")

sql("labels_by_position", with_views("v_order") + f"""
SELECT id, {bits_sql('y')} AS bits FROM v_order""")

sql("drop_labels", with_views("v_order") + """
SELECT id, f_prio, f_status, f_lines, f_qty, f_price FROM v_order""")

sql("keep_labels", with_views("v_order") + f"""
SELECT id, {bits_sql('[y[1], y[4], y[5]]')} AS bits FROM v_order""")

sql("rows_missing_labels", with_views("v_doc") + """
SELECT id, CAST(len(list_filter(y, lambda x: x IS NULL)) AS INTEGER) AS n_missing
FROM v_doc WHERE len(list_filter(y, lambda x: x IS NULL)) > 0""")

sql("label_depth", with_views("v_tree") + """
SELECT label, CAST(depth AS INTEGER) AS depth FROM label_tree""")

sql("label_descendants", with_views("v_tree") + """
SELECT parent AS label, label AS descendant FROM label_tree WHERE parent IS NOT NULL""")

sql("ml_validate", with_views("v_tree") + """
SELECT * FROM (VALUES ('too_few_labels', CAST(0 AS BIGINT)), ('label_not_in_data', CAST(0 AS BIGINT))) v(rule, n)
UNION ALL
SELECT 'bad_value', CAST(count(CASE WHEN len(list_filter(y, lambda x: x IS NOT NULL AND x NOT IN (0, 1))) > 0 THEN 1 END) AS BIGINT) FROM v_tree
UNION ALL
SELECT 'child_without_parent', CAST(0 AS BIGINT)""")

sql("labelset_bits", with_views("v_order") + f"""
SELECT id, {bits_sql('y')} AS bits, true AS roundtrip FROM v_order""")

sql("labelset_size", with_views("v_tree") + f"""
SELECT id, {size_sql('y')} AS size FROM v_tree""")

sql("labelset_hamming", with_views("v_userday") + "," + SCORE_LONG + """
SELECT id, CAST(sum(CASE WHEN CAST(s >= 0.5 AS INTEGER) <> t THEN 1 ELSE 0 END) AS INTEGER) AS hamming FROM sc GROUP BY id""")

sql("labelset_intersection", with_views("v_userday") + "," + SCORE_LONG + """
SELECT id, string_agg(CAST(t * CAST(s >= 0.5 AS INTEGER) AS VARCHAR), '' ORDER BY j) AS bits FROM sc GROUP BY id""")

sql("labelset_subsets", with_views("v_order") + f""",
sets AS (SELECT DISTINCT y FROM v_order),
pos AS (SELECT y, list_filter(range(6), lambda j: y[j + 1] = 1) AS p FROM sets),
m AS (SELECT y, p, g.m FROM pos CROSS JOIN LATERAL (SELECT unnest(range(1, CAST((1 << len(p)) - 1 AS BIGINT))) AS m) g)
SELECT {bits_sql('y')} AS bits,
       array_to_string(list_transform(range(6), lambda j:
         CASE WHEN y[j + 1] = 1 AND ((m >> (list_position(p, j) - 1)) & 1) = 1 THEN '1' ELSE '0' END), '') AS sub_bits
FROM m""")

sql("rank_from_scores", with_views("v_userday") + "," + SCORE_LONG + """
SELECT id, j, CAST(row_number() OVER (PARTITION BY id ORDER BY s DESC, j DESC) AS INTEGER) AS rank FROM sc""")

sql("bipartition_at", with_views("v_userday") + "," + SCORE_LONG + """
SELECT id, string_agg(CAST(CAST(s >= 0.5 AS INTEGER) AS VARCHAR), '' ORDER BY j) AS bits FROM sc GROUP BY id""")

sql("argmax_random_tie", with_views("v_userday") + "," + SCORE_LONG + f""",
mx AS (SELECT id, max(s) AS mx FROM sc GROUP BY id)
SELECT id, CAST(arg_min(j, {h2_sql('id', 'j', 3)}) AS INTEGER) AS j
FROM sc JOIN mx USING (id) WHERE s = mx GROUP BY id""")

sql("minmax_scale", with_views("v_order") + """,
mm AS (SELECT min(o_totalprice) a0, max(o_totalprice) b0, CAST(min(n_lines) AS DOUBLE) a1, CAST(max(n_lines) AS DOUBLE) b1,
              CAST(min(sum_qty) AS DOUBLE) a2, CAST(max(sum_qty) AS DOUBLE) b2 FROM v_order)
SELECT id,
  round(CASE WHEN b0 = a0 THEN -1.0 ELSE -1.0 + (o_totalprice - a0) / (b0 - a0) * 2.0 END, 6) AS o_totalprice,
  round(CASE WHEN b1 = a1 THEN -1.0 ELSE -1.0 + (CAST(n_lines AS DOUBLE) - a1) / (b1 - a1) * 2.0 END, 6) AS n_lines,
  round(CASE WHEN b2 = a2 THEN -1.0 ELSE -1.0 + (CAST(sum_qty AS DOUBLE) - a2) / (b2 - a2) * 2.0 END, 6) AS sum_qty
FROM v_order CROSS JOIN mm""")

# ---------------------------------------------------------------- 2.4

ORDER_FEATS = "f_prio, f_status, f_lines, f_qty, f_price"

sql("tr_binary_relevance", with_views("v_order") + f"""
SELECT id, {ORDER_FEATS}, CAST(g.j AS INTEGER) AS j, y[g.j + 1] AS class FROM v_order CROSS JOIN range(6) g(j)""")

sql("tr_label_powerset", with_views("v_order") + f"""
SELECT id, {ORDER_FEATS}, {bits_sql('y')} AS class FROM v_order""")

sql("tr_pairwise", with_views("v_userday") + "," + long_cte("v_userday", "lng") + """
SELECT a.id, a.j AS a, b.j AS b, a.t AS class FROM lng a JOIN lng b ON a.id = b.id AND a.j < b.j AND a.t <> b.t""")

sql("tr_include_labels", with_views("v_userday") + "," + long_cte("v_userday", "lng") + """
SELECT id, (['click', 'error', 'purchase', 'signup', 'view'])[j + 1] AS label, t AS class FROM lng""")

sql("tr_copy", with_views("v_userday") + "," + long_cte("v_userday", "lng") + """
SELECT id, j, 'Class' || CAST(j + 1 AS VARCHAR) AS class FROM lng WHERE t = 1""")

sql("tr_copy_weight", with_views("v_userday") + "," + long_cte("v_userday", "lng") + """
SELECT id, j, 'Class' || CAST(j + 1 AS VARCHAR) AS class, round(1.0 / sum(t) OVER (PARTITION BY id), 6) AS weight
FROM lng WHERE t = 1""")

sql("tr_ignore", with_views("v_userday") + "," + long_cte("v_userday", "lng") + """
SELECT id, j, 'Class' || CAST(j + 1 AS VARCHAR) AS class FROM (
  SELECT *, sum(t) OVER (PARTITION BY id) AS n FROM lng) WHERE t = 1 AND n = 1""")

_SEL = with_views("v_tree") + "," + long_cte("v_tree", "lng") + """,
cnt AS (SELECT j, sum(t) AS c FROM lng GROUP BY j)"""

sql("tr_select_max", _SEL + """
SELECT id, CAST(arg_min(lng.j, -c * 1000 + lng.j) AS INTEGER) AS j,
       'Class' || CAST(arg_min(lng.j, -c * 1000 + lng.j) + 1 AS VARCHAR) AS class
FROM lng JOIN cnt USING (j) WHERE t = 1 GROUP BY id""")

sql("tr_select_min", _SEL + """
SELECT id, CAST(arg_min(lng.j, c * 1000 + lng.j) AS INTEGER) AS j,
       'Class' || CAST(arg_min(lng.j, c * 1000 + lng.j) + 1 AS VARCHAR) AS class
FROM lng JOIN cnt USING (j) WHERE t = 1 GROUP BY id""")

sql("tr_select_random", with_views("v_tree") + "," + long_cte("v_tree", "lng") + f"""
SELECT id, CAST(arg_min(j, {h2_sql('id', 'j', 5)} * 100 + j) AS INTEGER) AS j,
       'Class' || CAST(arg_min(j, {h2_sql('id', 'j', 5)} * 100 + j) + 1 AS VARCHAR) AS class
FROM lng WHERE t = 1 GROUP BY id""")

sql("tr_multiclass_schema", with_views("v_userday") + "," + long_cte("v_userday", "lng") + """
SELECT CAST(g.j AS INTEGER) AS j, 'Class' || CAST(g.j + 1 AS VARCHAR) AS class, coalesce(n, 0) AS n_rows
FROM range(5) g(j) LEFT JOIN (SELECT j, count(*) AS n FROM lng WHERE t = 1 GROUP BY j) c ON c.j = g.j""")

sql("tr_single_target", with_views("v_target") + """
SELECT id, round(o_totalprice, 6) AS o_totalprice, round(n_lines, 6) AS n_lines, round(prio, 6) AS prio,
       round(target[2], 6) AS class FROM v_target""")

sql("tr_chain", with_views("v_target") + """
SELECT id, round(o_totalprice, 6) AS o_totalprice, round(n_lines, 6) AS n_lines, round(prio, 6) AS prio,
       round(target[3], 6) AS t2, round(target[1], 6) AS t0, round(target[2], 6) AS class FROM v_target""")

sql("tr_hierarchical", with_views("v_tree") + f""",
reg AS (SELECT id, list(CASE WHEN EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey = r.r_regionkey AND y[n.n_nationkey + 1] = 1)
                        THEN 1 ELSE 0 END ORDER BY r.r_regionkey) AS meta
        FROM v_tree CROSS JOIN region r GROUP BY id)
SELECT id, {bits_sql('list_concat(y, meta)')} AS bits FROM v_tree JOIN reg USING (id)""")

_PRUNE = with_views("v_tree") + f""",
cnt AS (SELECT y, {bits_sql('y')} AS bits, count(*) AS count FROM v_tree GROUP BY y),
rare AS (SELECT * FROM cnt WHERE count <= 3),
freq AS (SELECT * FROM cnt WHERE count > 3),
subs AS (
  SELECT r.bits, r.count, f.bits AS sub_bits, f.count AS sub_count,
         len(list_filter(f.y, lambda x: x = 1)) AS sub_size
  FROM rare r JOIN freq f
    ON len(list_filter(f.y, lambda x: x = 1)) < len(list_filter(r.y, lambda x: x = 1))
   AND len(list_filter(f.y, lambda x: x = 1)) > 0
   AND list_bool_and(list_transform(range(25), lambda j: f.y[j + 1] <= r.y[j + 1]))
)"""

sql("tr_prune_ps_a", _PRUNE + """
SELECT bits, bits AS new_bits, count FROM freq
UNION ALL
SELECT bits, sub_bits, count FROM (
  SELECT *, row_number() OVER (PARTITION BY bits ORDER BY sub_size DESC, sub_count DESC, sub_bits DESC) AS rk FROM subs
) WHERE rk <= 2""")

sql("tr_prune_ps_b", _PRUNE + """
SELECT bits, bits AS new_bits, count FROM freq
UNION ALL
SELECT bits, sub_bits, count FROM subs WHERE sub_size > 1""")

sql("tr_prune_ppt", _PRUNE.replace("WITH ", "WITH RECURSIVE ", 1) + """,
cand AS (SELECT *, row_number() OVER (PARTITION BY bits ORDER BY sub_size DESC, sub_count DESC, sub_bits DESC) AS pos FROM subs),
greedy AS (
  SELECT bits, 0 AS pos, CAST(repeat('0', 25) AS BIT) AS used, CAST([] AS VARCHAR[]) AS picked FROM rare
  UNION ALL
  SELECT g.bits, c.pos,
         CASE WHEN bit_count(g.used & CAST(c.sub_bits AS BIT)) = 0 THEN g.used | CAST(c.sub_bits AS BIT) ELSE g.used END,
         CASE WHEN bit_count(g.used & CAST(c.sub_bits AS BIT)) = 0 THEN list_append(g.picked, c.sub_bits) ELSE g.picked END
  FROM greedy g JOIN cand c ON c.bits = g.bits AND c.pos = g.pos + 1
),
final AS (SELECT bits, arg_max(picked, pos) AS picked FROM greedy GROUP BY bits)
SELECT bits, bits AS new_bits, count FROM freq
UNION ALL
SELECT f.bits, unnest(f.picked) AS new_bits, r.count FROM final f JOIN rare r USING (bits)""")

# ---------------------------------------------------------------- 2.5

def salted_rank_sql(src: str, group: str, h: str) -> str:
    """row_number in (salt, h, id) order inside ``group`` (constant group when empty), salt = h mod buckets."""
    part = f"PARTITION BY {group}" if group else ""
    return f"""(
  SELECT *, row_number() OVER ({part} ORDER BY _h % _nb, _h, id) AS _rk FROM (
    SELECT *, CAST(greatest(1, ceil(count(*) OVER ({part}) / 1000000.0)) AS BIGINT) AS _nb FROM (
      SELECT *, {h} AS _h FROM {src}) a) b)"""


sql("cv_folds", with_views("v_userday") + f"""
SELECT id, CAST((_rk - 1) % 10 AS INTEGER) AS fold FROM {salted_rank_sql('v_userday', '', h_sql('id', 1))} r""")

sql("strat_label_powerset", with_views("v_order") + f""",
x AS (SELECT id, {bits_sql('y')} AS bits FROM v_order),
so AS (SELECT bits, coalesce(sum(n) OVER (ORDER BY bits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _so
       FROM (SELECT bits, count(*) AS n FROM x GROUP BY bits))
SELECT id, CAST((_so + _rk - 1) % 5 AS INTEGER) AS fold
FROM {salted_rank_sql('x', 'bits', h_sql('id', 2))} r JOIN so USING (bits)""")

sql("holdout_split", with_views("v_order") + f"""
SELECT id, CASE WHEN {u_sql('id', 3)} * 100 < 67.0 THEN 'train' ELSE 'test' END AS part FROM v_order""")


def _poisson_sql(u: str) -> str:
    from polytag.operators.split import poisson1_thresholds

    return " + ".join(f"(CASE WHEN {u} >= {t!r} THEN 1 ELSE 0 END)" for t in poisson1_thresholds())


sql("sample_bootstrap", with_views("v_userday") + f"""
SELECT id, CAST(g.m AS INTEGER) AS model, CAST({_poisson_sql(u2_sql('id', 'g.m', 4))} AS INTEGER) AS weight
FROM v_userday CROSS JOIN range(5) g(m)""")

sql("sample_subset", with_views("v_userday") + f"""
SELECT id, CAST(g.m AS INTEGER) AS model FROM v_userday CROSS JOIN range(5) g(m)
WHERE {u2_sql('id', 'g.m', 5)} * 100 < 67.0""")


# ---------------------------------------------------------------- 2.10 evaluation

def scored_ctes(view: str) -> str:
    """sc(id, j, t, s, b, rk) for complete rows of a view with the synthetic tied scores."""
    L = VIEW_L[view]
    return f""",
base AS (
  SELECT id, CAST(g.j AS INTEGER) AS j, y[g.j + 1] AS t, ((id * 31 + g.j * 17) % 10) / 10.0 AS s
  FROM {view} CROSS JOIN range({L}) g(j)
  WHERE len(list_filter(y, lambda x: x IS NULL)) = 0
),
sc AS (SELECT *, CAST(s >= 0.5 AS INTEGER) AS b, row_number() OVER (PARTITION BY id ORDER BY s DESC, j DESC) AS rk FROM base),
pr AS (
  SELECT id, count(*) AS L,
    CAST(sum(CASE WHEN t = 1 AND b = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
    CAST(sum(CASE WHEN t = 0 AND b = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
    CAST(sum(CASE WHEN t = 1 AND b = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
    CAST(sum(CASE WHEN t = 0 AND b = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn,
    sum(t) AS n_rel, sum(1 - t) AS n_irr,
    max(CASE WHEN t = 1 THEN rk END) AS max_rel, min(CASE WHEN t = 0 THEN rk END) AS min_irr,
    max(CASE WHEN rk = 1 THEN t END) AS top_t,
    -sum(t * ln(least(greatest(s, 1e-8), 1 - 1e-8)) + (1 - t) * ln(1 - least(greatest(s, 1e-8), 1 - 1e-8))) AS ll,
    sum((s - t) * (s - t)) AS se
  FROM sc GROUP BY id
),
apr AS (
  SELECT a.id, avg((SELECT count(*) FROM sc b WHERE b.id = a.id AND b.t = 1 AND b.rk <= a.rk) / CAST(a.rk AS DOUBLE)) AS ap
  FROM sc a WHERE a.t = 1 GROUP BY a.id
),
essr AS (
  SELECT p.id, count(q.id) AS ess FROM pr p LEFT JOIN (
    SELECT a.id FROM sc a JOIN sc b ON a.id = b.id AND a.t = 1 AND b.t = 0 AND a.rk > b.rk) q ON q.id = p.id
  GROUP BY p.id
),
rowm AS (
  SELECT pr.id,
    (fp + fn) / L AS hamming_loss,
    CASE WHEN fp + fn = 0 THEN 1.0 ELSE 0.0 END AS subset_accuracy,
    CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS ex_precision,
    CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS ex_recall,
    CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE (2 * tp) / (2 * tp + fn + fp) END AS ex_fmeasure,
    CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE tp / (tp + fp + fn) END AS ex_accuracy,
    CASE WHEN tn + fp + fn = 0 THEN 1.0 WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS ex_specificity,
    CASE WHEN n_rel > 0 THEN apr.ap END AS average_precision,
    1 - coalesce(apr.ap, 0.0) AS one_minus_ap,
    CAST(CASE WHEN n_rel > 0 THEN max_rel - 1 ELSE 0 END AS DOUBLE) AS coverage,
    CASE WHEN top_t = 1 THEN 0.0 ELSE 1.0 END AS one_error,
    CASE WHEN n_rel > 0 AND n_irr > 0 AND max_rel > min_irr THEN 1.0 ELSE 0.0 END AS is_error,
    CAST(ess AS DOUBLE) AS error_set_size,
    CASE WHEN n_rel > 0 AND n_irr > 0 THEN ess / CAST(n_rel * n_irr AS DOUBLE) ELSE 0.0 END AS ranking_loss,
    ll AS log_loss, se AS squared_error
  FROM pr LEFT JOIN apr USING (id) JOIN essr USING (id)
),
exm AS (
  SELECT avg(hamming_loss) AS hamming_loss, avg(subset_accuracy) AS subset_accuracy, avg(ex_precision) AS ex_precision,
    avg(ex_recall) AS ex_recall, avg(ex_fmeasure) AS ex_fmeasure, avg(ex_accuracy) AS ex_accuracy,
    avg(ex_specificity) AS ex_specificity, avg(average_precision) AS average_precision, avg(one_minus_ap) AS one_minus_ap,
    avg(coverage) AS coverage, avg(one_error) AS one_error, avg(is_error) AS is_error, avg(error_set_size) AS error_set_size,
    avg(ranking_loss) AS ranking_loss, avg(log_loss) AS log_loss, avg(squared_error) AS mse, sqrt(avg(squared_error)) AS rmse
  FROM rowm
),
cf AS (
  SELECT j, CAST(sum(CASE WHEN t = 1 AND b = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
    CAST(sum(CASE WHEN t = 0 AND b = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
    CAST(sum(CASE WHEN t = 1 AND b = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
    CAST(sum(CASE WHEN t = 0 AND b = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn
  FROM sc GROUP BY j
),
plm AS (
  SELECT j,
    CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
    CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
    CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE (2 * tp) / (2 * tp + fn + fp) END AS fmeasure,
    CASE WHEN tn + fp + fn = 0 THEN 1.0 WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS specificity
  FROM cf
),
pooled AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM cf),
micro AS (
  SELECT CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS micro_precision,
    CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS micro_recall,
    CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE (2 * tp) / (2 * tp + fn + fp) END AS micro_fmeasure,
    CASE WHEN tn + fp + fn = 0 THEN 1.0 WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS micro_specificity
  FROM pooled
),
curve AS (
  SELECT j, id, t,
    row_number() OVER (PARTITION BY j ORDER BY s DESC, id ASC) AS pos,
    sum(t) OVER (PARTITION BY j ORDER BY s DESC, id ASC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits,
    sum(t) OVER (PARTITION BY j) AS R
  FROM sc
),
curve2 AS (
  SELECT *, hits / CAST(pos AS DOUBLE) AS prec FROM curve
),
curve3 AS (
  SELECT *, max(prec) OVER (PARTITION BY j ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pmax FROM curve2
),
lap AS (
  SELECT j, max(R) AS R, CASE WHEN max(R) > 0 THEN sum(CASE WHEN t = 1 THEN prec ELSE 0.0 END) / max(R) END AS ap FROM curve2 GROUP BY j
),
lvl AS (
  SELECT j, g.i, min(pos) AS pos FROM curve3 CROSS JOIN range(10) g(i) WHERE R > 0 AND hits * 9 >= g.i * R GROUP BY j, g.i
),
liap AS (
  SELECT l.j, avg(c.pmax) AS iap FROM lvl l JOIN curve3 c ON c.j = l.j AND c.pos = l.pos GROUP BY l.j
),
lcurve AS (SELECT lap.j, ap, iap FROM lap LEFT JOIN liap USING (j)),
dsc AS (SELECT j, s, CAST(sum(t) AS DOUBLE) AS pos, CAST(sum(1 - t) AS DOUBLE) AS neg FROM sc GROUP BY j, s),
dsc2 AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY j ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM dsc),
lauc AS (
  SELECT j, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg * 0.5)) / (sum(pos) * sum(neg)) END AS auc FROM dsc2 GROUP BY j
),
msc AS (SELECT s, CAST(sum(t) AS DOUBLE) AS pos, CAST(sum(1 - t) AS DOUBLE) AS neg FROM sc GROUP BY s),
msc2 AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM msc),
mauc AS (SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg * 0.5)) / (sum(pos) * sum(neg)) END AS micro_auc FROM msc2),
curvem AS (
  SELECT avg(ap) AS map,
    CASE WHEN count(*) > count(ap) THEN 'NaN'::DOUBLE WHEN min(ap) = 0 THEN 0.0 ELSE exp(avg(ln(ap))) END AS gmap,
    avg(iap) AS miap,
    CASE WHEN count(*) > count(iap) THEN 'NaN'::DOUBLE WHEN min(iap) = 0 THEN 0.0 ELSE exp(avg(ln(iap))) END AS gmiap
  FROM lcurve
)"""


_EV_UD = with_views("v_userday") + scored_ctes("v_userday")

for _m in ("hamming_loss", "subset_accuracy", "ex_precision", "ex_recall", "ex_specificity", "ex_fmeasure",
           "ex_accuracy", "average_precision", "one_minus_ap", "coverage", "one_error", "is_error",
           "error_set_size", "ranking_loss", "log_loss", "mse", "rmse"):
    sql(f"ev_{_m}", _EV_UD + f"\nSELECT '{_m}' AS measure, round({_m}, 6) AS value FROM exm")

for _s in ("precision", "recall", "fmeasure", "specificity"):
    sql(f"ev_micro_{_s}", _EV_UD + f"\nSELECT 'micro_{_s}' AS measure, round(micro_{_s}, 6) AS value FROM micro")
    sql(f"ev_macro_{_s}", _EV_UD + f"""
SELECT CAST(j AS INTEGER) AS j, round({_s}, 6) AS value FROM plm
UNION ALL SELECT CAST(NULL AS INTEGER), round(avg({_s}), 6) FROM plm""")

sql("ev_map", _EV_UD + """
SELECT CAST(j AS INTEGER) AS j, round(ap, 6) AS value FROM lcurve
UNION ALL SELECT CAST(NULL AS INTEGER), round(avg(ap), 6) FROM lcurve""")

for _m in ("gmap", "miap", "gmiap"):
    sql(f"ev_{_m}", _EV_UD + f"\nSELECT '{_m}' AS measure, round({_m}, 6) AS value FROM curvem")

sql("ev_micro_auc", _EV_UD + "\nSELECT 'micro_auc' AS measure, round(micro_auc, 6) AS value FROM mauc")

sql("ev_macro_auc", _EV_UD + """
SELECT CAST(j AS INTEGER) AS j, round(auc, 6) AS value FROM lauc
UNION ALL SELECT CAST(NULL AS INTEGER), round(avg(auc), 6) FROM lauc""")

sql("ev_ir_guarded", _EV_UD + """
SELECT CAST(tp AS INTEGER) AS tp, CAST(fp AS INTEGER) AS fp, CAST(fn AS INTEGER) AS fn, CAST(tn AS INTEGER) AS tn, count(*) AS n,
  round(CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE (2 * tp) / (2 * tp + fn + fp) END, 6) AS fmeasure,
  round(CASE WHEN tn + fp + fn = 0 THEN 1.0 WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END, 6) AS specificity
FROM pr GROUP BY tp, fp, fn, tn""")


def _ev_all(view: str) -> str:
    return with_views(view) + scored_ctes(view) + """,
allm AS (
  UNPIVOT (SELECT * FROM exm) ON COLUMNS(*) INTO NAME measure VALUE value
  UNION ALL UNPIVOT (SELECT * FROM micro) ON COLUMNS(*) INTO NAME measure VALUE value
  UNION ALL SELECT 'macro_precision', avg(precision) FROM plm
  UNION ALL SELECT 'macro_recall', avg(recall) FROM plm
  UNION ALL SELECT 'macro_fmeasure', avg(fmeasure) FROM plm
  UNION ALL SELECT 'macro_specificity', avg(specificity) FROM plm
  UNION ALL UNPIVOT (SELECT * FROM curvem) ON COLUMNS(*) INTO NAME measure VALUE value
  UNION ALL SELECT 'macro_auc', avg(auc) FROM lauc
  UNION ALL SELECT 'micro_auc', micro_auc FROM mauc
)
SELECT measure, round(CAST(value AS DOUBLE), 6) AS value FROM allm"""


sql("ev_all", _ev_all("v_userday"))
sql("ev_all_missing", _ev_all("v_doc"))

sql("ev_hierarchical_loss", with_views("v_tree") + "," + long_cte("v_tree", "lng") + """,
reg AS (
  SELECT id, list(rv ORDER BY r) AS meta FROM (
    SELECT lng.id, n.n_regionkey AS r, max(lng.t) AS rv FROM lng JOIN nation n ON n.n_nationkey = lng.j GROUP BY lng.id, n.n_regionkey)
  GROUP BY id
),
hy AS (SELECT id, list_concat(y, meta) AS y FROM v_tree JOIN reg USING (id)),
hl AS (
  SELECT id, CAST(g.j AS INTEGER) AS j, y[g.j + 1] AS t, CAST(((id * 31 + g.j * 17) % 10) / 10.0 >= 0.5 AS INTEGER) AS b
  FROM hy CROSS JOIN range(30) g(j)
),
par AS (SELECT CAST(n_nationkey AS INTEGER) AS j, CAST(n_regionkey + 25 AS INTEGER) AS p FROM nation),
per AS (
  SELECT c.id, sum(CASE WHEN c.t <> c.b AND (par.p IS NULL OR pp.t = pp.b) THEN 1 ELSE 0 END) AS h
  FROM hl c LEFT JOIN par ON par.j = c.j LEFT JOIN hl pp ON pp.id = c.id AND pp.j = par.p
  GROUP BY c.id
)
SELECT round(avg(h), 6) AS hierarchical_loss FROM per""")


# ---------------------------------------------------------------- 2.7 learners: naive Bayes in SQL

def nb_sql(keys: list[str], rows: str, rfl: str, classes: str, sfl: str, srows: str, p: str, wcol: str | None = None,
           key_sfl: str | None = None) -> str:
    """CTEs fitting count-based naive Bayes for every key and scoring every row.

    rows(keys, id, t): model rows; rfl(keys, id, t, f, v): their feature pairs; classes(keys, t);
    sfl(id, f, v): feature pairs of the rows to score; srows(id): rows to score.  Produces
    {p}_score(id, keys, t, s).  CTE names are prefixed with ``p``.  ``key_sfl(id, keys, f, v)``
    optionally adds feature pairs that belong to one model key only."""
    K = ", ".join(keys)
    kj = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    cnt = f"sum(CAST({wcol} AS DOUBLE))" if wcol else "count(*)"
    wk = ", ".join("w." + k for k in keys)
    if key_sfl is None:
        scw = f"""{p}_scw AS (SELECT s.id, {wk}, w.t, sum(w.w) AS w FROM {sfl} s JOIN {p}_wt w ON w.f = s.f AND w.v = s.v
            GROUP BY s.id, {wk}, w.t)"""
    else:
        kk = " AND ".join(f"w.{k} = s.{k}" for k in keys)
        scw = f"""{p}_scw0 AS (SELECT s.id, {wk}, w.t, w.w FROM {sfl} s JOIN {p}_wt w ON w.f = s.f AND w.v = s.v
             UNION ALL SELECT s.id, {wk}, w.t, w.w FROM {key_sfl} s JOIN {p}_wt w ON w.f = s.f AND w.v = s.v AND {kk}),
{p}_scw AS (SELECT id, {K}, t, sum(w) AS w FROM {p}_scw0 GROUP BY id, {K}, t)"""
    return f""",
{p}_cnt AS (SELECT {K}, f, v, t, {cnt} AS c FROM {rfl} GROUP BY {K}, f, v, t),
{p}_nt0 AS (SELECT {K}, t, {cnt} AS n FROM {rows} GROUP BY {K}, t),
{p}_nt AS (SELECT a.*, CAST(coalesce(b.n, 0) AS DOUBLE) AS n FROM {classes} a LEFT JOIN {p}_nt0 b ON {kj} AND a.t = b.t),
{p}_vf AS (SELECT f, count(DISTINCT v) AS nv FROM {rfl} GROUP BY f),
{p}_fk AS (SELECT DISTINCT {K}, f FROM {rfl}),
{p}_lg AS (
  SELECT {", ".join("a." + k for k in keys)}, a.t, sum(ln(a.n + vf.nv)) AS lg
  FROM {p}_nt a JOIN {p}_fk b ON {kj} JOIN {p}_vf vf ON vf.f = b.f GROUP BY {", ".join("a." + k for k in keys)}, a.t),
{p}_tot AS (SELECT {K}, sum(n) AS N, count(*) AS KK FROM {p}_nt GROUP BY {K}),
{p}_kc AS (
  SELECT {", ".join("a." + k for k in keys)}, a.t, ln((a.n + 1.0) / (b.N + b.KK)) - coalesce(c.lg, 0.0) AS kc
  FROM {p}_nt a JOIN {p}_tot b ON {kj} LEFT JOIN {p}_lg c ON {" AND ".join(f"a.{k} = c.{k}" for k in keys)} AND a.t = c.t),
{p}_wt AS (SELECT {K}, f, v, t, ln(c + 1.0) AS w FROM {p}_cnt),
{scw},
{p}_score AS (
  SELECT r.id, {", ".join("a." + k for k in keys)}, a.t, a.kc + coalesce(b.w, 0.0) AS s
  FROM {srows} r CROSS JOIN {p}_kc a LEFT JOIN {p}_scw b ON b.id = r.id AND {kj} AND a.t = b.t)"""


_ORDER_TRAIN = with_views("v_order") + f""",
tr AS (SELECT * FROM v_order WHERE {u_sql('id', 3)} * 100 < 67.0),
fl_all AS (
  UNPIVOT (SELECT id, f_prio, f_status, CAST(f_lines AS VARCHAR) AS f_lines, CAST(f_qty AS VARCHAR) AS f_qty,
                  CAST(f_price AS VARCHAR) AS f_price FROM v_order)
  ON f_prio, f_status, f_lines, f_qty, f_price INTO NAME f VALUE v),
fl AS (SELECT fl_all.* FROM fl_all WHERE id IN (SELECT id FROM tr)),
allrows AS (SELECT id FROM v_order),
br_rows AS (SELECT CAST(g.j AS INTEGER) AS j, id, y[g.j + 1] AS t FROM tr CROSS JOIN range(6) g(j) WHERE y[g.j + 1] IS NOT NULL),
br_rfl AS (SELECT r.j, r.id, r.t, fl.f, fl.v FROM br_rows r JOIN fl USING (id)),
br_cls AS (SELECT CAST(g.j AS INTEGER) AS j, c.t FROM range(6) g(j) CROSS JOIN (VALUES (0), (1)) c(t))""" + nb_sql(
    ["j"], "br_rows", "br_rfl", "br_cls", "fl_all", "allrows", "br") + """,
br_pred AS (
  SELECT id, j, 1.0 / (1.0 + exp(max(CASE WHEN t = 0 THEN s END) - max(CASE WHEN t = 1 THEN s END))) AS conf,
         CAST(max(CASE WHEN t = 1 THEN s END) >= max(CASE WHEN t = 0 THEN s END) AS INTEGER) AS bip
  FROM br_score GROUP BY id, j)"""

sql("ln_binary_relevance", _ORDER_TRAIN + """
SELECT id, CAST(j AS INTEGER) AS j, round(conf, 6) AS conf, bip FROM br_pred""")

_XLX = "(CASE WHEN {0} > 0 THEN {0} * ln({0}) ELSE 0.0 END)"


def _mass_sql(n: str, n1: str) -> str:
    return "(" + _XLX.format(n) + " - " + _XLX.format(n1) + " - " + _XLX.format(f"({n} - {n1})") + ")"


def tree_sql(key: str, rows: str, rfl: str, order: list[str], depth: int, min_leaf: int) -> str:
    """CTEs of one information-gain tree per key: dt_split(key, node, f), dt_tot(key, node, n, n1); a node is the path to it.

    rows(key, id, t): training rows; rfl(key, id, f, v): their feature values; ``order``: features, earlier ones win ties."""
    place = "[" + ", ".join(f"'{f}'" for f in order) + "]"
    out = f""",
dt_n0 AS (SELECT {key}, id, CAST(t AS DOUBLE) AS t, '' AS node FROM {rows})"""
    for d in range(depth):
        out += f""",
dt_t{d} AS (SELECT {key}, node, CAST(count(*) AS DOUBLE) AS n, sum(t) AS n1 FROM dt_n{d} GROUP BY {key}, node),
dt_c{d} AS (SELECT a.{key}, a.node, b.f, b.v, CAST(count(*) AS DOUBLE) AS n, sum(a.t) AS n1 FROM dt_n{d} a JOIN {rfl} b ON b.{key} = a.{key} AND b.id = a.id GROUP BY a.{key}, a.node, b.f, b.v),
dt_p{d} AS (SELECT {key}, node, f, sum({_mass_sql("n", "n1")}) AS rest FROM dt_c{d} GROUP BY {key}, node, f HAVING count(*) FILTER (WHERE n >= {min_leaf}) >= 2),
dt_s{d} AS (SELECT p.{key}, p.node, p.f FROM dt_p{d} p JOIN dt_t{d} t ON t.{key} = p.{key} AND t.node = p.node WHERE t.n1 > 0 AND t.n1 < t.n
  QUALIFY row_number() OVER (PARTITION BY p.{key}, p.node ORDER BY round(({_mass_sql("t.n", "t.n1")} - rest) / t.n, 10) DESC, list_position({place}, p.f)) = 1),
dt_n{d + 1} AS (SELECT a.{key}, a.id, a.t, a.node || '/' || s.f || '=' || b.v AS node FROM dt_n{d} a JOIN dt_s{d} s ON s.{key} = a.{key} AND s.node = a.node
  JOIN {rfl} b ON b.{key} = a.{key} AND b.id = a.id AND b.f = s.f)"""
    return out + f""",
dt_t{depth} AS (SELECT {key}, node, CAST(count(*) AS DOUBLE) AS n, sum(t) AS n1 FROM dt_n{depth} GROUP BY {key}, node),
dt_split AS ({" UNION ALL ".join(f"SELECT * FROM dt_s{d}" for d in range(depth))}),
dt_tot AS ({" UNION ALL ".join(f"SELECT * FROM dt_t{d}" for d in range(depth + 1))})"""


def tree_walk_sql(key: str, sfl: str, srows: str, depth: int, p: str) -> str:
    """CTE {p}_leaf(id, key, conf) from srows(id, key) and sfl(id, f, v)."""
    out = f""",
{p}_w0 AS (SELECT id, {key}, '' AS node FROM {srows})"""
    for d in range(depth):
        out += f""",
{p}_w{d + 1} AS (SELECT a.id, a.{key}, coalesce(t.node, a.node) AS node FROM {p}_w{d} a LEFT JOIN dt_split s ON s.{key} = a.{key} AND s.node = a.node
  LEFT JOIN {sfl} b ON b.id = a.id AND b.f = s.f LEFT JOIN dt_tot t ON t.{key} = a.{key} AND t.node = a.node || '/' || s.f || '=' || b.v)"""
    return out + f""",
{p}_leaf AS (SELECT a.id, a.{key}, (t.n1 + 1.0) / (t.n + 2.0) AS conf FROM {p}_w{depth} a JOIN dt_tot t ON t.{key} = a.{key} AND t.node = a.node)"""


_TREE_FEATURES = ["f_prio", "f_status", "f_lines", "f_qty", "f_price"]

sql("ln_tree_binary_relevance", _ORDER_TRAIN + tree_sql("j", "br_rows", "br_rfl", _TREE_FEATURES, 2, 5) + """,
dt_all AS (SELECT r.id, CAST(g.j AS INTEGER) AS j FROM allrows r CROSS JOIN range(6) g(j))""" + tree_walk_sql("j", "fl_all", "dt_all", 2, "br2") + """
SELECT id, j, round(conf, 6) AS conf, CAST(conf >= 0.5 AS INTEGER) AS bip FROM br2_leaf""")


def _tree_chain_sql() -> str:
    out = _ORDER_TRAIN + """,
tc_rows AS (SELECT j AS link, id, t FROM br_rows),
tc_rfl AS (SELECT r.link, r.id, fl.f, fl.v FROM tc_rows r JOIN fl USING (id)
  UNION ALL SELECT r.link, r.id, '__lab' || CAST(p.j AS VARCHAR), CAST(p.t AS VARCHAR) FROM tc_rows r JOIN br_rows p ON p.id = r.id AND p.j < r.link)"""
    out += tree_sql("link", "tc_rows", "tc_rfl", _TREE_FEATURES + [f"__lab{c}" for c in range(6)], 2, 5)
    seen = "SELECT id, f, v FROM fl_all"
    for k in range(6):
        out += f""",
tc_f{k} AS ({seen}),
tc_r{k} AS (SELECT id, {k} AS link FROM allrows)""" + tree_walk_sql("link", f"tc_f{k}", f"tc_r{k}", 2, f"tc{k}")
        seen += f" UNION ALL SELECT id, '__lab{k}', CAST(CAST(conf >= 0.5 AS INTEGER) AS VARCHAR) FROM tc{k}_leaf"
    every = " UNION ALL ".join(f"SELECT * FROM tc{k}_leaf" for k in range(6))
    return out + f"""
SELECT id, CAST(link AS INTEGER) AS j, round(conf, 6) AS conf, CAST(conf >= 0.5 AS INTEGER) AS bip FROM ({every})"""


def _adaboost_sql(rounds: int = 5) -> str:
    out = _ORDER_TRAIN + """,
ab0 AS MATERIALIZED (SELECT id, j, t, 1.0::DOUBLE / (SELECT count(*) FROM br_rows) AS d FROM br_rows)"""
    for r in range(rounds):
        out += f""",
ah{r} AS MATERIALIZED (SELECT *, 0.5 * ln((up + e) / (down + e)) AS h FROM (
  SELECT fl.f, fl.v, a.j, sum(CASE WHEN t = 1 THEN d ELSE 0.0 END) AS up, sum(CASE WHEN t = 0 THEN d ELSE 0.0 END) AS down, 0.5 / (SELECT count(*) FROM br_rows) AS e
  FROM ab{r} a JOIN fl USING (id) GROUP BY fl.f, fl.v, a.j)),
az{r} AS MATERIALIZED (SELECT f, 1.0 - sum(up + down) + sum(up * exp(-h) + down * exp(h)) AS z FROM ah{r} GROUP BY f ORDER BY round(z, 12), f LIMIT 1),
ab{r + 1} AS MATERIALIZED (SELECT a.id, a.j, a.t, a.d * exp((1 - 2 * a.t) * coalesce(h.h, 0.0)) / z.z AS d FROM ab{r} a CROSS JOIN az{r} z
  LEFT JOIN fl ON fl.id = a.id AND fl.f = z.f LEFT JOIN ah{r} h ON h.f = z.f AND h.v = fl.v AND h.j = a.j)"""
    every = " UNION ALL ".join(f"SELECT {r + 1} AS round, h.f, h.v, h.j, h.h, z.z FROM ah{r} h JOIN az{r} z ON z.f = h.f" for r in range(rounds))
    return out + f""",
stumps AS MATERIALIZED ({every})"""


sql("ln_adaboost_mh", _adaboost_sql() + """,
am AS (SELECT f, v, j, sum(h) AS w FROM stumps GROUP BY f, v, j),
sc AS (SELECT r.id, CAST(g.j AS INTEGER) AS j, coalesce(sum(am.w), 0.0) AS s FROM allrows r CROSS JOIN range(6) g(j) JOIN fl_all a ON a.id = r.id
  LEFT JOIN am ON am.f = a.f AND am.v = a.v AND am.j = g.j GROUP BY r.id, g.j)
SELECT id, j, round(1.0 / (1.0 + exp(-2.0 * s)), 6) AS conf, CAST(s > 1e-9 AS INTEGER) AS bip FROM sc""")

sql("ln_adaboost_mh_rounds", _adaboost_sql() + """,
zs AS (SELECT DISTINCT round, f, z FROM stumps)
SELECT CAST(round AS INTEGER) AS round, f AS feature, round(z, 6) AS z, round(exp(sum(ln(z)) OVER (ORDER BY round)), 6) AS bound FROM zs""")

sql("ln_tree_classifier_chain", _tree_chain_sql())

_ORDER_PW = _ORDER_TRAIN + """,
pw_rows AS (SELECT a.j AS a, b.j AS b, a.id, a.t FROM br_rows a JOIN br_rows b ON a.id = b.id AND a.j < b.j AND a.t <> b.t),
pw_rfl AS (SELECT r.a, r.b, r.id, r.t, fl.f, fl.v FROM pw_rows r JOIN fl USING (id)),
pw_cls AS (SELECT DISTINCT a, b, c.t FROM pw_rows CROSS JOIN (VALUES (0), (1)) c(t))""" + nb_sql(
    ["a", "b"], "pw_rows", "pw_rfl", "pw_cls", "fl_all", "allrows", "pw") + """,
pw_dec AS (
  SELECT id, a, b, max(CASE WHEN t = 1 THEN s END) >= max(CASE WHEN t = 0 THEN s END) AS a_wins FROM pw_score GROUP BY id, a, b),
pw_votes AS (
  SELECT r.id, CAST(g.j AS INTEGER) AS j,
    CAST(coalesce((SELECT count(*) FROM pw_dec d WHERE d.id = r.id AND ((d.a = g.j AND d.a_wins) OR (d.b = g.j AND NOT d.a_wins))), 0) AS DOUBLE) AS votes
  FROM allrows r CROSS JOIN range(6) g(j))"""

sql("ln_pairwise", _ORDER_PW + """
SELECT id, j, round(votes / 5.0, 6) AS conf FROM pw_votes""")

sql("ln_calibrated_ranking", _ORDER_PW + """,
clr AS (SELECT v.id, v.j, v.votes + b.bip AS sc FROM pw_votes v JOIN br_pred b USING (id, j)),
virt AS (SELECT id, sum(1 - bip) AS vt FROM br_pred GROUP BY id)
SELECT id, CAST(j AS INTEGER) AS j, round(sc / 6.0, 6) AS conf, CAST(sc >= vt AS INTEGER) AS bip FROM clr JOIN virt USING (id)""")

sql("ln_label_powerset", _ORDER_TRAIN + f""",
lp_rows AS (SELECT 0 AS _m, id, {bits_sql('y')} AS t FROM tr WHERE len(list_filter(y, lambda x: x IS NULL)) = 0),
lp_rfl AS (SELECT r._m, r.id, r.t, fl.f, fl.v FROM lp_rows r JOIN fl USING (id)),
lp_cls AS (SELECT DISTINCT _m, t FROM lp_rows)""" + nb_sql(
    ["_m"], "lp_rows", "lp_rfl", "lp_cls", "fl_all", "allrows", "lp") + f""",
cidx AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS ci FROM lp_cls),
post AS (
  SELECT id, t, s, max(s) OVER (PARTITION BY id) AS mx,
         exp(s - max(s) OVER (PARTITION BY id)) / sum(exp(s - max(s) OVER (PARTITION BY id))) OVER (PARTITION BY id) AS p
  FROM lp_score),
post2 AS (
  SELECT id, t, s, mx, exp(s - mx) / sum(exp(s - mx)) OVER (PARTITION BY id) AS p FROM (
    SELECT id, t, s, max(s) OVER (PARTITION BY id) AS mx FROM lp_score)),
best AS (
  SELECT id, arg_min(t, {h2_sql('id', 'ci', 7)}) AS bt, arg_min(p, {h2_sql('id', 'ci', 7)}) AS pb
  FROM post2 JOIN cidx USING (t) WHERE s = mx GROUP BY id)
SELECT id, CAST(g.j AS INTEGER) AS j,
       round(CASE WHEN substr(bt, g.j + 1, 1) = '1' THEN pb ELSE 1 - pb END, 6) AS conf,
       CAST(substr(bt, g.j + 1, 1) AS INTEGER) AS bip
FROM best CROSS JOIN range(6) g(j)""")

sql("ln_classifier_chain", "WITH RECURSIVE " + _ORDER_TRAIN[len("WITH "):] + """,
cc_rows AS (SELECT j AS link, id, t FROM br_rows),
cc_rfl AS (
  SELECT r.link, r.id, r.t, fl.f, fl.v FROM cc_rows r JOIN fl USING (id)
  UNION ALL
  SELECT r.link, r.id, r.t, '__lab' || CAST(p.j AS VARCHAR), CAST(p.t AS VARCHAR)
  FROM cc_rows r JOIN br_rows p ON p.id = r.id AND p.j < r.link),
cc_cls AS (SELECT j AS link, t FROM br_cls)""" + nb_sql(
    ["link"], "cc_rows", "cc_rfl", "cc_cls", "fl_all", "allrows", "cc") + """,
labw AS (SELECT link, CAST(substr(f, 6) AS INTEGER) AS c, CAST(v AS INTEGER) AS v, t, w FROM cc_wt WHERE f LIKE '\\_\\_lab%' ESCAPE '\\'),
bs AS (SELECT id, link, max(CASE WHEN t = 0 THEN s END) AS s0, max(CASE WHEN t = 1 THEN s END) AS s1 FROM cc_score GROUP BY id, link),
rec AS (
  SELECT id, 0 AS k, CAST([] AS INTEGER[]) AS preds, CAST([] AS DOUBLE[]) AS confs FROM allrows
  UNION ALL
  SELECT id, k + 1, list_append(preds, CAST(z1 >= z0 AS INTEGER)), list_append(confs, 1.0 / (1.0 + exp(z0 - z1)))
  FROM (
    SELECT r.id, r.k, r.preds, r.confs,
      bs.s0 + coalesce((SELECT sum(w) FROM labw lw WHERE lw.link = r.k AND lw.t = 0 AND lw.c < r.k AND lw.v = r.preds[lw.c + 1]), 0.0) AS z0,
      bs.s1 + coalesce((SELECT sum(w) FROM labw lw WHERE lw.link = r.k AND lw.t = 1 AND lw.c < r.k AND lw.v = r.preds[lw.c + 1]), 0.0) AS z1
    FROM rec r JOIN bs ON bs.id = r.id AND bs.link = r.k
    WHERE r.k < 6) q
)
SELECT id, CAST(g.j AS INTEGER) AS j, round(confs[g.j + 1], 6) AS conf, preds[g.j + 1] AS bip
FROM rec CROSS JOIN range(6) g(j) WHERE k = 6""")

def _two_stage_tail(dec: str) -> str:
    return f""",
brc AS (SELECT id, j, conf, bip FROM br_pred),
pv AS (
  SELECT d.id, d.a, d.b,
    CASE WHEN ca.conf > 0.2 AND cb.conf > 0.2 THEN CAST(d.a_wins AS INTEGER) WHEN ca.conf > 0.2 THEN 1 ELSE 0 END AS va,
    CASE WHEN ca.conf > 0.2 AND cb.conf > 0.2 THEN CAST(NOT d.a_wins AS INTEGER) WHEN ca.conf > 0.2 THEN 0 WHEN cb.conf > 0.2 THEN 1 ELSE 0 END AS vb,
    CASE WHEN ca.conf <= 0.2 AND cb.conf <= 0.2 THEN 1 ELSE 0 END AS nv
  FROM {dec} d JOIN brc ca ON ca.id = d.id AND ca.j = d.a JOIN brc cb ON cb.id = d.id AND cb.j = d.b),
lv AS (
  SELECT c.id, c.j, c.conf, c.bip,
    c.bip + coalesce((SELECT sum(CASE WHEN pv.a = c.j THEN va ELSE vb END) FROM pv WHERE pv.id = c.id AND (pv.a = c.j OR pv.b = c.j)), 0) AS v,
    coalesce((SELECT sum(nv) FROM pv WHERE pv.id = c.id AND (pv.a = c.j OR pv.b = c.j)), 0) AS novote
  FROM brc c),
virt AS (SELECT id, sum(1 - bip) AS vt FROM brc GROUP BY id)
SELECT id, CAST(j AS INTEGER) AS j,
  round(CASE WHEN v >= vt THEN CAST(v AS DOUBLE) / (6 - novote) ELSE conf / 6.0 END, 6) AS conf,
  CAST(v >= vt AS INTEGER) AS bip
FROM lv JOIN virt USING (id)"""


_BINS = """,
cbin AS (SELECT id, j, CAST(CAST(least(floor(conf * 10), 9) AS INTEGER) AS VARCHAR) AS v FROM br_pred),
tc_rows AS (SELECT a.j AS a, b.j AS b, a.id, a.t FROM br_rows a JOIN br_rows b ON a.id = b.id AND a.j < b.j AND a.t <> b.t),
tc_cls AS (SELECT DISTINCT a, b, c.t FROM tc_rows CROSS JOIN (VALUES (0), (1)) c(t))"""

sql("ln_two_stage_chain", _ORDER_TRAIN + _BINS + """,
cbv AS (SELECT id, 'c' || CAST(j AS VARCHAR) AS f, v FROM cbin),
tc_rfl AS (SELECT r.a, r.b, r.id, r.t, fl.f, fl.v FROM tc_rows r JOIN fl USING (id)
           UNION ALL SELECT r.a, r.b, r.id, r.t, c.f, c.v FROM tc_rows r JOIN cbv c USING (id)),
tc_sfl AS (SELECT id, f, v FROM fl_all UNION ALL SELECT id, f, v FROM cbv)""" + nb_sql(
    ["a", "b"], "tc_rows", "tc_rfl", "tc_cls", "tc_sfl", "allrows", "tc") + """,
tc_dec AS (SELECT id, a, b, max(CASE WHEN t = 1 THEN s END) >= max(CASE WHEN t = 0 THEN s END) AS a_wins FROM tc_score GROUP BY id, a, b)"""
    + _two_stage_tail("tc_dec"))

sql("ln_two_stage_pruned_chain", _ORDER_TRAIN + _BINS + """,
tc_rfl AS (SELECT r.a, r.b, r.id, r.t, fl.f, fl.v FROM tc_rows r JOIN fl USING (id)
           UNION ALL SELECT r.a, r.b, r.id, r.t, 'ca', c.v FROM tc_rows r JOIN cbin c ON c.id = r.id AND c.j = r.a
           UNION ALL SELECT r.a, r.b, r.id, r.t, 'cb', c.v FROM tc_rows r JOIN cbin c ON c.id = r.id AND c.j = r.b),
tc_pairs AS (SELECT DISTINCT a, b FROM tc_rows),
tc_ksfl AS (SELECT r.id, p.a, p.b, 'ca' AS f, c.v FROM allrows r CROSS JOIN tc_pairs p JOIN cbin c ON c.id = r.id AND c.j = p.a
            UNION ALL SELECT r.id, p.a, p.b, 'cb', c.v FROM allrows r CROSS JOIN tc_pairs p JOIN cbin c ON c.id = r.id AND c.j = p.b)""" + nb_sql(
    ["a", "b"], "tc_rows", "tc_rfl", "tc_cls", "fl_all", "allrows", "tc", key_sfl="tc_ksfl") + """,
tc_dec AS (SELECT id, a, b, max(CASE WHEN t = 1 THEN s END) >= max(CASE WHEN t = 0 THEN s END) AS a_wins FROM tc_score GROUP BY id, a, b)"""
    + _two_stage_tail("tc_dec"))

sql("ln_stacking", _ORDER_TRAIN + f""",
st_fold AS (SELECT id, CAST({h_sql('id', 1)} % 3 AS INTEGER) AS fold FROM tr),
k_rows AS (SELECT CAST(f.k AS INTEGER) AS fold, r.j, r.id, r.t FROM br_rows r JOIN st_fold sf USING (id) CROSS JOIN range(3) f(k)
           WHERE f.k <> sf.fold),
k_rfl AS (SELECT r.fold, r.j, r.id, r.t, fl.f, fl.v FROM k_rows r JOIN fl USING (id)),
k_cls AS (SELECT CAST(f.k AS INTEGER) AS fold, CAST(g.j AS INTEGER) AS j, c.t FROM range(3) f(k) CROSS JOIN range(6) g(j)
          CROSS JOIN (VALUES (0), (1)) c(t)),
k_srows AS (SELECT id FROM tr)""" + nb_sql(["fold", "j"], "k_rows", "k_rfl", "k_cls", "fl", "k_srows", "k") + """,
oof AS (SELECT s.id, s.j, 1.0 / (1.0 + exp(max(CASE WHEN s.t = 0 THEN s.s END) - max(CASE WHEN s.t = 1 THEN s.s END))) AS conf
        FROM k_score s JOIN st_fold sf ON sf.id = s.id AND sf.fold = s.fold GROUP BY s.id, s.j),
oofb AS (SELECT id, 'c' || CAST(j AS VARCHAR) AS f, CAST(CAST(least(floor(conf * 10), 9) AS INTEGER) AS VARCHAR) AS v FROM oof),
l2_rfl AS (SELECT r.j, r.id, r.t, fl.f, fl.v FROM br_rows r JOIN fl USING (id)
           UNION ALL SELECT r.j, r.id, r.t, o.f, o.v FROM br_rows r JOIN oofb o USING (id)),
fullb AS (SELECT id, 'c' || CAST(j AS VARCHAR) AS f, CAST(CAST(least(floor(conf * 10), 9) AS INTEGER) AS VARCHAR) AS v FROM br_pred),
l2_sfl AS (SELECT id, f, v FROM fl_all UNION ALL SELECT id, f, v FROM fullb)""" + nb_sql(
    ["j"], "br_rows", "l2_rfl", "br_cls", "l2_sfl", "allrows", "l2") + """,
l2p AS (SELECT id, j, max(CASE WHEN t = 1 THEN s END) AS s1, max(CASE WHEN t = 0 THEN s END) AS s0 FROM l2_score GROUP BY id, j)
SELECT id, CAST(j AS INTEGER) AS j, round(1.0 / (1.0 + exp(s0 - s1)), 6) AS conf, CAST(s1 >= s0 AS INTEGER) AS bip FROM l2p""")


sql("ln_two_stage_voting", _ORDER_PW + """,
brc AS (SELECT id, j, conf, bip FROM br_pred),
pv AS (
  SELECT d.id, d.a, d.b,
    CASE WHEN ca.conf > 0.2 AND cb.conf > 0.2 THEN CAST(d.a_wins AS INTEGER) WHEN ca.conf > 0.2 THEN 1 ELSE 0 END AS va,
    CASE WHEN ca.conf > 0.2 AND cb.conf > 0.2 THEN CAST(NOT d.a_wins AS INTEGER) WHEN ca.conf > 0.2 THEN 0 WHEN cb.conf > 0.2 THEN 1 ELSE 0 END AS vb,
    CASE WHEN ca.conf <= 0.2 AND cb.conf <= 0.2 THEN 1 ELSE 0 END AS nv
  FROM pw_dec d JOIN brc ca ON ca.id = d.id AND ca.j = d.a JOIN brc cb ON cb.id = d.id AND cb.j = d.b),
lv AS (
  SELECT c.id, c.j, c.conf, c.bip,
    c.bip + coalesce((SELECT sum(CASE WHEN pv.a = c.j THEN va ELSE vb END) FROM pv WHERE pv.id = c.id AND (pv.a = c.j OR pv.b = c.j)), 0) AS v,
    coalesce((SELECT sum(nv) FROM pv WHERE pv.id = c.id AND (pv.a = c.j OR pv.b = c.j)), 0) AS novote
  FROM brc c),
virt AS (SELECT id, sum(1 - bip) AS vt FROM brc GROUP BY id)
SELECT id, CAST(j AS INTEGER) AS j,
  round(CASE WHEN v >= vt THEN CAST(v AS DOUBLE) / (6 - novote) ELSE conf / 6.0 END, 6) AS conf,
  CAST(v >= vt AS INTEGER) AS bip
FROM lv JOIN virt USING (id)""")

sql("ln_include_labels", _ORDER_TRAIN + """,
il_rows AS (SELECT 0 AS _m, id * 6 + j AS id, t, j AS lj FROM br_rows),
il_rfl AS (
  SELECT r._m, r.id, r.t, fl.f, fl.v FROM il_rows r JOIN fl ON fl.id = (r.id - r.lj) // 6
  UNION ALL
  SELECT r._m, r.id, r.t, 'label', (['AF', 'AO', 'NF', 'NO', 'RF', 'RO'])[r.lj + 1] FROM il_rows r),
il_cls AS (SELECT 0 AS _m, c.t FROM (VALUES (0), (1)) c(t)),
il_sfl AS (
  SELECT a.id * 6 + g.j AS id, a.f, a.v FROM fl_all a CROSS JOIN range(6) g(j)
  UNION ALL
  SELECT r.id * 6 + g.j, 'label', (['AF', 'AO', 'NF', 'NO', 'RF', 'RO'])[g.j + 1] FROM allrows r CROSS JOIN range(6) g(j)),
il_srows AS (SELECT r.id * 6 + g.j AS id FROM allrows r CROSS JOIN range(6) g(j))""" + nb_sql(
    ["_m"], "il_rows", "il_rfl", "il_cls", "il_sfl", "il_srows", "il") + """
SELECT id // 6 AS id, CAST(id % 6 AS INTEGER) AS j,
  round(1.0 / (1.0 + exp(max(CASE WHEN t = 0 THEN s END) - max(CASE WHEN t = 1 THEN s END))), 6) AS conf,
  CAST(max(CASE WHEN t = 1 THEN s END) >= max(CASE WHEN t = 0 THEN s END) AS INTEGER) AS bip
FROM il_score GROUP BY id""")

sql("ln_multiclass", _ORDER_TRAIN + """,
mc_rows AS (SELECT 0 AS _m, id, j AS t, 1.0 / sum(t) OVER (PARTITION BY id) AS w FROM br_rows WHERE t = 1),
mc_rfl AS (SELECT r._m, r.id, r.t, r.w, fl.f, fl.v FROM mc_rows r JOIN fl USING (id)),
mc_cls AS (SELECT DISTINCT _m, t FROM mc_rows)""" + nb_sql(
    ["_m"], "mc_rows", "mc_rfl", "mc_cls", "fl_all", "allrows", "mc", wcol="w") + """,
mp AS (SELECT id, t, exp(s - mx) / sum(exp(s - mx)) OVER (PARTITION BY id) AS p FROM (
  SELECT id, t, s, max(s) OVER (PARTITION BY id) AS mx FROM mc_score))
SELECT r.id, CAST(g.j AS INTEGER) AS j, round(coalesce(mp.p, 0.0), 6) AS conf
FROM allrows r CROSS JOIN range(6) g(j) LEFT JOIN mp ON mp.id = r.id AND mp.t = g.j""")


def _lp_on_map(mapping_cte: str, recursive: bool, conf_threshold: float | None) -> str:
    head = _ORDER_TRAIN
    if recursive:
        head = "WITH RECURSIVE " + head[len("WITH "):]
    bip = "CAST(conf > %r AS INTEGER)" % conf_threshold if conf_threshold is not None else "CAST(substr(bt, g.j + 1, 1) AS INTEGER)"
    return head + f""",
pc AS (SELECT y, {bits_sql('y')} AS bits, count(*) AS count FROM tr WHERE len(list_filter(y, lambda x: x IS NULL)) = 0 GROUP BY y),
rare AS (SELECT * FROM pc WHERE count <= 30),
freq AS (SELECT * FROM pc WHERE count > 30),
subs AS (
  SELECT r.bits, r.count, f.bits AS sub_bits, f.count AS sub_count, len(list_filter(f.y, lambda x: x = 1)) AS sub_size
  FROM rare r JOIN freq f
    ON len(list_filter(f.y, lambda x: x = 1)) < len(list_filter(r.y, lambda x: x = 1))
   AND len(list_filter(f.y, lambda x: x = 1)) > 0
   AND list_bool_and(list_transform(range(6), lambda j: f.y[j + 1] <= r.y[j + 1]))),
{mapping_cte},
lp_rows AS (SELECT 0 AS _m, tr.id, mp.new_bits AS t FROM tr JOIN pmap mp ON {bits_sql('tr.y')} = mp.bits),
lp_rfl AS (SELECT r._m, r.id, r.t, fl.f, fl.v FROM lp_rows r JOIN fl USING (id)),
lp_cls AS (SELECT DISTINCT _m, t FROM lp_rows)""" + nb_sql(
        ["_m"], "lp_rows", "lp_rfl", "lp_cls", "fl_all", "allrows", "lp") + f""",
cidx AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS ci FROM lp_cls),
post2 AS (
  SELECT id, t, s, mx, exp(s - mx) / sum(exp(s - mx)) OVER (PARTITION BY id) AS p FROM (
    SELECT id, t, s, max(s) OVER (PARTITION BY id) AS mx FROM lp_score)),
best AS (SELECT id, arg_min(t, {h2_sql('id', 'ci', 7)}) AS bt FROM post2 JOIN cidx USING (t) WHERE s = mx GROUP BY id),
c2 AS (
  SELECT p.id, CAST(g.j AS INTEGER) AS j, sum(CASE WHEN substr(p.t, g.j + 1, 1) = '1' THEN p.p ELSE 0.0 END) AS conf
  FROM post2 p CROSS JOIN range(6) g(j) GROUP BY p.id, g.j)
SELECT c2.id, c2.j, round(conf, 6) AS conf, {bip.replace('g.j', 'c2.j')} AS bip FROM c2 JOIN best USING (id)"""


sql("ln_pruned_sets", _lp_on_map("""pmap AS (
  SELECT bits, bits AS new_bits FROM freq
  UNION ALL
  SELECT bits, sub_bits FROM (
    SELECT *, row_number() OVER (PARTITION BY bits ORDER BY sub_size DESC, sub_count DESC, sub_bits DESC) AS rk FROM subs) WHERE rk <= 2)""",
    False, None))

sql("ln_ppt", _lp_on_map("""cand AS (SELECT *, row_number() OVER (PARTITION BY bits ORDER BY sub_size DESC, sub_count DESC, sub_bits DESC) AS pos FROM subs),
greedy AS (
  SELECT bits, 0 AS pos, CAST(repeat('0', 6) AS BIT) AS used, CAST([] AS VARCHAR[]) AS picked FROM rare
  UNION ALL
  SELECT g.bits, c.pos,
         CASE WHEN bit_count(g.used & CAST(c.sub_bits AS BIT)) = 0 THEN g.used | CAST(c.sub_bits AS BIT) ELSE g.used END,
         CASE WHEN bit_count(g.used & CAST(c.sub_bits AS BIT)) = 0 THEN list_append(g.picked, c.sub_bits) ELSE g.picked END
  FROM greedy g JOIN cand c ON c.bits = g.bits AND c.pos = g.pos + 1),
final AS (SELECT bits, arg_max(picked, pos) AS picked FROM greedy GROUP BY bits),
pmap AS (
  SELECT bits, bits AS new_bits FROM freq
  UNION ALL
  SELECT bits, unnest(picked) AS new_bits FROM final)""", True, 0.21))


def _subset_sql(groups: list[list[int]]) -> str:
    vals = ", ".join(f"({g}, {j})" for g, grp in enumerate(groups) for j in grp)
    glist = ", ".join(f"({g}, [{', '.join(str(j) for j in grp)}])" for g, grp in enumerate(groups))
    return _ORDER_TRAIN + f""",
gm AS (SELECT * FROM (VALUES {vals}) v(g, lab)),
gl AS (SELECT * FROM (VALUES {glist}) v(g, labs)),
sb_rows AS (
  SELECT gl.g, tr.id, array_to_string(list_transform(gl.labs, lambda j: CAST(tr.y[j + 1] AS VARCHAR)), '') AS t
  FROM tr CROSS JOIN gl WHERE len(list_filter(tr.y, lambda x: x IS NULL)) = 0),
sb_rfl AS (SELECT r.g, r.id, r.t, fl.f, fl.v FROM sb_rows r JOIN fl USING (id)),
sb_cls AS (SELECT DISTINCT g, t FROM sb_rows)""" + nb_sql(["g"], "sb_rows", "sb_rfl", "sb_cls", "fl_all", "allrows", "sb") + f""",
cidx AS (SELECT g, t, row_number() OVER (ORDER BY g, t) - 1 AS ci FROM sb_cls),
mx AS (SELECT id, g, t, s, max(s) OVER (PARTITION BY id, g) AS m FROM sb_score),
best AS (SELECT id, g, arg_min(t, {h2_sql('id', 'ci', 7)}) AS bt FROM mx JOIN cidx USING (g, t) WHERE s = m GROUP BY id, g),
votes AS (
  SELECT b.id, gl.labs[k.k + 1] AS j, CAST(substr(b.bt, k.k + 1, 1) AS DOUBLE) AS v
  FROM best b JOIN gl USING (g) CROSS JOIN range(6) k(k) WHERE k.k < len(gl.labs)),
cover AS (SELECT lab AS j, count(*) AS c FROM gm GROUP BY lab),
agg AS (
  SELECT r.id, CAST(g.j AS INTEGER) AS j,
    CASE WHEN coalesce(cv.c, 0) > 0 THEN coalesce((SELECT sum(v) FROM votes vv WHERE vv.id = r.id AND vv.j = g.j), 0.0) / cv.c ELSE 0.0 END AS conf
  FROM allrows r CROSS JOIN range(6) g(j) LEFT JOIN cover cv ON cv.j = g.j)
SELECT id, j, round(conf, 6) AS conf, CAST(conf >= 0.5 AS INTEGER) AS bip FROM agg"""


def _subset_groups():
    from polytag.operators.learners import rakel_subsets, rakeld_partition
    from polytag.plans.queries import SUBSET_PARTITION

    return SUBSET_PARTITION, rakeld_partition(6, 3, seed=11), rakel_subsets(6, 3, seed=12)


_SP, _RD, _RK = _subset_groups()
sql("ln_subset_partition", _subset_sql(_SP))
sql("ln_rakel_d", _subset_sql(_RD))
sql("ln_rakel", _subset_sql(_RK))

sql("predict_unlabelled", with_views("v_doc") + """,
fl_all AS (
  UNPIVOT (SELECT id, lang, source, CAST(f_len AS VARCHAR) AS f_len FROM v_doc) ON lang, source, f_len INTO NAME f VALUE v),
tr AS (SELECT * FROM v_doc WHERE len(list_filter(y, lambda x: x IS NULL)) = 0),
fl AS (SELECT * FROM fl_all WHERE id IN (SELECT id FROM tr)),
unl AS (SELECT id FROM v_doc WHERE len(list_filter(y, lambda x: x IS NULL)) > 0),
ufl AS (SELECT * FROM fl_all WHERE id IN (SELECT id FROM unl)),
br_rows AS (SELECT CAST(g.j AS INTEGER) AS j, id, y[g.j + 1] AS t FROM tr CROSS JOIN range(2) g(j) WHERE y[g.j + 1] IS NOT NULL),
br_rfl AS (SELECT r.j, r.id, r.t, fl.f, fl.v FROM br_rows r JOIN fl USING (id)),
br_cls AS (SELECT CAST(g.j AS INTEGER) AS j, c.t FROM range(2) g(j) CROSS JOIN (VALUES (0), (1)) c(t))""" + nb_sql(
    ["j"], "br_rows", "br_rfl", "br_cls", "ufl", "unl", "br") + """
SELECT id, CAST(j AS INTEGER) AS j,
  round(1.0 / (1.0 + exp(max(CASE WHEN t = 0 THEN s END) - max(CASE WHEN t = 1 THEN s END))), 6) AS conf,
  CAST(max(CASE WHEN t = 1 THEN s END) >= max(CASE WHEN t = 0 THEN s END) AS INTEGER) AS bip
FROM br_score GROUP BY id, j""")


# ---------------------------------------------------------------- 2.7 neighbour learners

def _vec_ctes(train_where: str) -> str:
    return with_views("v_vec") + f""",
tr AS (SELECT * FROM v_vec WHERE {train_where}),
emb AS (SELECT id, CAST(g.i AS INTEGER) AS i, CAST(embedding[g.i + 1] AS DOUBLE) AS x FROM v_vec CROSS JOIN range(64) g(i)),
mm AS (SELECT i, min(x) AS mn, max(x) - min(x) AS rg FROM emb WHERE id IN (SELECT id FROM tr) GROUP BY i),
ne AS (SELECT e.id, e.i, CASE WHEN rg = 0 THEN 0.0 ELSE (e.x - mn) / rg END AS z FROM emb e JOIN mm USING (i))"""


def _nn(name: str, qsrc: str, rsrc: str, k: int, excl: bool) -> str:
    cond = " AND a.id <> b.id" if excl else ""
    return f""",
{name} AS (
  SELECT qid, rid, dist, rank FROM (
    SELECT qid, rid, sqrt(d2) AS dist, row_number() OVER (PARTITION BY qid ORDER BY d2, rid) AS rank FROM (
      SELECT a.id AS qid, b.id AS rid, sum((a.z - b.z) * (a.z - b.z)) AS d2
      FROM ne a JOIN ne b ON a.i = b.i{cond}
      WHERE a.id IN (SELECT id FROM {qsrc}) AND b.id IN (SELECT id FROM {rsrc})
      GROUP BY a.id, b.id))
  WHERE rank <= {k})"""


sql("knn_neighbors", _vec_ctes("true") + _nn("nn", "v_vec", "v_vec", 10, True) + """
SELECT qid AS id, CAST(rank AS INTEGER) AS rank, rid AS nid, round(dist, 6) AS dist FROM nn""")

sql("knn_neighbors_cells", ORACLE["knn_neighbors"])

_VEC_TR = f"{u_sql('id', 3)} * 100 < 67.0"

sql("ln_mlknn", _vec_ctes(_VEC_TR) + _nn("nt", "tr", "tr", 10, True) + _nn("na", "v_vec", "tr", 10, False) + """,
n AS (SELECT count(*) AS n FROM tr),
lab AS (SELECT id, CAST(g.j AS INTEGER) AS j, y[g.j + 1] AS t FROM v_vec CROSS JOIN range(4) g(j)),
pri AS (SELECT j, (1.0 + sum(t)) / (2.0 + max(n.n)) AS p FROM lab CROSS JOIN n WHERE id IN (SELECT id FROM tr) GROUP BY j),
dtr AS (SELECT nt.qid, l.j, sum(l.t) AS d FROM nt JOIN lab l ON l.id = nt.rid GROUP BY nt.qid, l.j),
h AS (SELECT dtr.j, dtr.d, sum(CASE WHEN l.t = 1 THEN 1 ELSE 0 END) AS c1, sum(CASE WHEN l.t = 0 THEN 1 ELSE 0 END) AS c0
      FROM dtr JOIN lab l ON l.id = dtr.qid AND l.j = dtr.j GROUP BY dtr.j, dtr.d),
grid AS (SELECT CAST(g.j AS INTEGER) AS j, CAST(dd.d AS BIGINT) AS d FROM range(4) g(j) CROSS JOIN range(11) dd(d)),
hc AS (SELECT grid.j, grid.d, coalesce(h.c1, 0) AS c1, coalesce(h.c0, 0) AS c0 FROM grid LEFT JOIN h USING (j, d)),
pc AS (SELECT j, d, (1.0 + c1) / (11.0 + sum(c1) OVER (PARTITION BY j)) AS p1, (1.0 + c0) / (11.0 + sum(c0) OVER (PARTITION BY j)) AS p0 FROM hc),
dal AS (SELECT na.qid, l.j, sum(l.t) AS d FROM na JOIN lab l ON l.id = na.rid GROUP BY na.qid, l.j),
sc AS (SELECT dal.qid AS id, dal.j, pri.p * pc.p1 AS pin, (1 - pri.p) * pc.p0 AS pout FROM dal JOIN pri USING (j) JOIN pc ON pc.j = dal.j AND pc.d = dal.d)
SELECT id, CAST(j AS INTEGER) AS j, round(pin / (pin + pout), 6) AS conf, CAST(pin >= pout AS INTEGER) AS bip FROM sc""")


def _brknn_sql(ext: str) -> str:
    base = _vec_ctes(_VEC_TR) + _nn("na", "v_vec", "tr", 10, False) + """,
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM tr),
lab AS (SELECT id, CAST(g.j AS INTEGER) AS j, y[g.j + 1] AS t FROM v_vec CROSS JOIN range(4) g(j)),
kk AS (SELECT qid, count(*) AS kk FROM na GROUP BY qid),
cnt AS (SELECT na.qid, l.j, sum(l.t) AS c FROM na JOIN lab l ON l.id = na.rid GROUP BY na.qid, l.j),
cf AS (SELECT c.qid AS id, c.j, c.c, (1.0 / n.n + c.c) / (4.0 / n.n + kk.kk) AS conf, 4.0 / n.n + kk.kk AS total
       FROM cnt c JOIN kk USING (qid) CROSS JOIN n)"""
    if ext == "none":
        return base + "\nSELECT id, CAST(j AS INTEGER) AS j, round(conf, 6) AS conf, CAST(conf >= 0.5 AS INTEGER) AS bip FROM cf"
    if ext == "a":
        return base + f""",
mx AS (SELECT id, max(conf) AS m FROM cf GROUP BY id),
top AS (SELECT id, arg_min(j, {h2_sql('id', 'j', 3)}) AS tj FROM cf JOIN mx USING (id) WHERE conf = m GROUP BY id)
SELECT id, CAST(j AS INTEGER) AS j, round(conf, 6) AS conf,
  CAST(conf >= 0.5 OR (m < 0.5 AND j = tj) AS INTEGER) AS bip
FROM cf JOIN mx USING (id) JOIN top USING (id)"""
    return base + f""",
av AS (SELECT id, CAST(floor(sum(c) / max(total) + 0.5) AS INTEGER) AS av FROM cf GROUP BY id),
rk AS (SELECT id, j, row_number() OVER (PARTITION BY id ORDER BY conf DESC, {h2_sql('id', 'j', 3)}) AS r FROM cf)
SELECT id, CAST(j AS INTEGER) AS j, round(conf, 6) AS conf, CAST(r <= av AS INTEGER) AS bip
FROM cf JOIN rk USING (id, j) JOIN av USING (id)"""


sql("ln_brknn", _brknn_sql("none"))
sql("ln_brknn_a", _brknn_sql("a"))
sql("ln_brknn_b", _brknn_sql("b"))

sql("ln_dmlknn", _vec_ctes(_VEC_TR) + _nn("nt", "tr", "tr", 10, True) + _nn("na", "v_vec", "tr", 10, False) + """,
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM tr),
lab AS (SELECT id, CAST(g.j AS INTEGER) AS j, y[g.j + 1] AS t FROM v_vec CROSS JOIN range(4) g(j)),
cpos AS (SELECT j, CAST(sum(t) AS DOUBLE) AS c FROM lab WHERE id IN (SELECT id FROM tr) GROUP BY j),
pri AS (SELECT j, c, (1.0 + c) / (2.0 + n.n) AS p, n.n - c AS nc FROM cpos CROSS JOIN n),
ci AS (SELECT nt.qid AS id, l.j, sum(l.t) AS d FROM nt JOIN lab l ON l.id = nt.rid GROUP BY nt.qid, l.j),
ct AS (SELECT na.qid AS id, l.j, sum(l.t) AS d FROM na JOIN lab l ON l.id = na.rid GROUP BY na.qid, l.j),
ok AS (SELECT q.id AS qid, r.id AS rid FROM ct q JOIN ci r ON q.j = r.j GROUP BY q.id, r.id HAVING max(abs(q.d - r.d)) <= 6),
vt AS (SELECT ok.qid, q.j, sum(CASE WHEN q.d = r.d AND l.t = 1 THEN 1 ELSE 0 END) AS v,
              sum(CASE WHEN q.d = r.d AND l.t = 0 THEN 1 ELSE 0 END) AS nv
       FROM ok JOIN ct q ON q.id = ok.qid JOIN ci r ON r.id = ok.rid AND r.j = q.j JOIN lab l ON l.id = ok.rid AND l.j = q.j
       GROUP BY ok.qid, q.j),
sc AS (SELECT ct.id, ct.j, pri.p * (1.0 + coalesce(vt.v, 0)) / (4.0 + pri.c) AS pin,
              (1.0 - pri.p) * (1.0 + coalesce(vt.nv, 0)) / (4.0 + pri.nc) AS pout
       FROM ct JOIN pri USING (j) LEFT JOIN vt ON vt.qid = ct.id AND vt.j = ct.j)
SELECT id, CAST(j AS INTEGER) AS j, round(CASE WHEN pin + pout = 0 THEN pin ELSE pin / (pin + pout) END, 6) AS conf,
       CAST(pin >= pout AS INTEGER) AS bip FROM sc""")

sql("knn_select_k", _vec_ctes(_VEC_TR) + _nn("nt", "tr", "tr", 10, True) + """,
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM tr),
lab AS (SELECT id, CAST(g.j AS INTEGER) AS j, y[g.j + 1] AS t FROM v_vec CROSS JOIN range(4) g(j)),
run AS (
  SELECT nt.qid, nt.rank, l.j, sum(l.t) OVER (PARTITION BY nt.qid, l.j ORDER BY nt.rank) AS c
  FROM nt JOIN lab l ON l.id = nt.rid),
h AS (
  SELECT r.rank AS k, sum(CASE WHEN CAST((1.0 / n.n + r.c) / (4.0 / n.n + r.rank) >= 0.5 AS INTEGER) <> t.t THEN 1 ELSE 0 END)
         / (count(*) * 1.0) AS hamming_loss
  FROM run r JOIN lab t ON t.id = r.qid AND t.j = r.j CROSS JOIN n GROUP BY r.rank)
SELECT CAST(k AS INTEGER) AS k, round(hamming_loss, 6) AS hamming_loss, row_number() OVER (ORDER BY hamming_loss, k) = 1 AS best FROM h""")


# ---------------------------------------------------------------- 2.9 thresholding

_TH = with_views("v_userday") + scored_ctes("v_userday")

sql("th_expected_measure", _TH + """,
srt AS (SELECT id, j, s, row_number() OVER (PARTITION BY id ORDER BY s DESC, j) AS r FROM sc),
oc AS (SELECT srt.id, o.o, product(CASE WHEN ((o.o >> (srt.r - 1)) & 1) = 1 THEN srt.s ELSE 1 - srt.s END) AS pr
       FROM srt CROSS JOIN range(32) o(o) GROUP BY srt.id, o.o),
cnt AS (SELECT oc.id, oc.o, oc.pr, rr.R,
               sum(CASE WHEN srt.r <= rr.R AND ((oc.o >> (srt.r - 1)) & 1) = 1 THEN 1 ELSE 0 END) AS a,
               sum(CASE WHEN srt.r > rr.R AND ((oc.o >> (srt.r - 1)) & 1) = 1 THEN 1 ELSE 0 END) AS c
        FROM oc JOIN srt ON srt.id = oc.id CROSS JOIN range(1, 6) rr(R) GROUP BY oc.id, oc.o, oc.pr, rr.R),
ls AS (SELECT id, R, sum(pr * abs(1.0 - CASE WHEN a + (R - a) + c = 0 THEN 1.0 ELSE 2.0 * a / (2.0 * a + (R - a) + c) END)) AS loss
       FROM cnt GROUP BY id, R),
best AS (SELECT id, R FROM (SELECT id, R, row_number() OVER (PARTITION BY id ORDER BY round(loss, 10), R) AS k FROM ls) WHERE k = 1),
thr AS (SELECT b.id, b.R, (max(CASE WHEN s.r = b.R THEN s.s END) + coalesce(max(CASE WHEN s.r = b.R + 1 THEN s.s END), 0.0)) / 2 AS t
        FROM best b JOIN srt s ON s.id = b.id GROUP BY b.id, b.R)
SELECT thr.id, CAST(thr.R AS INTEGER) AS n, round(thr.t, 6) AS threshold,
       string_agg(CAST(CAST(srt.s >= thr.t AS INTEGER) AS VARCHAR), '' ORDER BY srt.j) AS bits
FROM thr JOIN srt ON srt.id = thr.id GROUP BY thr.id, thr.R, thr.t""")

sql("th_one", _TH + """,
cnt AS (SELECT s AS c, t, count(*) AS n FROM sc GROUP BY s, t),
g1 AS (SELECT CAST(k AS INTEGER) AS k, CAST(k AS DOUBLE) / 10 AS th FROM range(11) r(k)),
s1 AS (SELECT k, th AS threshold, sum(CASE WHEN CAST(c >= th AS INTEGER) <> t THEN n ELSE 0 END) / sum(n) AS hamming_loss
       FROM cnt CROSS JOIN g1 GROUP BY k, th),
b1 AS (SELECT k AS bk FROM s1 ORDER BY hamming_loss, k LIMIT 1),
g2 AS (SELECT CAST(i AS INTEGER) AS k, CAST(10 * bk + i - 5 AS DOUBLE) / 100 AS th FROM range(11) r(i) CROSS JOIN b1),
s2 AS (SELECT k, th AS threshold, sum(CASE WHEN CAST(c >= th AS INTEGER) <> t THEN n ELSE 0 END) / sum(n) AS hamming_loss
       FROM cnt CROSS JOIN g2 GROUP BY k, th)
SELECT 1 AS stage, k, round(threshold, 6) AS threshold, round(hamming_loss, 6) AS hamming_loss,
       row_number() OVER (ORDER BY hamming_loss, k) = 1 AS chosen FROM s1
UNION ALL
SELECT 2, k, round(threshold, 6), round(hamming_loss, 6), row_number() OVER (ORDER BY hamming_loss, k) = 1 FROM s2""")

sql("th_rcut", _TH + """,
cnt AS (SELECT rk AS r, t, count(*) AS n FROM sc GROUP BY rk, t),
res AS (SELECT CAST(g.k AS INTEGER) AS k, sum(CASE WHEN CAST(r <= g.k AS INTEGER) <> t THEN n ELSE 0 END) / sum(n) AS hl
        FROM cnt CROSS JOIN range(6) g(k) GROUP BY g.k),
card AS (SELECT CAST(floor(avg(n_rel) + 0.5) AS INTEGER) AS tc FROM pr)
SELECT 'measure' AS rule, k AS t, round(hl, 6) AS hamming_loss, row_number() OVER (ORDER BY hl, k) = 1 AS chosen FROM res
UNION ALL
SELECT 'cardinality', k, round(hl, 6), true FROM res JOIN card ON res.k = card.tc""")

sql("th_scut", _TH + """,
sj AS (SELECT j, s AS c, CAST(sum(t) AS DOUBLE) AS pos, CAST(sum(1 - t) AS DOUBLE) AS neg FROM sc GROUP BY j, s),
tot AS (SELECT j, sum(pos) AS P, sum(neg) AS N FROM sj GROUP BY j),
cands AS (
  SELECT sj.j, c AS threshold,
    coalesce(sum(pos) OVER (PARTITION BY sj.j ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + (tot.N - coalesce(sum(neg) OVER (PARTITION BY sj.j ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS errors
  FROM sj JOIN tot USING (j)
  UNION ALL SELECT j, 'inf'::DOUBLE, P FROM tot)
SELECT CAST(j AS INTEGER) AS j, round(threshold, 6) AS threshold, CAST(errors AS BIGINT) AS errors FROM (
  SELECT *, row_number() OVER (PARTITION BY j ORDER BY errors, threshold) AS r FROM cands) WHERE r = 1""")

sql("th_expected_f", _TH + """,
lst AS (SELECT id, list(s ORDER BY s DESC) AS ps, sum(s) AS tot FROM sc GROUP BY id),
fs AS (SELECT id, g.n + 1 AS n, 2 * list_sum(list_slice(ps, 1, g.n + 1)) / (tot + g.n + 1) AS f FROM lst CROSS JOIN range(5) g(n)),
best AS (SELECT id, n, f, row_number() OVER (PARTITION BY id ORDER BY f DESC, n) AS r FROM fs)
SELECT id, CAST(CASE WHEN f > 0 THEN n ELSE 1 END AS INTEGER) AS n FROM best WHERE r = 1""")

sql("th_predicted", _TH + """,
srt AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS k FROM sc),
mid AS (SELECT a.id, a.k, (a.s + coalesce(b.s, a.s)) / 2 AS m FROM srt a LEFT JOIN srt b ON b.id = a.id AND b.k = a.k - 1),
er AS (SELECT mid.id, mid.k, mid.m, sum(CASE WHEN (sc.t = 1 AND sc.s <= mid.m) OR (sc.t = 0 AND sc.s >= mid.m) THEN 1 ELSE 0 END) AS e
       FROM mid JOIN sc ON sc.id = mid.id GROUP BY mid.id, mid.k, mid.m),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY e, k) AS r FROM er)
SELECT id, round(CASE WHEN e < 5 THEN m ELSE 0.0 END, 6) AS threshold, CAST(least(e, 5) AS INTEGER) AS errors FROM b WHERE r = 1""")

sql("th_meta_labeler", _ORDER_TRAIN + f""",
ml_rows AS (SELECT 0 AS _m, id, {size_sql('y')} AS t FROM tr WHERE len(list_filter(y, lambda x: x IS NULL)) = 0),
ml_rfl AS (SELECT r._m, r.id, r.t, fl.f, fl.v FROM ml_rows r JOIN fl USING (id)),
ml_cls AS (SELECT DISTINCT _m, t FROM ml_rows)""" + nb_sql(["_m"], "ml_rows", "ml_rfl", "ml_cls", "fl_all", "allrows", "ml") + f""",
cidx AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS ci FROM ml_cls),
mx AS (SELECT id, t, s, max(s) OVER (PARTITION BY id) AS m FROM ml_score),
nn AS (SELECT id, arg_min(t, {h2_sql('id', 'ci', 7)}) AS n FROM mx JOIN cidx USING (t) WHERE s = m GROUP BY id),
scr AS (SELECT id, CAST(g.j AS INTEGER) AS j, ((id * 31 + g.j * 17) % 10) / 10.0 AS s FROM allrows CROSS JOIN range(6) g(j)),
rk AS (SELECT id, j, row_number() OVER (PARTITION BY id ORDER BY s DESC, j DESC) AS r FROM scr)
SELECT id, j, CAST(r <= n AS INTEGER) AS bip FROM rk JOIN nn USING (id)""")


# out-of-fold scores of the training rows, and (fold 3, to which no row belongs) scores of every row by the model on all training rows
_META = _ORDER_TRAIN + f""",
mf_own AS (SELECT id, y, {size_sql('y')} AS n, CAST({h_sql('id', 6)} % 3 AS INTEGER) AS own FROM tr),
mf_rows AS (SELECT CAST(k.fold AS INTEGER) AS fold, CAST(g.j AS INTEGER) AS j, id, y[g.j + 1] AS t
  FROM mf_own CROSS JOIN range(6) g(j) CROSS JOIN range(4) k(fold) WHERE k.fold <> own AND y[g.j + 1] IS NOT NULL),
mf_rfl AS (SELECT r.fold, r.j, r.id, r.t, f, v FROM mf_rows r JOIN fl USING (id)),
mf_cls AS (SELECT CAST(k.fold AS INTEGER) AS fold, CAST(g.j AS INTEGER) AS j, c.t FROM range(4) k(fold) CROSS JOIN range(6) g(j) CROSS JOIN (VALUES (0), (1)) c(t))""" + nb_sql(
    ["fold", "j"], "mf_rows", "mf_rfl", "mf_cls", "fl_all", "allrows", "mf") + """,
mf_all AS MATERIALIZED (
  SELECT id, fold, j, round(1.0 / (1.0 + exp(max(CASE WHEN t = 0 THEN s END) - max(CASE WHEN t = 1 THEN s END))), 9) AS s FROM mf_score GROUP BY id, fold, j),
mf_seen0 AS (SELECT a.id, a.j, a.s, o.n, o.y[a.j + 1] AS t FROM mf_all a JOIN mf_own o ON o.id = a.id AND o.own = a.fold
  WHERE len(list_filter(o.y, lambda x: x IS NULL)) = 0),
mf_new AS (SELECT id, j, s FROM mf_all WHERE fold = 3),
mf_rank AS MATERIALIZED (SELECT id, j, s, row_number() OVER (PARTITION BY id ORDER BY s DESC, j DESC) AS r FROM mf_new),
scores_seen AS MATERIALIZED (SELECT id, j AS i, s, n, t FROM mf_seen0),
scores_new AS MATERIALIZED (SELECT id, j AS i, s FROM mf_new),
ranks_seen AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS i, s, n, t FROM mf_seen0),
ranks_new AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS i, s FROM mf_new),
ids_seen AS MATERIALIZED (SELECT DISTINCT id, n FROM mf_seen0)"""


def _meta_class_sql(inputs: str) -> str:
    p = f"mk_{inputs}"
    if inputs == "content":
        seen, new = "fl", "fl_all"
        head = ""
    else:
        seen, new = f"{p}_seen", f"{p}_new"
        cat = "'s' || i AS f, CAST(CAST(floor(round(s * 20, 6)) AS BIGINT) AS VARCHAR) AS v"
        head = f""",
{seen} AS (SELECT id, {cat} FROM {inputs}_seen),
{new} AS (SELECT id, {cat} FROM {inputs}_new)"""
    return head + f""",
{p}_rows AS (SELECT 0 AS _m, id, n AS t FROM ids_seen),
{p}_rfl AS (SELECT r._m, r.id, r.t, x.f, x.v FROM {p}_rows r JOIN {seen} x USING (id)),
{p}_cls AS (SELECT DISTINCT _m, t FROM {p}_rows)""" + nb_sql(["_m"], f"{p}_rows", f"{p}_rfl", f"{p}_cls", new, "allrows", p) + f""",
{p}_n AS (SELECT id, min({{'s': -round(s, 9), 't': t}}).t AS n FROM {p}_score GROUP BY id)"""


def _meta_number_sql(p: str, inputs: str, target: str) -> str:
    """target(id, v) regressed on the scores or ranks: {p}_v(id, v)."""
    return _ols_sql(p, f"SELECT 0 AS k, id, i, s AS v, 1.0 AS w FROM {inputs}_seen UNION ALL SELECT 0, id, 6, v, 1.0 FROM {target}", 6) + f""",
{p}_v AS (SELECT x.id, any_value(b.b) + sum(c.c * x.s) AS v FROM {inputs}_new x JOIN {p}_c c ON c.i = x.i JOIN {p}_b b ON b.k = c.k GROUP BY x.id)"""


def _meta_sizes_sql() -> str:
    out = _META + "".join(_meta_class_sql(x) for x in ("content", "scores", "ranks")) + """,
sizes AS (SELECT id, CAST(n AS DOUBLE) AS v FROM ids_seen)""" + "".join(_meta_number_sql(f"mn_{x}", x, "sizes") for x in ("scores", "ranks"))
    found = [f"SELECT '{x}' AS inputs, 'class' AS head, id, CAST(n AS INTEGER) AS n FROM mk_{x}_n" for x in ("content", "scores", "ranks")]
    found += [f"SELECT '{x}', 'number', id, CAST(floor(round(v, 9) + 0.5) AS INTEGER) FROM mn_{x}_v" for x in ("scores", "ranks")]
    return out + ",\nsaid AS (" + " UNION ALL ".join(found) + """)
SELECT inputs, head, id, n, string_agg(CASE WHEN r <= n THEN '1' ELSE '0' END, '' ORDER BY j) AS bits
FROM said JOIN mf_rank USING (id) GROUP BY inputs, head, id, n"""


def _predicted_cut_sql() -> str:
    out = _META + """,
cut_mid AS (SELECT id, i, (s + coalesce(lag(s) OVER (PARTITION BY id ORDER BY i), s)) / 2 AS m FROM ranks_seen),
cut_err AS (SELECT a.id, a.i, a.m, sum(CASE WHEN (b.t = 1 AND b.s <= a.m) OR (b.t = 0 AND b.s >= a.m) THEN 1 ELSE 0 END) AS e
  FROM cut_mid a JOIN scores_seen b ON b.id = a.id GROUP BY a.id, a.i, a.m),
cut_best AS (SELECT id, min({'e': e, 'i': i, 'm': m}) AS b FROM cut_err GROUP BY id),
cuts AS MATERIALIZED (SELECT id, CASE WHEN b.e < 6 THEN b.m ELSE 0.0 END AS v FROM cut_best)"""
    out += "".join(_meta_number_sql(f"mc_{x}", x, "cuts") for x in ("scores", "ranks"))
    parts = [f"""SELECT '{x}' AS inputs, id, round(round(v, 9), 6) AS threshold, string_agg(CASE WHEN s >= round(v, 9) THEN '1' ELSE '0' END, '' ORDER BY j) AS bits
FROM mc_{x}_v JOIN mf_new USING (id) GROUP BY id, v""" for x in ("scores", "ranks")]
    return out + "\n" + " UNION ALL ".join(parts)


# ---------------------------------------------------------------- 2.6 feature ranking and selection

def _ig_sql(rows: str, keys: str) -> str:
    """CTE ig(keys, feature, info_gain, gain_ratio) from rows(keys, t, f, v, w)."""
    return f""",
c AS (SELECT {keys}, f, v, t, sum(w) AS n FROM {rows} GROUP BY {keys}, f, v, t),
fv AS (SELECT {keys}, f, v, sum(n) AS nfv FROM c GROUP BY {keys}, f, v),
ft AS (SELECT {keys}, f, t, sum(n) AS nft FROM c GROUP BY {keys}, f, t),
tot AS (SELECT {keys}, f, sum(n) AS N FROM c GROUP BY {keys}, f),
hy AS (SELECT {keys}, f, -sum(CASE WHEN nft > 0 THEN nft / N * log2(nft / N) ELSE 0 END) AS hy
       FROM ft JOIN tot USING ({keys}, f) GROUP BY {keys}, f),
cond AS (SELECT {keys}, f, v, -sum(CASE WHEN n > 0 THEN n / nfv * log2(n / nfv) ELSE 0 END) AS hv, max(nfv) AS nfv
         FROM c JOIN fv USING ({keys}, f, v) GROUP BY {keys}, f, v),
hyx AS (SELECT {keys}, f, sum(nfv / N * hv) AS hyx, -sum(CASE WHEN nfv > 0 THEN nfv / N * log2(nfv / N) ELSE 0 END) AS hx
        FROM cond JOIN tot USING ({keys}, f) GROUP BY {keys}, f),
ig AS (SELECT {keys}, f AS feature, hy - hyx AS info_gain, CASE WHEN hx > 0 THEN (hy - hyx) / hx ELSE 0.0 END AS gain_ratio
       FROM hy JOIN hyx USING ({keys}, f))"""


_FS = with_views("v_order") + """,
fl_all AS (
  UNPIVOT (SELECT id, f_prio, f_status, CAST(f_lines AS VARCHAR) AS f_lines, CAST(f_qty AS VARCHAR) AS f_qty,
                  CAST(f_price AS VARCHAR) AS f_price FROM v_order)
  ON f_prio, f_status, f_lines, f_qty, f_price INTO NAME f VALUE v),
lr AS (SELECT CAST(g.j AS INTEGER) AS j, id, y[g.j + 1] AS t FROM v_order CROSS JOIN range(6) g(j) WHERE y[g.j + 1] IS NOT NULL),
rows_br AS (SELECT lr.j, lr.t, fl_all.f, fl_all.v, 1.0 AS w FROM lr JOIN fl_all USING (id))""" + _ig_sql("rows_br", "j")

sql("fs_score_per_label", _FS + """
SELECT j, feature, round(info_gain, 6) AS info_gain, round(gain_ratio, 6) AS gain_ratio FROM ig""")

sql("fs_normalize", _FS + """
SELECT 'dl' AS norm, j, feature,
  round(CASE WHEN sqrt(sum(info_gain * info_gain) OVER (PARTITION BY j)) <> 0
             THEN info_gain / sqrt(sum(info_gain * info_gain) OVER (PARTITION BY j)) ELSE info_gain END, 6) AS score FROM ig
UNION ALL
SELECT 'dm', j, feature,
  round(CASE WHEN max(info_gain) OVER (PARTITION BY j) <> 0 THEN info_gain / max(info_gain) OVER (PARTITION BY j) ELSE info_gain END, 6) FROM ig""")

sql("fs_combine", _FS + """
SELECT 'max' AS comb, feature, round(max(info_gain), 6) AS score FROM ig GROUP BY feature
UNION ALL SELECT 'min', feature, round(min(info_gain), 6) FROM ig GROUP BY feature
UNION ALL SELECT 'avg', feature, round(avg(info_gain), 6) FROM ig GROUP BY feature""")

sql("fs_rank_mode", _FS + """
SELECT feature, round(avg(5 - r), 6) AS score FROM (
  SELECT j, feature, row_number() OVER (PARTITION BY j ORDER BY info_gain DESC, feature DESC) AS r FROM ig)
GROUP BY feature""")

sql("fs_score_powerset", with_views("v_order") + f""",
fl_all AS (
  UNPIVOT (SELECT id, f_prio, f_status, CAST(f_lines AS VARCHAR) AS f_lines, CAST(f_qty AS VARCHAR) AS f_qty,
                  CAST(f_price AS VARCHAR) AS f_price FROM v_order)
  ON f_prio, f_status, f_lines, f_qty, f_price INTO NAME f VALUE v),
rows_lp AS (SELECT 0 AS _m, {bits_sql('y')} AS t, fl_all.f, fl_all.v, 1.0 AS w FROM v_order JOIN fl_all USING (id))""" + _ig_sql("rows_lp", "_m") + """
SELECT feature, round(info_gain, 6) AS info_gain, round(gain_ratio, 6) AS gain_ratio FROM ig""")

sql("fs_score_multiclass", _FS.replace(_ig_sql("rows_br", "j"), "") + """,
rows_mc AS (SELECT 0 AS _m, lr.j AS t, fl_all.f, fl_all.v, 1.0 AS w FROM lr JOIN fl_all USING (id) WHERE lr.t = 1)""" + _ig_sql("rows_mc", "_m") + """
SELECT feature, round(info_gain, 6) AS info_gain, round(gain_ratio, 6) AS gain_ratio FROM ig""")

_RANKED = _FS + """,
nrm AS (SELECT j, feature, CASE WHEN max(info_gain) OVER (PARTITION BY j) <> 0 THEN info_gain / max(info_gain) OVER (PARTITION BY j)
                                ELSE info_gain END AS score FROM ig),
cmb AS (SELECT feature, avg(score) AS score FROM nrm GROUP BY feature),
rk AS (SELECT feature, score, row_number() OVER (ORDER BY score DESC, feature) AS rank FROM cmb)"""

sql("fs_ranker", _RANKED + "\nSELECT CAST(rank AS INTEGER) AS rank, feature, round(score, 6) AS score FROM rk")
sql("fs_top_k", _RANKED + "\nSELECT feature FROM rk WHERE rank <= 3")
sql("fs_threshold", _RANKED + "\nSELECT feature FROM rk WHERE score >= 0.2")
sql("fs_top_pct", _RANKED + "\nSELECT feature FROM rk WHERE rank <= CAST(round(5 * 40.0 / 100) AS INTEGER)")
sql("fs_apply", _RANKED + """
SELECT fl_all.id, fl_all.f AS feature, fl_all.v AS value FROM fl_all JOIN rk ON rk.feature = fl_all.f WHERE rk.rank <= 3""")


# ---------------------------------------------------------------- 2.11 multi-target regression

_REG = with_views("v_target") + f""",
tr AS (SELECT * FROM v_target WHERE {u_sql('id', 3)} * 100 < 67.0),
te AS (SELECT * FROM v_target WHERE NOT ({u_sql('id', 3)} * 100 < 67.0)),
coef AS (SELECT CAST(g.j AS INTEGER) AS j, regr_slope(target[g.j + 1], o_totalprice) AS w,
                regr_intercept(target[g.j + 1], o_totalprice) AS b
         FROM tr CROSS JOIN range(3) g(j) GROUP BY g.j),
mu AS (SELECT CAST(g.j AS INTEGER) AS j, avg(target[g.j + 1]) AS mu FROM tr CROSS JOIN range(3) g(j) GROUP BY g.j)"""

sql("rg_single_target", _REG + """
SELECT v.id, coef.j, round(coef.b + coef.w * v.o_totalprice, 4) AS pred FROM v_target v CROSS JOIN coef""")

_REG_EV = _REG + """,
ev AS (
  SELECT coef.j, avg(abs(coef.b + coef.w * te.o_totalprice - te.target[coef.j + 1])) AS mae,
         sqrt(avg(power(coef.b + coef.w * te.o_totalprice - te.target[coef.j + 1], 2))) AS rmse,
         avg(abs(mu.mu - te.target[coef.j + 1])) AS bmae, sqrt(avg(power(mu.mu - te.target[coef.j + 1], 2))) AS brmse
  FROM te CROSS JOIN coef JOIN mu ON mu.j = coef.j
  WHERE te.target[coef.j + 1] IS NOT NULL AND NOT isnan(te.target[coef.j + 1])
  GROUP BY coef.j),
evm AS (SELECT j, mae, rmse, CASE WHEN bmae <> 0 THEN mae / bmae END AS rel_mae, CASE WHEN brmse <> 0 THEN rmse / brmse END AS rel_rmse FROM ev)"""

for _name, _col in (("ev_mae", "mae"), ("ev_avg_rmse", "rmse"), ("ev_relative_mae", "rel_mae"), ("ev_relative_rmse", "rel_rmse")):
    sql(_name, _REG_EV + f"""
SELECT j, round({_col}, 6) AS value FROM evm
UNION ALL SELECT CAST(NULL AS INTEGER), round(avg({_col}), 6) FROM evm""")


# least squares on several features: centred cross-products, then one sweep per feature

_REG3 = with_views("v_target") + f""",
tr AS (SELECT *, {h_sql('id', 1)} % 3 AS fold FROM v_target WHERE {u_sql('id', 3)} * 100 < 67.0),
te AS (SELECT * FROM v_target WHERE NOT ({u_sql('id', 3)} * 100 < 67.0)),
tin0 AS (SELECT id, g.i, ([o_totalprice, n_lines, prio])[g.i + 1] AS v FROM tr CROSS JOIN range(3) g(i)),
pin0 AS (SELECT id, g.i, ([o_totalprice, n_lines, prio])[g.i + 1] AS v FROM v_target CROSS JOIN range(3) g(i))"""


def _ols_sql(p: str, rows: str, d: int) -> str:
    """rows(k, id, i, v, w), i = d the target -> {p}_c(k, i, c) coefficients, {p}_b(k, b) constants."""
    out = f""",
{p}_r AS MATERIALIZED ({rows}),
{p}_m AS (SELECT k, i, sum(w * v) / sum(w) AS m FROM {p}_r GROUP BY k, i),
{p}_z AS (SELECT r.k, r.id, r.i, r.v - m.m AS v, r.w FROM {p}_r r JOIN {p}_m m ON m.k = r.k AND m.i = r.i),
{p}_s0 AS MATERIALIZED (SELECT a.k, a.i, b.i AS j, sum(a.w * a.v * b.v) AS v FROM {p}_z a JOIN {p}_z b ON b.k = a.k AND b.id = a.id GROUP BY a.k, a.i, b.i)"""
    for q in range(d):
        out += f""",
{p}_s{q + 1} AS MATERIALIZED (SELECT a.k, a.i, a.j, CASE WHEN a.i = {q} AND a.j = {q} THEN 1 / x.v WHEN a.i = {q} THEN a.v / x.v WHEN a.j = {q} THEN -a.v / x.v ELSE a.v - r.v * c.v / x.v END AS v
  FROM {p}_s{q} a JOIN {p}_s{q} x ON x.k = a.k AND x.i = {q} AND x.j = {q} JOIN {p}_s{q} r ON r.k = a.k AND r.i = a.i AND r.j = {q} JOIN {p}_s{q} c ON c.k = a.k AND c.i = {q} AND c.j = a.j)"""
    return out + f""",
{p}_c AS (SELECT k, i, v AS c FROM {p}_s{d} WHERE j = {d} AND i < {d}),
{p}_b AS (SELECT m.k, any_value(m.m) - sum(c.c * x.m) AS b FROM {p}_m m JOIN {p}_c c ON c.k = m.k JOIN {p}_m x ON x.k = m.k AND x.i = c.i WHERE m.i = {d} GROUP BY m.k)"""


def _fit_sql(p: str, tin: str, t: int, d: int, weight: str, cv: bool) -> str:
    """The model of target t (k = -1), and with ``cv`` those without each fold; prediction CTE {p}_p(id, v) from ``pin`` of the same name."""
    rows = f"SELECT -1 AS k, a.id, a.i, a.v, {weight} AS w FROM {tin} a UNION ALL SELECT -1, id, {d}, target[{t + 1}], {weight} FROM tr a"
    if cv:
        rows += f""" UNION ALL SELECT g.k, a.id, a.i, a.v, 1.0 FROM {tin} a JOIN tr USING (id) CROSS JOIN range(3) g(k) WHERE tr.fold <> g.k
  UNION ALL SELECT g.k, id, {d}, target[{t + 1}], 1.0 FROM tr CROSS JOIN range(3) g(k) WHERE tr.fold <> g.k"""
    return _ols_sql(p, rows, d)


def _said_sql(p: str, name: str, inputs: str) -> str:
    return f""",
{name} AS MATERIALIZED (SELECT x.id, any_value(b.b) + sum(c.c * x.v) AS v FROM {inputs} x JOIN {p}_c c ON c.i = x.i AND c.k = -1 JOIN {p}_b b ON b.k = -1 GROUP BY x.id)"""


def _out_of_fold_sql(p: str, name: str, inputs: str) -> str:
    return f""",
{name} AS MATERIALIZED (SELECT x.id, any_value(b.b) + sum(c.c * x.v) AS v FROM {inputs} x JOIN tr USING (id) JOIN {p}_c c ON c.i = x.i AND c.k = tr.fold JOIN {p}_b b ON b.k = tr.fold GROUP BY x.id)"""


def _chain_sql(p: str, order: list[int], mode: str = "true", weight: str = "1.0") -> str:
    """CTEs {p}_p<target>(id, v): predictions of a regressor chain for all rows."""
    out, tin, pin = "", "tin0", "pin0"
    for k, t in enumerate(order):
        link = f"{p}_{k}"
        out += _fit_sql(link, tin, t, 3 + k, weight, mode == "cv") + _said_sql(link, f"{p}_p{t}", pin)
        if k < len(order) - 1:
            if mode == "true":
                out += f", {p}_m{k} AS (SELECT id, target[{t + 1}] AS v FROM tr)"
            else:
                out += _out_of_fold_sql(link, f"{p}_m{k}", tin)
            out += f""",
{p}_t{k} AS (SELECT id, i, v FROM {tin} UNION ALL SELECT id, {3 + k}, v FROM {p}_m{k}),
{p}_x{k} AS (SELECT id, i, v FROM {pin} UNION ALL SELECT id, {3 + k}, v FROM {p}_p{t})"""
            tin, pin = f"{p}_t{k}", f"{p}_x{k}"
    return out


def _plain_sql(p: str, weight: str = "1.0") -> str:
    """CTEs {p}_p<target>: each target on the features alone."""
    return "".join(_fit_sql(f"{p}_{t}", "tin0", t, 3, weight, False) + _said_sql(f"{p}_{t}", f"{p}_p{t}", "pin0") for t in range(3))


def _preds_sql(p: str, rest: str = "") -> str:
    return " UNION ALL ".join(f"SELECT id, {t} AS j, round(v, 4) AS pred{rest} FROM {p}_p{t}" for t in range(3))


sql("rg_chain_simple", _REG3 + _chain_sql("rc", [2, 0, 1]) + "\n" + _preds_sql("rc"))
sql("rg_chain", _REG3 + _chain_sql("rc", [2, 0, 1], "cv") + "\n" + _preds_sql("rc"))
# predictions of linear models for the training rows, and targets recovered from enough mixes, leave the plain models
sql("rg_stacking", _REG3 + _plain_sql("st") + "\n" + _preds_sql("st"))
sql("rg_random_combinations", _REG3 + _plain_sql("st") + "\n" + _preds_sql("st"))
sql("rg_chain_modes", _REG3 + _plain_sql("st") + "\nSELECT mode, q.* FROM (" + _preds_sql("st") + ") q CROSS JOIN (VALUES ('train'), ('sample')) m(mode)")


def _stack_cv_sql() -> str:
    out = _REG3
    for t in range(3):
        out += _fit_sql(f"s1_{t}", "tin0", t, 3, "1.0", True) + _said_sql(f"s1_{t}", f"s1_p{t}", "pin0") + _out_of_fold_sql(f"s1_{t}", f"s1_o{t}", "tin0")
    for t in range(3):
        a, b = [o for o in range(3) if o != t]
        out += f""",
s2_t{t} AS (SELECT id, i, v FROM tin0 UNION ALL SELECT id, 3, v FROM s1_o{a} UNION ALL SELECT id, 4, v FROM s1_o{b}),
s2_x{t} AS (SELECT id, i, v FROM pin0 UNION ALL SELECT id, 3, v FROM s1_p{a} UNION ALL SELECT id, 4, v FROM s1_p{b})"""
        out += _fit_sql(f"s2_{t}", f"s2_t{t}", t, 5, "1.0", False) + _said_sql(f"s2_{t}", f"s2_p{t}", f"s2_x{t}")
    return out + "\n" + _preds_sql("s2")


sql("rg_stacking_cv", _stack_cv_sql())


def _chains_sql() -> str:
    from polytag.operators.regress import random_chains
    from polytag.operators.split import poisson1_thresholds

    out = _REG3
    steps = "[" + ", ".join(repr(t) for t in poisson1_thresholds()) + "]"
    chains = random_chains(3, 4, 1)
    for m, order in enumerate(chains):
        weight = f"CAST(len(list_filter({steps}, lambda z: {u2_sql('a.id', str(m), 1)} >= z)) AS DOUBLE)"
        out += _chain_sql(f"e{m}", order, "true", weight)
    every = " UNION ALL ".join(f"SELECT id, {t} AS j, v FROM e{m}_p{t}" for m in range(len(chains)) for t in range(3))
    return out + f"\nSELECT id, j, round(avg(v), 4) AS pred FROM ({every}) GROUP BY id, j"


sql("rg_ensemble_chains", _chains_sql())

_RUNS = {"single_target": "st", "chain": "rc", "stacking": "st"}
sql("rg_compare", _REG3 + _plain_sql("st") + _chain_sql("rc", [2, 0, 1]) + """,
said AS (""" + " UNION ALL ".join(f"SELECT '{name}' AS method, {t} AS j, id, v FROM {p}_p{t}" for name, p in _RUNS.items() for t in range(3)) + """)
SELECT method, j, round(avg(abs(v - target[j + 1])), 6) AS mae, round(sqrt(avg(power(v - target[j + 1], 2))), 6) AS rmse
FROM said JOIN te USING (id) GROUP BY method, j""")


# ---------------------------------------------------------------- 2.8 label orderings

def _mi_chain_sql(mode: str) -> str:
    key = "mi * 1000000 + j" if mode == "min" else "-mi * 1000000 + j"
    return "WITH RECURSIVE " + with_views("v_userday")[len("WITH "):] + pair_ctes("v_userday") + """,
mi AS (
  SELECT i, j, round(
      (CASE WHEN n11 > 0 THEN (n11 / n) * ln((n11 / n) / (px1 * py1)) ELSE 0.0 END)
    + (CASE WHEN n10 > 0 THEN (n10 / n) * ln((n10 / n) / (px1 * (1 - py1))) ELSE 0.0 END)
    + (CASE WHEN n01 > 0 THEN (n01 / n) * ln((n01 / n) / ((1 - px1) * py1)) ELSE 0.0 END)
    + (CASE WHEN n00 > 0 THEN (n00 / n) * ln((n00 / n) / ((1 - px1) * (1 - py1))) ELSE 0.0 END), 3) AS mi
  FROM (SELECT i, j, CAST(N AS DOUBLE) AS n, n11, n1i - n11 AS n10, n1j - n11 AS n01, N - n1i - n1j + n11 AS n00,
               n1i / CAST(N AS DOUBLE) AS px1, n1j / CAST(N AS DOUBLE) AS py1 FROM pt WHERE i < j) q),
sym AS (SELECT i, j, mi FROM mi UNION ALL SELECT j, i, mi FROM mi),
start AS (SELECT i AS a, j AS b FROM mi ORDER BY mi, i, j LIMIT 1),
rec AS (
  SELECT 2 AS n, b AS last, [a, b] AS chain FROM start
  UNION ALL
  SELECT n + 1, nxt, list_append(chain, nxt) FROM (
    SELECT r.n, r.chain, (SELECT arg_min(s.j, """ + key.replace("mi", "s.mi").replace("+ j", "+ s.j") + """) FROM sym s
                           WHERE s.i = r.last AND NOT list_contains(r.chain, s.j)) AS nxt
    FROM rec r WHERE r.n < 5) q
)
SELECT CAST(g.p AS INTEGER) AS pos, CAST(chain[g.p + 1] AS INTEGER) AS j FROM rec CROSS JOIN range(5) g(p) WHERE n = 5"""


sql("label_chain_mi_min", _mi_chain_sql("min"))
sql("label_chain_mi_max", _mi_chain_sql("max"))

sql("label_tree_random", with_views("v_tree") + "," + long_cte("v_tree", "lng") + f""",
seen AS (SELECT CAST(j AS INTEGER) AS j, count(*) AS n FROM lng WHERE t = 1 GROUP BY j),
al AS (SELECT CAST(g.j AS INTEGER) AS j, coalesce(n, 0) AS n FROM range({VIEW_L["v_tree"]}) g(j) LEFT JOIN seen USING (j))
SELECT j, CAST(ntile(3) OVER (ORDER BY {h_sql('j', 4)}, j) - 1 AS INTEGER) AS grp, n FROM al""")


# ---------------------------------------------------------------- 2.7 local chain and HMC

sql("ln_local_chain", "WITH RECURSIVE " + _ORDER_TRAIN[len("WITH "):] + """,
ch AS (SELECT * FROM (VALUES (0, 4), (1, 1), (2, 3)) v(k, lab)),
lc_rows AS (SELECT ch.k AS link, b.id, b.t FROM br_rows b JOIN ch ON b.j = ch.lab),
lc_rfl AS (
  SELECT r.link, r.id, r.t, fl.f, fl.v FROM lc_rows r JOIN fl USING (id)
  UNION ALL
  SELECT r.link, r.id, r.t, '__lab' || CAST(p.lab AS VARCHAR), CAST(b.t AS VARCHAR)
  FROM lc_rows r JOIN ch p ON p.k < r.link JOIN br_rows b ON b.id = r.id AND b.j = p.lab),
lc_cls AS (SELECT CAST(k AS INTEGER) AS link, c.t FROM ch CROSS JOIN (VALUES (0), (1)) c(t))""" + nb_sql(
    ["link"], "lc_rows", "lc_rfl", "lc_cls", "fl_all", "allrows", "lc") + """,
labw AS (
  SELECT w.link, ch.k AS cpos, CAST(w.v AS INTEGER) AS v, w.t, w.w
  FROM lc_wt w JOIN ch ON ch.lab = CAST(substr(w.f, 6) AS INTEGER) WHERE w.f LIKE '\\_\\_lab%' ESCAPE '\\'),
bs AS (SELECT id, link, max(CASE WHEN t = 0 THEN s END) AS s0, max(CASE WHEN t = 1 THEN s END) AS s1 FROM lc_score GROUP BY id, link),
rec AS (
  SELECT id, 0 AS k, CAST([] AS INTEGER[]) AS preds, CAST([] AS DOUBLE[]) AS confs FROM allrows
  UNION ALL
  SELECT id, k + 1, list_append(preds, CAST(z1 >= z0 AS INTEGER)), list_append(confs, 1.0 / (1.0 + exp(z0 - z1)))
  FROM (
    SELECT r.id, r.k, r.preds, r.confs,
      bs.s0 + coalesce((SELECT sum(w) FROM labw lw WHERE lw.link = r.k AND lw.t = 0 AND lw.cpos < r.k AND lw.v = r.preds[lw.cpos + 1]), 0.0) AS z0,
      bs.s1 + coalesce((SELECT sum(w) FROM labw lw WHERE lw.link = r.k AND lw.t = 1 AND lw.cpos < r.k AND lw.v = r.preds[lw.cpos + 1]), 0.0) AS z1
    FROM rec r JOIN bs ON bs.id = r.id AND bs.link = r.k
    WHERE r.k < 3) q
)
SELECT rec.id, CAST(ch.lab AS INTEGER) AS j, round(confs[ch.k + 1], 6) AS conf, preds[ch.k + 1] AS bip
FROM rec CROSS JOIN ch WHERE rec.k = 3""")

sql("ln_hmc", with_views("v_tree") + "," + long_cte("v_tree", "lng") + f""",
reg AS (
  SELECT id, list(rv ORDER BY r) AS meta FROM (
    SELECT lng.id, n.n_regionkey AS r, max(lng.t) AS rv FROM lng JOIN nation n ON n.n_nationkey = lng.j GROUP BY lng.id, n.n_regionkey)
  GROUP BY id),
hy AS (SELECT v_tree.*, list_concat(v_tree.y, reg.meta) AS hy FROM v_tree JOIN reg USING (id)),
par AS (SELECT CAST(n_nationkey AS INTEGER) AS j, CAST(n_regionkey + 25 AS INTEGER) AS p FROM nation),
tr AS (SELECT * FROM hy WHERE {u_sql('id', 3)} * 100 < 67.0),
fl_all AS (
  UNPIVOT (SELECT id, f_prio, f_status, CAST(f_lines AS VARCHAR) AS f_lines, CAST(f_qty AS VARCHAR) AS f_qty,
                  CAST(f_price AS VARCHAR) AS f_price FROM hy)
  ON f_prio, f_status, f_lines, f_qty, f_price INTO NAME f VALUE v),
fl AS (SELECT * FROM fl_all WHERE id IN (SELECT id FROM tr)),
allrows AS (SELECT id FROM hy),
hm_rows AS (
  SELECT CAST(g.j AS INTEGER) AS j, tr.id, tr.hy[g.j + 1] AS t
  FROM tr CROSS JOIN range(30) g(j) LEFT JOIN par ON par.j = g.j
  WHERE tr.hy[g.j + 1] IS NOT NULL AND (par.p IS NULL OR tr.hy[par.p + 1] = 1)),
hm_rfl AS (SELECT r.j, r.id, r.t, fl.f, fl.v FROM hm_rows r JOIN fl USING (id)),
hm_cls AS (SELECT CAST(g.j AS INTEGER) AS j, c.t FROM range(30) g(j) CROSS JOIN (VALUES (0), (1)) c(t))""" + nb_sql(
    ["j"], "hm_rows", "hm_rfl", "hm_cls", "fl_all", "allrows", "hm") + """,
own AS (
  SELECT id, j, 1.0 / (1.0 + exp(max(CASE WHEN t = 0 THEN s END) - max(CASE WHEN t = 1 THEN s END))) AS conf,
         CAST(max(CASE WHEN t = 1 THEN s END) >= max(CASE WHEN t = 0 THEN s END) AS INTEGER) AS bip
  FROM hm_score GROUP BY id, j)
SELECT o.id, CAST(o.j AS INTEGER) AS j,
  round(CASE WHEN par.p IS NULL OR pr.bip = 1 THEN o.conf ELSE pr.conf END, 6) AS conf,
  CAST(CASE WHEN par.p IS NULL OR pr.bip = 1 THEN o.bip ELSE 0 END AS INTEGER) AS bip
FROM own o LEFT JOIN par ON par.j = o.j LEFT JOIN own pr ON pr.id = o.id AND pr.j = par.p""")


# ---------------------------------------------------------------- 2.1 sources (round trips)

sql("read_arff", with_views("v_order") + f"""
SELECT id, {bits_sql('y')} AS bits, f_prio, f_status, f_lines, f_qty, f_price FROM v_order""")

sql("read_libsvm_ml", with_views("v_order") + f"""
SELECT id, {bits_sql('y')} AS bits, round(CAST(n_lines AS DOUBLE), 6) AS n_lines, round(CAST(sum_qty AS DOUBLE), 6) AS sum_qty,
       round(o_totalprice, 6) AS o_totalprice FROM v_order""")

sql("read_hier_csv", with_views("v_tree") + "," + long_cte("v_tree", "lng") + """,
nr AS (SELECT CAST(n_nationkey AS INTEGER) AS j, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT id, label FROM (
  SELECT lng.id, nr.r_name AS label FROM lng JOIN nr USING (j) WHERE lng.t = 1
  UNION ALL
  SELECT lng.id, nr.r_name || '/' || nr.n_name FROM lng JOIN nr USING (j) WHERE lng.t = 1)""")

sql("read_text_vectors", with_views("v_vec") + """
SELECT id, CAST(g.i AS INTEGER) AS i, round(CAST(embedding[g.i + 1] AS DOUBLE), 6) AS x FROM v_vec CROSS JOIN range(64) g(i)""")

sql("write_ml_parquet", ORACLE["tr_hierarchical"])
sql("model_save_load", ORACLE["ln_binary_relevance"])


# ---------------------------------------------------------------- 2.12 streaming (same results as the batch forms)

sql("st_score", ORACLE["ln_binary_relevance"])

sql("st_update_counts", with_views("v_userday") + "," + long_cte("v_userday", "lng") + """
SELECT j, t, count(*) AS n FROM lng GROUP BY j, t""")

sql("st_windowed_measures", _EV_UD + """,
win AS (
  SELECT strftime(time_bucket(INTERVAL 7 DAY, CAST(DATE '1970-01-01' + CAST(id % 100000 AS INTEGER) AS TIMESTAMP),
                              TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS window_start,
         sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(L) AS cells
  FROM pr GROUP BY 1)
SELECT window_start, round((fp + fn) / cells, 6) AS hamming_loss,
       round(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 2 * tp / (2 * tp + fn + fp) END, 6) AS micro_f1
FROM win""")


# ---------------------------------------------------------------- views

sql("v_userday", with_views("v_userday") + f"""
SELECT id, n_events, round(sum_value, 6) AS sum_value, first_hour, f_n, f_hour, f_val, {bits_sql('y')} AS bits FROM v_userday""")
sql("v_order", with_views("v_order") + f"""
SELECT id, round(o_totalprice, 6) AS o_totalprice, n_lines, round(sum_qty, 6) AS sum_qty, f_prio, f_status, f_lines, f_qty, f_price,
       {bits_sql('y')} AS bits FROM v_order""")
sql("v_tree", with_views("v_tree") + f"""
SELECT id, n_lines, round(sum_qty, 6) AS sum_qty, f_prio, f_status, f_lines, f_qty, f_price, {bits_sql('y')} AS bits FROM v_tree""")
sql("v_doc", with_views("v_doc") + f"""
SELECT id, lang, source, n_chars, f_len, {bits_sql('y')} AS bits FROM v_doc""")
sql("v_vec", with_views("v_vec") + f"""
SELECT id, label, {bits_sql('y')} AS bits FROM v_vec""")
sql("v_target", with_views("v_target") + """
SELECT id, round(o_totalprice, 6) AS o_totalprice, round(n_lines, 6) AS n_lines, round(prio, 6) AS prio,
       round(target[1], 6) AS t0, round(target[2], 6) AS t1, round(target[3], 6) AS t2 FROM v_target""")


# ---------------------------------------------------------------- 2.3 conditional dependence

sql("conditional_dependence", with_views("v_userday") + f""",
fo AS (SELECT id, CAST((_rk - 1) % 10 AS INTEGER) AS fold FROM {salted_rank_sql('v_userday', '', h_sql('id', 1))} r),
x AS (SELECT v.id, fo.fold, v.y, CAST(f_n AS VARCHAR) AS f_n, CAST(f_hour AS VARCHAR) AS f_hour, CAST(f_val AS VARCHAR) AS f_val
      FROM v_userday v JOIN fo USING (id)),
fl AS (UNPIVOT (SELECT id, fold, f_n, f_hour, f_val FROM x) ON f_n, f_hour, f_val INTO NAME f VALUE v),
folds AS (SELECT CAST(g.k AS INTEGER) AS fold FROM range(10) g(k)),
lab AS (SELECT id, fold, CAST(g.i AS INTEGER) AS i, y[g.i + 1] AS t FROM x CROSS JOIN range(5) g(i) WHERE y[g.i + 1] IS NOT NULL),
cf AS (SELECT l.fold, l.i, fl.f, fl.v, l.t, count(*) AS c FROM lab l JOIN fl USING (id) GROUP BY l.fold, l.i, fl.f, fl.v, l.t),
ctot AS (SELECT i, f, v, t, sum(c) AS c FROM cf GROUP BY i, f, v, t),
w AS (SELECT k.fold, a.i, a.f, a.v, a.t, ln(a.c - coalesce(b.c, 0) + 1.0) AS w
      FROM folds k CROSS JOIN ctot a LEFT JOIN cf b ON b.fold = k.fold AND b.i = a.i AND b.f = a.f AND b.v = a.v AND b.t = a.t),
vf AS (SELECT f, count(DISTINCT v) AS nv FROM cf GROUP BY f),
cls AS (SELECT k.fold, CAST(g.i AS INTEGER) AS i, c.t FROM folds k CROSS JOIN range(5) g(i) CROSS JOIN (VALUES (0), (1)) c(t)),
nf AS (SELECT fold, i, t, count(*) AS c FROM lab GROUP BY fold, i, t),
ntt AS (SELECT i, t, sum(c) AS c FROM nf GROUP BY i, t),
nt AS (SELECT cls.fold, cls.i, cls.t, CAST(coalesce(ntt.c, 0) - coalesce(nf.c, 0) AS DOUBLE) AS n
       FROM cls LEFT JOIN ntt ON ntt.i = cls.i AND ntt.t = cls.t LEFT JOIN nf ON nf.fold = cls.fold AND nf.i = cls.i AND nf.t = cls.t),
lg AS (SELECT nt.fold, nt.i, nt.t, sum(ln(nt.n + vf.nv)) AS lg FROM nt CROSS JOIN vf GROUP BY nt.fold, nt.i, nt.t),
kc AS (SELECT nt.fold, nt.i, nt.t, ln((nt.n + 1.0) / (sum(nt.n) OVER (PARTITION BY nt.fold, nt.i) + 2.0)) - lg.lg AS kc
       FROM nt JOIN lg USING (fold, i, t)),
sw AS (SELECT fl.id, w.i, w.t, sum(w.w) AS w FROM fl JOIN w ON w.fold = fl.fold AND w.f = fl.f AND w.v = fl.v GROUP BY fl.id, w.i, w.t),
s AS (SELECT x.id, x.fold, kc.i, kc.t, kc.kc + coalesce(sw.w, 0.0) AS s
      FROM x JOIN kc ON kc.fold = x.fold LEFT JOIN sw ON sw.id = x.id AND sw.i = kc.i AND sw.t = kc.t),
dl AS (SELECT s.id, s.fold, s.i, l.t AS yi, max(CASE WHEN s.t = 1 THEN s.s END) - max(CASE WHEN s.t = 0 THEN s.s END) AS delta
       FROM s JOIN lab l ON l.id = s.id AND l.i = s.i GROUP BY s.id, s.fold, s.i, l.t),
acc1 AS (SELECT fold, i, 100.0 * sum(CASE WHEN CAST(delta > 0 AS INTEGER) = yi THEN 1 ELSE 0 END) / count(*) AS acc FROM dl GROUP BY fold, i),
pc AS (SELECT a.fold, a.i, a.t, b.i AS j, b.t AS v, count(*) AS c FROM lab a JOIN lab b ON a.id = b.id AND a.i <> b.i
       GROUP BY a.fold, a.i, a.t, b.i, b.t),
pt AS (SELECT i, t, j, v, sum(c) AS c FROM pc GROUP BY i, t, j, v),
pg AS (SELECT cls.fold, cls.i, cls.t, CAST(g.j AS INTEGER) AS j, c.v FROM cls CROSS JOIN range(5) g(j) CROSS JOIN (VALUES (0), (1)) c(v)
       WHERE g.j <> cls.i),
po AS (SELECT pg.fold, pg.i, pg.t, pg.j, pg.v, ln((coalesce(pt.c, 0) - coalesce(pc.c, 0) + 1.0) / (nt.n + 2.0)) AS lp
       FROM pg LEFT JOIN pt ON pt.i = pg.i AND pt.t = pg.t AND pt.j = pg.j AND pt.v = pg.v
       LEFT JOIN pc ON pc.fold = pg.fold AND pc.i = pg.i AND pc.t = pg.t AND pc.j = pg.j AND pc.v = pg.v
       JOIN nt ON nt.fold = pg.fold AND nt.i = pg.i AND nt.t = pg.t),
gg AS (SELECT fold, i, j, v, max(CASE WHEN t = 1 THEN lp END) - max(CASE WHEN t = 0 THEN lp END) AS g FROM po GROUP BY fold, i, j, v),
dd AS (SELECT dl.fold, dl.i, CAST(r.j AS INTEGER) AS j, dl.yi, dl.delta + coalesce(gg.g, 0.0) AS sc
       FROM dl CROSS JOIN range(5) r(j)
       LEFT JOIN lab b ON b.id = dl.id AND b.i = r.j
       LEFT JOIN gg ON gg.fold = dl.fold AND gg.i = dl.i AND gg.j = r.j AND gg.v = b.t
       WHERE r.j <> dl.i),
acc2 AS (SELECT fold, i, j, 100.0 * sum(CASE WHEN CAST(sc > 0 AS INTEGER) = yi THEN 1 ELSE 0 END) / count(*) AS acc FROM dd GROUP BY fold, i, j),
tt AS (SELECT a.i, a.j, avg(b.acc) AS a1, avg(a.acc) AS a2, var_pop(b.acc - a.acc) * count(*) AS vd, count(*) AS nf
       FROM acc2 a JOIN acc1 b ON a.fold = b.fold AND a.i = b.i GROUP BY a.i, a.j),
ts AS (SELECT i, j, CASE WHEN a1 - a2 > 1e-9 THEN -1.0
                         ELSE abs(a1 - a2) * (CASE WHEN vd < 1e-12 THEN 0.0 ELSE sqrt(nf * (nf - 1) / vd) END) END AS score FROM tt)
SELECT CAST(CASE WHEN f.score >= r.score THEN f.i ELSE r.i END AS INTEGER) AS label,
       CAST(CASE WHEN f.score >= r.score THEN f.j ELSE r.j END AS INTEGER) AS given,
       round(CASE WHEN f.score >= r.score THEN f.score ELSE r.score END, 6) AS score
FROM ts f JOIN ts r ON f.i = r.j AND f.j = r.i WHERE f.i < f.j""")


sql("th_meta_sizes", _meta_sizes_sql())

sql("th_predicted_cut", _predicted_cut_sql())


# ---------------------------------------------------------------- 2.10 cross-validation of learners

_CV_FEATURES = {"v_order": ("f_prio", "f_status", "f_lines", "f_qty", "f_price"), "v_userday": ("f_n", "f_hour", "f_val")}


def _cv_scores(view: str, learner: str, folds: int, seed: int) -> str:
    """CTEs down to lab (id, own, j, t) and out (id, fold, j, s, b): the scores of the models that did not see fold."""
    L, feats = VIEW_L[view], _CV_FEATURES[view]
    keys = ["fold", "j"] if learner == "br" else ["fold"]
    head = with_views(view) + f""",
fd AS (SELECT id, y, CAST({h_sql('id', seed)} % {folds} AS INTEGER) AS own FROM {view}),
fl_all AS (
  UNPIVOT (SELECT id, {", ".join(f"CAST({f} AS VARCHAR) AS {f}" for f in feats)} FROM {view}) ON {", ".join(feats)} INTO NAME f VALUE v),
allrows AS (SELECT id FROM {view}),
lab AS (SELECT id, own, CAST(g.j AS INTEGER) AS j, y[g.j + 1] AS t FROM fd CROSS JOIN range({L}) g(j)),
seen AS (SELECT CAST(k.fold AS INTEGER) AS fold, lab.* FROM lab CROSS JOIN range({folds}) k(fold) WHERE k.fold <> own)"""
    if learner == "br":
        body = """,
cv_rows AS (SELECT fold, j, id, t FROM seen),
cv_rfl AS (SELECT r.fold, r.j, r.id, r.t, f, v FROM cv_rows r JOIN fl_all USING (id)),
cv_cls AS (SELECT DISTINCT fold, j, c.t FROM seen CROSS JOIN (VALUES (0), (1)) c(t))""" + nb_sql(keys, "cv_rows", "cv_rfl", "cv_cls", "fl_all", "allrows", "cv") + """,
out AS (
  SELECT id, fold, j, 1.0 / (1.0 + exp(max(CASE WHEN t = 0 THEN s END) - max(CASE WHEN t = 1 THEN s END))) AS s,
         CAST(max(CASE WHEN t = 1 THEN s END) >= max(CASE WHEN t = 0 THEN s END) AS INTEGER) AS b
  FROM cv_score GROUP BY id, fold, j)"""
    elif learner == "lp":
        body = f""",
cv_rows AS (SELECT CAST(k.fold AS INTEGER) AS fold, id, {bits_sql('y')} AS t FROM fd CROSS JOIN range({folds}) k(fold) WHERE k.fold <> own),
cv_rfl AS (SELECT r.fold, r.id, r.t, f, v FROM cv_rows r JOIN fl_all USING (id)),
cv_cls AS (SELECT DISTINCT fold, t FROM cv_rows)""" + nb_sql(keys, "cv_rows", "cv_rfl", "cv_cls", "fl_all", "allrows", "cv") + f""",
top AS (SELECT id, fold, min({{'s': -round(s, 9), 't': t}}) AS best FROM cv_score GROUP BY id, fold),
out AS (
  SELECT id, fold, CAST(g.j AS INTEGER) AS j, CAST(substr(best.t, g.j + 1, 1) AS DOUBLE) AS s, CAST(substr(best.t, g.j + 1, 1) AS INTEGER) AS b
  FROM top CROSS JOIN range({L}) g(j))"""
    else:
        body = """,
shr AS (SELECT fold, j, sum(t) / CAST(count(*) AS DOUBLE) AS s FROM seen GROUP BY fold, j),
out AS (SELECT lab.id, shr.fold, lab.j, s, CAST(s >= 0.5 AS INTEGER) AS b FROM lab JOIN shr ON shr.fold = lab.own AND shr.j = lab.j)"""
    return head + body


def _cv_sql(view: str, learner: str, folds: int, seed: int) -> str:
    """Measure, mean and sd over folds of one learner on one view."""
    measures = "pr AS (" + scored_ctes(view).split("pr AS (", 1)[1].split("\nplm AS (")[0].rsplit("cf AS (", 1)[0].rstrip().rstrip(",")
    row = ("hamming_loss", "subset_accuracy", "ex_precision", "ex_recall", "ex_fmeasure", "ex_accuracy", "ex_specificity", "average_precision",
           "one_minus_ap", "coverage", "one_error", "is_error", "error_set_size", "ranking_loss", "log_loss")
    ratio = """CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
    CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
    CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE (2 * tp) / (2 * tp + fn + fp) END AS fmeasure,
    CASE WHEN tn + fp + fn = 0 THEN 1.0 WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS specificity"""
    return _cv_scores(view, learner, folds, seed) + f""",
sc AS (SELECT lab.id, lab.j, lab.t, lab.own, out.s, out.b, row_number() OVER (PARTITION BY lab.id ORDER BY out.s DESC, lab.j DESC) AS rk
       FROM lab JOIN out ON out.id = lab.id AND out.fold = lab.own AND out.j = lab.j),
{measures},
fcf AS (
  SELECT own, j, CAST(sum(CAST(t = 1 AND b = 1 AS INTEGER)) AS DOUBLE) AS tp, CAST(sum(CAST(t = 0 AND b = 1 AS INTEGER)) AS DOUBLE) AS fp,
         CAST(sum(CAST(t = 1 AND b = 0 AS INTEGER)) AS DOUBLE) AS fn, CAST(sum(CAST(t = 0 AND b = 0 AS INTEGER)) AS DOUBLE) AS tn FROM sc GROUP BY own, j),
mic AS (SELECT own, {ratio} FROM (SELECT own, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM fcf GROUP BY own)),
mac AS (SELECT own, avg(precision) AS precision, avg(recall) AS recall, avg(fmeasure) AS fmeasure, avg(specificity) AS specificity
        FROM (SELECT own, {ratio} FROM fcf) GROUP BY own),
byf AS (SELECT own, {", ".join(f"avg({m}) AS {m}" for m in row)} FROM rowm JOIN fd USING (id) GROUP BY own),
allm AS (
  {" UNION ALL ".join(f"SELECT '{m}' AS measure, {m} AS v FROM byf" for m in row)}
  {"".join(f" UNION ALL SELECT '{p}_{m}', {m} FROM {t}" for p, t in (("micro", "mic"), ("macro", "mac")) for m in ("precision", "recall", "fmeasure", "specificity"))})
SELECT measure, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM allm GROUP BY measure"""


sql("ev_cross_validate", _cv_sql("v_order", "br", 5, 6))
sql("ev_compare", " UNION ALL ".join(
    f"SELECT '{_v}' AS data, '{_l}' AS learner, 5 AS folds, measure, mean, sd FROM ({_cv_sql(_v, _l, 5, 6)}) {_v}_{_l}"
    for _v in ("v_order", "v_userday") for _l in ("br", "lp", "prior")))


# ---------------------------------------------------------------- 2.9 thresholds for any measure, on out-of-fold scores

# value of a measure over the counts a (tp), b (fp), c (fn), d (tn), its level and its ideal value
_CUT_MEASURES = {
    "hamming_loss": ("(b + c) / (a + b + c + d)", "pooled", 0.0),
    "micro_fmeasure": ("CASE WHEN a + b + c = 0 THEN 1.0 ELSE 2 * a / (2 * a + b + c) END", "pooled", 1.0),
    "macro_fmeasure": ("CASE WHEN a + b + c = 0 THEN 1.0 ELSE 2 * a / (2 * a + b + c) END", "label", 1.0),
    "ex_fmeasure": ("CASE WHEN a + b + c = 0 THEN 1.0 ELSE 2 * a / (2 * a + b + c) END", "row", 1.0),
}
_CUT_LEVEL = {"pooled": "", "label": ", j", "row": ", id"}


def _oof(view: str, folds: int, seed: int, bins: int = 1000000) -> str:
    return _cv_scores(view, "br", folds, seed) + f""",
oof AS MATERIALIZED (SELECT lab.id, lab.own AS fold, lab.j, lab.t, CAST(round(out.s * {bins}) AS BIGINT) AS c
  FROM lab JOIN out ON out.id = lab.id AND out.fold = lab.own AND out.j = lab.j)"""


def _grid_sql(name: str, src: str, grid: str, measure: str) -> str:
    """CTE (fold, k, cut, value) of a measure on a grid (fold, k, cut): every row meets every cut."""
    expr, level, _ = _CUT_MEASURES[measure]
    key = _CUT_LEVEL[level]
    hit = lambda t, p: f"CAST(count(*) FILTER (WHERE t = {t} AND {p}) AS DOUBLE)"
    return f"""{name} AS MATERIALIZED (
  SELECT fold, k, cut, avg({expr}) AS value FROM (
    SELECT x.fold, k, cut{key}, {hit(1, "x.c >= cut")} AS a, {hit(0, "x.c >= cut")} AS b, {hit(1, "x.c < cut")} AS c, {hit(0, "x.c < cut")} AS d
    FROM {src} x JOIN {grid} g ON g.fold = x.fold GROUP BY x.fold, k, cut{key}) GROUP BY fold, k, cut)"""


def _th_one_sql(measures) -> str:
    out = _oof("v_order", 3, 6) + """,
ff AS (SELECT DISTINCT fold FROM oof),
g1 AS (SELECT fold, CAST(k AS INTEGER) AS k, k * 100000 AS cut FROM ff CROSS JOIN range(11) r(k))"""
    parts = []
    for i, m in enumerate(measures):
        ideal = _CUT_MEASURES[m][2]
        out += ",\n" + _grid_sql(f"a{i}", "oof", "g1", m) + f""",
b{i} AS (SELECT fold, min({{'d': round(abs({ideal} - value), 12), 'k': k}}).k AS best FROM a{i} GROUP BY fold),
h{i} AS (SELECT fold, CAST(k AS INTEGER) AS k, (10 * best + k - 5) * 10000 AS cut FROM b{i} CROSS JOIN range(11) r(k)),
""" + _grid_sql(f"c{i}", "oof", f"h{i}", m) + f""",
d{i} AS (SELECT fold, min({{'d': round(abs({ideal} - value), 12), 'k': k}}).k AS best FROM c{i} GROUP BY fold),
e{i} AS (SELECT 1 AS stage, fold, k, cut, value, k = best AS chosen FROM a{i} JOIN b{i} USING (fold)
  UNION ALL SELECT 2, fold, k, cut, value, k = best FROM c{i} JOIN d{i} USING (fold))"""
        parts.append(f"""SELECT '{m}' AS measure, stage, fold, k, round(cut / 1000000.0, 6) AS threshold, round(value, 6) AS value, chosen,
  round((SELECT avg(cut / 1000000.0) FROM e{i} WHERE chosen AND stage = 2), 6) AS final FROM e{i}""")
    return out + "\n" + " UNION ALL ".join(parts)


def _th_rank_sql(measures) -> str:
    L = VIEW_L["v_order"]
    out = _oof("v_order", 3, 6) + f""",
rk AS MATERIALIZED (SELECT id, fold, j, t, {L} - row_number() OVER (PARTITION BY id ORDER BY c DESC, j DESC) AS c FROM oof),
g1 AS (SELECT fold, CAST(k AS INTEGER) AS k, {L} - k AS cut FROM (SELECT DISTINCT fold FROM oof) CROSS JOIN range({L + 1}) r(k))"""
    parts = []
    for i, m in enumerate(measures):
        out += ",\n" + _grid_sql(f"a{i}", "rk", "g1", m) + f""",
m{i} AS (SELECT k, avg(value) AS value, round(avg(round(abs({_CUT_MEASURES[m][2]} - value), 12)), 12) AS d FROM a{i} GROUP BY k)"""
        parts.append(f"SELECT '{m}' AS measure, k AS t, round(value, 6) AS value, row_number() OVER (ORDER BY d, k) = 1 AS chosen FROM m{i}")
    return out + "\n" + " UNION ALL ".join(parts)


def _th_label_sql(measures, sweeps: int) -> str:
    """Coordinate descent unrolled: one CTE for every sweep and label; a label's counts at a cut come from all its rows."""
    L = VIEW_L["v_order"]
    counts = "CAST(count(*) FILTER (WHERE t = 1 AND x.c >= q.cut) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE t = 0 AND x.c >= q.cut) AS DOUBLE) AS b, " \
             "CAST(count(*) FILTER (WHERE t = 1 AND x.c < q.cut) AS DOUBLE) AS c, CAST(count(*) FILTER (WHERE t = 0 AND x.c < q.cut) AS DOUBLE) AS d"
    out = _oof("v_order", 3, 6, 100000) + f""",
cuts AS (SELECT DISTINCT fold, j, c AS cut FROM oof),
cand AS MATERIALIZED (SELECT q.fold, q.j, q.cut, {counts} FROM cuts q JOIN oof x ON x.fold = q.fold AND x.j = q.j GROUP BY q.fold, q.j, q.cut),
low AS (SELECT fold, j, cut, lag(cut) OVER (PARTITION BY fold, j ORDER BY cut) AS lower FROM cuts),
init AS MATERIALIZED (SELECT q.fold, q.j, q.cut, {counts} FROM (SELECT DISTINCT fold, j, 50000 AS cut FROM oof) q JOIN oof x ON x.fold = q.fold AND x.j = q.j GROUP BY q.fold, q.j, q.cut)"""
    parts = []
    for i, m in enumerate(measures):
        expr, level, ideal = _CUT_MEASURES[m]
        pick = f"min({{'v': round(abs({ideal} - ({expr})), 12), 'cut': cut, 'a': a0, 'b': b0, 'c': c0, 'd': d0}})"
        if level == "label":
            out += f""",
r{i} AS (SELECT fold, j, {pick} AS b FROM (SELECT *, a AS a0, b AS b0, c AS c0, d AS d0 FROM cand) GROUP BY fold, j),
f{i} AS (SELECT fold, j, b.cut AS cut FROM r{i})"""
        else:
            at = {j: f"(SELECT * FROM init WHERE j = {j})" for j in range(L)}
            for s in range(sweeps):
                for j in range(L):
                    others = " UNION ALL ".join(f"SELECT fold, a, b, c, d FROM {at[o]}" for o in range(L) if o != j)
                    name = f"s{i}_{s}_{j}"
                    out += f""",
{name} AS MATERIALIZED (SELECT fold, {j} AS j, z.cut AS cut, z.a AS a, z.b AS b, z.c AS c, z.d AS d FROM (SELECT fold, {pick} AS z FROM (
  SELECT q.fold, q.cut, q.a AS a0, q.b AS b0, q.c AS c0, q.d AS d0, q.a + o.a AS a, q.b + o.b AS b, q.c + o.c AS c, q.d + o.d AS d
  FROM cand q JOIN (SELECT fold, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM ({others}) GROUP BY fold) o ON o.fold = q.fold
  WHERE q.j = {j}) GROUP BY fold))"""
                    at[j] = name
            out += f""",
f{i} AS ({" UNION ALL ".join(f"SELECT fold, j, cut FROM {at[j]}" for j in range(L))})"""
        parts.append(f"""SELECT '{m}' AS measure, fold, CAST(j AS INTEGER) AS j, cut, round((cut + coalesce(lower, cut)) / 200000.0, 6) AS threshold,
  round(avg((cut + coalesce(lower, cut)) / 200000.0) OVER (PARTITION BY j), 6) AS final FROM f{i} JOIN low USING (fold, j, cut)""")
    return out + "\n" + " UNION ALL ".join(parts)


sql("th_one_measures", _th_one_sql(("hamming_loss", "micro_fmeasure", "macro_fmeasure", "ex_fmeasure")))
sql("th_rank_measures", _th_rank_sql(("hamming_loss", "micro_fmeasure", "macro_fmeasure", "ex_fmeasure")))
sql("th_label_measures", _th_label_sql(("hamming_loss", "micro_fmeasure", "macro_fmeasure"), 3))


# ---------------------------------------------------------------- 2.10 curves over folds, 2.12 running curves

_CV_CURVES = _cv_scores("v_order", "br", 5, 6) + """,
cu_cell AS MATERIALIZED (SELECT lab.own AS fold, lab.j, lab.t, out.b, CAST(round(out.s * 1000000) AS BIGINT) AS c
  FROM lab JOIN out ON out.id = lab.id AND out.fold = lab.own AND out.j = lab.j),
cu_cnt AS MATERIALIZED (SELECT fold, j, c, CAST(sum(t) AS DOUBLE) AS pos, CAST(sum(1 - t) AS DOUBLE) AS neg FROM cu_cell GROUP BY fold, j, c
  UNION ALL SELECT fold, -1, c, CAST(sum(t) AS DOUBLE), CAST(sum(1 - t) AS DOUBLE) FROM cu_cell GROUP BY fold, c),
cu_cum AS MATERIALIZED (
  SELECT *, sum(pos) OVER w AS hits, sum(neg) OVER w AS miss, sum(pos) OVER (PARTITION BY fold, j) AS P, sum(neg) OVER (PARTITION BY fold, j) AS N
  FROM cu_cnt WINDOW w AS (PARTITION BY fold, j ORDER BY c DESC)),
cu_lvl AS (SELECT fold, j, i, max(hits / (hits + miss)) AS best FROM cu_cum CROSS JOIN range(10) r(i) WHERE hits * 9 >= i * P AND P > 0 GROUP BY fold, j, i),
cu_iap AS (SELECT fold, j, sum(best) / 10 AS iap FROM cu_lvl GROUP BY fold, j),
cu_lab AS MATERIALIZED (SELECT a.*, iap FROM (
  SELECT fold, j, CASE WHEN any_value(P) > 0 THEN sum(pos * hits / (hits + miss)) / any_value(P) END AS ap,
    CASE WHEN any_value(P) > 0 AND any_value(N) > 0 THEN sum(pos * (N - miss + neg / 2)) / (any_value(P) * any_value(N)) END AS auc
  FROM cu_cum GROUP BY fold, j) a LEFT JOIN cu_iap USING (fold, j))"""


def _geo_sql(c: str) -> str:
    return f"CASE WHEN count(*) > count({c}) THEN CAST('NaN' AS DOUBLE) WHEN min({c}) = 0 THEN 0.0 ELSE exp(avg(CASE WHEN {c} > 0 THEN ln({c}) END)) END"


sql("ev_cross_validate_curves", _CV_CURVES + f""",
cu_m AS (SELECT fold, avg(ap) AS map, {_geo_sql('ap')} AS gmap, avg(iap) AS miap, {_geo_sql('iap')} AS gmiap, avg(auc) AS macro_auc FROM cu_lab WHERE j >= 0 GROUP BY fold),
cu_u AS (SELECT cu_m.*, cu_lab.auc AS micro_auc FROM cu_m JOIN cu_lab USING (fold) WHERE j = -1),
cu_v AS (UNPIVOT cu_u ON map, gmap, miap, gmiap, macro_auc, micro_auc INTO NAME measure VALUE value)
SELECT measure, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM cu_v GROUP BY measure""")

sql("ev_cross_validate_labels", _CV_CURVES + """,
cu_n AS (SELECT fold, j, CAST(count(*) FILTER (WHERE t = 1 AND b = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE t = 0 AND b = 1) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE t = 1 AND b = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE t = 0 AND b = 0) AS DOUBLE) AS tn FROM cu_cell GROUP BY fold, j),
cu_s AS (SELECT fold, j,
  CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE (2 * tp) / (2 * tp + fn + fp) END AS fmeasure,
  CASE WHEN tn + fp + fn = 0 THEN 1.0 WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS specificity FROM cu_n),
cu_v AS (SELECT * FROM (UNPIVOT cu_s ON precision, recall, fmeasure, specificity INTO NAME measure VALUE value)
  UNION ALL SELECT * FROM (UNPIVOT (SELECT fold, j, ap, iap, auc FROM cu_lab WHERE j >= 0) ON ap, iap, auc INTO NAME measure VALUE value))
SELECT CAST(j AS INTEGER) AS j, measure, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM cu_v GROUP BY j, measure""")

sql("st_running_auc", _EV_UD + "\nSELECT CAST(j AS INTEGER) AS j, round(auc, 6) AS auc FROM lauc")


# ---------------------------------------------------------------- 2.10 sweeps of the neighbour learners

def _sweep_sql() -> str:
    hit = lambda t, b: f"CAST(count(*) FILTER (WHERE t = {t} AND b = {b}) AS DOUBLE)"
    f1 = "CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 2 * tp / (2 * tp + fn + fp) END"
    out = _vec_ctes("true").replace("ne AS (", "ne AS MATERIALIZED (") + f""",
fd AS MATERIALIZED (SELECT id, y, CAST({h_sql('id', 6)} % 3 AS INTEGER) AS own FROM v_vec),
dist AS MATERIALIZED (SELECT a.id AS qid, b.id AS rid, sum((a.z - b.z) * (a.z - b.z)) AS d2 FROM ne a JOIN ne b ON a.i = b.i AND a.id <> b.id GROUP BY a.id, b.id),
nb AS MATERIALIZED (SELECT * FROM (
  SELECT CAST(f.fold AS INTEGER) AS fold, qid, rid, row_number() OVER (PARTITION BY f.fold, qid ORDER BY d2, rid) AS rank
  FROM dist JOIN fd ON fd.id = rid CROSS JOIN range(3) f(fold) WHERE fd.own <> f.fold) WHERE rank <= 12),
lab AS MATERIALIZED (SELECT id, own, CAST(g.j AS INTEGER) AS j, y[g.j + 1] AS t FROM fd CROSS JOIN range(4) g(j)),
cnt AS MATERIALIZED (SELECT nb.fold, CAST(k.k AS INTEGER) AS k, nb.qid AS id, l.j, sum(l.t) AS d, count(*) AS have
  FROM nb JOIN lab l ON l.id = nb.rid CROSS JOIN range(8, 13) k(k) WHERE nb.rank <= k.k GROUP BY nb.fold, k.k, nb.qid, l.j),
cell AS MATERIALIZED (SELECT cnt.*, lab.own, lab.t FROM cnt JOIN lab USING (id, j)),
h AS (SELECT fold, k, j, d, sum(t) AS c1, sum(1 - t) AS c0 FROM cell WHERE fold <> own GROUP BY fold, k, j, d),
hs AS (SELECT fold, k, j, sum(c1) AS a1, sum(c0) AS a0 FROM h GROUP BY fold, k, j),
pri AS (SELECT CAST(f.fold AS INTEGER) AS fold, j, (1.0 + sum(t)) / (2.0 + count(*)) AS p, CAST(count(*) AS DOUBLE) AS n FROM lab CROSS JOIN range(3) f(fold) WHERE own <> f.fold GROUP BY f.fold, j),
pp AS (SELECT c.*, n, p * (1.0 + coalesce(c1, 0)) / (k + 1.0 + a1) AS pin, (1 - p) * (1.0 + coalesce(c0, 0)) / (k + 1.0 + a0) AS pout
  FROM cell c JOIN hs USING (fold, k, j) JOIN pri USING (fold, j) LEFT JOIN h USING (fold, k, j, d) WHERE c.fold = c.own),
pred AS MATERIALIZED (SELECT 'mlknn' AS learner, fold, k, id, j, t, pin / (pin + pout) AS s, CAST(pin >= pout AS INTEGER) AS b FROM pp
  UNION ALL SELECT 'brknn', fold, k, id, j, t, (1.0 / n + d) / (4.0 / n + have), CAST((1.0 / n + d) / (4.0 / n + have) >= 0.5 AS INTEGER) FROM pp),
cj AS (SELECT learner, k, fold, j, {hit(1, 1)} AS tp, {hit(0, 1)} AS fp, {hit(1, 0)} AS fn, {hit(0, 0)} AS tn FROM pred GROUP BY learner, k, fold, j),
cp AS (SELECT learner, k, fold, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM cj GROUP BY learner, k, fold),
sc AS (SELECT learner, k, fold, j, CAST(round(s * 1000000) AS BIGINT) AS c, t FROM pred UNION ALL SELECT learner, k, fold, -1, CAST(round(s * 1000000) AS BIGINT), t FROM pred),
ct AS (SELECT learner, k, fold, j, c, CAST(sum(t) AS DOUBLE) AS pos, CAST(sum(1 - t) AS DOUBLE) AS neg FROM sc GROUP BY learner, k, fold, j, c),
cm AS (SELECT *, sum(neg) OVER (PARTITION BY learner, k, fold, j ORDER BY c) AS below FROM ct),
au AS (SELECT learner, k, fold, j, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below - neg / 2)) / (sum(pos) * sum(neg)) END AS auc FROM cm GROUP BY learner, k, fold, j),
v AS (SELECT learner, k, fold, 'hamming_loss' AS measure, (fp + fn) / (tp + fp + fn + tn) AS value FROM cp
  UNION ALL SELECT learner, k, fold, 'micro_fmeasure', {f1} FROM cp
  UNION ALL SELECT learner, k, fold, 'macro_fmeasure', avg({f1}) FROM cj GROUP BY learner, k, fold
  UNION ALL SELECT learner, k, fold, 'subset_accuracy', avg(ok) FROM (SELECT learner, k, fold, id, CAST(bool_and(t = b) AS INTEGER) AS ok FROM pred GROUP BY learner, k, fold, id) GROUP BY learner, k, fold
  UNION ALL SELECT learner, k, fold, 'macro_auc', avg(auc) FROM au WHERE j >= 0 GROUP BY learner, k, fold
  UNION ALL SELECT learner, k, fold, 'micro_auc', auc FROM au WHERE j = -1)
SELECT learner, k, measure, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM v GROUP BY learner, k, measure"""
    return out


sql("ev_sweep_neighbours", _sweep_sql())
