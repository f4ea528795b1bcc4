"""The same views as ``views.py`` written as plain SQL common table expressions.

They feed the second-engine check in ``__spark_entry__.oracle_sql``: each oracle
query starts with ``WITH`` + the views it needs.  DuckDB lists are 1-based.
"""

from __future__ import annotations

V_USERDAY = """
v_userday AS (
  SELECT user_id * 100000 + (day - DATE '1970-01-01') AS id, user_id, CAST(extract(day FROM day) AS INTEGER) AS dom,
         n_events, sum_value, first_hour,
         CAST(least(n_events, 5) AS INTEGER) AS f_n,
         CAST(first_hour // 6 AS INTEGER) AS f_hour,
         CAST(least(floor(sum_value / 50), 6) AS INTEGER) AS f_val,
         [click, error, purchase, signup, view] AS y
  FROM (
    SELECT user_id, CAST(ts AS DATE) AS day,
           max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS click,
           max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS error,
           max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS purchase,
           max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS signup,
           max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS view,
           count(*) AS n_events, sum(value) AS sum_value, min(hour(ts)) AS first_hour
    FROM events GROUP BY user_id, CAST(ts AS DATE)
  ) g
)"""

_ORDER_LINES = """
    SELECT l_orderkey,
           max(CASE WHEN l_returnflag || l_linestatus = 'AF' THEN 1 ELSE 0 END) AS AF,
           max(CASE WHEN l_returnflag || l_linestatus = 'AO' THEN 1 ELSE 0 END) AS AO,
           max(CASE WHEN l_returnflag || l_linestatus = 'NF' THEN 1 ELSE 0 END) AS NF,
           max(CASE WHEN l_returnflag || l_linestatus = 'NO' THEN 1 ELSE 0 END) AS "NO",
           max(CASE WHEN l_returnflag || l_linestatus = 'RF' THEN 1 ELSE 0 END) AS RF,
           max(CASE WHEN l_returnflag || l_linestatus = 'RO' THEN 1 ELSE 0 END) AS RO,
           count(*) AS n_lines, sum(l_quantity) AS sum_qty,
           avg(l_extendedprice) AS avg_price, avg(l_discount) AS avg_disc
    FROM lineitem GROUP BY l_orderkey"""

_BINNED = """o_orderpriority AS f_prio, o_orderstatus AS f_status,
         CAST(least(n_lines, 7) AS INTEGER) AS f_lines,
         CAST(least(floor(sum_qty / 50), 7) AS INTEGER) AS f_qty,
         CAST(least(floor(o_totalprice / 100000), 4) AS INTEGER) AS f_price"""

V_ORDER = f"""
v_order AS (
  SELECT o_orderkey AS id, o_totalprice, n_lines, sum_qty,
         {_BINNED},
         [AF, AO, NF, "NO", RF, RO] AS y
  FROM ({_ORDER_LINES}) l JOIN orders ON l_orderkey = o_orderkey
)"""

V_TARGET = f"""
v_target AS (
  SELECT o_orderkey AS id, o_totalprice, CAST(n_lines AS DOUBLE) AS n_lines,
         CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS prio,
         {_BINNED},
         [CAST(sum_qty AS DOUBLE), avg_price, avg_disc] AS target
  FROM ({_ORDER_LINES}) l JOIN orders ON l_orderkey = o_orderkey
)"""

V_TREE = f"""
v_tree_lab AS (
  SELECT l_orderkey, list_transform(range(25), lambda k: CASE WHEN list_contains(list(DISTINCT s_nationkey), k) THEN 1 ELSE 0 END) AS y,
         count(*) AS n_lines, sum(l_quantity) AS sum_qty
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY l_orderkey
),
v_tree AS (
  SELECT o_orderkey AS id, o_totalprice, n_lines, sum_qty,
         {_BINNED},
         y
  FROM v_tree_lab JOIN orders ON l_orderkey = o_orderkey
),
label_tree AS (
  SELECT r_name AS label, CAST(r_regionkey + 25 AS INTEGER) AS idx, CAST(NULL AS VARCHAR) AS parent,
         CAST(NULL AS INTEGER) AS parent_idx, 1 AS depth FROM region
  UNION ALL
  SELECT n_name, CAST(n_nationkey AS INTEGER), r_name, CAST(r_regionkey + 25 AS INTEGER), 2
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""

V_DOC = """
v_doc AS (
  SELECT d.doc_id AS id, lang, source, n_chars,
         CAST(least(floor(n_chars / 1000), 5) AS INTEGER) AS f_len,
         [CAST(quality AS INTEGER), CAST(toxic AS INTEGER)] AS y
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

V_VEC = """
v_vec AS (
  SELECT vec_id AS id, embedding, label,
         [label & 1, (label >> 1) & 1, (label >> 2) & 1, (label >> 3) & 1] AS y
  FROM embeddings
)"""

VIEW_SQL = {
    "v_userday": V_USERDAY,
    "v_order": V_ORDER,
    "v_tree": V_TREE,
    "v_doc": V_DOC,
    "v_vec": V_VEC,
    "v_target": V_TARGET,
}

VIEW_L = {"v_userday": 5, "v_order": 6, "v_tree": 25, "v_doc": 2, "v_vec": 4}


def with_views(*names: str) -> str:
    return "WITH " + ",".join(VIEW_SQL[n] for n in names)


def long_cte(view: str, name: str | None = None) -> str:
    """(id, j, t) long form of a view's label array, as a CTE body."""
    name = name or f"{view}_long"
    return f"""
{name} AS (
  SELECT id, CAST(g.j AS INTEGER) AS j, y[g.j + 1] AS t
  FROM {view} CROSS JOIN range({VIEW_L[view]}) g(j)
)"""
