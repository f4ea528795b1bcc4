"""Running aggregates along a total order without one task per group.

``ordered_scan`` computes inclusive running sums / maxima inside ``part_cols``
along (score, tie).  A window partitioned only by the group would put a whole
group (for example every row of one label) into one task.  Instead:

1. one aggregation gives, per group, ``n_ranges - 1`` approximate quantiles of
   the score and the tie-key range; the result (groups x n_ranges numbers) is
   collected once and re-enters the plan as a small broadcast table, so every
   later use sees the same boundaries;
2. each row gets a range id that is monotone in (score, tie): the number of
   boundaries below its score, and — when its score equals a boundary (a hot
   value, possibly repeated many times) — a sub-range cut by the tie key, so a
   hot tie group is spread over several ranges too;
3. a window per (group, range) gives local running values, and the per-range
   totals (a groups x ranges table) give each range its carried-in offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _count_below(bounds: str, value: Column, most: int, equal: bool) -> Column:
    """How many of at most ``most`` ascending ``bounds`` are below ``value`` (or equal to it), by halving: a look at about log2(most) of them per row."""
    def step(at: Column, width: Column) -> Column:
        bound = F.get(bounds, at + width - 1)
        return F.when(bound <= value if equal else bound < value, at + width).otherwise(at)

    widths = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, most.bit_length())))])
    return F.aggregate(widths, F.lit(0), step)


def ordered_scan(
    df: DataFrame,
    part_cols: list[str],
    score: str,
    tie: str | None,
    aggs: dict[str, tuple[str, str]],
    score_desc: bool = False,
    tie_desc: bool = False,
    n_ranges: int | None = None,
) -> DataFrame:
    """Add one column per ``aggs`` entry: name -> (op, source column), op in {"sum", "max"};
    the value aggregates all rows of the group up to and including this row in the order
    (score, tie) with the given directions.  (score, tie) must be unique inside a group."""
    spark = df.sparkSession
    if n_ranges is None:
        n_ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    s = -F.col(score).cast("double") if score_desc else F.col(score).cast("double")
    t = F.lit(0.0) if tie is None else (-F.col(tie).cast("double") if tie_desc else F.col(tie).cast("double"))
    x = df.withColumn("_s", s).withColumn("_t", t)
    if not part_cols:
        x = x.withColumn("_g", F.lit(0))
    parts = list(part_cols) or ["_g"]
    qs = [i / n_ranges for i in range(1, n_ranges)]
    stats = x.groupBy(*parts).agg(
        F.percentile_approx("_s", qs, 10000).alias("_b"), F.min("_t").alias("_tmin"), F.max("_t").alias("_tmax")
    )
    # label-sized: collect once so both uses of the boundaries below are identical
    rows = stats.collect()
    stats = spark.createDataFrame(rows, stats.schema)
    x = x.join(F.broadcast(stats), parts)
    base = _count_below("_b", F.col("_s"), n_ranges - 1, False)
    dup = _count_below("_b", F.col("_s"), n_ranges - 1, True) - base
    span = F.col("_tmax") - F.col("_tmin") + 1.0
    sub = F.when(dup > 0, F.floor((F.col("_t") - F.col("_tmin")) * (dup + 1) / span)).otherwise(F.lit(0))
    x = x.withColumn("_rg", (base * (n_ranges + 1) + sub).cast("bigint")).drop("_b", "_tmin", "_tmax")

    def agg_fn(op):
        return F.sum if op == "sum" else F.max

    w = Window.partitionBy(*parts, "_rg").orderBy("_s", "_t").rowsBetween(Window.unboundedPreceding, 0)
    for name, (op, src) in aggs.items():
        x = x.withColumn(f"_l_{name}", agg_fn(op)(F.col(src)).over(w))
    tot = x.groupBy(*parts, "_rg").agg(*[agg_fn(op)(F.col(src)).alias(f"_t_{name}") for name, (op, src) in aggs.items()])
    w2 = Window.partitionBy(*parts).orderBy("_rg").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*parts, "_rg", *[agg_fn(op)(F.col(f"_t_{name}")).over(w2).alias(f"_o_{name}") for name, (op, _) in aggs.items()])
    x = x.join(tot, [*parts, "_rg"])
    for name, (op, _) in aggs.items():
        o, lc = F.col(f"_o_{name}"), F.col(f"_l_{name}")
        val = (F.coalesce(o, F.lit(0)) + lc) if op == "sum" else F.when(o.isNull(), lc).otherwise(F.greatest(o, lc))
        x = x.withColumn(name, val)
    drop = ["_rg", "_s", "_t", *[f"_l_{n}" for n in aggs], *[f"_o_{n}" for n in aggs]] + (["_g"] if not part_cols else [])
    return x.drop(*drop)
