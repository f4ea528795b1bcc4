"""Splits and sampling.

Randomness comes from a seeded stable hash of the row id, so a split is the
same for any partitioning, re-run or executor loss.  Exact ranks inside a
group (for stratified folds) are computed with *adaptive salting*: each group
is cut into ceil(n_group / rows_per_bucket) sub-buckets by the hash, ranked
inside the sub-bucket, and shifted by the counts of the earlier sub-buckets.
A hot group holding a third of the data is therefore ranked by many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polytag.frame import MLFrame
from polytag.functions import labelsets as LS
from polytag.operators import nb as NB

ROWS_PER_BUCKET = 1_000_000


def uniform(key, seed: int = 0) -> Column:
    """Deterministic U[0,1) from an integer key."""
    return LS.stable_hash(key, seed) / F.lit(float(LS.MINSTD_M))


def salted_rank(df: DataFrame, group_cols, h: Column, id_col: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``_rk``: 1-based rank inside ``group_cols`` in (salt, h, id) order, salt = h mod n_buckets(group)."""
    group_cols = list(group_cols)
    x = df.withColumn("_h", h)
    if not group_cols:
        x = x.withColumn("_g", F.lit(0))
        group_cols = ["_g"]
    gc = x.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_gn"))
    gc = gc.select(*group_cols, F.greatest(F.lit(1), F.ceil(F.col("_gn") / F.lit(rows_per_bucket))).cast("bigint").alias("_nb"))
    x = x.join(gc, group_cols).withColumn("_salt", F.pmod(F.col("_h"), F.col("_nb")))
    w = Window.partitionBy(*group_cols, "_salt").orderBy("_h", id_col)
    x = x.withColumn("_rn", F.row_number().over(w))
    sc = x.groupBy(*group_cols, "_salt").agg(F.count(F.lit(1)).alias("_c"))
    w2 = Window.partitionBy(*group_cols).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sc = sc.withColumn("_off", F.coalesce(F.sum("_c").over(w2), F.lit(0))).drop("_c")
    x = x.join(sc, [*group_cols, "_salt"]).withColumn("_rk", F.col("_off") + F.col("_rn"))
    drop = ["_nb", "_salt", "_rn", "_off"] + (["_g"] if group_cols == ["_g"] else [])
    return x.drop(*drop)


def cv_folds(mlf: MLFrame, k: int = 10, seed: int = 1) -> DataFrame:
    """(id, fold): rows in a seeded random order dealt to k folds (sizes differ by at most one)."""
    r = salted_rank(mlf.df.select(mlf.id_col), [], LS.stable_hash(mlf.id_col, seed), mlf.id_col)
    return r.select(mlf.id_col, F.pmod(F.col("_rk") - 1, F.lit(k)).cast("int").alias("fold"))


def strat_label_powerset(mlf: MLFrame, k: int = 10, seed: int = 1) -> DataFrame:
    """(id, fold): every distinct label set is dealt round-robin over the folds, continuing the
    deal across sets (sets in bit-string order) so fold sizes stay balanced too."""
    x = mlf.df.select(mlf.id_col, LS.bits(mlf.y_col).alias("bits"))
    r = salted_rank(x, ["bits"], LS.stable_hash(mlf.id_col, seed), mlf.id_col)
    # offset of each set = rows of the sets before it; the distinct-set table is label-set sized
    sets = x.groupBy("bits").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("bits").rowsBetween(Window.unboundedPreceding, -1)
    sets = sets.select("bits", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_so"))
    r = r.join(sets, "bits")
    return r.select(mlf.id_col, F.pmod(F.col("_so") + F.col("_rk") - 1, F.lit(k)).cast("int").alias("fold"))


def holdout_split(mlf: MLFrame, pct: float = 67.0, seed: int = 1) -> DataFrame:
    """(id, part): 'train' for a seeded pct % of rows, else 'test'."""
    u = uniform(mlf.id_col, seed)
    return mlf.df.select(mlf.id_col, F.when(u * 100 < F.lit(pct), "train").otherwise("test").alias("part"))


def poisson1_thresholds() -> list[float]:
    """CDF of Poisson(1) at 0, 1, ... until a further term no longer changes the sum (built from the formula, not a table)."""
    out, term, acc = [], math.exp(-1.0), 0.0
    while acc + term != acc:
        acc += term
        out.append(acc)
        term /= len(out)
    return out


def bootstrap_weights(mlf: MLFrame, models: int = 10, seed: int = 1) -> DataFrame:
    """(id, model, weight): Poisson(1) bag weights per row and model (a bootstrap sample of the same
    size in expectation); weight 0 = out of bag.  No rows move; the model id becomes a grouping key."""
    m = F.explode(F.sequence(F.lit(0), F.lit(models - 1))).alias("model")
    x = mlf.df.select(mlf.id_col, m)
    u = LS.stable_hash2(mlf.id_col, F.col("model"), seed) / F.lit(float(LS.MINSTD_M))
    w = sum(F.when(u >= F.lit(t), 1).otherwise(0) for t in poisson1_thresholds())
    return x.select(mlf.id_col, F.col("model").cast("int").alias("model"), w.cast("int").alias("weight"))


def subset_sample(mlf: MLFrame, models: int = 10, pct: float = 67.0, seed: int = 1) -> DataFrame:
    """(id, model): rows drawn without replacement, pct % per model."""
    m = F.explode(F.sequence(F.lit(0), F.lit(models - 1))).alias("model")
    x = mlf.df.select(mlf.id_col, m)
    u = LS.stable_hash2(mlf.id_col, F.col("model"), seed) / F.lit(float(LS.MINSTD_M))
    return x.filter(u * 100 < F.lit(pct)).select(mlf.id_col, F.col("model").cast("int").alias("model"))


# ------------------------------------------------------------------ iterative stratification


def greedy_quota(D: list[int], C: list[int], n: int, step: int) -> list[int]:
    """Fold counts of the greedy that puts each of ``n`` rows into the fold with the largest desire
    D (then the largest total desire C, then the lowest fold index) and lowers both by ``step``.

    Each fold's keys (D - step t, C - step t) fall strictly with t, so the greedy takes exactly the
    n largest keys of all folds: find the n-th largest D-value x by bisection, take every key above
    it and break the ties at x by (C, fold).  O(k log range); integers, so no float ties."""
    k = len(D)
    if n <= 0:
        return [0] * k

    def at_least(x):  # keys with D-value >= x
        return sum((d - x) // step + 1 for d in D if d >= x)

    lo, hi = min(D) - step * (n + 1), max(D)
    while lo < hi:  # largest x with at_least(x) >= n
        mid = (lo + hi + 1) // 2
        if at_least(mid) >= n:
            lo = mid
        else:
            hi = mid - 1
    x = lo
    q = [((d - x - 1) // step + 1) if d > x else 0 for d in D]
    rest = n - sum(q)
    tied = [f for f in range(k) if D[f] >= x and (D[f] - x) % step == 0]
    tied.sort(key=lambda f: (-(C[f] - (D[f] - x)), f))
    for f in tied[:rest]:
        q[f] += 1
    return q


def iterative_stratification(mlf: MLFrame, k: int = 10, seed: int = 1) -> DataFrame:
    """(id, fold): iterative stratification (Sechidis et al. 2011).  The label with the fewest
    unassigned rows goes first; its rows are dealt to the folds that most want that label (then
    that want the most rows), each row lowering its fold's desire for every label it carries; rows
    with no label follow the total desire alone.

    One round per label, no per-row loop: the fold quotas of the round come from ``greedy_quota``
    on the driver (k numbers); Spark ranks the round's rows in a seeded random order (salted, so a
    label holding a third of the rows is ranked by many tasks) and deals them by cumulative quota.
    Each round's assignment is checkpointed and yields the k x L label sums that update the
    desires.  Differences from the reference: exact ties go to the lower fold index instead of a
    random one, and rows of a round are dealt in random order rather than file order."""
    idc, L = mlf.id_col, mlf.L
    x, n = NB.materialize(mlf.df.select(idc, mlf.y_col))
    freq = [int(v or 0) for v in x.agg(F.array(*[F.sum(F.when(F.col(mlf.y_col)[j] == 1, 1).otherwise(0))
                                                for j in range(L)]).alias("c")).first()["c"]]
    # desires scaled by k so they stay integers: desire = count / k, one row = k units
    D = [[freq[j] for j in range(L)] for _ in range(k)]
    C = [n for _ in range(k)]
    openc = list(freq)
    done: list[int] = []
    parts = []

    def deal(rows: DataFrame, q: list[int]) -> DataFrame:
        cum = [sum(q[:f + 1]) for f in range(k)]
        r = salted_rank(rows, [], LS.stable_hash(idc, seed), idc)
        bounds = F.array(*[F.lit(c) for c in cum])
        return r.select(idc, mlf.y_col, F.size(F.filter(bounds, lambda b: b < F.col("_rk"))).cast("int").alias("fold"))

    for _ in range(L):
        cand = [j for j in range(L) if openc[j] > 0]
        if not cand:
            break
        lab = min(cand, key=lambda j: (openc[j], j))
        q = greedy_quota([D[f][lab] for f in range(k)], C, openc[lab], k)
        cond = F.col(mlf.y_col)[lab] == 1
        for j in done:
            cond = cond & (F.coalesce(F.col(mlf.y_col)[j], F.lit(0)) != 1)
        part, _ = NB.materialize(deal(x.filter(cond), q))
        sums = part.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[
            F.sum(F.when(F.col(mlf.y_col)[j] == 1, 1).otherwise(0)).alias(f"s{j}") for j in range(L)]).collect()
        for r in sums:
            f = r["fold"]
            C[f] -= k * r["n"]
            for j in range(L):
                D[f][j] -= k * r[f"s{j}"]
                openc[j] -= r[f"s{j}"]
        done.append(lab)
        parts.append(part.select(idc, "fold"))
    cond = F.lit(True)
    for j in range(L):
        cond = cond & (F.coalesce(F.col(mlf.y_col)[j], F.lit(0)) != 1)
    rest = x.filter(cond)
    n0 = rest.count()
    if n0:
        parts.append(deal(rest, greedy_quota(list(C), list(C), n0, k)).select(idc, "fold"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
