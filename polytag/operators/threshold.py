"""Thresholding: turning confidences into label sets.

Inputs are prediction frames (id, y, conf[, rank]).  Grid searches compress the
long (score, truth) pairs to counts per distinct score first, so the grid is
evaluated on a table no larger than the number of distinct scores; the few
grid results come back to the driver only to pick the winner.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polytag.functions import labelsets as LS
from polytag.functions.ordered import ordered_scan


def _long(df: DataFrame) -> DataFrame:
    z = df.filter(~F.exists("y", lambda x: x.isNull())).select("id", F.posexplode(F.arrays_zip("y", "conf")).alias("j", "z"))
    return z.select("id", F.col("j").cast("int").alias("j"), F.col("z.y").alias("t"), F.col("z.conf").alias("c"))


def _hamming_on_grid(df: DataFrame, grid: list[tuple[int, float]]) -> DataFrame:
    """(k, threshold, hamming_loss) for each (k, threshold) of the grid: bip = conf >= threshold."""
    cnt = _long(df).groupBy("c", "t").agg(F.count(F.lit(1)).alias("n"))
    g = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("th")) for k, t in grid])
    x = cnt.select("c", "t", "n", F.explode(g).alias("g"))
    wrong = F.when((F.col("c") >= F.col("g.th")).cast("int") != F.col("t"), F.col("n")).otherwise(0)
    return x.groupBy(F.col("g.k").alias("k"), F.col("g.th").alias("threshold")).agg(
        (F.sum(wrong) / F.sum("n")).alias("hamming_loss"))


def _pick_first_min(res: DataFrame, key: str = "k") -> DataFrame:
    w = Window.orderBy("hamming_loss", key)  # grid-sized (a few rows)
    return res.withColumn("chosen", F.row_number().over(w) == 1)


def one_threshold(df: DataFrame) -> DataFrame:
    """(stage, k, threshold, hamming_loss, chosen): one global threshold minimising Hamming loss,
    first on 0, 0.1, ..., 1, then on best - 0.05 ... best + 0.05 in steps of 0.01 (integer grids,
    first minimum wins)."""
    s1 = _pick_first_min(_hamming_on_grid(df, [(k, k / 10) for k in range(11)]))
    best = s1.filter("chosen").first()["k"]
    s2 = _pick_first_min(_hamming_on_grid(df, [(i, (10 * best + i - 5) / 100) for i in range(11)]))
    return s1.select(F.lit(1).alias("stage"), "*").unionByName(s2.select(F.lit(2).alias("stage"), "*"))


def rcut(df: DataFrame, L: int) -> DataFrame:
    """(rule, t, hamming_loss, chosen): keep the t top-ranked labels.  Rule 'measure' scans t = 0..L
    (first minimum wins); rule 'cardinality' uses t = round(mean number of labels)."""
    lg = df.filter(~F.exists("y", lambda x: x.isNull())).select(F.posexplode(F.arrays_zip("y", "rank")).alias("j", "z"))
    cnt = lg.groupBy(F.col("z.rank").alias("r"), F.col("z.y").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    x = cnt.select("r", "t", "n", F.explode(F.sequence(F.lit(0), F.lit(L))).alias("k"))
    wrong = F.when((F.col("r") <= F.col("k")).cast("int") != F.col("t"), F.col("n")).otherwise(0)
    res = x.groupBy("k").agg((F.sum(wrong) / F.sum("n")).alias("hamming_loss"))
    meas = _pick_first_min(res).select(F.lit("measure").alias("rule"), F.col("k").cast("int").alias("t"), "hamming_loss", "chosen")
    card = df.agg(F.avg(LS.size("y")).alias("m")).first()["m"]
    tc = int(math.floor(card + 0.5))
    cres = res.filter(F.col("k") == tc).select(F.lit("cardinality").alias("rule"), F.col("k").cast("int").alias("t"), "hamming_loss",
                                              F.lit(True).alias("chosen"))
    return meas.unionByName(cres)


def scut_hamming(df: DataFrame) -> DataFrame:
    """(j, threshold, errors): per label the threshold (one of its scores; conf >= threshold is
    positive; +inf = none) with the fewest errors; for Hamming loss every label is independent,
    so one running count over the label's distinct scores replaces the coordinate descent."""
    sc = _long(df).groupBy("j", "c").agg(F.sum("t").cast("double").alias("pos"), F.sum(1 - F.col("t")).cast("double").alias("neg"))
    s = ordered_scan(sc, ["j"], "c", None, {"pos_cum": ("sum", "pos"), "neg_cum": ("sum", "neg")})
    tot = sc.groupBy("j").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    s = s.join(tot, "j")
    # threshold at score c: positives below c are missed, negatives at or above c are false alarms
    err = (F.col("pos_cum") - F.col("pos")) + (F.col("N") - (F.col("neg_cum") - F.col("neg")))
    cands = s.select("j", F.col("c").alias("threshold"), err.alias("errors")).unionByName(
        tot.select("j", F.lit(float("inf")).alias("threshold"), F.col("P").alias("errors")))
    w = Window.partitionBy("j").orderBy("errors", "threshold")
    return cands.withColumn("r", F.row_number().over(w)).filter("r = 1").select("j", "threshold", F.col("errors").cast("bigint").alias("errors"))


def expected_f(df: DataFrame, L: int) -> DataFrame:
    """(id, n): number of top labels maximising 2 * sum(top-n p) / (sum(p) + n), n = 1..L (first
    maximum; the reference counts improvements, equal when they are consecutive)."""
    srt = F.reverse(F.array_sort("conf"))
    tot = F.aggregate("conf", F.lit(0.0), lambda a, v: a + v)
    cum = F.transform(F.sequence(F.lit(1), F.lit(L)), lambda n: F.aggregate(F.slice(srt, 1, n), F.lit(0.0), lambda a, v: a + v))
    fs = F.transform(cum, lambda s, i: F.struct((-(2 * s / (tot + i + 1))).alias("nf"), (i + 1).alias("n")))
    best = F.array_min(fs)
    return df.select("id", F.when(best["nf"] < 0, best["n"]).otherwise(1).cast("int").alias("n"))


def apply_top_n(df: DataFrame, n_col: str = "n") -> DataFrame:
    """bip = rank <= n."""
    return df.withColumn("bip", F.transform("rank", lambda r: (r <= F.col(n_col)).cast("int")))


def best_row_cut(y: str, conf: str) -> Column:
    """STRUCT<threshold, errors> of a row with complete labels: over midpoints of consecutive sorted scores (ascending; the first
    is the lowest score itself), the first with the fewest errors (positives <= t, negatives >= t); 0 when none beats L errors."""
    srt = F.array_sort(conf)
    mids = F.transform(srt, lambda x, k: (x + F.get(srt, F.greatest(k - 1, F.lit(0)))) / 2)

    def errs(t):
        return F.aggregate(F.zip_with(y, conf, lambda yy, c: F.when(((yy == 1) & (c <= t)) | ((yy == 0) & (c >= t)), 1).otherwise(0)),
                           F.lit(0), lambda a, v: a + v)

    best = F.array_min(F.transform(mids, lambda t, k: F.struct(errs(t).alias("e"), k.alias("k"), t.alias("t"))))
    return F.struct(F.when(best["e"] < F.size(y), best["t"]).otherwise(0.0).alias("threshold"), F.least(best["e"], F.size(y)).alias("errors"))


def predicted_threshold_target(df: DataFrame) -> DataFrame:
    """(id, threshold, errors): the per-row target of the threshold-prediction meta learner (``best_row_cut``)."""
    x = df.filter(~F.exists("y", lambda v: v.isNull())).select("id", best_row_cut("y", "conf").alias("b"))
    return x.select("id", "b.threshold", "b.errors")


def linear_threshold_function(df: DataFrame, L: int) -> tuple[np.ndarray, DataFrame]:
    """Least-squares threshold function t(x) = w . conf + b fitted to each row's ideal threshold
    (midpoint between the lowest positive and the highest negative score, +-0.1 when one side is
    empty).  X'X and X'y come from one aggregation ((L+1)^2 numbers); the solve is on the driver."""
    big = 1.7976931348623157e308
    lo_pos = F.array_min(F.transform(F.zip_with("y", "conf", lambda yy, c: F.when(yy == 1, c).otherwise(F.lit(big))), lambda v: v))
    hi_neg = F.array_max(F.transform(F.zip_with("y", "conf", lambda yy, c: F.when(yy == 0, c).otherwise(F.lit(-big))), lambda v: v))
    tgt = F.when(lo_pos == hi_neg, lo_pos).when(lo_pos == big, hi_neg + 0.1).when(hi_neg == -big, lo_pos - 0.1).otherwise((lo_pos + hi_neg) / 2)
    x = df.select(F.concat("conf", F.array(F.lit(1.0))).alias("x"), tgt.alias("t"))
    n = L + 1
    agg = x.agg(*[F.sum(F.col("x")[a] * F.col("x")[b]).alias(f"g{a}_{b}") for a in range(n) for b in range(a, n)],
                *[F.sum(F.col("x")[a] * F.col("t")).alias(f"h{a}") for a in range(n)]).first()
    G = np.zeros((n, n))
    for a in range(n):
        for b in range(a, n):
            G[a, b] = G[b, a] = agg[f"g{a}_{b}"]
    h = np.array([agg[f"h{a}"] for a in range(n)])
    w = np.linalg.lstsq(G, h, rcond=None)[0]
    spark = df.sparkSession
    coef = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "idx int, weight double")
    return w, coef


# ------------------------------------------------------------------ expected-measure cut (probabilistic thresholding)

# Example-based bipartition measures over (tp, fp, fn, tn) counts and their ideal values, with the
# same guards as the evaluation measures.
def _ex_measure(name: str, a: float, b: float, c: float, d: float) -> float:
    if name == "hamming_loss":
        return (b + c) / (a + b + c + d)
    if name == "subset_accuracy":
        return 1.0 if b + c == 0 else 0.0
    if name == "ex_accuracy":
        return 1.0 if a + b + c == 0 else a / (a + b + c)
    if name == "ex_precision":
        return 1.0 if a + b + c == 0 else (0.0 if a + b == 0 else a / (a + b))
    if name == "ex_recall":
        return 1.0 if a + b + c == 0 else (0.0 if a + c == 0 else a / (a + c))
    if name == "ex_specificity":
        return 1.0 if d + b + c == 0 else (0.0 if d + b == 0 else d / (d + b))
    if name == "ex_fmeasure":
        return 1.0 if a + b + c == 0 else 2 * a / (2 * a + b + c)
    raise ValueError(name)


IDEAL = {"hamming_loss": 0.0}  # every other measure has ideal value 1
DP_CELLS = 8_000_000  # numbers held by one DP step (rows x ~L^2), about 64 MB of doubles


def _loss_tables(name: str, L: int) -> list:
    """For each cut R = 1..L the (R+1) x (L-R+1) table |ideal - measure(a, R-a, c, L-R-c)|."""
    ideal = IDEAL.get(name, 1.0)
    out = []
    for R in range(1, L + 1):
        t = np.empty((R + 1, L - R + 1))
        for a in range(R + 1):
            for c in range(L - R + 1):
                t[a, c] = abs(ideal - _ex_measure(name, a, R - a, c, L - R - c))
        out.append(t)
    return out


def _count_dists(P: np.ndarray) -> tuple[list, list]:
    """Poisson-binomial distributions of the positives among the first r and the last L-r columns of
    each row of P (n x L), for r = 0..L: pre[r] is n x (r+1), suf[r] is n x (L-r+1)."""
    n, L = P.shape
    pre = [np.ones((n, 1))]
    for r in range(L):
        p = P[:, r:r + 1]
        cur = pre[-1]
        nxt = np.zeros((n, r + 2))
        nxt[:, :-1] += cur * (1 - p)
        nxt[:, 1:] += cur * p
        pre.append(nxt)
    suf = [None] * (L + 1)
    suf[L] = np.ones((n, 1))
    for r in range(L - 1, -1, -1):
        p = P[:, r:r + 1]
        cur = suf[r + 1]
        nxt = np.zeros((n, L - r + 1))
        nxt[:, :-1] += cur * (1 - p)
        nxt[:, 1:] += cur * p
        suf[r] = nxt
    return pre, suf


def expected_measure_cut(df: DataFrame, L: int, measure: str = "ex_fmeasure", conf: str = "conf") -> DataFrame:
    """(id, n, threshold, bip): per row, the number R >= 1 of top-scored labels that minimises the
    expected distance of ``measure`` from its ideal value when label j is positive with probability
    conf_j independently (first minimum); threshold = midpoint of the R-th and (R+1)-th highest
    score (half the lowest when R = L) and bip = conf >= threshold.

    Row-parallel with no shuffle: each Arrow batch is one numpy DP over all its rows, O(L^2) per row."""
    tables = _loss_tables(measure, L)

    # the DP keeps ~L^2 numbers per row: cut each Arrow batch into row chunks under a cell budget
    chunk = max(1, DP_CELLS // max(1, (L + 1) * (L + 2)))

    def run(batches):
        for pdf in batches:
            for s0 in range(0, len(pdf), chunk):
                part = pdf.iloc[s0:s0 + chunk]
                C = np.vstack(part[conf].to_numpy()).astype(np.float64)
                P = -np.sort(-C, axis=1)
                pre, suf = _count_dists(P)
                loss = np.stack([np.einsum("na,ac,nc->n", pre[R], tables[R - 1], suf[R]) for R in range(1, L + 1)], axis=1)
                best = np.argmin(np.round(loss, 10), axis=1) + 1  # rounding: float-noise guard for exact ties
                hi = P[np.arange(len(P)), best - 1]
                lo = np.where(best < L, P[np.arange(len(P)), np.minimum(best, L - 1)], 0.0)
                thr = (hi + lo) / 2
                bip = (C >= thr[:, None]).astype(np.int32)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "n": best.astype(np.int32), "threshold": thr, "bip": list(bip)})

    return df.select("id", conf).mapInPandas(run, "id long, n int, threshold double, bip array<int>")
