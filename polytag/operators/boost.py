"""Boosting of (row, label) weights with one stump for all labels a round (AdaBoost.MH).

A stump parts the rows by the values of one categorical feature and says, for every label, a confidence per value; rows without a value
abstain.  A round is one ``groupBy`` over the weighted (feature, value, label) cells of all features, combined before the shuffle: the
weight of the label's positive and negative rows in each cell gives the confidence 1/2 ln((w+ + e) / (w- + e)), e = 1 / (2 x cells of rows and labels),
and the feature's normaliser Z; the feature of the smallest Z (to twelve places, then by name) is the stump.  The product of the Zs bounds the
training Hamming loss.  Rows are compacted to (features, label set) with a multiplicity; the weights ride with them as one array per
row and are carried to the next round by a join with the chosen stump's table (one row per value).  Every round's table is a reliable checkpoint;
only the chosen feature and its Z come to the driver.  Stumps on the same feature add up, so the model is one (feature, value, label) table, and
a prediction is the join that naive Bayes scores with.

Cases: a missing label has no weight; a row without any feature value scores 0 (confidence 1/2, negative); a table without labelled rows gives no rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polytag.frame import MLFrame
from polytag.operators import nb as NB


@dataclass
class BoostModel:
    features: list[str]
    L: int
    weights: DataFrame  # (f, v, j, w), checkpointed
    n_weights: int
    rounds: list[tuple[int, str, float, float]]  # (round, feature, z, bound)


def fit_mh(mlf: MLFrame, train: DataFrame, rounds: int = 20) -> BoostModel:
    y, L = F.col(mlf.y_col), mlf.L
    rows = train.groupBy(*mlf.features, mlf.y_col).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    state, _ = NB.materialize(rows.select(NB.feature_pairs(mlf.features).alias("_p"), y.alias("_y"), F.transform(
        y, lambda t: F.when(t.isNotNull(), F.col("_n")).otherwise(0.0)).alias("_d")))
    total = state.agg(F.sum(F.aggregate("_d", F.lit(0.0), lambda a, d: a + d))).first()[0] or 0.0
    state = state.withColumn("_d", F.transform("_d", lambda d: d / F.lit(total))) if total else state
    smooth = F.lit(0.5 / total if total else 0.0)
    tables: list[DataFrame] = []
    told: list[tuple[int, str, float, float]] = []
    bound = 1.0
    for r in range(1, rounds + 1 if total else 1):
        cell = state.select(F.explode("_p").alias("p"), F.arrays_zip("_y", "_d").alias("z")).select("p.f", "p.v", F.posexplode("z").alias("j", "z"))
        weight = lambda t: F.sum(F.when(F.col("z._y") == t, F.col("z._d")).otherwise(0.0))
        cells = cell.groupBy("f", "v", "j").agg(weight(1).alias("up"), weight(0).alias("down"))
        cells, _ = NB.materialize(cells.withColumn("h", 0.5 * F.log((F.col("up") + smooth) / (F.col("down") + smooth))))
        z = 1.0 - F.sum(F.col("up") + F.col("down")) + F.sum(F.col("up") * F.exp(-F.col("h")) + F.col("down") * F.exp("h"))
        best = cells.groupBy("f").agg(z.alias("z")).orderBy(F.round("z", 12), "f").limit(1).collect()
        if not best or best[0]["z"] >= 1.0 - 1e-12:
            break
        f, z_best = best[0]["f"], float(best[0]["z"])
        bound *= z_best
        told.append((r, f, z_best, bound))
        stump = cells.filter(F.col("f") == f).select("f", "v", F.col("j").cast("int").alias("j"), "h")
        tables.append(stump)
        # one row per value: the confidences in label order
        by_value, n = NB.materialize(stump.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("j", "h"))).alias("_h")))
        own = F.get(F.filter("_p", lambda p: p["f"] == F.lit(f)), F.lit(0))["v"]
        joined = state.withColumn("_v", own).join(NB.maybe_broadcast(by_value, n), F.col("_v") == F.col("v"), "left")
        moved = F.transform(F.arrays_zip("_y", "_d"), lambda x, i: x["_d"] * F.exp(
            (1 - 2 * F.coalesce(x["_y"], F.lit(0))) * F.coalesce(F.get("_h", i)["h"], F.lit(0.0))) / F.lit(z_best))
        state, _ = NB.materialize(joined.select("_p", "_y", moved.alias("_d")))
    if tables:
        every = tables[0]
        for t in tables[1:]:
            every = every.unionByName(t)
        weights = every.groupBy("f", "v", "j").agg(F.sum("h").alias("w"))
    else:
        weights = train.sparkSession.createDataFrame([], "f string, v string, j int, w double")
    weights, n_weights = NB.materialize(weights)
    return BoostModel(list(mlf.features), L, weights, n_weights, told)


def predict_mh(model: BoostModel, df: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, j, conf, bip): conf = 1 / (1 + exp(-2 x summed confidence)); positive iff the sum is above 0.  Each feature tuple is scored once."""
    fk = NB.feature_key(model.features)
    tuples = df.select(fk.alias("_fk"), *model.features).dropDuplicates(["_fk"])
    pairs = tuples.select("_fk", F.explode(NB.feature_pairs(model.features)).alias("p")).select("_fk", "p.f", "p.v")
    found = pairs.join(NB.maybe_broadcast(model.weights, model.n_weights), ["f", "v"]).select("_fk", "j", "w")
    labels = F.explode(F.sequence(F.lit(0), F.lit(model.L - 1))).alias("j")
    scored = found.unionByName(tuples.select("_fk", labels, F.lit(0.0).alias("w"))).groupBy("_fk", "j").agg(F.sum("w").alias("s"))
    # a sum of confidences that cancel is not a verdict
    scored, n = NB.materialize(scored.select("_fk", "j", (1.0 / (1.0 + F.exp(-2.0 * F.col("s")))).alias("conf"), (F.col("s") > 1e-9).cast("int").alias("bip")))
    return df.select(id_col, fk.alias("_fk")).join(NB.maybe_broadcast(scored, n), "_fk").select(id_col, "j", "conf", "bip")
