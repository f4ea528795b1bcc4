"""Meta learners: a second model predicts each row's number of labels, or the cut of its scores.

The second model learns from scores of rows that the first has not seen.  One count keyed by (fold, label) fits the first
learner's out-of-fold models and, as one more fold to which no row belongs, its model on all rows; so training scores and the scores of
new rows come from one table, kept per distinct feature tuple.  The second model reads

* ``content``: the row's categorical features,
* ``scores``: its scores in label order,
* ``ranks``: its scores in ascending order,

and is either a naive Bayes over sizes (``head="class"``; scores enter as categories of equal width) or least squares
(``head="number"``; features enter as 0/1 columns, one for each value but the first).  Training rows enter as distinct (features,
fold, labels) with their number, and predictions are worked out once per distinct feature tuple, then joined to the rows.

Defined cases: a row with a missing label trains the first learner on its other labels and the second not at all; a value not seen in
training, or a missing one, is no category; equal class scores go to the smaller size; without training rows every size and cut is 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polytag.frame import MLFrame
from polytag.functions import labelsets as LS
from polytag.operators import evaluate as EV
from polytag.operators import gram as GR
from polytag.operators import nb as NB
from polytag.operators import threshold as TH

INPUTS = ("content", "scores", "ranks")
HEADS = ("class", "number")
#: width of a score category is 1 / SCORE_CATEGORIES
SCORE_CATEGORIES = 20
#: most 0/1 columns of the least-squares head; its cross-products hold their square
MOST_COLUMNS = 2_000


@dataclass
class MetaFrame:
    """``seen``: (features, y, _w, conf) of the training rows, scored by models that did not see them; ``tuples``: (_key, features,
    conf) of every distinct feature tuple to predict, scored by the model on all training rows."""

    mlf: MLFrame
    seen: DataFrame
    tuples: DataFrame
    n_tuples: int


def meta_frame(mlf: MLFrame, train: DataFrame, rows: DataFrame, folds: int = 3, seed: int = 1) -> MetaFrame:
    """Scores for the second model: out-of-fold ones of ``train``, final ones of the feature tuples of ``rows``."""
    feats = list(mlf.features)
    fold = F.pmod(LS.stable_hash(mlf.id_col, seed), F.lit(folds)).cast("int")
    seen, _ = NB.materialize(train.groupBy(*feats, fold.alias("_fold"), F.col(mlf.y_col).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("_w")))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda f: f != F.col("_fold"))
    cells = seen.select(*feats, "_w", "_fold", F.posexplode("y").alias("j", "t")).filter("t is not null")
    cells = cells.select(*feats, "_w", F.col("j").cast("int").alias("j"), "t", F.explode(others).alias("fold"))
    keys = train.sparkSession.range(folds + 1).select(F.col("id").cast("int").alias("fold")).select("fold", F.explode(F.sequence(F.lit(0), F.lit(mlf.L - 1))).alias("j"))
    model = NB.fit_nb(cells, ["fold", "j"], feats, keys.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("t")), weight="_w")
    key = NB.feature_key(feats).alias("_key")
    tuples = seen.select(key, *feats).unionByName(rows.select(key, *feats)).dropDuplicates(["_key"])
    p = NB.nb_binary_scores(model, tuples, "_key").groupBy("_key", "fold").agg(F.array_sort(F.collect_list(F.struct("j", "p1"))).alias("a"))  # L entries
    # rounded, so that scores that differ by the order of their sums alone are equal
    scores, n = NB.materialize(p.select("_key", "fold", F.transform("a", lambda e: F.round(e["p1"], 9)).alias("conf")))
    own = seen.select("*", key).withColumnRenamed("_fold", "fold").join(NB.maybe_broadcast(scores, n), ["_key", "fold"])
    final, n = NB.materialize(tuples.join(NB.maybe_broadcast(scores.filter(F.col("fold") == folds).drop("fold"), n), "_key"))
    return MetaFrame(mlf, NB.materialize(EV.complete_rows(own))[0], final, n)


def _categories(mf: MetaFrame, inputs: str) -> Column:
    """The second model's inputs as (f, v) pairs."""
    if inputs == "content":
        return NB.feature_pairs(mf.mlf.features)
    conf = F.array_sort("conf") if inputs == "ranks" else F.col("conf")

    def pair(v: Column, j: Column) -> Column:
        return F.struct(F.concat(F.lit("s"), j.cast("string")).alias("f"), F.floor(F.round(v * SCORE_CATEGORIES, 6)).cast("string").alias("v"))

    return F.filter(F.transform(conf, pair), lambda s: s["v"].isNotNull())


def _numbers(mf: MetaFrame, inputs: str) -> list[Column]:
    """The second model's inputs as numeric columns."""
    if inputs != "content":
        conf = F.array_sort("conf") if inputs == "ranks" else F.col("conf")
        return [conf[j] for j in range(mf.mlf.L)]
    found = mf.seen.select(F.explode(NB.feature_pairs(mf.mlf.features)).alias("p")).select("p.f", "p.v").distinct()
    values = found.limit(MOST_COLUMNS + len(mf.mlf.features) + 1).collect()  # refused below when cut
    if len(values) > MOST_COLUMNS + len(mf.mlf.features):
        raise ValueError(f"over {MOST_COLUMNS} feature values; take scores or ranks as inputs, or bin the features")
    by: dict[str, list[str]] = {}
    for r in sorted(values):
        by.setdefault(r["f"], []).append(r["v"])
    return [F.coalesce((F.col(f).cast("string") == v).cast("double"), F.lit(0.0)) for f in mf.mlf.features for v in by.get(f, [])[1:]]


def _checked(inputs: str, head: str) -> None:
    if inputs not in INPUTS or head not in HEADS:
        raise ValueError(f"no such meta learner: {inputs!r}, {head!r}")


def _classed(mf: MetaFrame, inputs: str, target: Column) -> DataFrame:
    """(_key, said): the likeliest class of ``target``, of equally likely ones the smallest."""
    rows = mf.seen.select("_w", target.alias("t"), _categories(mf, inputs).alias("_pairs"))
    model = NB.fit_nb(rows, [], [], weight="_w", pairs="_pairs")
    if not model.const:
        return mf.tuples.select("_key", F.lit(0).alias("said"))
    pairs = mf.tuples.select("_key", F.explode(_categories(mf, inputs)).alias("p")).select("_key", "p.f", "p.v")
    hits = pairs.join(NB.maybe_broadcast(model.weights, model.n_weights), ["f", "v"]).select("_key", "t", F.col("w").alias("x"))
    base = mf.tuples.select("_key", F.explode(model.const_array()).alias("c")).select("_key", F.col("c.t").alias("t"), F.col("c.kc").alias("x"))
    s = hits.unionByName(base).groupBy("_key", "t").agg(F.sum("x").alias("s"))
    return s.groupBy("_key").agg(F.min(F.struct((-F.round("s", 9)).alias("s"), "t")).alias("b")).select("_key", F.col("b.t").alias("said"))


def _regressed(mf: MetaFrame, inputs: str, target: Column) -> DataFrame:
    """(_key, said): the least-squares value of ``target``."""
    xs = _numbers(mf, inputs)
    x = mf.seen.select("_w", F.array(*xs).alias("x") if xs else F.array().cast("array<double>").alias("x"), target.cast("double").alias("t"))
    cols = [F.col("x")[i] for i in range(len(xs))]
    g = GR.grams(x, cols, ["t"], weights=[F.col("_w")])
    coefficients = GR.combinations(g, np.ones((1, 1)))
    return mf.tuples.select("_key", GR.predicted(coefficients, xs)[0].alias("said"))


def _decided(mf: MetaFrame, rows: DataFrame, said: DataFrame, value: Column, yes: Callable[[], Column]) -> DataFrame:
    per = mf.tuples.select("_key", "conf").join(said, "_key").withColumn("said", value).withColumn("bip", yes())
    per, n = NB.materialize(per)
    return rows.select(F.col(mf.mlf.id_col).alias("id"), NB.feature_key(mf.mlf.features).alias("_key")).join(NB.maybe_broadcast(per, n), "_key").drop("_key")


def predict_sizes(mf: MetaFrame, rows: DataFrame, inputs: str = "content", head: str = "class") -> DataFrame:
    """(id, n, conf, bip): the labels of the ``n`` best ranks, ``n`` said by the second model (a number is rounded, halves up)."""
    _checked(inputs, head)
    size = LS.size("y")
    said = _classed(mf, inputs, size) if head == "class" else _regressed(mf, inputs, size)
    # a regression that comes within 1e-9 of a half is taken as that half
    n = F.col("said").cast("int") if head == "class" else F.floor(F.round("said", 9) + 0.5).cast("int")
    out = _decided(mf, rows, said, n, lambda: F.transform(LS.ranks("conf"), lambda r: (r <= F.col("said")).cast("int")))
    return out.withColumnRenamed("said", "n").select("id", "n", "conf", "bip")


def predict_thresholds(mf: MetaFrame, rows: DataFrame, inputs: str = "scores") -> DataFrame:
    """(id, threshold, conf, bip): labels whose score reaches the cut that least squares predicts; it is fitted to each training
    row's best cut (``threshold.best_row_cut``)."""
    _checked(inputs, "number")
    said = _regressed(mf, inputs, TH.best_row_cut("y", "conf")["threshold"])
    out = _decided(mf, rows, said, F.round("said", 9), lambda: F.transform("conf", lambda c: (c >= F.col("said")).cast("int")))
    return out.withColumnRenamed("said", "threshold").select("id", "threshold", "conf", "bip")
