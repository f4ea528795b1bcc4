"""Cross-validation and comparison of learners: every row is scored by the model that did not see its fold.

The fold is part of the model key, so all folds are fitted by one count and no learner is fitted in a loop over folds; scores are
computed per distinct feature tuple and joined to the rows on (tuple, fold).  Measures are taken per fold; the result is
their mean and population standard deviation over the folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polytag.frame import MLFrame
from polytag.functions import labelsets as LS
from polytag.operators import curves as CU
from polytag.operators import evaluate as EV
from polytag.operators import learners as LN
from polytag.operators import nb as NB

LEARNERS = ("br", "lp", "prior")


def _folded(mlf: MLFrame, folds: int, seed: int) -> DataFrame:
    return mlf.df.withColumn("_fold", F.pmod(LS.stable_hash(mlf.id_col, seed), F.lit(folds)).cast("int"))


def _other_folds(folds: int) -> F.Column:
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("_fold"))).alias("fold")


def _br(mlf: MLFrame, rows: DataFrame, folds: int) -> DataFrame:
    """(key, fold, conf, bip) of one binary model per (fold, label)."""
    c = rows.groupBy(*mlf.features, "_fold", mlf.y_col).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    x = c.select(*mlf.features, "_w", "_fold", F.posexplode(mlf.y_col).alias("j", "t")).filter(F.col("t").isNotNull())
    x = x.select(*mlf.features, "_w", F.col("j").cast("int").alias("j"), "t", _other_folds(folds))
    spark = rows.sparkSession
    keys = spark.range(folds).select(F.col("id").cast("int").alias("fold")).select("fold", F.explode(F.sequence(F.lit(0), F.lit(mlf.L - 1))).alias("j"))
    classes = keys.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("t"))
    model = NB.fit_nb(x, ["fold", "j"], list(mlf.features), classes, weight="_w")
    tuples = rows.select(NB.feature_key(mlf.features).alias("_key"), *mlf.features).dropDuplicates(["_key"])
    p = NB.nb_binary_scores(model, tuples, "_key")
    one = F.struct("j", F.col("p1").alias("conf"), (F.col("s1") >= F.col("s0")).cast("int").alias("bip"))
    g = p.groupBy("_key", "fold").agg(F.array_sort(F.collect_list(one)).alias("a"))  # L entries a group
    return g.select("_key", "fold", F.col("a.conf").alias("conf"), F.col("a.bip").alias("bip"))


def _lp(mlf: MLFrame, rows: DataFrame, folds: int) -> DataFrame:
    """(key, fold, conf, bip): the most probable label set seen outside the fold (ties: the smaller bit string)."""
    c = rows.filter(~F.exists(mlf.y_col, lambda v: v.isNull())).groupBy(*mlf.features, "_fold", LS.bits(mlf.y_col).alias("t")).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    model = NB.fit_nb(c.select(*mlf.features, "_w", "t", _other_folds(folds)), ["fold"], list(mlf.features), weight="_w")
    tuples = rows.select(NB.feature_key(mlf.features).alias("_key"), *mlf.features).dropDuplicates(["_key"])
    # two scores that differ by rounding only are a tie
    s = NB.nb_scores(model, tuples, "_key").withColumn("s", F.round("s", 9))
    best = s.groupBy("_key", "fold").agg(F.min(F.struct((-F.col("s")).alias("s"), "t")).alias("b"))
    bip = LS.from_bits(F.col("b.t"))
    return best.select("_key", "fold", bip.cast("array<double>").alias("conf"), bip.alias("bip"))


def _prior(mlf: MLFrame, rows: DataFrame, folds: int) -> DataFrame:
    """(fold, conf, bip): each label's share of ones outside the fold."""
    n = rows.select("_fold", F.posexplode(mlf.y_col).alias("j", "t")).filter("t is not null").groupBy("_fold", "j").agg(F.sum("t").alias("ones"), F.count(F.lit(1)).alias("n"))
    out = n.select("j", "ones", "n", _other_folds(folds)).groupBy("fold", "j").agg((F.sum("ones") / F.sum("n")).alias("conf"))
    g = out.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("j", "conf"))).alias("a")).select("fold", F.col("a.conf").alias("conf"))
    return g.withColumn("bip", LS.bipartition("conf", 0.5))


def out_of_fold(mlf: MLFrame, learner: str, folds: int = 5, seed: int = 1) -> DataFrame:
    """(id, fold, y, conf, bip): every row with the prediction of the model that did not see its fold."""
    rows, _ = NB.materialize(_folded(mlf, folds, seed).select(mlf.id_col, *mlf.features, mlf.y_col, "_fold"))
    keyed = rows.select(F.col(mlf.id_col).alias("id"), F.col("_fold").alias("fold"), F.col(mlf.y_col).alias("y"), NB.feature_key(mlf.features).alias("_key"))
    if learner == "prior":
        return keyed.join(F.broadcast(_prior(mlf, rows, folds)), "fold").drop("_key")  # one row per fold
    if learner not in LEARNERS:
        raise ValueError(f"unknown learner {learner!r}")
    scored, n = NB.materialize({"br": _br, "lp": _lp}[learner](mlf, rows, folds))
    return keyed.join(NB.maybe_broadcast(scored, n), ["_key", "fold"]).drop("_key")


def fold_measures(pred: DataFrame) -> DataFrame:
    """(fold, measure, value): the row measures, and the micro and macro forms of the label measures, per fold."""
    x = EV.complete_rows(EV.with_predictions(pred)).withColumn("id", F.struct("id", "fold"))
    r = EV.row_measures(x)
    per = r.groupBy(F.col("id.fold").alias("fold")).agg(*[F.avg(m).alias(m) for m in EV.ROW_MEASURES])
    rows = per.select("fold", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in EV.ROW_MEASURES])).alias("m")).select("fold", "m.*")
    cells = x.select(F.col("id.fold").alias("fold"), F.posexplode(F.arrays_zip("y", "bip")).alias("j", "z")).select("fold", "j", F.col("z.y").alias("t"), F.col("z.bip").alias("b"))
    hit = lambda t, b: F.sum(((F.col("t") == t) & (F.col("b") == b)).cast("double"))
    conf = cells.groupBy("fold", "j").agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))

    def ratios(prefix: str) -> F.Column:
        c = {k: F.col(k) for k in ("tp", "fp", "fn", "tn")}
        found = {"precision": EV.ir_precision(c["tp"], c["fp"], c["fn"]), "recall": EV.ir_recall(c["tp"], c["fp"], c["fn"]),
                 "fmeasure": EV.ir_fmeasure(c["tp"], c["fp"], c["fn"]), "specificity": EV.ir_specificity(c["tn"], c["fp"], c["fn"])}
        return F.explode(F.array(*[F.struct(F.lit(f"{prefix}_{k}").alias("measure"), v.alias("value")) for k, v in found.items()])).alias("m")

    pooled = conf.groupBy("fold").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn", "tn")]).select("fold", ratios("micro")).select("fold", "m.*")
    macro = conf.select("fold", ratios("macro")).select("fold", "m.*").groupBy("fold", "measure").agg(F.avg("value").alias("value"))
    return rows.unionByName(pooled).unionByName(macro)


def cross_validate(mlf: MLFrame, learner: str = "br", folds: int = 5, seed: int = 1) -> DataFrame:
    """(measure, mean, sd): mean and population standard deviation of every measure over the folds."""
    m = fold_measures(out_of_fold(mlf, learner, folds, seed))
    return m.groupBy("measure").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


#: scores are compared to this many parts of the unit in curves over folds
CURVE_BINS = 1_000_000


def _scored_folds(mlf: MLFrame, learner: str, folds: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions and their score counts per fold and label, both written once."""
    pred, _ = NB.materialize(out_of_fold(mlf, learner, folds, seed))
    return pred, NB.materialize(CU.score_counts(pred, ["fold"], CURVE_BINS))[0]


def _over_folds(m: DataFrame, *keys: str) -> DataFrame:
    return m.groupBy(*keys, "measure").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def cross_validate_all(mlf: MLFrame, learner: str = "br", folds: int = 5, seed: int = 1, levels: int = 10) -> DataFrame:
    """(measure, mean, sd) over the folds: row and label measures of the sets, and the curve measures of the scores."""
    pred, counts = _scored_folds(mlf, learner, folds, seed)
    return _over_folds(fold_measures(pred).unionByName(CU.curve_measures(counts, ["fold"], levels)))


def cross_validate_curves(mlf: MLFrame, learner: str = "br", folds: int = 5, seed: int = 1, levels: int = 10) -> DataFrame:
    """(measure, mean, sd) of the curve measures alone."""
    return _over_folds(CU.curve_measures(_scored_folds(mlf, learner, folds, seed)[1], ["fold"], levels))


def cross_validate_labels(mlf: MLFrame, learner: str = "br", folds: int = 5, seed: int = 1, levels: int = 10) -> DataFrame:
    """(j, measure, mean, sd) of every label's own measures; a fold in which a measure is undefined is left out of its mean."""
    pred, counts = _scored_folds(mlf, learner, folds, seed)
    return _over_folds(CU.label_measures(pred, counts, ["fold"], levels), "j")


def compare(data: dict[str, MLFrame], learners: tuple[str, ...] = LEARNERS, fold_counts: tuple[int, ...] = (5,), seed: int = 1) -> DataFrame:
    """(data, learner, folds, measure, mean, sd): the comparison table of learners over data sets and fold counts."""
    out = None
    for name, mlf in data.items():
        for learner in learners:
            for folds in fold_counts:
                one = cross_validate(mlf, learner, folds, seed).select(F.lit(name).alias("data"), F.lit(learner).alias("learner"), F.lit(folds).alias("folds"), "measure", "mean", "sd")
                out = one if out is None else out.unionByName(one)
    return out
