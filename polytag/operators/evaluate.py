"""Evaluation measures for multi-label predictions.

Input: a DataFrame with ``id``, ``y`` (ARRAY<INT> truth) and prediction arrays
``conf`` (ARRAY<DOUBLE>), ``bip`` (ARRAY<INT>) and ``rank`` (ARRAY<INT>).

Three physical forms:
* R (per row): array expressions per row, then one ``avg`` (partial aggregation);
* L (per label): ``posexplode`` to (j, t, p) and summed confusion counts;
* C (curves): running counts along confidence order via ``ordered_scan``
  (range-partitioned), or per distinct score for ROC area.

Rows with a missing label are left out of the classification measures.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polytag.functions import labelsets as LS
from polytag.functions.ordered import ordered_scan

LOG_EPS = 1e-8


# ------------------------------------------------------------------ guarded IR ratios (scalar)


def ir_precision(tp, fp, fn) -> Column:
    return F.when(tp + fp + fn == 0, 1.0).when(tp + fp == 0, 0.0).otherwise(tp / (tp + fp))


def ir_recall(tp, fp, fn) -> Column:
    return F.when(tp + fp + fn == 0, 1.0).when(tp + fn == 0, 0.0).otherwise(tp / (tp + fn))


def ir_specificity(tn, fp, fn) -> Column:
    return F.when(tn + fp + fn == 0, 1.0).when(tn + fp == 0, 0.0).otherwise(tn / (tn + fp))


def ir_fmeasure(tp, fp, fn, beta: float = 1.0) -> Column:
    b2 = beta * beta
    return F.when(tp + fp + fn == 0, 1.0).otherwise(((b2 + 1) * tp) / ((b2 + 1) * tp + b2 * fn + fp))


# ------------------------------------------------------------------ helpers


def with_predictions(df: DataFrame, conf: str = "conf", t: float = 0.5) -> DataFrame:
    """Add ``bip`` (conf >= t) and ``rank`` (1 = top, ties to the larger index) when absent."""
    if "bip" not in df.columns:
        df = df.withColumn("bip", LS.bipartition(conf, t))
    if "rank" not in df.columns:
        df = df.withColumn("rank", LS.ranks(conf))
    return df


def complete_rows(df: DataFrame, y: str = "y") -> DataFrame:
    return df.filter(~F.exists(F.col(y), lambda x: x.isNull()))


def _count2(a, b, pred) -> Column:
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda u, v: F.when(pred(u, v), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


# ------------------------------------------------------------------ R: per-row measures


def row_measures(df: DataFrame, beta: float = 1.0, forgiveness: float = 1.0) -> DataFrame:
    """Per-row values of every row measure (columns named after the measure)."""
    x = df.select(
        "id", "y", "conf", "bip", "rank",
        _count2("y", "bip", lambda u, v: (u == 1) & (v == 1)).cast("double").alias("tp"),
        _count2("y", "bip", lambda u, v: (u == 0) & (v == 1)).cast("double").alias("fp"),
        _count2("y", "bip", lambda u, v: (u == 1) & (v == 0)).cast("double").alias("fn"),
        _count2("y", "bip", lambda u, v: (u == 0) & (v == 0)).cast("double").alias("tn"),
        F.size("y").alias("L"),
    )
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    y, rank, conf = F.col("y"), F.col("rank"), F.col("conf")
    rel_ranks = F.filter(F.zip_with(y, rank, lambda t, r: F.when(t == 1, r)), lambda v: v.isNotNull())
    irr_ranks = F.filter(F.zip_with(y, rank, lambda t, r: F.when(t == 0, r)), lambda v: v.isNotNull())
    n_rel, n_irr = F.size(rel_ranks), F.size(irr_ranks)
    ap = F.aggregate(
        F.transform(rel_ranks, lambda r: F.size(F.filter(rel_ranks, lambda q: q <= r)) / r.cast("double")),
        F.lit(0.0), lambda s, v: s + v,
    ) / n_rel
    ess = F.aggregate(
        F.transform(rel_ranks, lambda r: F.size(F.filter(irr_ranks, lambda q: q < r))), F.lit(0), lambda s, v: s + v
    ).cast("double")
    top = F.array_position(rank, 1)
    union = tp + fp + fn
    clip = lambda p: F.least(F.greatest(p, F.lit(LOG_EPS)), F.lit(1 - LOG_EPS))
    ll = -F.aggregate(
        F.zip_with(y, conf, lambda t, p: t * F.log(clip(p)) + (1 - t) * F.log(1 - clip(p))), F.lit(0.0), lambda s, v: s + v
    )
    se = F.aggregate(F.zip_with(y, conf, lambda t, p: (p - t) * (p - t)), F.lit(0.0), lambda s, v: s + v)
    return x.select(
        "id",
        ((fp + fn) / F.col("L")).alias("hamming_loss"),
        F.when(fp + fn == 0, 1.0).otherwise(0.0).alias("subset_accuracy"),
        ir_precision(tp, fp, fn).alias("ex_precision"),
        ir_recall(tp, fp, fn).alias("ex_recall"),
        ir_fmeasure(tp, fp, fn, beta).alias("ex_fmeasure"),
        F.when(union == 0, 1.0).otherwise(F.pow(tp / union, F.lit(forgiveness))).alias("ex_accuracy"),
        ir_specificity(tn, fp, fn).alias("ex_specificity"),
        F.when(n_rel > 0, ap).alias("average_precision"),
        (1 - F.when(n_rel > 0, ap).otherwise(0.0)).alias("one_minus_ap"),
        F.when(n_rel > 0, F.array_max(rel_ranks) - 1).otherwise(0).cast("double").alias("coverage"),
        F.when(F.get(y, (top - 1).cast("int")) == 1, 0.0).otherwise(1.0).alias("one_error"),
        F.when((n_rel > 0) & (n_irr > 0) & (F.array_max(rel_ranks) > F.array_min(irr_ranks)), 1.0).otherwise(0.0).alias("is_error"),
        ess.alias("error_set_size"),
        F.when((n_rel > 0) & (n_irr > 0), ess / (n_rel * n_irr)).otherwise(0.0).alias("ranking_loss"),
        ll.alias("log_loss"),
        se.alias("squared_error"),
    )


ROW_MEASURES = (
    "hamming_loss", "subset_accuracy", "ex_precision", "ex_recall", "ex_fmeasure", "ex_accuracy",
    "ex_specificity", "average_precision", "one_minus_ap", "coverage", "one_error", "is_error",
    "error_set_size", "ranking_loss", "log_loss",
)


def example_measures(df: DataFrame, **kw) -> DataFrame:
    """One row: mean of every row measure over complete rows, plus mse and rmse."""
    r = row_measures(complete_rows(df), **kw)
    agg = r.agg(*[F.avg(m).alias(m) for m in ROW_MEASURES], F.avg("squared_error").alias("mse"))
    return agg.withColumn("rmse", F.sqrt("mse"))


# ------------------------------------------------------------------ L: per-label confusion


def label_confusion(df: DataFrame) -> DataFrame:
    """(j, tp, fp, fn, tn) per label over complete rows."""
    z = complete_rows(df).select(F.posexplode(F.arrays_zip("y", "bip")).alias("j", "z"))
    t, p = F.col("z.y"), F.col("z.bip")
    return z.groupBy("j").agg(
        F.sum(F.when((t == 1) & (p == 1), 1).otherwise(0)).cast("double").alias("tp"),
        F.sum(F.when((t == 0) & (p == 1), 1).otherwise(0)).cast("double").alias("fp"),
        F.sum(F.when((t == 1) & (p == 0), 1).otherwise(0)).cast("double").alias("fn"),
        F.sum(F.when((t == 0) & (p == 0), 1).otherwise(0)).cast("double").alias("tn"),
    ).withColumn("j", F.col("j").cast("int"))


def per_label_measures(conf: DataFrame, beta: float = 1.0) -> DataFrame:
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    return conf.select(
        "j", ir_precision(tp, fp, fn).alias("precision"), ir_recall(tp, fp, fn).alias("recall"),
        ir_fmeasure(tp, fp, fn, beta).alias("fmeasure"), ir_specificity(tn, fp, fn).alias("specificity"),
    )


def melt(one_row: DataFrame) -> DataFrame:
    """One-row frame of measures -> (measure, value) rows."""
    return one_row.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"))
                            for c in one_row.columns])).alias("m")
    ).select("m.measure", "m.value")


def micro_macro(conf: DataFrame, beta: float = 1.0) -> DataFrame:
    """(measure, value): micro (pooled counts) and macro (mean over labels) precision/recall/F/specificity."""
    pl = per_label_measures(conf, beta)
    macro = pl.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "fmeasure", "specificity")])
    pooled = conf.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    micro = pooled.select(
        ir_precision(tp, fp, fn).alias("micro_precision"), ir_recall(tp, fp, fn).alias("micro_recall"),
        ir_fmeasure(tp, fp, fn, beta).alias("micro_fmeasure"), ir_specificity(tn, fp, fn).alias("micro_specificity"),
    )
    return melt(micro).unionByName(melt(macro))


# ------------------------------------------------------------------ C: curves


def _long(df: DataFrame) -> DataFrame:
    z = complete_rows(df).select("id", F.posexplode(F.arrays_zip("y", "conf")).alias("j", "z"))
    return z.select("id", F.col("j").cast("int").alias("j"), F.col("z.y").alias("t"), F.col("z.conf").alias("c"))


def label_ap_curves(df: DataFrame, levels: int = 10) -> DataFrame:
    """(j, n_rel, ap, iap): average precision and interpolated AP per label.

    Rows are ordered by confidence desc, ties by id (the row order)."""
    lg = _long(df).withColumn("one", F.lit(1)).withColumn("t", F.col("t").cast("int"))
    s = ordered_scan(lg, ["j"], "c", "id", {"pos": ("sum", "one"), "hits": ("sum", "t")}, score_desc=True)
    s = s.withColumn("prec", F.col("hits") / F.col("pos")).join(F.broadcast(lg.groupBy("j").agg(F.sum("t").alias("R"))), "j")
    # interpolated precision at level i: the best precision of the rows at which recall i/(levels-1) is reached or passed,
    # so the best per (label, highest level reached) is all that is needed
    lv = levels - 1
    reached = F.when(F.col("R") > 0, F.floor(F.col("hits") * lv / F.col("R"))).otherwise(F.lit(0)).cast("int")
    per = s.groupBy("j", reached.alias("level")).agg(
        F.sum(F.when(F.col("t") == 1, F.col("prec")).otherwise(0.0)).alias("_s"), F.max("prec").alias("best"), F.first("R").alias("R"))
    per = per.groupBy("j").agg(F.sum("_s").alias("_s"), F.first("R").alias("R"), F.collect_list(F.struct("level", "best")).alias("_p"))
    at = lambda i: F.array_max(F.transform(F.filter("_p", lambda p: p["level"] >= i), lambda p: p["best"]))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(lv)), F.lit(0.0), lambda acc, i: acc + at(i))
    return per.select("j", F.col("R").alias("n_rel"), F.when(F.col("R") > 0, F.col("_s") / F.col("R")).alias("ap"),
                      F.when(F.col("R") > 0, total / F.lit(levels)).alias("iap"))


def _auc_from_scores(sc: DataFrame, part: list[str]) -> DataFrame:
    """ROC area per ``part`` from (part, c, pos, neg) counts per distinct score; ties count 1/2."""
    s = ordered_scan(sc, part, "c", None, {"neg_cum": ("sum", "neg")})
    s = s.withColumn("neg_below", F.col("neg_cum") - F.col("neg"))
    g = s.groupBy(*part).agg(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5)).alias("u"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
    )
    return g.select(*part, F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("u") / (F.col("P") * F.col("N"))).alias("auc"))


def label_auc(df: DataFrame) -> DataFrame:
    """(j, auc) per label."""
    lg = _long(df)
    sc = lg.groupBy("j", "c").agg(F.sum("t").cast("double").alias("pos"), F.sum(1 - F.col("t")).cast("double").alias("neg"))
    return _auc_from_scores(sc, ["j"])


def micro_auc(df: DataFrame) -> DataFrame:
    """One row: ROC area over all (row, label) pairs pooled; grouped by score first."""
    lg = _long(df)
    sc = lg.groupBy("c").agg(F.sum("t").cast("double").alias("pos"), F.sum(1 - F.col("t")).cast("double").alias("neg"))
    return _auc_from_scores(sc, []).select(F.col("auc").alias("micro_auc"))


def curve_measures(df: DataFrame, levels: int = 10) -> DataFrame:
    """(measure, value): map, gmap, miap, gmiap, macro_auc, micro_auc."""
    c = label_ap_curves(df, levels)
    geo = lambda col: F.when(F.count(F.when(F.col(col).isNull(), 1)) > 0, F.lit(math.nan)).when(
        F.min(col) == 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.log(F.col(col)))))
    m = c.agg(F.avg("ap").alias("map"), geo("ap").alias("gmap"), F.avg("iap").alias("miap"), geo("iap").alias("gmiap"))
    a = label_auc(df).agg(F.avg("auc").alias("macro_auc"))
    return melt(m).unionByName(melt(a)).unionByName(melt(micro_auc(df)))


# ------------------------------------------------------------------ hierarchy


def hierarchical_loss(df: DataFrame, ancestors: list[list[int]]) -> DataFrame:
    """One row: mean over rows of the number of wrong nodes whose ancestors are all right.

    ``ancestors[j]`` lists the label indices above j (label-sized, from the tree)."""
    anc = F.array(*[F.array(*[F.lit(a) for a in al]).cast("array<int>") for al in ancestors])
    y, b = F.col("y"), F.col("bip")
    wrong = lambda j: F.get(y, j) != F.get(b, j)
    per_node = F.transform(
        F.sequence(F.lit(0), F.size(y) - 1),
        lambda j: F.when(wrong(j) & F.forall(F.get(anc, j), lambda a: ~wrong(a)), 1).otherwise(0),
    )
    r = complete_rows(df).select(F.aggregate(per_node, F.lit(0), lambda s, v: s + v).alias("h"))
    return r.agg(F.avg("h").alias("hierarchical_loss"))


# ------------------------------------------------------------------ regression


def regression_measures(df: DataFrame, target: str = "target", pred: str = "pred", train_mean: list[float] | None = None) -> DataFrame:
    """(j, mae, rmse, rel_mae, rel_rmse) per target over non-missing values; relative ones divide by
    the error of predicting the training mean (``train_mean``; default: mean of this set)."""
    z = df.select(F.posexplode(F.arrays_zip(F.col(target).alias("t"), F.col(pred).alias("p"))).alias("j", "z"))
    z = z.select(F.col("j").cast("int").alias("j"), F.col("z.t").alias("t"), F.col("z.p").alias("p")).filter(
        F.col("t").isNotNull() & ~F.isnan("t"))
    if train_mean is None:
        means = z.groupBy("j").agg(F.avg("t").alias("mu"))
    else:
        spark = df.sparkSession
        means = spark.createDataFrame([(i, float(m)) for i, m in enumerate(train_mean)], "j int, mu double")
    z = z.join(F.broadcast(means), "j")
    g = z.groupBy("j").agg(
        F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae"),
        F.sqrt(F.avg((F.col("p") - F.col("t")) ** 2)).alias("rmse"),
        F.avg(F.abs(F.col("mu") - F.col("t"))).alias("base_mae"),
        F.sqrt(F.avg((F.col("mu") - F.col("t")) ** 2)).alias("base_rmse"),
    )
    return g.select(
        "j", "mae", "rmse",
        F.when(F.col("base_mae") != 0, F.col("mae") / F.col("base_mae")).alias("rel_mae"),
        F.when(F.col("base_rmse") != 0, F.col("rmse") / F.col("base_rmse")).alias("rel_rmse"),
    )


def evaluate(df: DataFrame, levels: int = 10, measures=()) -> DataFrame:
    """Long table (measure, value) of every measure the prediction columns allow, and of the user's own ``measures``
    (``cuts.Measure``: an expression over four counts and the level these are taken at).  The prediction
    columns are checkpointed once (the measures read them about six times; re-deriving them would
    re-run the whole scoring pipeline each time)."""
    from polytag.operators.nb import materialize

    df, _ = materialize(df.select(*[c for c in ("id", "y", "conf", "bip", "rank") if c in df.columns]))
    out = melt(example_measures(df)).unionByName(micro_macro(label_confusion(df))).unionByName(curve_measures(df, levels))
    if measures:
        from polytag.operators.cuts import measured

        out = out.unionByName(measured(df, measures))
    return out
