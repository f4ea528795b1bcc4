"""Conditional label dependence: does knowing label j improve the prediction of label i?

For every ordered pair (i, j) two models predict label i in k-fold cross-validation: the
*independent* one from the features, the *dependent* one from the features plus label j.  The
fold accuracies (percent correct) go into a paired t statistic; it is -1 when the independent
model is better on average.  Each unordered pair keeps the larger of its two orders.

With the count-based naive Bayes base, the dependent model's log score is the independent one
plus ln P(y_j | y_i = t), so the L (L - 1) dependent models need only the label-pair counts.
Out-of-fold models come from *one* count per fold: model(fold k) = count(all) - count(fold k).

    P(t)          = (n_t + 1) / (n + 2)
    P(v | t)      = (c(f, v, t) + 1) / (n_t + V_f)     V_f = distinct values of f in the data
    P(y_j=v | t)  = (c(t, v) + 1) / (n_t + 2)

A class wins only when its score is strictly larger (an exact tie predicts 0, as a first-maximum
rule over the classes {0, 1} does).  Two float guards (documented deviations): the means are
compared with a 1e-9 margin and a squared-deviation sum below 1e-12 counts as zero, so rounding
noise does not turn equal accuracies into a huge t.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polytag.frame import MLFrame
from polytag.operators import nb as NB
from polytag.operators import split as SP

CRITICAL = 3.25  # fixed value: default critical t of the dependence test


def _oof(counts: DataFrame, keys: list[str], folds: DataFrame, value: str = "c") -> DataFrame:
    """Out-of-fold counts: for every fold k, the total over all folds minus fold k's own count."""
    tot = counts.groupBy(*keys).agg(F.sum(value).alias("_tot"))
    grid = folds.crossJoin(tot)
    return grid.join(counts, ["fold", *keys], "left").select(
        "fold", *keys, (F.col("_tot") - F.coalesce(F.col(value), F.lit(0))).alias(value))


def fold_accuracies(mlf: MLFrame, k: int = 10, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(fold, i, acc) of the independent models and (fold, i, j, acc) of the dependent ones."""
    spark = mlf.df.sparkSession
    idc = mlf.id_col
    L = mlf.L
    # rows that agree in fold, features and labels are one row of weight n
    x = mlf.df.join(SP.cv_folds(mlf, k, seed), idc).groupBy("fold", mlf.y_col, *mlf.features).agg(F.count(F.lit(1)).alias("n"))
    x, _ = NB.materialize(x.select(F.monotonically_increasing_id().alias(idc), "fold", mlf.y_col, "n", NB.feature_pairs(mlf.features).alias("fv")))
    folds = spark.range(k).select(F.col("id").cast("int").alias("fold"))

    lab = x.select(idc, "fold", "fv", "n", F.posexplode(mlf.y_col).alias("i", "t")).filter(F.col("t").isNotNull())
    cf = lab.select("fold", "i", "t", "n", F.explode("fv").alias("p")).groupBy("fold", "i", F.col("p.f").alias("f"),
                                                                              F.col("p.v").alias("v"), "t").agg(F.sum("n").alias("c"))
    cf, _ = NB.materialize(cf)
    vf = cf.groupBy("f").agg(F.countDistinct("v").alias("nv"))
    nvs = vf.collect()  # one row per feature
    w_oof = _oof(cf, ["i", "f", "v", "t"], folds)
    weights, n_w = NB.materialize(w_oof.filter(F.col("c") > 0).select("fold", "i", "f", "v", "t", F.log(F.col("c") + 1.0).alias("w")))

    classes = folds.crossJoin(spark.range(L).select(F.col("id").cast("int").alias("i"))).crossJoin(
        spark.createDataFrame([(0,), (1,)], "t int"))
    nf = lab.groupBy("fold", "i", "t").agg(F.sum("n").alias("c"))
    nt = _oof(nf, ["i", "t"], folds)
    nt = classes.join(nt, ["fold", "i", "t"], "left").select("fold", "i", "t", F.coalesce("c", F.lit(0)).cast("double").alias("n"))
    lg = sum((F.log(F.col("n") + F.lit(float(r["nv"]))) for r in nvs), F.lit(0.0))
    ntot = nt.groupBy("fold", "i").agg(F.sum("n").alias("ntot"))
    kc = nt.join(ntot, ["fold", "i"]).select("fold", "i", "t", (F.log((F.col("n") + 1.0) / (F.col("ntot") + 2.0)) - lg).alias("kc"))
    const = kc.collect()  # folds x labels x 2
    karr = F.array(*[F.struct(F.lit(r["fold"]).alias("fold"), F.lit(r["i"]).alias("i"), F.lit(r["t"]).alias("t"),
                              F.lit(float(r["kc"])).alias("x")) for r in const])

    # independent scores of every held-out row: delta = s1 - s0 per (row, i)
    fl = x.select(idc, "fold", mlf.y_col, F.explode("fv").alias("p")).select(idc, "fold", mlf.y_col, F.col("p.f").alias("f"),
                                                                             F.col("p.v").alias("v"))
    m = fl.join(NB.maybe_broadcast(weights, n_w), ["fold", "f", "v"]).select(idc, "fold", mlf.y_col, "i", "t", F.col("w").alias("x"))
    base = x.select(idc, "fold", mlf.y_col, F.explode(F.filter(karr, lambda e: e["fold"] == F.col("fold"))).alias("e")).select(
        idc, "fold", mlf.y_col, F.col("e.i").alias("i"), F.col("e.t").alias("t"), F.col("e.x").alias("x"))
    s = m.unionByName(base).groupBy(idc, "fold", "i").agg(
        F.first(mlf.y_col).alias("y"),
        (F.sum(F.when(F.col("t") == 1, F.col("x"))) - F.sum(F.when(F.col("t") == 0, F.col("x")))).alias("delta"))
    s = s.withColumn("yi", F.get("y", F.col("i"))).filter(F.col("yi").isNotNull())
    s, _ = NB.materialize(s.join(x.select(idc, "n"), idc))

    acc1 = s.groupBy("fold", "i").agg(
        (F.lit(100.0) * F.sum(((F.col("delta") > 0).cast("int") == F.col("yi")).cast("int") * F.col("n")) / F.sum("n")).alias("acc"))

    # dependent: add ln P(y_j | t=1) - ln P(y_j | t=0) from out-of-fold label-pair counts
    sets = x.groupBy("fold", mlf.y_col).agg(F.sum("n").alias("count"))
    pa = sets.select("fold", "count", mlf.y_col, F.posexplode(mlf.y_col).alias("i", "t")).filter(F.col("t").isNotNull())
    pa = pa.select("fold", "count", "i", "t", F.posexplode(mlf.y_col).alias("j", "v")).filter(
        F.col("v").isNotNull() & (F.col("i") != F.col("j")))
    pc = pa.groupBy("fold", "i", "t", "j", "v").agg(F.sum("count").alias("c"))
    pgrid = classes.crossJoin(spark.range(L).select(F.col("id").cast("int").alias("j"))).crossJoin(
        spark.createDataFrame([(0,), (1,)], "v int")).filter(F.col("i") != F.col("j"))
    po = _oof(pc, ["i", "t", "j", "v"], folds)
    po = pgrid.join(po, ["fold", "i", "t", "j", "v"], "left").select("fold", "i", "t", "j", "v", F.coalesce("c", F.lit(0)).alias("c"))
    po = po.join(nt, ["fold", "i", "t"]).select("fold", "i", "t", "j", "v", F.log((F.col("c") + 1.0) / (F.col("n") + 2.0)).alias("lp"))
    g = po.groupBy("fold", "i", "j", "v").agg(
        (F.sum(F.when(F.col("t") == 1, F.col("lp"))) - F.sum(F.when(F.col("t") == 0, F.col("lp")))).alias("g"))
    g, n_g = NB.materialize(g)
    d = s.select("fold", "i", "yi", "delta", F.col("n").alias("m"), F.posexplode("y").alias("j", "v")).filter(F.col("j") != F.col("i"))
    d = d.join(NB.maybe_broadcast(g, n_g), ["fold", "i", "j", "v"], "left")
    pred = ((F.col("delta") + F.coalesce(F.col("g"), F.lit(0.0))) > 0).cast("int")
    acc2 = d.groupBy("fold", "i", "j").agg(
        (F.lit(100.0) * F.sum((pred == F.col("yi")).cast("int") * F.col("m")) / F.sum("m")).alias("acc"))
    return acc1, acc2


def conditional_dependence(mlf: MLFrame, k: int = 10, seed: int = 1) -> DataFrame:
    """(label, given, score) for every unordered label pair: the order with the larger t statistic
    (the first order on ties); sort by score descending for the reference's ranking."""
    acc1, acc2 = fold_accuracies(mlf, k, seed)
    a = acc2.join(acc1.withColumnRenamed("acc", "acc1"), ["fold", "i"]).select("i", "j", "acc1", F.col("acc").alias("acc2"))
    t = a.groupBy("i", "j").agg(F.avg("acc1").alias("a1"), F.avg("acc2").alias("a2"),
                                (F.var_pop(F.col("acc1") - F.col("acc2")) * F.count(F.lit(1))).alias("vd"),
                                F.count(F.lit(1)).alias("nf"))
    m = F.when(F.col("vd") < 1e-12, F.lit(0.0)).otherwise(F.sqrt(F.col("nf") * (F.col("nf") - 1) / F.col("vd")))
    t = t.select("i", "j", F.when(F.col("a1") - F.col("a2") > 1e-9, F.lit(-1.0))
                 .otherwise(F.abs(F.col("a1") - F.col("a2")) * m).alias("score"))
    fwd = t.filter(F.col("i") < F.col("j")).alias("f")
    rev = t.filter(F.col("i") > F.col("j")).alias("r")
    p = fwd.join(rev, (F.col("f.i") == F.col("r.j")) & (F.col("f.j") == F.col("r.i")))
    keep_f = F.col("f.score") >= F.col("r.score")
    return p.select(F.when(keep_f, F.col("f.i")).otherwise(F.col("r.i")).cast("int").alias("label"),
                    F.when(keep_f, F.col("f.j")).otherwise(F.col("r.j")).cast("int").alias("given"),
                    F.when(keep_f, F.col("f.score")).otherwise(F.col("r.score")).alias("score"))
