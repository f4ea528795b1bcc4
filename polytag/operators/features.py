"""Feature ranking and selection.

Every (label, feature, value, class) count comes from one aggregation over the
exploded rows (partial + final), so all features are scored against all labels
in one shuffle; the count table is feature x value x label sized.  Scores use
log base 2 (information gain; gain ratio = gain / split information).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polytag.frame import MLFrame
from polytag.functions import labelsets as LS
from polytag.operators.nb import feature_pairs


def _xlogx(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))


def scores_from_rows(rows: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys..., feature, info_gain, gain_ratio) from rows (keys..., t, _fv ARRAY<STRUCT<f, v>>)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    fl = rows.select(*keys, "t", w.alias("_w"), F.explode("_fv").alias("p")).select(*keys, "t", "_w", "p.f", "p.v")
    c = fl.groupBy(*keys, "f", "v", "t").agg(F.sum("_w").alias("n"))
    fv = c.groupBy(*keys, "f", "v").agg(F.sum("n").alias("nfv"))
    ft = c.groupBy(*keys, "f", "t").agg(F.sum("n").alias("nft"))
    tot = c.groupBy(*keys, "f").agg(F.sum("n").alias("N"))
    # H(Y) per (key, feature) over the rows where the feature is present
    hy = ft.join(tot, [*keys, "f"]).groupBy(*keys, "f").agg(
        (-F.sum(_xlogx(F.col("nft") / F.col("N")))).alias("hy"), F.first("N").alias("N"))
    cond = c.join(fv, [*keys, "f", "v"]).groupBy(*keys, "f", "v").agg(
        (-F.sum(_xlogx(F.col("n") / F.col("nfv")))).alias("hv"), F.first("nfv").alias("nfv"))
    hyx = cond.join(tot, [*keys, "f"]).groupBy(*keys, "f").agg(
        F.sum(F.col("nfv") / F.col("N") * F.col("hv")).alias("hyx"), (-F.sum(_xlogx(F.col("nfv") / F.col("N")))).alias("hx"))
    out = hy.join(hyx, [*keys, "f"])
    ig = F.col("hy") - F.col("hyx")
    return out.select(*keys, F.col("f").alias("feature"), ig.alias("info_gain"),
                      F.when(F.col("hx") > 0, ig / F.col("hx")).otherwise(F.lit(0.0)).alias("gain_ratio"))


def score_per_label(mlf: MLFrame, train: DataFrame | None = None) -> DataFrame:
    """(j, feature, info_gain, gain_ratio): every feature against every label (binary relevance)."""
    train = mlf.df if train is None else train
    rows = train.select(feature_pairs(mlf.features).alias("_fv"), F.posexplode(mlf.y_col).alias("j", "t")).filter(F.col("t").isNotNull())
    return scores_from_rows(rows.withColumn("j", F.col("j").cast("int")), ["j"])


def score_powerset(mlf: MLFrame) -> DataFrame:
    """(feature, info_gain, gain_ratio) against the label-set class."""
    rows = mlf.df.filter(~F.exists(mlf.y_col, lambda v: v.isNull())).select(
        feature_pairs(mlf.features).alias("_fv"), LS.bits(mlf.y_col).alias("t"), F.lit(0).alias("_m"))
    return scores_from_rows(rows, ["_m"]).drop("_m")


def score_multiclass(mlf: MLFrame, kind: str = "copy") -> DataFrame:
    """(feature, info_gain, gain_ratio) after a multi-class transformation (copy, copy_weight, ...)."""
    from polytag.operators import transform as TR

    if kind == "copy_weight":
        x, w = TR.copy(mlf, weighted=True), "weight"
    elif kind == "ignore":
        x, w = TR.ignore(mlf), None
    elif kind in ("select_max", "select_min"):
        x, w = TR.select_by_frequency(mlf, most=kind == "select_max"), None
    elif kind == "select_random":
        x, w = TR.select_random(mlf), None
    elif kind == "copy":
        x, w = TR.copy(mlf), None
    else:
        raise ValueError(f"unknown multi-class transformation {kind!r}")
    rows = x.select(feature_pairs(mlf.features).alias("_fv"), F.col("j").alias("t"), F.lit(0).alias("_m"),
                    *([F.col(w)] if w else []))
    return scores_from_rows(rows, ["_m"], w).drop("_m")


def normalise(scores: DataFrame, col: str, mode: str = "dl") -> DataFrame:
    """Per label: 'dl' divides by the L2 norm of the label's scores, 'dm' by their maximum, 'none' keeps them."""
    if mode == "none":
        return scores.withColumn("score", F.col(col))
    w = Window.partitionBy("j")
    den = F.sqrt(F.sum(F.col(col) * F.col(col)).over(w)) if mode == "dl" else F.max(col).over(w)
    return scores.withColumn("score", F.when(den != 0, F.col(col) / den).otherwise(F.col(col)))


def rank_scores(scores: DataFrame, col: str, n_features: int) -> DataFrame:
    """Rank mode: per label, rank features by score desc (ties: feature name desc) and score F - rank."""
    w = Window.partitionBy("j").orderBy(F.col(col).desc(), F.col("feature").desc())
    return scores.withColumn("score", (F.lit(n_features) - F.row_number().over(w)).cast("double"))


def combine(scores: DataFrame, how: str = "avg", col: str = "score") -> DataFrame:
    """(feature, score) combined over labels with max / min / avg."""
    fn = {"max": F.max, "min": F.min, "avg": F.avg}[how]
    return scores.groupBy("feature").agg(fn(col).alias("score"))


def ranker(scores: DataFrame) -> DataFrame:
    """(rank, feature, score): features by score desc, ties by name."""
    w = Window.orderBy(F.col("score").desc(), F.col("feature"))  # feature-sized
    return scores.withColumn("rank", F.row_number().over(w))


def top_k(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.filter(F.col("rank") <= k).select("feature")


def by_threshold(ranked: DataFrame, t: float) -> DataFrame:
    return ranked.filter(F.col("score") >= t).select("feature")


def top_percent(ranked: DataFrame, pct: float) -> DataFrame:
    n = ranked.count()
    keep = int(round(n * pct / 100.0))
    return ranked.filter(F.col("rank") <= keep).select("feature")


def apply(mlf: MLFrame, chosen: list[str]) -> MLFrame:
    """Keep the chosen features (and id, labels)."""
    keep = [f for f in mlf.features if f in chosen]
    return mlf.with_df(mlf.df.select(mlf.id_col, *keep, mlf.y_col), features=tuple(keep))
