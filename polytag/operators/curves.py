"""Ranking curves of labels (average precision, interpolated precision, ROC area) from counts of positives and negatives per score.

The count table (keys..., j, c, pos, neg) has one row per distinct score of a label and adds up over any split of the rows: folds,
partitions, micro-batches (``merged``).  Rows of one score enter a curve together, so no order of the rows decides a tie.  With
``bins`` scores become integers first, which bounds the table by keys x labels x bins and makes equal scores meet in any engine; without,
the curves are exact on the distinct scores.

Running counts come from ``ordered_scan``, so a label's scores are spread over tasks; each measure is then a grouped sum or maximum.

Defined cases: a row with a missing label takes no part; a missing score or NaN lies below every other; a label without positives
has no average precision, one without positives or negatives no area (NULL); an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polytag.functions.ordered import ordered_scan
from polytag.operators import evaluate as EV

CURVES = ("ap", "iap", "auc")
MEANS = ("map", "gmap", "miap", "gmiap", "macro_auc", "micro_auc")


def score_cells(pred: DataFrame, keys: Sequence[str] = (), bins: int | None = None) -> DataFrame:
    """(keys..., j, c, t) of complete rows, one row per label: a projection, so it also runs on a stream."""
    z = EV.complete_rows(pred).select(*keys, F.posexplode(F.arrays_zip("y", "conf")).alias("j", "z"))
    score = F.nanvl(F.col("z.conf").cast("double"), F.lit(None).cast("double"))
    c = F.coalesce(score, F.lit(-math.inf)) if bins is None else F.coalesce(F.round(score * bins), F.lit(-1.0))
    return z.select(*keys, F.col("j").cast("int").alias("j"), c.alias("c"), F.col("z.y").alias("t"))


def score_counts(pred: DataFrame, keys: Sequence[str] = (), bins: int | None = None) -> DataFrame:
    """(keys..., j, c, pos, neg) per distinct score."""
    t = F.col("t").cast("double")
    return score_cells(pred, keys, bins).groupBy(*keys, "j", "c").agg(F.sum(t).alias("pos"), F.sum(1.0 - t).alias("neg"))


def merged(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of several parts (unioned, or over keys that are given up) as one table."""
    return counts.groupBy(*keys, "j", "c").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _scanned(counts: DataFrame, part: list[str]) -> DataFrame:
    """Adds hits and miss (positives and negatives at or above the score) and P and N (all of them)."""
    s = ordered_scan(counts, part, "c", None, {"hits": ("sum", "pos"), "miss": ("sum", "neg")}, score_desc=True)
    tot = [F.sum("pos").alias("P"), F.sum("neg").alias("N")]
    if not part:
        return s.join(F.broadcast(counts.agg(*tot)))  # one row
    return s.join(counts.groupBy(*part).agg(*tot), part)


def _area() -> Column:
    below = F.col("N") - F.col("miss") + F.col("neg") * 0.5
    pairs = F.first("P") * F.first("N")
    return F.when(pairs > 0, F.sum(F.col("pos") * below) / pairs)


def label_curves(counts: DataFrame, keys: Sequence[str] = (), levels: int = 10) -> DataFrame:
    """(keys..., j, positives, ap, iap, auc).  ap: precision at each score weighted by its positives; iap: mean over ``levels``
    recalls 0, ..., 1 of the best precision at that recall or a higher one; auc: share of (positive, negative) pairs in order,
    pairs of one score counting half."""
    s = _scanned(counts, [*keys, "j"]).withColumn("prec", F.col("hits") / (F.col("hits") + F.col("miss")))
    best = [F.max(F.when(F.col("hits") * (levels - 1) >= i * F.col("P"), F.col("prec"))) for i in range(levels)]
    some = F.first("P") > 0
    return s.groupBy(*keys, "j").agg(
        F.first("P").alias("positives"), F.when(some, F.sum(F.col("pos") * F.col("prec")) / F.first("P")).alias("ap"),
        F.when(some, sum(best[1:], best[0]) / levels).alias("iap"), _area().alias("auc"))


def pooled_area(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., micro_auc): the area over all labels' cells together."""
    x = counts.groupBy(*keys, "c").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return _scanned(x, list(keys)).groupBy(*keys).agg(_area().alias("micro_auc"))


def curve_measures(counts: DataFrame, keys: Sequence[str] = (), levels: int = 10) -> DataFrame:
    """(keys..., measure, value): arithmetic and geometric means of ap and iap over the labels, and both areas.  A geometric mean with
    an undefined label is NaN, the other means leave that label out."""
    def geo(c: str) -> Column:
        undefined = F.count(F.when(F.col(c).isNull(), 1)) > 0
        return F.when(undefined, F.lit(math.nan)).when(F.min(c) == 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.log(c))))

    per = label_curves(counts, keys, levels).groupBy(*keys).agg(
        F.avg("ap").alias("map"), geo("ap").alias("gmap"), F.avg("iap").alias("miap"), geo("iap").alias("gmiap"), F.avg("auc").alias("macro_auc"))
    return _melted(per, keys, MEANS[:-1]).unionByName(_melted(pooled_area(counts, keys), keys, MEANS[-1:]))


def _melted(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in names])
    return df.select(*keys, F.explode(cells).alias("m")).select(*keys, "m.measure", "m.value")


def label_measures(pred: DataFrame, counts: DataFrame, keys: Sequence[str] = (), levels: int = 10) -> DataFrame:
    """(keys..., j, measure, value): precision, recall, fmeasure and specificity of each label's predicted sets, and its curves."""
    cells = EV.complete_rows(pred).select(*keys, F.posexplode(F.arrays_zip("y", "bip")).alias("j", "z")).select(*keys, F.col("j").cast("int").alias("j"), "z.y", "z.bip")
    hit = lambda t, b: F.sum(((F.col("y") == t) & (F.col("bip") == b)).cast("double"))
    n = cells.groupBy(*keys, "j").agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    sets = n.select(*keys, "j", EV.ir_precision(tp, fp, fn).alias("precision"), EV.ir_recall(tp, fp, fn).alias("recall"),
                    EV.ir_fmeasure(tp, fp, fn).alias("fmeasure"), EV.ir_specificity(tn, fp, fn).alias("specificity"))
    at = [*keys, "j"]
    return _melted(sets, at, ("precision", "recall", "fmeasure", "specificity")).unionByName(_melted(label_curves(counts, keys, levels), at, CURVES))
