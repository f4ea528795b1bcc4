"""Thresholds chosen for any bipartition measure, per fold of out-of-fold scores.

Input is a prediction frame (id, fold, y, conf), as ``validate.out_of_fold`` gives it: every row scored by a model that
did not see it.  Scores become integer bins once (``bins`` to the unit), so that a cut means the same set of predictions in
any engine and equal scores meet.  Everything after that reads one of two count tables, which add up over any split of the
rows:

* score counts (fold, j, c, pos, neg): at most folds x labels x bins rows.  They serve measures of the pooled counts and of
  each label's counts.
* patterns (fold, y, c, n): distinct truth and score vectors.  They serve measures taken row by row.

A measure is a function of four counts (tp, fp, fn, tn), the level these are taken at and the value it should come near, so a user's own measure
needs one expression.  Best cuts are ``min`` aggregates over (distance, cut): the first minimum wins and no
window holds a label's rows.

Defined cases: a row with a missing label takes no part; a missing score or NaN lies below every cut; an empty frame
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polytag.functions import labelsets as LS
from polytag.functions.ordered import ordered_scan
from polytag.operators import evaluate as EV
from polytag.operators.nb import materialize

BINS = 1_000_000
COUNTS = ("tp", "fp", "fn", "tn")


@dataclass(frozen=True)
class Measure:
    """``value(tp, fp, fn, tn)`` taken over all cells ("pooled"), over each label's cells ("label") or over each row's
    cells ("row"); the last two are averaged.  A "label" measure lies on one side of ``ideal``."""

    name: str
    value: Callable[[Column, Column, Column, Column], Column]
    level: str
    ideal: float = 1.0

    def __post_init__(self):
        if self.level not in ("pooled", "label", "row"):
            raise ValueError(f"unknown level {self.level!r}")

    def of(self, *counts: Column | str) -> Column:
        return self.value(*[F.col(c) if isinstance(c, str) else c for c in counts])

    def distance(self, value: Column) -> Column:
        # sums of fractions differ in their last bits with the order of the rows; they must not decide a tie
        return F.round(F.abs(F.lit(self.ideal) - value), 12)


def _ratios() -> dict[str, Callable]:
    return {
        "precision": lambda a, b, c, d: EV.ir_precision(a, b, c),
        "recall": lambda a, b, c, d: EV.ir_recall(a, b, c),
        "specificity": lambda a, b, c, d: EV.ir_specificity(d, b, c),
        "fmeasure": lambda a, b, c, d: EV.ir_fmeasure(a, b, c),
    }


MEASURES: dict[str, Measure] = {
    m.name: m
    for m in (
        Measure("hamming_loss", lambda a, b, c, d: (b + c) / (a + b + c + d), "pooled", 0.0),
        *(Measure(f"{p}_{k}", f, lv) for p, lv in (("micro", "pooled"), ("macro", "label"), ("ex", "row")) for k, f in _ratios().items()),
        Measure("ex_accuracy", lambda a, b, c, d: F.when(a + b + c == 0, 1.0).otherwise(a / (a + b + c)), "row"),
        Measure("subset_accuracy", lambda a, b, c, d: (b + c == 0).cast("double"), "row"),
    )
}


def as_measure(measure: str | Measure) -> Measure:
    return measure if isinstance(measure, Measure) else MEASURES[measure]


def measured(pred: DataFrame, measures: Sequence[str | Measure], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., measure, value) of any measures of the predicted sets (``bip``) of complete rows: one scan of the rows serves all measures
    taken per row, one all others.  Without rows, no keys and no values."""
    found = [as_measure(m) for m in measures]
    x = EV.complete_rows(pred)

    def rows(df: DataFrame, of: list[Measure], at: Callable[[Measure], Column]) -> DataFrame:
        g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[at(m).cast("double").alias(f"m{i}") for i, m in enumerate(of)]).filter("_n > 0")
        return g.select(*keys, F.explode(F.array(*[F.struct(F.lit(m.name).alias("measure"), F.col(f"m{i}").alias("value")) for i, m in enumerate(of)])).alias("m")).select(*keys, "m.*")

    parts = []
    if per := [m for m in found if m.level == "row"]:
        counts = _row_counts("y", lambda b, j: b == 1, "bip")
        parts.append(rows(x.select(*keys, *[c.alias(n) for c, n in zip(counts, COUNTS, strict=True)]), per, lambda m: F.avg(m.of(*COUNTS))))
    if per := [m for m in found if m.level != "row"]:
        cells = x.select(*keys, F.posexplode(F.arrays_zip("y", "bip")).alias("j", "z"))
        hit = lambda t, b: F.sum(((F.col("z.y") == t) & (F.col("z.bip") == b)).cast("double"))
        n = cells.groupBy(*keys, "j").agg(*[hit(t, b).alias(c) for (t, b), c in zip(((1, 1), (0, 1), (1, 0), (0, 0)), COUNTS, strict=True)])
        parts.append(rows(n, per, lambda m: F.avg(m.of(*COUNTS)) if m.level == "label" else m.of(*[F.sum(c) for c in COUNTS])))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ count tables


def score_bins(conf: str | Column, bins: int = BINS) -> Column:
    """Scores in 0..1 as integer bins 0..bins; a missing score or NaN is bin -1."""
    return F.transform(conf, lambda v: F.coalesce(F.round(F.nanvl(v.cast("double"), F.lit(None)) * bins), F.lit(-1.0)).cast("long"))


def binned(pred: DataFrame, bins: int = BINS) -> DataFrame:
    """(fold, y, c): the complete rows with their scores as bins."""
    return EV.complete_rows(pred).select("fold", "y", score_bins("conf", bins).alias("c"))


def patterns(x: DataFrame) -> DataFrame:
    return x.groupBy("fold", "y", "c").agg(F.count(F.lit(1)).cast("double").alias("n"))


def score_counts(pat: DataFrame) -> DataFrame:
    z = pat.select("fold", "n", F.posexplode(F.arrays_zip("y", "c")).alias("j", "z"))
    t = F.col("z.y") == 1
    return z.groupBy("fold", F.col("j").cast("int").alias("j"), F.col("z.c").alias("c")).agg(
        F.sum(F.when(t, F.col("n")).otherwise(0.0)).alias("pos"), F.sum(F.when(t, 0.0).otherwise(F.col("n"))).alias("neg"))


def _row_counts(y: str, yes: Callable[[Column, Column], Column], c: str) -> list[Column]:
    """tp, fp, fn, tn of a row, where ``yes(bin, label)`` says whether a label is predicted."""
    hits = F.transform(F.arrays_zip(F.col(y).alias("t"), F.col(c).alias("b")), lambda z, j: F.when(yes(z["b"], j), 2).otherwise(0) + z["t"])
    return [F.aggregate(hits, F.lit(0.0), _counter(k)) for k in (3, 2, 1, 0)]


def _counter(k: int) -> Callable[[Column, Column], Column]:
    return lambda n, h: n + F.when(h == k, 1.0).otherwise(0.0)


# ------------------------------------------------------------------ one cut for all labels


def _on_grid(pat: DataFrame, measure: Measure, grid: Column) -> DataFrame:
    """(fold, k, cut, value) for each (k, cut) of ``grid``, an array column over the columns of ``pat``; positive: bin >= cut."""
    if measure.level == "row":
        x = pat.select("fold", "y", "c", "n", F.explode(grid).alias("g")).select("fold", "y", "c", "n", "g.*")
        v = measure.of(*_row_counts("y", lambda b, j: b >= F.col("cut"), "c"))
        return x.select("fold", "k", "cut", "n", v.alias("v")).groupBy("fold", "k", "cut").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("value"))
    x = pat.select("fold", "j", "c", "pos", "neg", F.explode(grid).alias("g")).select("fold", "j", "c", "pos", "neg", "g.*")
    up = F.col("c") >= F.col("cut")
    cells = x.groupBy("fold", "k", "cut", "j").agg(
        F.sum(F.when(up, F.col("pos")).otherwise(0.0)).alias("tp"), F.sum(F.when(up, F.col("neg")).otherwise(0.0)).alias("fp"),
        F.sum(F.when(up, 0.0).otherwise(F.col("pos"))).alias("fn"), F.sum(F.when(up, 0.0).otherwise(F.col("neg"))).alias("tn"))
    if measure.level == "label":
        return cells.groupBy("fold", "k", "cut").agg(F.avg(measure.of(*COUNTS)).alias("value"))
    return cells.groupBy("fold", "k", "cut").agg(*[F.sum(c).alias(c) for c in COUNTS]).select("fold", "k", "cut", measure.of(*COUNTS).alias("value"))


def _table(pat: DataFrame, measure: Measure) -> DataFrame:
    return pat if measure.level == "row" else score_counts(pat)


def _first_best(res: DataFrame, measure: Measure, keys: list[str]) -> DataFrame:
    one = F.min(F.struct(measure.distance(F.col("value")).alias("d"), "k", "cut"))
    return res.groupBy(*keys).agg(one.alias("b")).select(*keys, F.col("b.k").alias("best"))


def one_threshold(pred: DataFrame, measure: str | Measure, bins: int = BINS) -> DataFrame:
    """(stage, fold, k, threshold, value, chosen): per fold the cut for all labels whose measure comes nearest its ideal, first on
    0, 0.1, ..., 1, then on best - 0.05, ..., best + 0.05 in steps of 0.01 (first minimum wins).  ``bins`` is a multiple of 100."""
    if bins % 100:
        raise ValueError("bins must be a multiple of 100")
    m = as_measure(measure)
    tab, _ = materialize(_table(patterns(binned(pred, bins)), m))
    step = lambda of: F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.struct(k.alias("k"), of(k).cast("long").alias("cut")))
    s1, _ = materialize(_on_grid(tab, m, step(lambda k: k * (bins // 10))))
    best = _first_best(s1, m, ["fold"])  # one row a fold
    s2 = _on_grid(tab.join(F.broadcast(best), "fold"), m, step(lambda k: (10 * F.col("best") + k - 5) * (bins // 100)))
    res, _ = materialize(s1.select(F.lit(1).alias("stage"), "*").unionByName(s2.select(F.lit(2).alias("stage"), "*")))
    out = res.join(F.broadcast(_first_best(res, m, ["stage", "fold"])), ["stage", "fold"])
    return out.select("stage", "fold", "k", (F.col("cut") / bins).alias("threshold"), "value", (F.col("k") == F.col("best")).alias("chosen"))


def final_threshold(search: DataFrame) -> DataFrame:
    """(threshold): the mean of the folds' chosen cuts of the last stage."""
    return search.filter("chosen and stage = 2").agg(F.avg("threshold").alias("threshold"))


def rank_cut(pred: DataFrame, L: int, measure: str | Measure, bins: int = BINS) -> DataFrame:
    """(t, value, chosen): keep the t top-ranked labels, t = 0..L; ``value`` is the mean over folds, chosen the first t whose
    mean distance from the ideal is least.  Ties of a score go to the larger label index."""
    m = as_measure(measure)
    # the same search on the number of labels ranked below: rank <= t is L - rank >= L - t
    ranked = binned(pred, bins).withColumn("c", F.transform(LS.ranks("c"), lambda r: (F.lit(L) - r).cast("long")))
    tab = _table(patterns(ranked), m)
    grid = F.transform(F.sequence(F.lit(0), F.lit(L)), lambda k: F.struct(k.alias("k"), (F.lit(L) - k).cast("long").alias("cut")))
    res = _on_grid(tab, m, grid).groupBy("k").agg(F.avg("value").alias("value"), F.avg(m.distance(F.col("value"))).alias("d"))
    res, _ = materialize(res)
    best = res.agg(F.min(F.struct(F.round("d", 12).alias("d"), "k")).alias("b")).select(F.col("b.k").alias("best"))
    return res.join(F.broadcast(best)).select(F.col("k").cast("int").alias("t"), "value", (F.col("k") == F.col("best")).alias("chosen"))


# ------------------------------------------------------------------ one cut per label


def _cum(tab: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Per key and bin the sums of ``cols`` over the bins below (``<col>_lo``) and at or above (``<col>_hi``)."""
    s = ordered_scan(tab, keys, "c", None, {f"{c}_cum": ("sum", c) for c in cols})
    tot = tab.groupBy(*keys).agg(*[F.sum(c).alias(f"{c}_all") for c in cols])
    s = s.join(F.broadcast(tot), keys)  # one row a fold and label
    return s.select(*keys, "c", *[(F.col(f"{c}_cum") - F.col(c)).alias(f"{c}_lo") for c in cols],
                    *[(F.col(f"{c}_all") - F.col(f"{c}_cum") + F.col(c)).alias(f"{c}_hi") for c in cols])


def _candidates(sc: DataFrame) -> DataFrame:
    """(fold, j, c, tp, fp, fn, tn): a label's counts if its cut is its bin c."""
    s = _cum(sc, ["fold", "j"], ["pos", "neg"])
    return s.select("fold", "j", "c", F.col("pos_hi").alias("tp"), F.col("neg_hi").alias("fp"), F.col("pos_lo").alias("fn"), F.col("neg_lo").alias("tn"))


def _pick(x: DataFrame, measure: Measure, keys: list[str]) -> dict:
    """{key: (cut, counts)} of the first best candidate; ``value`` is the measure, one row a key returns."""
    extra = [c for c in COUNTS if c in x.columns]
    b = x.groupBy(*keys).agg(F.min(F.struct(measure.distance(F.col("value")).alias("d"), "c", *extra)).alias("b"))
    return {tuple(r[k] for k in keys): (r["b"]["c"], tuple(r["b"][c] for c in extra)) for r in b.collect()}


def label_thresholds(pred: DataFrame, L: int, measure: str | Measure, sweeps: int = 10, bins: int = BINS) -> DataFrame:
    """(fold, j, cut, threshold): one cut per label and fold by coordinate descent from 0.5: label by label, the cut (one of the label's scores)
    whose measure comes nearest its ideal while the other labels' cuts stand, first minimum; until a sweep
    moves no cut, or ``sweeps``.  ``threshold`` is the midpoint to the label's next lower score, ``cut`` the bin itself.

    All folds move together: a step is one aggregate that returns one row a fold.  A measure of each label's counts is
    independent by label and takes a single aggregate."""
    m = as_measure(measure)
    spark = pred.sparkSession
    pat, _ = materialize(patterns(binned(pred, bins)))
    sc, _ = materialize(score_counts(pat))
    if m.level == "label":
        x = _candidates(sc).withColumn("value", m.of(*COUNTS))
        cuts = {k: v[0] for k, v in _pick(x, m, ["fold", "j"]).items()}
    elif m.level == "pooled":
        cuts = _descend_pooled(spark, sc, m, L, sweeps, bins)
    else:
        cuts = _descend_rows(spark, pat, m, L, sweeps, bins)
    chosen = spark.createDataFrame([(f, j, c) for (f, j), c in cuts.items()], "fold int, j int, cut long")
    lower = sc.join(F.broadcast(chosen), ["fold", "j"]).filter("c < cut").groupBy("fold", "j").agg(F.max("c").alias("lower"))
    both = chosen.join(F.broadcast(lower), ["fold", "j"], "left")
    return both.select("fold", "j", "cut", ((F.col("cut") + F.coalesce("lower", "cut")) / (2.0 * bins)).alias("threshold"))


def _descend_pooled(spark, sc: DataFrame, m: Measure, L: int, sweeps: int, bins: int) -> dict:
    cands, _ = materialize(_candidates(sc))
    up = F.col("c") >= bins // 2
    start = sc.groupBy("fold", "j").agg(
        *[F.sum(F.when(up == hi, F.col(c)).otherwise(0.0)).alias(n) for n, c, hi in (("tp", "pos", True), ("fp", "neg", True), ("fn", "pos", False), ("tn", "neg", False))])
    state = {(r["fold"], r["j"]): tuple(r[c] for c in COUNTS) for r in start.collect()}  # folds x labels
    folds = sorted({f for f, _ in state})
    cuts: dict = {}
    for _ in range(sweeps if folds else 0):
        before = dict(cuts)
        for j in range(L):
            rest = [(f, *[sum(state[f, o][k] for o in range(L) if o != j) for k in range(4)]) for f in folds]
            others = spark.createDataFrame(rest, "fold int, " + ", ".join(f"o_{c} double" for c in COUNTS))
            x = cands.filter(F.col("j") == j).join(F.broadcast(others), "fold")
            x = x.withColumn("value", m.of(*[F.col(c) + F.col(f"o_{c}") for c in COUNTS]))
            for (f,), (cut, counts) in _pick(x, m, ["fold"]).items():
                cuts[f, j], state[f, j] = cut, counts
        if cuts == before:
            break
    return cuts


def _descend_rows(spark, pat: DataFrame, m: Measure, L: int, sweeps: int, bins: int) -> dict:
    """As above for a measure of rows: with the other cuts fixed, a pattern is worth one value if label j is predicted and another if
    not, so the value of every cut of j follows from running sums of the two over j's bins."""
    folds = sorted(r["fold"] for r in pat.select("fold").distinct().collect())
    total = {r["fold"]: r["n"] for r in pat.groupBy("fold").agg(F.sum("n").alias("n")).collect()}
    at = {(f, j): bins // 2 for f in folds for j in range(L)}
    cuts: dict = {}
    for _ in range(sweeps if folds else 0):
        before = dict(cuts)
        for j in range(L):
            now = spark.createDataFrame([(f, [at[f, o] for o in range(L)], total[f]) for f in folds], "fold int, at array<long>, total double")
            x = pat.join(F.broadcast(now), "fold")
            with_j = m.of(*_row_counts("y", lambda b, o, j=j: (o == j) | ((o != j) & (b >= F.get("at", o))), "c"))
            without = m.of(*_row_counts("y", lambda b, o, j=j: (o != j) & (b >= F.get("at", o)), "c"))
            x = x.select("fold", "n", "total", F.col("c")[j].alias("c"), with_j.alias("yes"), without.alias("no"))
            by_bin, _ = materialize(x.groupBy("fold", "c").agg(F.sum(F.col("n") * F.col("yes") / F.col("total")).alias("yes"), F.sum(F.col("n") * F.col("no") / F.col("total")).alias("no")))
            s = _cum(by_bin, ["fold"], ["yes", "no"]).withColumn("value", F.col("yes_hi") + F.col("no_lo"))
            for (f,), (cut, _c) in _pick(s, m, ["fold"]).items():
                cuts[f, j] = at[f, j] = cut
        if cuts == before:
            break
    return cuts


def mean_thresholds(cuts: DataFrame) -> DataFrame:
    """(j, threshold): each label's mean threshold over the folds."""
    return cuts.groupBy("j").agg(F.avg("threshold").alias("threshold"))


def apply_thresholds(pred: DataFrame, thresholds: list[float]) -> DataFrame:
    """``pred`` with bip: score >= its label's threshold."""
    th = F.array(*[F.lit(float(t)) for t in thresholds])
    return pred.withColumn("bip", F.transform("conf", lambda v, j: F.coalesce(F.nanvl(v, F.lit(-1.0)) >= F.get(th, j), F.lit(False)).cast("int")))
