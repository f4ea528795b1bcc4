"""Cross-validated parameter sweeps of the neighbour learners: (learner, k, fold) is one key of one prediction table.

Every row's ``max(ks)`` nearest rows are searched once in each fold.  The neighbours a model of fold f uses (the rows outside f) are the best
of the other folds' lists, and those for a smaller k are a prefix, so all folds and all k share the searches; fits and
predictions are then counts keyed by (fold, k).  Distances are scaled by the ranges of all rows.

Learners: ``mlknn`` (label priors and neighbour-count likelihoods with ``s`` added) and ``brknn`` (vote shares, cut at 1/2).

Defined cases: a row without a vector or with a missing label takes no part; with fewer rows than k a row has fewer neighbours, and
votes among those it has; without training rows scores are 1/2 (``mlknn``) or 1 over the labels (``brknn``); an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polytag.frame import MLFrame
from polytag.functions import labelsets as LS
from polytag.operators import curves as CV
from polytag.operators import evaluate as EV
from polytag.operators import knn as KN
from polytag.operators import nb as NB
from polytag.operators import validate as VA

LEARNERS = ("mlknn", "brknn")
PREDICTION = "id long, fold int, learner string, k int, y array<int>, conf array<double>, bip array<int>"


def fold_neighbours(rows: DataFrame, vec: str, kmax: int, folds: int) -> DataFrame:
    """(fold, qid, rank, rid): each row's ``kmax`` nearest rows outside ``fold``, itself left out, for every fold.  ``rows``: id, fold, ``vec``."""
    ranges = KN.vector_ranges(rows, vec)
    out = None
    for g in range(folds):
        # a row's own fold is searched too: the models of other folds train on it
        nb = KN.knn(rows, rows.filter(F.col("fold") == g), kmax, vec, ranges=ranges).select("qid", "rid", "dist", F.lit(g).alias("grp"))
        out = nb if out is None else out.unionByName(nb)
    found, _ = NB.materialize(out)
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("grp"))
    x = found.select("qid", "rid", "dist", F.explode(others).alias("fold"))
    w = Window.partitionBy("fold", "qid").orderBy("dist", "rid")  # at most kmax x folds rows
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= kmax).select("fold", "qid", "rank", "rid")


def _votes(nb: DataFrame, rows: DataFrame, L: int, ks: Sequence[int], folds: int) -> DataFrame:
    """(fold, k, id, own, y, cnt, have): per row and k the neighbours with each label, and how many neighbours there are."""
    prefixes = F.explode(F.filter(F.array(*[F.lit(int(k)) for k in ks]), lambda k: k >= F.col("rank"))).alias("k")
    x = nb.join(rows.select(F.col("id").alias("rid"), F.col("y").alias("ny")), "rid").select("fold", "qid", "ny", prefixes)
    cnt = F.array(*[F.sum(F.get("ny", F.lit(j))) for j in range(L)])
    g = x.groupBy("fold", "k", "qid").agg(cnt.alias("cnt"), F.count(F.lit(1)).alias("have"))
    every = rows.select(F.col("id").alias("qid"), F.col("fold").alias("own"), "y").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")).select("*", F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"))
    none = F.array(*[F.lit(0).cast("long")] * L)
    x = every.join(g, ["fold", "k", "qid"], "left")  # a row may have no neighbour outside a fold
    return x.select("fold", "k", F.col("qid").alias("id"), "own", "y", F.coalesce("cnt", none).alias("cnt"), F.coalesce("have", F.lit(0)).alias("have"))


def _arrays(x: DataFrame, learner: str) -> DataFrame:
    """(id, fold, j, k, y, conf, b) rows to one row per (id, k) with label arrays."""
    g = x.groupBy("id", "fold", "k").agg(F.array_sort(F.collect_list(F.struct("j", "conf", "b"))).alias("a"), F.first("y").alias("y"))  # L entries
    return g.select("id", "fold", F.lit(learner).alias("learner"), "k", "y", F.col("a.conf").alias("conf"), F.col("a.b").alias("bip"))


def _mlknn(votes: DataFrame, rows: DataFrame, L: int, folds: int, s: float) -> DataFrame:
    cells = votes.select("fold", "k", "own", "id", "y", F.posexplode(F.arrays_zip("cnt", "y")).alias("j", "z")).select(
        "fold", "k", "own", "id", "j", F.col("z.cnt").alias("d"), F.col("z.y").alias("t"), F.when(F.col("fold") == F.col("own"), F.col("y")).alias("y"))
    one, zero = F.sum((F.col("t") == 1).cast("double")), F.sum((F.col("t") == 0).cast("double"))
    h, n = NB.materialize(cells.filter("fold <> own").groupBy("fold", "k", "j", "d").agg(one.alias("c1"), zero.alias("c0")))
    every = h.groupBy("fold", "k", "j").agg(F.sum("c1").alias("all1"), F.sum("c0").alias("all0"))
    seen = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.get("y", F.lit(j))) for j in range(L)]).alias("c"))
    other = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))).alias("f")
    prior = seen.select("n", "c", other).select("n", "f", F.posexplode("c").alias("j", "c"))
    prior = prior.groupBy(F.col("f").alias("fold"), "j").agg(((F.lit(s) + F.sum("c")) / (F.lit(2 * s) + F.sum("n"))).alias("prior"))
    x = cells.filter("fold = own").join(NB.maybe_broadcast(h, n), ["fold", "k", "j", "d"], "left")
    x = x.join(NB.maybe_broadcast(every, n), ["fold", "k", "j"], "left").join(NB.maybe_broadcast(prior, n), ["fold", "j"], "left")

    def share(c: str, total: str) -> Column:
        return (F.lit(s) + F.coalesce(c, F.lit(0.0))) / (F.lit(s) * (F.col("k") + 1) + F.coalesce(total, F.lit(0.0)))

    prior = F.coalesce("prior", F.lit(0.5))
    pin, pout = prior * share("c1", "all1"), (1 - prior) * share("c0", "all0")
    return _arrays(x.select("id", "fold", "k", "j", "y", (pin / (pin + pout)).alias("conf"), (pin >= pout).cast("int").alias("b")), "mlknn")


def _brknn(votes: DataFrame, rows: DataFrame, L: int) -> DataFrame:
    n = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    train = n.select("fold", (F.lit(rows.count()) - F.col("n")).cast("double").alias("n"))  # one row per fold
    x = votes.filter("fold = own").join(F.broadcast(train), "fold")
    conf = F.transform("cnt", lambda c: F.when(F.col("n") == 0, 1.0 / L).otherwise(
        (F.try_divide(F.lit(1.0), "n") + c) / (F.try_divide(F.lit(float(L)), "n") + F.col("have"))))
    return x.select("id", "fold", F.lit("brknn").alias("learner"), "k", "y", conf.alias("conf")).withColumn("bip", LS.bipartition("conf", 0.5))


def neighbour_sweep(mlf: MLFrame, vec: str, ks: Sequence[int] = (8, 9, 10, 11, 12), learners: Sequence[str] = LEARNERS, folds: int = 5,
                    seed: int = 1, s: float = 1.0) -> DataFrame:
    """(id, fold, learner, k, y, conf, bip): every row predicted by the models that did not see it, for every learner and k."""
    if set(learners) - set(LEARNERS):
        raise ValueError(f"learners are {LEARNERS}")
    fold = F.pmod(LS.stable_hash(mlf.id_col, seed), F.lit(folds)).cast("int")
    x = EV.complete_rows(mlf.df.filter(F.col(vec).isNotNull()), mlf.y_col)
    rows, n = NB.materialize(x.select(F.col(mlf.id_col).alias("id"), fold.alias("fold"), F.col(mlf.y_col).alias("y"), vec))
    if not n:
        return rows.sparkSession.createDataFrame([], PREDICTION)
    votes, _ = NB.materialize(_votes(fold_neighbours(rows, vec, max(ks), folds), rows, mlf.L, ks, folds))
    slim = rows.drop(vec)
    made = {"mlknn": lambda: _mlknn(votes, slim, mlf.L, folds, s), "brknn": lambda: _brknn(votes, slim, mlf.L)}
    out = None
    for learner in learners:
        p = made[learner]()
        out = p if out is None else out.unionByName(p)
    return out


def sweep_measures(pred: DataFrame, levels: int = 10) -> DataFrame:
    """(learner, k, measure, mean, sd) over the folds, of all set, ranking and curve measures, for every key at once."""
    pred, _ = NB.materialize(pred)
    sets = VA.fold_measures(pred.select("id", F.struct("learner", "k", "fold").alias("fold"), "y", "conf", "bip"))
    keys = ["learner", "k", "fold"]
    curves = CV.curve_measures(NB.materialize(CV.score_counts(pred, keys, VA.CURVE_BINS))[0], keys, levels)
    m = sets.select("fold.learner", "fold.k", "fold.fold", "measure", "value").unionByName(curves.select(*keys, "measure", "value"))
    return m.groupBy("learner", "k", "measure").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
