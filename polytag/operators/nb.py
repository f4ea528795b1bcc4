"""Count-based naive Bayes over categorical features — the default base learner.

A model is two small tables of counts turned into log weights, keyed by the
model key (label j, label pair (a, b), chain link, ...), so *all* models of a
multi-label learner are fitted by one ``groupBy`` over the exploded rows:

    P(v | t) = (c(f, v, t) + 1) / (n_t + V_f)      V_f = distinct values of feature f
    P(t)     = (n_t + 1) / (n + K)                  K = number of classes of the key

score(t) = ln P(t) - sum_f ln(n_t + V_f) + sum_f ln(c(f, v_f, t) + 1); only the
(f, v, t) cells with c > 0 are stored, so scoring is a join of the row's
(f, v) pairs with the weight table plus one constant per (key, t).

Fitted tables are checkpointed (reliable checkpoint in the shared folder) so
scoring never re-runs training; the weight table is broadcast only when its
counted size is below ``BROADCAST_ROWS``, else it is joined by shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polytag.session import ensure_checkpoint_dir

BROADCAST_ROWS = 2_000_000


def materialize(df: DataFrame) -> tuple[DataFrame, int]:
    """Reliable checkpoint (cuts lineage, survives executor loss) and row count."""
    ensure_checkpoint_dir(df.sparkSession)
    cp = df.checkpoint(eager=True)
    return cp, cp.count()


def maybe_broadcast(df: DataFrame, n_rows: int) -> DataFrame:
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def feature_pairs(features) -> F.Column:
    """ARRAY<STRUCT<f, v>> of a row's categorical feature values (NULL values are skipped)."""
    arr = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in features])
    return F.filter(arr, lambda s: s["v"].isNotNull())


@dataclass
class NBModel:
    keys: list[str]
    features: list[str]
    weights: DataFrame  # (*keys, f, v, t, w)
    n_weights: int
    const: list  # dicts (*keys, t, kc)

    def const_array(self) -> F.Column:
        return F.array(*[
            F.struct(*[F.lit(r[k]).alias(k) for k in self.keys], F.lit(r["t"]).alias("t"), F.lit(float(r["kc"])).alias("kc"))
            for r in self.const
        ])


NCOUNT = "__n"


def fit_nb(rows: DataFrame, keys: list[str], features: list[str], classes: DataFrame | None = None,
           weight: str | None = None, pairs: str | None = None) -> NBModel:
    """Fit every model of ``rows`` at once.  ``rows`` has the key columns, a class column ``t``,
    the feature columns (or a ready ``pairs`` column of STRUCT<f, v>) and optionally a weight.
    ``classes`` (keys..., t) lists the classes of each key (default: the classes seen).

    The rows are read once: one aggregation (partial + final) counts every (key, f, v, t) cell,
    plus a pseudo-feature that counts the class sizes; the count table is checkpointed and every
    other statistic (class sizes, distinct values per feature, features per key) comes from it."""
    if not keys:  # a single model: key it by a constant so every step stays an equi-join
        keys = ["_m"]
        rows = rows.withColumn("_m", F.lit(0))
        classes = classes.withColumn("_m", F.lit(0)) if classes is not None else None
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    fv = F.col(pairs) if pairs else feature_pairs(features)
    fv = F.concat(fv, F.array(F.struct(F.lit(NCOUNT).alias("f"), F.lit("").alias("v"))))
    fl = rows.select(*keys, "t", w.alias("_w"), F.explode(fv).alias("p")).select(*keys, "t", "_w", "p.f", "p.v")
    cnt, _ = materialize(fl.groupBy(*keys, "f", "v", "t").agg(F.sum("_w").alias("c")))
    feat = cnt.filter(F.col("f") != NCOUNT)
    nt = cnt.filter(F.col("f") == NCOUNT).select(*keys, "t", F.col("c").alias("n"))
    if classes is not None:
        nt = classes.join(nt, [*keys, "t"], "left").select(*keys, "t", F.coalesce("n", F.lit(0.0)).alias("n"))
    vf = feat.groupBy("f").agg(F.countDistinct("v").alias("nv"))
    fk = feat.select(*keys, "f").distinct().join(F.broadcast(vf), "f")
    g = nt.join(fk, keys, "left")
    logs = g.groupBy(*keys, "t", "n").agg(F.sum(F.log(F.col("n") + F.col("nv"))).alias("lg"))
    tot = nt.groupBy(*keys).agg(F.sum("n").alias("n_tot"), F.count(F.lit(1)).alias("n_cls"))
    kk = logs.join(tot, keys)
    const_df = kk.select(*keys, "t", (F.log((F.col("n") + 1.0) / (F.col("n_tot") + F.col("n_cls"))) - F.coalesce("lg", F.lit(0.0))).alias("kc"))
    const = [r.asDict() for r in const_df.collect()]  # model-sized: keys x classes
    weights, n_w = materialize(feat.select(*keys, "f", "v", "t", F.log(F.col("c") + 1.0).alias("w")))
    return NBModel(list(keys), list(features), weights, n_w, const)


def nb_scores(model: NBModel, df: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, *keys, t, s): log score of every class of every model key for every row of ``df``."""
    fl = df.select(id_col, F.explode(feature_pairs(model.features)).alias("p")).select(id_col, "p.f", "p.v")
    m = fl.join(maybe_broadcast(model.weights, model.n_weights), ["f", "v"]).select(id_col, *model.keys, "t", F.col("w").alias("x"))
    base = df.select(id_col, F.explode(model.const_array()).alias("c")).select(
        id_col, *[F.col(f"c.{k}").alias(k) for k in model.keys], F.col("c.t").alias("t"), F.col("c.kc").alias("x"))
    return m.unionByName(base).groupBy(id_col, *model.keys, "t").agg(F.sum("x").alias("s"))


def feature_key(features) -> F.Column:
    """A null-safe string key of a row's feature values (rows with equal features score equally)."""
    return F.to_json(F.struct(*[F.col(f) for f in features]))


def nb_binary_scores(model: NBModel, df: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, *keys, s0, s1, p1): scores and probability of class 1 for every binary model key.

    Scores depend only on the feature values, so every *distinct* feature tuple is scored once
    (explode, weight join and one grouped sum over tuples instead of rows); the scored tuple table
    is checkpointed and joined back to the rows, broadcast only when its counted size is under
    ``BROADCAST_ROWS``."""
    tup = df.select(feature_key(model.features).alias("__nbk"), *model.features).dropDuplicates(["__nbk"])
    fl = tup.select("__nbk", F.explode(feature_pairs(model.features)).alias("p")).select("__nbk", "p.f", "p.v")
    m = fl.join(maybe_broadcast(model.weights, model.n_weights), ["f", "v"]).select("__nbk", *model.keys, "t", F.col("w").alias("x"))
    base = tup.select("__nbk", F.explode(model.const_array()).alias("c")).select(
        "__nbk", *[F.col(f"c.{k}").alias(k) for k in model.keys], F.col("c.t").alias("t"), F.col("c.kc").alias("x"))
    g = m.unionByName(base).groupBy("__nbk", *model.keys).agg(
        F.sum(F.when(F.col("t") == 1, F.col("x"))).alias("s1"), F.sum(F.when(F.col("t") == 0, F.col("x"))).alias("s0"))
    g, n = materialize(g.select("__nbk", *model.keys, "s0", "s1",
                                (F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("s0") - F.col("s1")))).alias("p1")))
    rows = df.select(id_col, feature_key(model.features).alias("__nbk"))
    return rows.join(maybe_broadcast(g, n), "__nbk").drop("__nbk")
