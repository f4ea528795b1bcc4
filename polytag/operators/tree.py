"""Decision trees as a base learner: the trees of *all* model keys (labels, chain links, ...) grow together.

Growth is level by level.  A level is one ``groupBy`` over the rows still in open nodes: the weights of all rows and of class 1
per (key, node, feature, value), with a pseudo-feature for the node itself, combined before the shuffle.  From these
model-sized cells every split is scored and the best one of a node chosen; the rows step to its children by one join with the split table
(broadcast only under its counted size).  So the number of jobs depends on the depth alone, never on the number of labels, and nothing
but counts and the split tables is compared.  A level's tables are reliable checkpoints.

Splits: a categorical feature opens one child per value (a missing value is a value of its own); a numeric feature is binned at given edges and
cut in two at the best edge.  ``gain`` takes the greatest information gain, ``gain_ratio`` the greatest gain per split information
among splits of at least average gain.  A split needs two children of ``min_leaf`` weight; equal scores (to ten places) go to the earlier feature, then the lower cut.  A
split without gain is allowed (``min_gain`` = 0), since a parity of two features shows no gain at its first step.  With ``prune`` a node whose own training
errors (plus 1/2) are at most its leaves' (plus 1/2 each) becomes a leaf.

A tree is one array of nodes; a prediction walks it inside one expression, ``depth`` steps of array and map lookups, and stops at the
last node it can reach (a value never seen there has no child).  Probabilities are (n1 + 1) / (n + 2) of that node.  A key without training rows
predicts 1/2.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polytag.operators import nb as NB

#: a forest of at most so many nodes is sent to every task as one row; a larger one is joined key by key
FOREST_NODES = 1_000_000


@dataclass(frozen=True)
class TreeBase:
    """Parameters of the base learner; ``numeric`` gives the bin edges of numeric features (others are categorical)."""

    depth: int = 6
    min_leaf: float = 2.0
    criterion: str = "gain_ratio"
    min_gain: float = 0.0
    prune: bool = False
    numeric: Mapping[str, Sequence[float]] = field(default_factory=dict)

    def values(self, features: Sequence[str]) -> Column:
        """A row's feature values as strings, in the order of ``features`` ('' is missing)."""
        return F.array(*(self._value(f) for f in features))

    def _value(self, f: str) -> Column:
        if f in self.numeric and not len(self.numeric[f]):
            return F.lit("0")
        if f not in self.numeric:
            return F.coalesce(F.concat(F.lit("="), F.col(f).cast("string")), F.lit(""))
        edges = F.array(*(F.lit(float(e)) for e in self.numeric[f]))
        x = F.col(f).cast("double")
        bin_ = F.size(F.filter(edges, lambda e: e < x)).cast("string")
        return F.when(x.isNull() | F.isnan(x), F.lit("")).otherwise(bin_)

    def fit(self, rows: DataFrame, keys: list[str], features: list[str], all_keys: DataFrame, more: int = 0) -> TreeModel:
        """``rows``: keys, t (0/1), _w, _vals (values of ``features`` and ``more`` further ones); ``all_keys``: every key."""
        return fit_trees(self, rows, keys, features, all_keys, more)


@dataclass
class TreeModel:
    base: TreeBase
    keys: list[str]
    features: list[str]
    trees: DataFrame  # (*keys, tree ARRAY<STRUCT<f, b, n, n1, kids MAP<STRING, INT>>>), one row per key, checkpointed
    n_nodes: int
    all_keys: list[dict]

    def leaf(self, tree: Column, vals: Column) -> Column:
        """The last node of ``tree`` that a row with these values reaches."""

        def step(i: Column, _: Column) -> Column:
            node = F.get(tree, i)
            v = F.get(vals, node["f"])
            side = F.when(v.try_cast("int") > node["b"], F.lit("1")).otherwise(F.lit("0"))
            return F.coalesce(F.try_element_at(node["kids"], F.when(node["b"] >= 0, side).otherwise(v)), i)

        return F.get(tree, F.aggregate(F.sequence(F.lit(1), F.lit(self.base.depth)), F.lit(0), step))

    def binary_scores(self, df: DataFrame, id_col: str = "id") -> DataFrame:
        """(id, *keys, s0, s1, p1) for every row and key; each distinct feature tuple is scored once."""
        fk = NB.feature_key(self.features)
        tuples = df.select(fk.alias("_fk"), *self.features).dropDuplicates(["_fk"])
        tuples = tuples.select("_fk", self.base.values(self.features).alias("_vals"))
        # one literal, whatever the number of keys
        kind = self.trees.select(F.array(F.struct(*self.keys)).alias("k")).schema["k"].dataType
        every = F.explode(F.from_json(F.lit(json.dumps(self.all_keys)), kind))
        pairs = tuples.select("_fk", "_vals", every.alias("_k")).select("_fk", "_vals", *(F.col(f"_k.{k}").alias(k) for k in self.keys))
        node = self.leaf(F.col("tree"), F.col("_vals"))
        scored = pairs.join(NB.maybe_broadcast(self.trees, self.n_nodes), self.keys).select("_fk", *self.keys, node.alias("_n"))
        p1 = share(F.col("_n.n"), F.col("_n.n1"))
        scored, n = NB.materialize(scored.select("_fk", *self.keys, F.log(1 - p1).alias("s0"), F.log(p1).alias("s1"), p1.alias("p1")))
        return df.select(id_col, fk.alias("_fk")).join(NB.maybe_broadcast(scored, n), "_fk").drop("_fk")


def share(n: Column, n1: Column) -> Column:
    return (n1 + 1.0) / (n + 2.0)


def quantile_edges(df: DataFrame, columns: Sequence[str], bins: int = 16, accuracy: int = 10_000) -> dict[str, list[float]]:
    """Bin edges per numeric column: distinct approximate quantiles (columns x bins numbers reach the driver)."""
    at = [i / bins for i in range(1, bins)]
    row = df.agg(*(F.percentile_approx(F.col(c).cast("double"), at, accuracy).alias(c) for c in columns)).first()
    return {c: sorted(set(row[c] or [])) for c in columns}


def _xlogx(c: Column) -> Column:
    return F.when(c > 0, c * F.log(c)).otherwise(0.0)


def _mass(n: Column, n1: Column) -> Column:
    """Weight times entropy of a node."""
    return _xlogx(n) - _xlogx(n1) - _xlogx(n - n1)


def _branches(cells: DataFrame, at: list[str], cuts: dict[int, int]) -> DataFrame:
    """(*at, f, b, branch, n, n1) of every possible split: one branch per value, or two sides of every cut of a numeric feature."""
    plain = cells.filter(~F.col("f").isin(list(cuts)) if cuts else F.lit(True)).select(*at, "f", F.lit(-1).alias("b"), F.col("v").alias("branch"), "n", "n1")
    if not cuts:
        return plain
    count = F.coalesce(*(F.when(F.col("f") == f, F.lit(c)) for f, c in cuts.items()))
    sided = cells.filter(F.col("f").isin(list(cuts))).select(*at, "f", "v", "n", "n1", F.explode(F.sequence(F.lit(0), count - 1)).alias("b"))
    side = F.when(F.col("v").try_cast("int") > F.col("b"), F.lit("1")).otherwise(F.lit("0"))
    return plain.unionByName(sided.withColumn("branch", side).groupBy(*at, "f", "b", "branch").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")))


def _best_splits(base: TreeBase, branches: DataFrame, totals: DataFrame, at: list[str]) -> DataFrame:
    """(*at, f, b): the best split of every node that has one."""
    per = branches.groupBy(*at, "f", "b").agg(
        F.sum(_mass(F.col("n"), F.col("n1"))).alias("rest"), F.sum(_xlogx(F.col("n"))).alias("parts"), F.sum("n").alias("all"),
        F.sum((F.col("n") >= base.min_leaf).cast("int")).alias("fit"))
    per = per.join(totals.filter((F.col("n1") > 0) & (F.col("n1") < F.col("n"))), at).filter(F.col("fit") >= 2)
    gain = F.round((_mass(F.col("n"), F.col("n1")) - F.col("rest")) / F.col("n"), 10)
    per = per.withColumn("gain", gain).filter(F.col("gain") >= base.min_gain)
    score = F.col("gain")
    if base.criterion == "gain_ratio":
        mean = F.avg("gain").over(Window.partitionBy(*at))
        per = per.withColumn("mean", mean).filter(F.col("gain") >= F.col("mean") - 1e-9)
        score = F.round(F.col("gain") * F.col("all") / (_xlogx(F.col("all")) - F.col("parts")), 10)
    best = per.groupBy(*at).agg(F.min(F.struct((-score).alias("s"), "f", "b")).alias("x"))
    return best.select(*at, F.col("x.f").alias("f"), F.col("x.b").alias("b"))


def _child(branch: Column) -> Column:
    return F.xxhash64("node", "f", "b", branch)


def fit_trees(base: TreeBase, rows: DataFrame, keys: list[str], features: list[str], all_keys: DataFrame, more: int = 0) -> TreeModel:
    at = [*keys, "node"]
    cuts = {i: len(base.numeric[f]) for i, f in enumerate(features) if base.numeric.get(f)}
    is_cut = F.col("f").isin(list(cuts)) if cuts else F.lit(False)
    state, _ = NB.materialize(rows.select(*keys, F.col("t").cast("double").alias("t"), F.col("_w").cast("double").alias("_w"), "_vals", F.lit(0).cast("long").alias("node")))
    levels: list[DataFrame] = []  # (*at, n, n1, f, b): nodes of a level, f null for leaves
    edges: list[DataFrame] = []  # (*at of the parent, branch, child)
    for level in range(base.depth + 1):
        cells = state.select(*at, "t", "_w", F.posexplode(F.concat(F.array(F.lit("")), "_vals")).alias("f", "v")).withColumn("f", F.col("f") - 1)
        cells, _ = NB.materialize(cells.groupBy(*at, "f", "v").agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("t")).alias("n1")))
        totals = cells.filter("f = -1").select(*at, "n", "n1")
        if level == 0:
            totals = all_keys.select(*keys, F.lit(0).cast("long").alias("node")).join(totals, at, "left").fillna(0.0, ["n", "n1"])
        branches = _branches(cells.filter("f >= 0"), at, cuts)
        splits, n_splits = NB.materialize(_best_splits(base, branches, totals, at).filter(F.lit(level < base.depth)))
        levels.append(totals.join(splits, at, "left"))
        if not n_splits:
            break
        edges.append(NB.materialize(branches.join(splits, [*at, "f", "b"]).select(*at, "branch", _child(F.col("branch")).alias("child")))[0])
        v = F.get("_vals", F.col("f"))
        side = F.when(v.try_cast("int") > F.col("b"), F.lit("1")).otherwise(F.lit("0"))
        moved = state.join(NB.maybe_broadcast(splits, n_splits), at)
        state, _ = NB.materialize(moved.select(*keys, "t", "_w", "_vals", _child(F.when(is_cut, side).otherwise(v)).alias("node")))
    if base.prune:
        levels = _pruned(levels, edges, keys)
    nodes = _union([x.withColumn("depth", F.lit(i)) for i, x in enumerate(levels)])
    order = Window.partitionBy(*keys).orderBy("depth", "node")
    nodes, n_nodes = NB.materialize(nodes.withColumn("at", F.row_number().over(order) - 1))
    spot = nodes.select(*keys, F.col("node").alias("child"), F.col("at").alias("to"))
    if edges:
        kids = _union(edges).join(nodes.filter(F.col("f").isNotNull()).select(*at), at).join(spot, [*keys, "child"])
        kids = kids.groupBy(*at).agg(F.collect_list(F.struct("branch", "to")).alias("kids"))
        nodes = nodes.join(kids, at, "left")
    else:
        nodes = nodes.withColumn("kids", F.lit(None).cast("array<struct<branch:string,to:int>>"))
    one = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "f", "b", "n", "n1", "kids"))).alias("t"))
    trees, _ = NB.materialize(one.select(*keys, F.transform("t", lambda x: F.struct(
        *(x[c].alias(c) for c in ("f", "b", "n", "n1")), F.map_from_entries(x["kids"]).alias("kids"))).alias("tree")))
    return TreeModel(base, list(keys), list(features), trees, n_nodes, [r.asDict() for r in all_keys.select(*keys).collect()])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pruned(levels: list[DataFrame], edges: list[DataFrame], keys: list[str]) -> list[DataFrame]:
    """The levels without the subtrees that err no less than their root would; model-sized joins, one up and one down per level."""
    at = [*keys, "node"]
    own = F.least(F.col("n1"), F.col("n") - F.col("n1")) + 0.5
    out = [NB.materialize(levels[-1].withColumn("err", own))[0]]
    for level, edge in zip(reversed(levels[:-1]), reversed(edges[: len(levels) - 1]), strict=True):
        below = edge.join(out[0].select(*keys, F.col("node").alias("child"), "err"), [*keys, "child"]).groupBy(*at).agg(F.sum("err").alias("kids_err"))
        x = level.join(below, at, "left").withColumn("_leaf", F.col("kids_err").isNull() | (own <= F.col("kids_err")))
        x = x.select(*at, "n", "n1", *(F.when(~F.col("_leaf"), F.col(c)).alias(c) for c in ("f", "b")), F.when(F.col("_leaf"), own).otherwise(F.col("kids_err")).alias("err"))
        out.insert(0, NB.materialize(x)[0])
    kept = [out[0]]
    for level, edge in zip(out[1:], edges, strict=False):
        alive = edge.join(kept[-1].filter(F.col("f").isNotNull()).select(*at), at).select(*keys, F.col("child").alias("node"))
        kept.append(NB.materialize(level.join(alive, at))[0])
    return [x.drop("err") for x in kept]


# ------------------------------------------------------------------ classifier chains on trees


def chain_rows(base: TreeBase, compact: DataFrame, features: Sequence[str], y_col: str, L: int, chain: list[int]) -> DataFrame:
    """(link, t, _w, _vals): link k sees the features and the true labels chain[:k] (the others are missing)."""
    place = [chain.index(c) if c in chain else len(chain) for c in range(L)]
    places = F.array(*(F.lit(p) for p in place))
    links = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(chain) - 1)).alias("k"), F.array(*(F.lit(c) for c in chain)).alias("lab")))
    x = compact.select(base.values(features).alias("_x"), F.col(y_col).alias("_y"), "_w", links.alias("ln"))
    true = F.transform(F.sequence(F.lit(0), F.lit(L - 1)), lambda c: F.when(
        F.get(places, c) < F.col("ln.k"), F.coalesce(F.concat(F.lit("="), F.get("_y", c).cast("string")), F.lit(""))).otherwise(F.lit("")))
    rows = x.select(F.col("ln.k").cast("int").alias("link"), F.get("_y", F.col("ln.lab")).alias("t"), "_w", F.concat("_x", true).alias("_vals"))
    return rows.filter(F.col("t").isNotNull())


def predict_chain(model: TreeModel, df: DataFrame, L: int, chain: list[int], id_col: str = "id", forest_nodes: int = FOREST_NODES) -> DataFrame:
    """(id, conf ARRAY, bip ARRAY) in label order; each link sees the predictions of the links before it.

    The forest is one row, so the chain is one ``aggregate`` per distinct feature tuple; beyond ``forest_nodes`` the links follow one another, one tree each."""
    fk = NB.feature_key(model.features)
    tuples = df.select(fk.alias("_fk"), *model.features).dropDuplicates(["_fk"])
    state = F.struct(F.array_repeat(F.lit(""), L).alias("seen"), F.array_repeat(F.lit(0.0), L).alias("conf"))
    tuples = tuples.select("_fk", model.base.values(model.features).alias("_x"), state.alias("_s"), F.lit(0).alias("_one"))

    def step(acc: Column, tree: Column, lab: Column, x: Column) -> Column:
        node = model.leaf(tree, F.concat(x, acc["seen"]))
        p = share(node["n"], node["n1"])
        said = F.when(p >= 0.5, F.lit("=1")).otherwise(F.lit("=0"))
        return F.struct(F.transform(acc["seen"], lambda v, i: F.when(i == lab, said).otherwise(v)).alias("seen"),
                        F.transform(acc["conf"], lambda v, i: F.when(i == lab, p).otherwise(v)).alias("conf"))

    labs = F.array(*(F.lit(c) for c in chain))
    if model.n_nodes <= forest_nodes:
        forest = model.trees.agg(F.array_sort(F.collect_list(F.struct("link", "tree")), lambda a, b: a["link"] - b["link"]).alias("_forest")).withColumn("_one", F.lit(0))
        done = tuples.join(F.broadcast(forest), "_one")
        done = done.withColumn("_s", F.aggregate(F.sequence(F.lit(0), F.lit(len(chain) - 1)), F.col("_s"),
                                                 lambda acc, k: step(acc, F.get("_forest", k)["tree"], F.get(labs, k), F.col("_x"))))
    else:
        done = tuples
        for k, lab in enumerate(chain):
            tree = model.trees.filter(F.col("link") == k).select(F.col("tree").alias("_tree"), F.lit(0).alias("_one"))
            done = done.join(F.broadcast(tree), "_one").withColumn("_s", step(F.col("_s"), F.col("_tree"), F.lit(lab), F.col("_x"))).drop("_tree")
            done, _ = NB.materialize(done)
    bip = F.transform("_s.seen", lambda v: (v == "=1").cast("int"))
    out, n = NB.materialize(done.select("_fk", F.col("_s.conf").alias("conf"), bip.alias("bip")))
    return df.select(id_col, fk.alias("_fk")).join(NB.maybe_broadcast(out, n), "_fk").select(id_col, "conf", "bip")
