"""Problem transformations: reshape a multi-label table into ordinary learning problems.

Every transformation is a projection, a filter or a generator (``posexplode``)
over the rows, so it runs map-side with no shuffle; the label-count based ones
read one label-sized totals row first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polytag.frame import MLFrame
from polytag.functions import labelsets as LS
from polytag.operators import stats as ST


def _feats(mlf: MLFrame) -> list[str]:
    return [mlf.id_col, *mlf.features]


def binary_relevance(mlf: MLFrame, j: int | None = None, flip: bool = False) -> DataFrame:
    """Features + one label as ``class``.  ``j=None`` gives every label at once (``j`` column).

    ``flip`` mirrors a nominal declared as {1,0}: the class index is 1 - value.
    """
    y = F.col(mlf.y_col)
    if j is not None:
        cls = y[j]
        return mlf.df.select(*_feats(mlf), (F.lit(1) - cls if flip else cls).alias("class"))
    out = mlf.df.select(*_feats(mlf), F.posexplode(mlf.y_col).alias("j", "class"))
    if flip:
        out = out.withColumn("class", F.lit(1) - F.col("class"))
    return out


def label_powerset(mlf: MLFrame) -> DataFrame:
    """Features + ``class`` = bit string of the label set."""
    return mlf.df.select(*_feats(mlf), LS.bits(mlf.y_col).alias("class"))


def pairwise(mlf: MLFrame) -> DataFrame:
    """All label pairs a < b in one pass: rows where exactly one of the two is set; class 1 iff a set."""
    y = F.col(mlf.y_col)
    idx = F.sequence(F.lit(0), F.lit(mlf.L - 1))
    x = mlf.df.select(*_feats(mlf), mlf.y_col, F.explode(idx).alias("a"))
    x = x.select(*_feats(mlf), mlf.y_col, "a", F.explode(F.filter(idx, lambda b: b > F.col("a"))).alias("b"))
    ta, tb = F.get(y, F.col("a")), F.get(y, F.col("b"))
    return x.filter(ta != tb).select(*_feats(mlf), F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), ta.alias("class"))


def include_labels(mlf: MLFrame) -> DataFrame:
    """One row per (row, label) with the label name as a feature and the 0/1 class."""
    names = F.array(*[F.lit(n) for n in mlf.labels])
    x = mlf.df.select(*_feats(mlf), F.posexplode(mlf.y_col).alias("j", "class"))
    return x.select(*_feats(mlf), F.get(names, F.col("j")).alias("label"), "class")


def _class_name(j) -> F.Column:
    return F.concat(F.lit("Class"), (j + 1).cast("string"))


def copy(mlf: MLFrame, weighted: bool = False) -> DataFrame:
    """One row per set label (``class`` = 'Class<j+1>'); rows with no label vanish.
    ``weighted`` adds weight = 1 / #labels of the row."""
    p = LS.positives(mlf.y_col)
    x = mlf.df.select(*_feats(mlf), F.size(p).alias("_n"), F.explode(p).alias("j"))
    cols = [*_feats(mlf), F.col("j").cast("int").alias("j"), _class_name(F.col("j")).alias("class")]
    if weighted:
        cols.append((F.lit(1.0) / F.col("_n")).alias("weight"))
    return x.select(*cols)


def ignore(mlf: MLFrame) -> DataFrame:
    """Keep rows with exactly one label."""
    p = LS.positives(mlf.y_col)
    x = mlf.df.select(*_feats(mlf), p.alias("_p")).filter(F.size("_p") == 1)
    j = F.col("_p")[0]
    return x.select(*_feats(mlf), j.cast("int").alias("j"), _class_name(j).alias("class"))


def _label_counts_literal(mlf: MLFrame) -> F.Column:
    """The L label counts as a literal array (label-sized, read once on the driver)."""
    row = ST.label_totals(mlf).first()
    return F.array(*[F.lit(int(c)) for c in row["n1"]])


def select_by_frequency(mlf: MLFrame, most: bool = True) -> DataFrame:
    """Class = most (or least) frequent label among the row's set labels; first index on ties;
    rows without labels are dropped."""
    counts = _label_counts_literal(mlf)
    sign = -1 if most else 1
    x = mlf.df.select(*_feats(mlf), LS.positives(mlf.y_col).alias("_p")).filter(F.size("_p") > 0)
    best = F.array_min(F.transform("_p", lambda j: F.struct((F.get(counts, j) * sign).alias("c"), j.alias("j"))))
    j = best["j"]
    return x.select(*_feats(mlf), j.cast("int").alias("j"), _class_name(j).alias("class"))


def select_random(mlf: MLFrame, seed: int = 1) -> DataFrame:
    """Class = a set label chosen by a seeded stable hash of (id, j); rows without labels dropped."""
    idc = F.col(mlf.id_col)
    x = mlf.df.select(*_feats(mlf), LS.positives(mlf.y_col).alias("_p")).filter(F.size("_p") > 0)
    pick = F.array_min(F.transform("_p", lambda j: F.struct(LS.stable_hash2(idc, j, seed).alias("h"), j.alias("j"))))
    j = pick["j"]
    return x.select(*_feats(mlf), j.cast("int").alias("j"), _class_name(j).alias("class"))


def multiclass_schema(mlf: MLFrame) -> DataFrame:
    """The shared output schema of multi-class transformations: (j, class name)."""
    return mlf.df.sparkSession.range(mlf.L).select(F.col("id").cast("int").alias("j"), _class_name(F.col("id")).alias("class"))


def single_target(df: DataFrame, features, j: int, target_col: str = "target", id_col: str = "id") -> DataFrame:
    """Features + one numeric target."""
    return df.select(id_col, *features, F.col(target_col)[j].alias("class"))


def chain_step(df: DataFrame, features, chain, k: int, target_col: str = "target", id_col: str = "id") -> DataFrame:
    """Features + the first k-1 targets of the chain as features + the k-th as class (k is 1-based)."""
    t = F.col(target_col)
    prev = [t[c].alias(f"t{c}") for c in chain[: k - 1]]
    return df.select(id_col, *features, *prev, t[chain[k - 1]].alias("class"))


def hierarchical(mlf: MLFrame) -> MLFrame:
    """Append meta-label columns for the inner tree nodes: meta = OR of all leaf labels below it, at any depth.

    The tree is label-sized; the meta labels are computed row-wise by array
    expressions (no shuffle)."""
    assert mlf.tree is not None, "hierarchical() needs a label tree"
    nodes = mlf.tree.select("label", "idx", "parent_idx").collect()
    kids: dict[int, list[int]] = {}
    for n in nodes:
        if n["parent_idx"] is not None:
            kids.setdefault(n["parent_idx"], []).append(n["idx"])
    name = {n["idx"]: n["label"] for n in nodes}

    def leaves(n: int) -> list[int]:
        return [x for c in kids[n] for x in leaves(c)] if n in kids else [n]

    inner = sorted(kids)
    y = F.col(mlf.y_col)
    meta = [F.greatest(*[F.coalesce(y[x], F.lit(0)) for x in leaves(p)], F.lit(0)) for p in inner]
    out = mlf.df.withColumn(mlf.y_col, F.concat(y, F.array(*meta)))
    return mlf.with_df(out, labels=tuple(mlf.labels) + tuple(name.get(p, f"meta{p}") for p in inner))


# ------------------------------------------------------------------ label set pruning


def _frequent_subsets(rare: DataFrame, freq: DataFrame, n_labels: int) -> DataFrame:
    """(bits, sub_bits, sub_size, sub_count): frequent sets that are proper non-empty subsets of
    each rare set.  Equi-join on the frequent set's first two labels (the rare side emits its
    ordered label pairs; one-label frequent sets join on the label alone), then a containment
    test, so no 2^s subset enumeration and no size guard is needed."""
    # sets of at most 62 labels travel and are compared as one number, larger ones as arrays
    as_set = lambda bits, y: F.conv(F.col(bits), 2, 10).cast("bigint") if n_labels <= 62 else F.col(y)
    fr = freq.select(F.col("bits").alias("sub_bits"), F.col("count").alias("sub_count"), LS.positives("y").alias("fp"))
    fr = fr.filter(F.size("fp") > 0).select("sub_bits", "sub_count", as_set("sub_bits", "fp").alias("sub"), F.size("fp").alias("sub_size"),
                                            F.col("fp")[0].alias("k0"),
                                            F.when(F.size("fp") > 1, F.col("fp")[1]).otherwise(F.lit(-1)).alias("k1"))
    rr = rare.select("bits", as_set("bits", "y").alias("set"), LS.size("y").alias("size"), LS.positives("y").alias("pos"))
    one = rr.select("bits", "set", "size", F.explode("pos").alias("k0"), F.lit(-1).alias("k1"))
    two = rr.select("bits", "set", "size", "pos", F.posexplode("pos").alias("i", "k0")).select(
        "bits", "set", "size", "k0", F.explode(F.slice("pos", F.col("i") + 2, F.size("pos"))).alias("k1"))
    keyed = one.unionByName(two)
    held = F.col("set").bitwiseAND(F.col("sub")) == F.col("sub") if n_labels <= 62 else F.forall("sub", lambda q: F.get("set", q) == 1)
    j = keyed.join(fr, ["k0", "k1"]).filter((F.col("sub_size") < F.col("size")) & held)
    return j.select("bits", "sub_bits", "sub_size", "sub_count")


def prune_ps(mlf: MLFrame, p: int, strategy: str = "A", b: int = 2) -> DataFrame:
    """Pruned sets: (bits, new_bits, count) — frequent sets (count > p) map to themselves; each rare
    set maps to its frequent subsets: strategy A keeps the top b by (size desc, count desc, bits);
    strategy B keeps every frequent subset with more than b labels.

    Works on the distinct-label-set table, which is far smaller than the rows."""
    counts = ST.labelset_counts(mlf)
    freq = counts.filter(F.col("count") > p).select("bits", "y", "count")
    rare = counts.filter(F.col("count") <= p).select("bits", "y", "count")
    subs = _frequent_subsets(rare, freq, mlf.L)
    freq = freq.select("bits", "count")
    if strategy.upper() == "A":
        from pyspark.sql.window import Window

        w = Window.partitionBy("bits").orderBy(F.col("sub_size").desc(), F.col("sub_count").desc(), F.col("sub_bits").desc())
        subs = subs.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= b)
    else:
        subs = subs.filter(F.col("sub_size") > b)
    rare_out = subs.join(rare.select("bits", "count"), "bits").select("bits", F.col("sub_bits").alias("new_bits"), "count")
    return freq.select("bits", F.col("bits").alias("new_bits"), "count").unionByName(rare_out)


def prune_ppt(mlf: MLFrame, p: int, strategy: str = "replace") -> DataFrame:
    """Pruned problem transformation: (bits, new_bits, count).  Frequent sets (count > p) stay;
    rare sets are dropped (``drop``) or replaced by disjoint frequent subsets chosen greedily,
    largest first, each subset taken only if it shares no label with those already taken.
    Equal sizes are ordered by count desc, then bits desc (the reference keeps enumeration order).
    The label-set counts feed three branches, so they are checkpointed once."""
    from polytag.operators.nb import materialize

    counts, _ = materialize(ST.labelset_counts(mlf))
    freq = counts.filter(F.col("count") > p).select("bits", "y", "count")
    keep = freq.select("bits", F.col("bits").alias("new_bits"), "count")
    if strategy == "drop":
        return keep
    rare = counts.filter(F.col("count") <= p).select("bits", "y", "count")
    subs = _frequent_subsets(rare, freq, mlf.L)
    # per rare set (label-set sized group): ordered candidate list, then a greedy disjoint fold;
    # label sets are 64-bit masks when L <= 62 (one AND per candidate), else 0/1 arrays
    L = mlf.L
    use_mask = L <= 62
    mask = F.conv(F.col("sub_bits"), 2, 10).cast("bigint") if use_mask else F.lit(0).cast("bigint")
    cand = subs.groupBy("bits").agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("sub_size")).alias("s"), (-F.col("sub_count")).alias("c"),
                                    F.col("sub_bits").alias("b"), mask.alias("m"))),
            lambda l, r: F.when(l["s"] < r["s"], -1).when(l["s"] > r["s"], 1).when(l["c"] < r["c"], -1)
            .when(l["c"] > r["c"], 1).when(l["b"] > r["b"], -1).when(l["b"] < r["b"], 1).otherwise(0),
        ).alias("cands")
    )
    if use_mask:
        def step(acc, c):
            free = acc["used"].bitwiseAND(c["m"]) == 0
            return F.struct(F.when(free, acc["used"].bitwiseOR(c["m"])).otherwise(acc["used"]).alias("used"),
                            F.when(free, F.concat(acc["picked"], F.array(c["b"]))).otherwise(acc["picked"]).alias("picked"))

        init = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("picked"))
    else:
        zero = F.array_repeat(F.lit(0), L)

        def step(acc, c):
            sub = LS.from_bits(c["b"])
            clash = F.exists(F.zip_with(acc["used"], sub, lambda u, v: (u == 1) & (v == 1)), lambda z: z)
            return F.when(clash, acc).otherwise(
                F.struct(F.zip_with(acc["used"], sub, lambda u, v: F.greatest(u, v)).alias("used"),
                         F.concat(acc["picked"], F.array(c["b"])).alias("picked")))

        init = F.struct(zero.alias("used"), F.array().cast("array<string>").alias("picked"))
    chosen = cand.select("bits", F.aggregate("cands", init, step)["picked"].alias("picked"))
    out = chosen.select("bits", F.explode("picked").alias("new_bits")).join(rare.select("bits", "count"), "bits")
    return keep.unionByName(out)
