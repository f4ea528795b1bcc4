"""Label partitions chosen by pairwise dependence: an ensemble of subset learners over random
partitions, and greedy agglomerative label clustering.

Both start from the conditional dependence scores of the label pairs (``dependence``), a label
x label table.  Scoring 50,000 random partitions is row-parallel over ``spark.range``: a seeded
hash orders the 2L - 1 elements (labels and separators) of each permutation, and the weight of
a partition is

    sum over pairs in one group (score - critical)  -  sum over pairs in different groups (score - critical)

which is what the reference's running sum adds up (each pair counted once).  Only bounded,
label-sized lists reach the driver (the <= 100 best distinct partitions, the k x L counts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polytag.frame import MLFrame
from polytag.functions import labelsets as LS
from polytag.operators import dependence as DP
from polytag.operators import learners as LN
from polytag.operators import nb as NB
from polytag.operators import split as SP

# fixed values: defaults of the ensemble of subset learners
N_RANDOM_PARTITIONS = 50000
N_FOR_DIVERSITY = 100
DIVERSITY_SHARE = 0.2


def pair_weights(dep: DataFrame, L: int, critical: float = DP.CRITICAL) -> dict[tuple[int, int], float]:
    """{(i, j): score - critical} for i < j (label-sized, collected)."""
    w = {}
    for r in dep.collect():
        a, b = sorted((int(r["label"]), int(r["given"])))
        w[(a, b)] = float(r["score"]) - critical
    return w


def random_partitions(spark: SparkSession, L: int, n: int, seed: int = 1) -> DataFrame:
    """(pid, grp ARRAY<INT>): grp[l] = number of separators before label l in a seeded random
    permutation of labels 0..L-1 and separators L..2L-2 (groups are the runs between separators)."""
    elems = F.sequence(F.lit(0), F.lit(2 * L - 2))
    keyed = F.transform(elems, lambda e: F.struct(LS.stable_hash2(F.col("pid"), e, seed).alias("h"), e.alias("e")))
    perm = F.transform(F.array_sort(keyed), lambda s: s["e"])
    x = spark.range(n).select(F.col("id").alias("pid")).select("pid", perm.alias("perm"))
    grp = F.transform(F.sequence(F.lit(0), F.lit(L - 1)), lambda lab: F.size(F.filter(
        F.slice(F.col("perm"), 1, F.array_position(F.col("perm"), lab) - 1), lambda e: e >= L)))
    return x.select("pid", grp.cast("array<int>").alias("grp"))


def score_partitions(parts: DataFrame, weights: dict[tuple[int, int], float]) -> DataFrame:
    """(pid, grp, weight)."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for (i, j), w in sorted(weights.items())])
    wt = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.when(
        F.get(F.col("grp"), p["i"]) == F.get(F.col("grp"), p["j"]), p["w"]).otherwise(-p["w"]))
    return parts.select("pid", "grp", wt.alias("weight"))


def groups_of(grp: list[int]) -> list[list[int]]:
    """Canonical partition: groups as ascending label lists, ordered by their first label."""
    by = {}
    for lab, g in enumerate(grp):
        by.setdefault(g, []).append(lab)
    return sorted(by.values(), key=lambda s: s[0])


def _same(part: list[list[int]], L: int) -> set[tuple[int, int]]:
    return {(a, b) for g in part for a in g for b in g if a < b}


def distance(p1: list[list[int]], p2: list[list[int]], L: int) -> int:
    """Label pairs that are together in one partition and apart in the other."""
    return len(_same(p1, L) ^ _same(p2, L))


def best_distinct(scored: DataFrame, n: int) -> list[tuple[float, list[list[int]]]]:
    """The n best partitions after the reference's de-duplication: in (weight desc, pid) order a
    partition is dropped when its weight truncates to the same integer as the previous one (and the
    very first is dropped when it truncates to 0).  Distributed: first of each truncated value by a
    grouped min, then a bounded top-n."""
    t = scored.withColumn("tv", F.col("weight").cast("long"))
    first = t.groupBy("tv").agg(F.min(F.struct((-F.col("weight")).alias("nw"), F.col("pid").alias("pid"), F.col("grp").alias("grp"))).alias("b"))
    top = first.select("tv", (-F.col("b.nw")).alias("weight"), F.col("b.pid").alias("pid"), F.col("b.grp").alias("grp"))
    rows = top.orderBy(F.desc("weight"), "pid").limit(n + 1).collect()
    if rows and rows[0]["tv"] == 0:
        rows = rows[1:]
    return [(float(r["weight"]), groups_of(list(r["grp"]))) for r in rows[:n]]


def select_diverse(cands: list[list[list[int]]], m: int, L: int, share: float = DIVERSITY_SHARE) -> list[list[list[int]]]:
    """Start with the best; each next pick: sort candidates by their distance to the nearest chosen
    one (stable), keep the slice just below the farthest (share of the list), take its best-ranked.
    When the slice is empty (fewer than 1 / share candidates) the farthest candidate is taken."""
    chosen = [cands[0]]
    for _ in range(1, m):
        md = [(min(distance(c, s, L) for s in chosen), i) for i, c in enumerate(cands)]
        md.sort(key=lambda x: x[0])
        end = len(md) - 1
        start = end - int(len(md) * share)
        window = md[start:end] if start < end else md[end:]
        chosen.append(cands[min(i for _, i in window)])
    return chosen


def choose_partitions(mlf: MLFrame, train: DataFrame, m: int = 10, diverse: bool = True, seed: int = 1,
                      n_random: int = N_RANDOM_PARTITIONS, folds: int = 10) -> list[list[list[int]]]:
    dep = DP.conditional_dependence(mlf.with_df(train), k=folds, seed=seed)
    w = pair_weights(dep, mlf.L)
    scored = score_partitions(random_partitions(train.sparkSession, mlf.L, n_random, seed), w)
    if diverse:
        cands = [p for _, p in best_distinct(scored, min(N_FOR_DIVERSITY, n_random))]
        return select_diverse(cands, m, mlf.L)
    return [p for _, p in best_distinct(scored, m)]


def ensemble_of_partitions(mlf: MLFrame, train: DataFrame, df: DataFrame, m: int = 10, diverse: bool = True,
                           seed: int = 1, n_random: int = N_RANDOM_PARTITIONS, threshold: float = 0.5) -> DataFrame:
    """(id, conf ARRAY, bip ARRAY): conf_j = share of the m chosen partitions whose group voted j in;
    all groups of all models are fitted by one count (the group is the model key)."""
    parts = choose_partitions(mlf, train, m, diverse, seed, n_random)
    groups = [g for p in parts for g in p]
    model = LN.fit_subsets(mlf, groups, train)
    return LN.predict_subsets(model, df, mlf.L, threshold=threshold)


# ------------------------------------------------------------------ greedy label clustering


def _group_correct(mlf: MLFrame, rows: DataFrame, group: list[int], folds: int) -> DataFrame:
    """(id, ok): out-of-fold label-powerset model of one label group; ok = its predicted label set
    of the group equals the true one.  Fold-keyed models (a row counts ``_w`` times for every fold but its own);
    a row is scored only by its own fold's model (the fold is a join key)."""
    idc = mlf.id_col
    t = LS.bits(F.array(*[F.get(F.col(mlf.y_col), F.lit(j)) for j in group]))
    tr = rows.select(idc, "_fold", "_w", t.alias("t"), *mlf.features)
    fit_rows = tr.select("t", "_w", *mlf.features, F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)),
                                                                lambda f: f != F.col("_fold"))).alias("fold"))
    model = NB.fit_nb(fit_rows, ["fold"], list(mlf.features), weight="_w")
    fl = tr.select(idc, F.col("_fold").alias("fold"), F.explode(NB.feature_pairs(mlf.features)).alias("p")).select(
        idc, "fold", "p.f", "p.v")
    s = fl.join(NB.maybe_broadcast(model.weights, model.n_weights), ["fold", "f", "v"]).select(idc, "fold", "t", F.col("w").alias("x"))
    base = tr.select(idc, F.col("_fold").alias("fold"), F.explode(model.const_array()).alias("c")).filter(
        F.col("c.fold") == F.col("fold")).select(idc, "fold", F.col("c.t").alias("t"), F.col("c.kc").alias("x"))
    sc = s.unionByName(base).groupBy(idc, "t").agg(F.sum("x").alias("s"))
    best = sc.groupBy(idc).agg(F.max(F.struct("s", "t")).alias("b"))
    return best.join(tr.select(idc, F.col("t").alias("truth")), idc).select(idc, (F.col("b.t") == F.col("truth")).alias("ok"))


def greedy_label_clustering(mlf: MLFrame, train: DataFrame, folds: int = 10, seed: int = 1,
                            critical: float = DP.CRITICAL, patience: int = 10) -> tuple[list[list[int]], DataFrame]:
    """Start from singletons; for label pairs in decreasing dependence, merge their groups when the
    cross-validated subset accuracy does not drop; stop below the critical score, after more than
    ``patience`` rejections in a row, or at one group; a partition already evaluated is skipped.

    A row enters by its features, labels and fold alone, so rows that agree in them are one row of weight ``_w``.
    Incremental: per-row correctness of every current group is kept (id, group, ok); a candidate
    only fits the merged group, so one step costs one fold-keyed count of the compacted rows.
    Returns the final groups and the trace (step, pair, accuracy, accepted)."""
    idc = mlf.id_col
    spark = train.sparkSession
    train, _ = NB.materialize(train.select(idc, *mlf.features, mlf.y_col))
    rows = train.filter(~F.exists(mlf.y_col, lambda v: v.isNull())).join(
        SP.cv_folds(mlf.with_df(train), folds, seed).withColumnRenamed("fold", "_fold"), idc)
    rows = LN.compact_rows(rows, [*mlf.features, "_fold"], mlf.y_col)
    rows, _ = NB.materialize(rows.withColumn(idc, F.monotonically_increasing_id()))
    fold_n = {r["_fold"]: int(r["n"]) for r in rows.groupBy("_fold").agg(F.sum("_w").alias("n")).collect()}

    def accuracy(okt: DataFrame) -> float:
        per = okt.groupBy(idc).agg(F.min(F.col("ok").cast("int")).alias("ok")).join(rows.select(idc, "_fold", "_w"), idc)
        acc = {r["_fold"]: int(r["s"]) for r in per.groupBy("_fold").agg(F.sum(F.col("ok") * F.col("_w")).alias("s")).collect()}
        return sum(acc.get(f, 0) / n for f, n in fold_n.items()) / len(fold_n)

    groups = [[j] for j in range(mlf.L)]
    oks = {}
    for g in groups:
        oks[tuple(g)], _ = NB.materialize(_group_correct(mlf, rows, g, folds).withColumn("g", F.lit(str(g))))

    def table(gs):
        out = None
        for g in gs:
            out = oks[tuple(g)] if out is None else out.unionByName(oks[tuple(g)])
        return out

    cur = accuracy(table(groups))
    seen = {str(groups)}
    dep = DP.conditional_dependence(mlf.with_df(train), k=folds, seed=seed).orderBy(F.desc("score"), "label", "given").collect()
    trace = [(0, -1, -1, float("nan"), cur, True)]
    misses = 0
    for step, r in enumerate(dep, start=1):
        if r["score"] < critical or misses > patience or len(groups) == 1:
            break
        a, b = int(r["label"]), int(r["given"])
        ga = next(g for g in groups if a in g)
        gb = next(g for g in groups if b in g)
        if ga is gb:
            continue
        merged = sorted(ga + gb)
        new = sorted([g for g in groups if g is not ga and g is not gb] + [merged], key=lambda s: s[0])
        if str(new) in seen:
            continue
        seen.add(str(new))
        if tuple(merged) not in oks:
            oks[tuple(merged)], _ = NB.materialize(_group_correct(mlf, rows, merged, folds).withColumn("g", F.lit(str(merged))))
        acc = accuracy(table(new))
        ok = acc >= cur
        trace.append((step, a, b, float(r["score"]), acc, ok))
        if ok:
            groups, cur, misses = new, acc, 0
        else:
            misses += 1
    tr = spark.createDataFrame(trace, "step int, a int, b int, score double, subset_accuracy double, accepted boolean")
    return groups, tr
