"""Multi-label learners on the count-based naive Bayes base (``nb``).

Every learner fits *all* of its binary / multi-class models with one grouped
count (the model key — label, pair, chain link, label set — is a grouping
column) and predicts with one join against the small weight table plus array
expressions; no per-label Spark job, no driver loop over rows.

Prediction frames are long (id, j, conf[, bip]) or array form (id, conf, bip).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polytag.frame import MLFrame
from polytag.functions import labelsets as LS
from polytag.operators import nb as NB


def _binary_classes(spark, keys_df: DataFrame) -> DataFrame:
    return keys_df.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("t"))


def to_arrays(long: DataFrame, cols=("conf",), id_col: str = "id") -> DataFrame:
    """(id, j, c...) -> (id, c ARRAY ...) ordered by j; one shuffle on id, L entries per group."""
    g = long.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("j", *cols))).alias("_a"))
    def field(c):
        return lambda e: e[c]

    return g.select(id_col, *[F.transform("_a", field(c)).alias(c) for c in cols])


def compact_rows(train: DataFrame, features, y_col: str) -> DataFrame:
    """Training rows grouped by (feature values, label set) with their multiplicity ``_w``.  The
    naive-Bayes counts are sums over rows, so equal rows are counted once with a weight (partial
    aggregation before the shuffle; the per-label / per-pair explode then runs on far fewer rows)."""
    return train.groupBy(*features, y_col).agg(F.count(F.lit(1)).cast("double").alias("_w"))


def label_counts(train: DataFrame, features, y_col: str, L: int, use=None) -> DataFrame:
    """(features..., j, t, _w): rows per feature tuple with t = 0 or 1 at label j, missing labels skipped.  Every row adds to
    2 L sums of its tuple; no row is exploded and label sets need not repeat.  ``use`` (label -> Column) keeps the
    rows that count for a label."""
    def rows(j, t):
        hit = F.get(y_col, F.lit(j)) == t
        return F.coalesce(F.sum((hit if use is None else hit & use(j)).cast("long")), F.lit(0)).cast("double")

    g = train.groupBy(*features).agg(*[rows(j, t).alias(f"_n{t}_{j}") for j in range(L) for t in (0, 1)])
    cells = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(t).alias("t"), F.col(f"_n{t}_{j}").alias("w")) for j in range(L) for t in (0, 1)])
    return g.select(*features, F.explode(cells).alias("_c")).select(
        *features, F.col("_c.j").alias("j"), F.col("_c.t").alias("t"), F.col("_c.w").alias("_w")).filter("_w > 0")


def on_feature_tuples(features, df: DataFrame, id_col: str, fn) -> DataFrame:
    """Run a prediction whose output depends only on the feature values once per distinct feature
    tuple (``fn(tuples, key_col)``), checkpoint it and join the rows back (broadcast only under the
    counted-size limit)."""
    rows = df.select(id_col, NB.feature_key(features).alias("_fk"))
    tup = df.select(NB.feature_key(features).alias("_fk"), *features).dropDuplicates(["_fk"])
    out, n = NB.materialize(fn(tup, "_fk"))
    return rows.join(NB.maybe_broadcast(out, n), "_fk").drop("_fk")


# ------------------------------------------------------------------ binary relevance


def fit_br(mlf: MLFrame, train: DataFrame | None = None, base=None):
    """One binary model per label, all from one count; rows with a missing label are skipped for it.
    ``base``: another base learner than naive Bayes (``tree.TreeBase``)."""
    train = mlf.df if train is None else train
    c = compact_rows(train, mlf.features, mlf.y_col)
    if base is not None:
        rows = c.select("_w", base.values(mlf.features).alias("_vals"), F.posexplode(mlf.y_col).alias("j", "t")).filter(F.col("t").isNotNull())
        labels = train.sparkSession.range(mlf.L).select(F.col("id").cast("int").alias("j"))
        return base.fit(rows.withColumn("j", F.col("j").cast("int")), ["j"], list(mlf.features), labels)
    rows = c.select(*mlf.features, "_w", F.posexplode(mlf.y_col).alias("j", "t")).filter(F.col("t").isNotNull())
    rows = rows.withColumn("j", F.col("j").cast("int"))
    spark = train.sparkSession
    classes = _binary_classes(spark, spark.range(mlf.L).select(F.col("id").cast("int").alias("j")))
    return NB.fit_nb(rows, ["j"], list(mlf.features), classes, weight="_w")


def binary_scores(model, df: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, *keys, s0, s1, p1) of any base learner's binary models."""
    return NB.nb_binary_scores(model, df, id_col) if isinstance(model, NB.NBModel) else model.binary_scores(df, id_col)


def predict_br(model, df: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, j, conf, bip): conf = P(1); positive iff P(1) >= P(0)."""
    p = binary_scores(model, df, id_col)
    return p.select(id_col, F.col("j").cast("int").alias("j"), F.col("p1").alias("conf"),
                    (F.col("s1") >= F.col("s0")).cast("int").alias("bip"))


# ------------------------------------------------------------------ label powerset


def ranked_classes(model: NB.NBModel, tops: F.Column, key: F.Column | None = None) -> F.Column:
    """The best classes of a tuple (array of structs with ``t``, ``e``) with each class's position ``i`` in the model's sorted class
    list, which seeds the tie-break (``key``: the group the class belongs to, positions running over (group, class))."""
    if key is None:
        names = sorted({r["t"] for r in model.const})
    else:
        names = [f"{g}:{t}" for g, t in sorted({(r["g"], r["t"]) for r in model.const})]
    at = F.create_map(*[x for i, b in enumerate(names) for x in (F.lit(b), F.lit(i))])

    def place(e):
        return F.element_at(at, e["t"] if key is None else F.concat(key.cast("string"), F.lit(":"), e["t"]))

    # a single best class needs no position
    return F.when(F.size(tops) > 1, F.transform(tops, lambda e: F.struct(e["t"].alias("t"), e["e"].alias("e"), place(e).alias("i")))).otherwise(
        F.transform(tops, lambda e: F.struct(e["t"].alias("t"), e["e"].alias("e"), F.lit(0).alias("i"))))


def tied_best(tops: F.Column, idc: F.Column, seed: int) -> F.Column:
    """The best class of a row: the only one, or of tied ones that of the smallest seeded hash of row and class position."""
    drawn = F.array_min(F.transform(tops, lambda e: F.struct(LS.stable_hash2(idc, e["i"], seed).alias("h"), e["t"].alias("t"), e["e"].alias("e"))))
    return F.when(F.size(tops) > 1, F.struct(drawn["t"].alias("t"), drawn["e"].alias("e"))).otherwise(
        F.struct(F.get(tops, F.lit(0))["t"].alias("t"), F.get(tops, F.lit(0))["e"].alias("e")))


def fit_lp(mlf: MLFrame, train: DataFrame | None = None, pruned: DataFrame | None = None) -> NB.NBModel:
    """One multi-class model over the label sets seen (class = bit string).  ``pruned`` optionally
    maps (bits -> new_bits) for pruned-set variants: a row of a rare set becomes one row per new set."""
    train = mlf.df if train is None else train
    rows = train.filter(~F.exists(mlf.y_col, lambda x: x.isNull())).select(*mlf.features, LS.bits(mlf.y_col).alias("bits"))
    if pruned is not None:
        rows = rows.join(pruned.select("bits", "new_bits"), "bits").select(*mlf.features, F.col("new_bits").alias("t"))
    else:
        rows = rows.withColumnRenamed("bits", "t")
    return NB.fit_nb(rows, [], list(mlf.features))


def predict_lp(model: NB.NBModel, df: DataFrame, L: int, conf_mode: int = 1, seed: int = 7,
               threshold: float | None = None, id_col: str = "id") -> DataFrame:
    """(id, conf ARRAY, bip ARRAY): posterior over the seen label sets; best set by max posterior
    (ties: seeded stable hash); conf mode 0 = the set itself, 1 = p or 1-p, 2 = sum of p over sets
    containing the label.  With ``threshold`` the bipartition is conf > threshold."""
    # Everything but the seeded tie-break depends on the feature values alone, so it is worked out once per distinct
    # feature tuple: the best sets (more than one only on a tie), the normaliser and, for mode 2, the L label sums.
    # A row joins these small arrays, never the list of all classes.
    fk = NB.feature_key(model.features)
    tup = df.select(fk.alias("_fk"), *model.features).dropDuplicates(["_fk"])
    s = NB.nb_scores(model, tup, "_fk")
    g = s.groupBy("_fk").agg(F.max("s").alias("mx"), F.collect_list(F.struct("t", "s")).alias("cs"))
    # unnormalised posteriors e = exp(s - max); every confidence divides by the tuple's sum once
    g = g.select("_fk", F.transform("cs", lambda e: F.struct(e["t"].alias("t"), F.exp(e["s"] - F.col("mx")).alias("e"),
                                                            (e["s"] == F.col("mx")).alias("top"))).alias("ps"))
    norm = F.aggregate("ps", F.lit(0.0), lambda a, e: a + e["e"])
    tops = ranked_classes(model, F.filter("ps", lambda e: e["top"]))
    sums = F.transform(F.sequence(F.lit(0), F.lit(L - 1)), lambda j: F.aggregate(
        "ps", F.lit(0.0), lambda a, e: a + F.when(e["t"].substr(j + 1, F.lit(1)) == "1", e["e"]).otherwise(0.0)))
    keep = [tops.alias("tops"), norm.alias("norm")] + ([sums.alias("sums")] if conf_mode == 2 else [])
    g, n_tup = NB.materialize(g.select("_fk", *keep))
    g = df.select(id_col, fk.alias("_fk")).join(NB.maybe_broadcast(g, n_tup * (L if conf_mode == 2 else 1)), "_fk").drop("_fk")
    best = tied_best(F.col("tops"), F.col(id_col), seed)
    g = g.select(id_col, "norm", *(["sums"] if conf_mode == 2 else []), best["t"].alias("best"), (best["e"] / F.col("norm")).alias("pbest"))
    bbits = LS.from_bits("best")
    if conf_mode == 0:
        conf = bbits.cast("array<double>")
    elif conf_mode == 1:
        conf = F.transform(bbits, lambda b: F.when(b == 1, F.col("pbest")).otherwise(1 - F.col("pbest")))
    else:
        conf = F.transform("sums", lambda x: x / F.col("norm"))
    if threshold is None:
        return g.select(id_col, conf.alias("conf"), bbits.alias("bip"))
    # one array of (conf, bip) pairs, so the conf expression is evaluated once per row
    cb = F.transform(conf, lambda c: F.struct(c.alias("c"), (c > F.lit(threshold)).cast("int").alias("b")))
    out = g.select(id_col, cb.alias("_cb"))
    return out.select(id_col, F.col("_cb.c").alias("conf"), F.col("_cb.b").alias("bip"))


# ------------------------------------------------------------------ classifier chain


def fit_cc(mlf: MLFrame, chain: list[int] | None = None, train: DataFrame | None = None, base=None, weight: str | None = None):
    """Link k predicts label chain[k] from the features and the *true* labels chain[:k]
    (label features named '__lab<j>'); all links from one count keyed by ``link``.  ``weight`` names a column of
    row weights (bags; rows of weight 0 are left out); ``base`` another base learner than naive Bayes (``tree.TreeBase``)."""
    train = mlf.df if train is None else train
    chain = list(range(mlf.L)) if chain is None else list(chain)
    if base is not None:
        from polytag.operators import tree as TREE

        w = F.sum(F.col(weight).cast("double")) if weight else F.count(F.lit(1)).cast("double")
        c = train.groupBy(*mlf.features, mlf.y_col).agg(w.alias("_w")).filter("_w > 0")
        keys = train.sparkSession.range(len(chain)).select(F.col("id").cast("int").alias("link"))
        m = base.fit(TREE.chain_rows(base, c, mlf.features, mlf.y_col, mlf.L, chain), ["link"], list(mlf.features), keys, more=mlf.L)
        m.chain = chain
        return m
    order = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(chain)])
    links = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(lab).alias("lab")) for k, lab in enumerate(chain)])
    # rows that agree in the features and the chain's labels count once, with their total weight
    own = F.array(*[F.get(mlf.y_col, F.lit(j)) if j in chain else F.lit(None).cast("int") for j in range(mlf.L)])
    x = train.select(*mlf.features, own.alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    x = x.groupBy(*mlf.features, "_y").agg(F.sum("_w").alias("_w")).filter("_w > 0")
    extra = ["_w"]
    x = x.select(NB.feature_pairs(mlf.features).alias("_b"), "_y", *extra, F.explode(links).alias("ln"))
    prev = F.transform(
        F.filter(order, lambda e: e["i"] < F.col("ln.k")),
        lambda e: F.struct(F.concat(F.lit("__lab"), e["c"].cast("string")).alias("f"), F.get("_y", e["c"]).cast("string").alias("v")),
    )
    rows = x.select(F.col("ln.k").cast("int").alias("link"), F.get("_y", F.col("ln.lab")).alias("t"), *extra,
                    F.filter(F.concat("_b", prev), lambda p: p["v"].isNotNull()).alias("_fv")).filter(F.col("t").isNotNull())
    spark = train.sparkSession
    classes = _binary_classes(spark, spark.range(len(chain)).select(F.col("id").cast("int").alias("link")))
    m = NB.fit_nb(rows, ["link"], list(mlf.features), classes, weight="_w", pairs="_fv")
    m.chain = chain  # type: ignore[attr-defined]
    return m


def predict_cc(model: NB.NBModel, df: DataFrame, L: int, id_col: str = "id") -> DataFrame:
    """(id, conf ARRAY, bip ARRAY) in label order.  The chain runs as one ``aggregate`` over the links
    with a literal coefficient array: state = predictions so far; link k adds the weights of the
    *predicted* earlier labels.  The plan stays flat whatever the chain length.  The chain runs
    once per distinct feature tuple (its output depends only on the features); rows join back."""
    if not isinstance(model, NB.NBModel):
        from polytag.operators import tree as TREE

        return TREE.predict_chain(model, df, L, model.chain, id_col)
    return on_feature_tuples(model.features, df, id_col, lambda t, k: _predict_cc(model, t, L, k))


def _predict_cc(model: NB.NBModel, df: DataFrame, L: int, id_col: str) -> DataFrame:
    chain = model.chain  # type: ignore[attr-defined]
    n = len(chain)
    base_w = model.weights.filter(~F.col("f").startswith("__lab"))
    W = {}
    for r in model.weights.filter(F.col("f").startswith("__lab")).collect():  # at most n x L x 2 x 2 cells
        W[(r["link"], int(r["f"][5:]), int(r["v"]), r["t"])] = float(r["w"])
    w4 = F.array(*[F.array(*[F.array(*[F.lit(W.get((k, i, v, t), 0.0)) for v in (0, 1) for t in (0, 1)]) for i in range(L)])
                   for k in range(n)])
    ck = [[0.0, 0.0] for _ in range(n)]
    for r in model.const:
        ck[r["link"]][r["t"]] = float(r["kc"])
    cka = F.array(*[F.array(F.lit(c[0]), F.lit(c[1])) for c in ck])
    fl = df.select(id_col, F.explode(NB.feature_pairs(model.features)).alias("p")).select(id_col, "p.f", "p.v")
    m = fl.join(NB.maybe_broadcast(base_w, model.n_weights), ["f", "v"]).select(id_col, "link", "t", "w")
    zero = df.select(id_col, F.lit(0).alias("link"), F.lit(0).alias("t"), F.lit(0.0).alias("w"))
    g = m.unionByName(zero).groupBy(id_col).agg(
        F.array(*[F.sum(F.when((F.col("link") == k) & (F.col("t") == 0), F.col("w")).otherwise(0.0)) for k in range(n)]).alias("b0"),
        F.array(*[F.sum(F.when((F.col("link") == k) & (F.col("t") == 1), F.col("w")).otherwise(0.0)) for k in range(n)]).alias("b1"),
    )
    chain_lit = F.array(*[F.lit(c) for c in chain])
    init = F.struct(F.array_repeat(F.lit(-1), L).alias("pred"), F.array_repeat(F.lit(0.0), L).alias("conf"))

    def step(acc, k):
        lab = F.get(chain_lit, k)
        prevs = F.filter(F.sequence(F.lit(0), F.lit(L - 1)), lambda i: F.get(acc["pred"], i) >= 0)

        def lw(t):
            return F.aggregate(prevs, F.lit(0.0), lambda a, i: a + F.get(F.get(F.get(w4, k), i), F.get(acc["pred"], i) * 2 + t))

        s0 = F.get(F.get(cka, k), 0) + F.get(F.col("b0"), k) + lw(0)
        s1 = F.get(F.get(cka, k), 1) + F.get(F.col("b1"), k) + lw(1)
        p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(s0 - s1))
        yhat = (s1 >= s0).cast("int")
        return F.struct(
            F.transform(acc["pred"], lambda v, i: F.when(i == lab, yhat).otherwise(v)).alias("pred"),
            F.transform(acc["conf"], lambda v, i: F.when(i == lab, p1).otherwise(v)).alias("conf"),
        )

    res = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), init, step)
    return g.select(id_col, res["conf"].alias("conf"), F.transform(res["pred"], lambda v: F.greatest(v, F.lit(0))).alias("bip"))


# ------------------------------------------------------------------ pairwise family


def fit_pairwise(mlf: MLFrame, train: DataFrame | None = None) -> NB.NBModel:
    """One model per label pair a < b on the rows where exactly one of the two is set (class 1 = a set);
    all pairs from one count.  Pairs without rows get no model."""
    train = mlf.df if train is None else train
    c = compact_rows(train, mlf.features, mlf.y_col)
    y = F.col(mlf.y_col)
    idx = F.sequence(F.lit(0), F.lit(mlf.L - 1))
    x = c.select(*mlf.features, "_w", mlf.y_col, F.explode(idx).alias("a"))
    x = x.select(*mlf.features, "_w", mlf.y_col, "a", F.explode(F.filter(idx, lambda b: b > F.col("a"))).alias("b"))
    ta, tb = F.get(y, F.col("a")), F.get(y, F.col("b"))
    rows = x.filter(ta != tb).select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), ta.alias("t"),
                                     *mlf.features, "_w")
    keys = rows.select("a", "b").distinct()
    classes = keys.select("a", "b", F.explode(F.array(F.lit(0), F.lit(1))).alias("t"))
    return NB.fit_nb(rows, ["a", "b"], list(mlf.features), classes, weight="_w")


def pairwise_votes(model: NB.NBModel, df: DataFrame, L: int, soft: bool = False, id_col: str = "id") -> DataFrame:
    """(id, votes ARRAY<DOUBLE>): each pair model gives its vote to a (P(1) >= P(0)) or to b
    (hard), or P(1) to a and P(0) to b (soft)."""
    p = NB.nb_binary_scores(model, df, id_col)
    va = F.col("p1") if soft else (F.col("s1") >= F.col("s0")).cast("double")
    vb = (1 - F.col("p1")) if soft else (F.col("s1") < F.col("s0")).cast("double")
    x = p.select(id_col, "a", "b", va.alias("va"), vb.alias("vb"))
    x = x.unionByName(df.select(id_col, F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(0.0).alias("va"), F.lit(0.0).alias("vb")))
    return x.groupBy(id_col).agg(F.array(*[
        F.sum(F.when(F.col("a") == j, F.col("va")).when(F.col("b") == j, F.col("vb")).otherwise(0.0)) for j in range(L)
    ]).alias("votes"))


def predict_pairwise(model: NB.NBModel, df: DataFrame, L: int, soft: bool = False, id_col: str = "id") -> DataFrame:
    """(id, conf ARRAY): votes / (L - 1); a ranking-only output."""
    return on_feature_tuples(model.features, df, id_col, lambda t, k: _predict_pairwise(model, t, L, soft, k))


def _predict_pairwise(model: NB.NBModel, df: DataFrame, L: int, soft: bool, id_col: str) -> DataFrame:
    v = pairwise_votes(model, df, L, soft, id_col)
    return v.select(id_col, F.transform("votes", lambda x: x / F.lit(float(L - 1))).alias("conf"))


def predict_clr(br: NB.NBModel, pw: NB.NBModel, df: DataFrame, L: int, soft: bool = False, id_col: str = "id") -> DataFrame:
    """Calibrated label ranking (see ``_predict_clr``), run once per distinct feature tuple."""
    return on_feature_tuples(br.features, df, id_col, lambda t, k: _predict_clr(br, pw, t, L, soft, k))


def _predict_clr(br: NB.NBModel, pw: NB.NBModel, df: DataFrame, L: int, soft: bool = False, id_col: str = "id") -> DataFrame:
    """Calibrated label ranking: pairwise votes plus a virtual label from BR.  Label j gains one
    vote when BR says yes, else the virtual label gains one; j is positive iff its votes >= the
    virtual label's; conf = votes / L."""
    v = pairwise_votes(pw, df, L, soft, id_col)
    b = to_arrays(predict_br(br, df, id_col), ("conf", "bip"), id_col)
    x = v.join(b, id_col)
    add = F.col("conf") if soft else F.col("bip").cast("array<double>")
    scores = F.zip_with("votes", add, lambda s, a: s + a)
    virt = F.aggregate(F.transform(add, lambda a: 1 - a), F.lit(0.0), lambda s, a: s + a)
    x = x.select(id_col, scores.alias("sc"), virt.alias("virt"))
    return x.select(id_col, F.transform("sc", lambda s: s / F.lit(float(L))).alias("conf"),
                    F.transform("sc", lambda s: (s >= F.col("virt")).cast("int")).alias("bip"))


# ------------------------------------------------------------------ two-stage architectures


def predict_tsva(br: NB.NBModel, pw: NB.NBModel, df: DataFrame, L: int, t: float = 0.2, id_col: str = "id") -> DataFrame:
    """Two-stage voting: a pair model votes only when both labels pass the BR stage (conf > t); if one
    passes it gets the vote, if none both lose a possible vote.  j is positive iff its votes (pairs +
    BR) >= the virtual label's; conf = votes / (L - lost) when positive, else BR conf / L."""
    return on_feature_tuples(br.features, df, id_col,
                             lambda x, k: _two_stage_vote(NB.nb_binary_scores(pw, x, k), br, x, L, t, k))


def conf_bins(conf_col: str, L: int, labels=None, prefix: str = "c") -> F.Column:
    """Binned first-stage confidences as categorical feature pairs (10 equal bins)."""
    labels = range(L) if labels is None else labels
    return F.array(*[F.struct(F.lit(f"{prefix}{j}").alias("f"),
                              F.least(F.floor(F.get(conf_col, F.lit(j)) * 10), F.lit(9)).cast("int").cast("string").alias("v"))
                     for j in labels])


def fit_pairwise_stacked(mlf: MLFrame, br: NB.NBModel, train: DataFrame, pruned: bool) -> NB.NBModel:
    """Pair models that also see first-stage (BR) confidences of the training rows, binned: all of
    them (chain architecture) or only the pair's two (pruned chain)."""
    from polytag.operators import transform as TR

    # the first stage sees the features alone, so rows that agree in features and labels count once
    c = compact_rows(train, mlf.features, mlf.y_col).withColumn("_fk", NB.feature_key(mlf.features))
    first = to_arrays(predict_br(br, c.dropDuplicates(["_fk"]), "_fk"), ("conf",), "_fk")
    sets = mlf.with_df(c.select(F.struct("_fk", "_w").alias(mlf.id_col), *mlf.features, mlf.y_col))
    pw = TR.pairwise(sets).select(F.col(f"{mlf.id_col}._fk").alias("_fk"), F.col(f"{mlf.id_col}._w").alias("_w"), "a", "b",
                                  F.col("class").alias("t"), *mlf.features).join(first, "_fk")
    base = NB.feature_pairs(mlf.features)
    if pruned:
        extra = F.array(
            F.struct(F.lit("ca").alias("f"), F.least(F.floor(F.get("conf", F.col("a")) * 10), F.lit(9)).cast("int").cast("string").alias("v")),
            F.struct(F.lit("cb").alias("f"), F.least(F.floor(F.get("conf", F.col("b")) * 10), F.lit(9)).cast("int").cast("string").alias("v")))
    else:
        extra = conf_bins("conf", mlf.L)
    rows = pw.select("a", "b", "t", "_w", F.concat(base, extra).alias("_fv"))
    classes = rows.select("a", "b").distinct().select("a", "b", F.explode(F.array(F.lit(0), F.lit(1))).alias("t"))
    m = NB.fit_nb(rows, ["a", "b"], list(mlf.features), classes, weight="_w", pairs="_fv")
    m.pruned = pruned  # type: ignore[attr-defined]
    return m


def predict_two_stage_chain(br: NB.NBModel, pw: NB.NBModel, df: DataFrame, L: int, t: float = 0.2, id_col: str = "id") -> DataFrame:
    """As two-stage voting, with pair models scored on features + binned BR confidences; once per distinct feature tuple."""
    return on_feature_tuples(br.features, df, id_col, lambda x, k: _predict_two_stage_chain(br, pw, x, L, t, k))


def _predict_two_stage_chain(br: NB.NBModel, pw: NB.NBModel, df: DataFrame, L: int, t: float, id_col: str) -> DataFrame:
    c = to_arrays(predict_br(br, df, id_col), ("conf",), id_col)
    x = df.join(c, id_col)
    feats = pw.features
    if pw.pruned:  # type: ignore[attr-defined]
        # pair-specific features: score per pair row (id, a, b)
        pairs = pw.weights.select("a", "b").distinct().collect()
        parr = F.array(*[F.struct(F.lit(r["a"]).alias("a"), F.lit(r["b"]).alias("b")) for r in pairs])
        rows = x.select(id_col, "conf", *feats, F.explode(parr).alias("pr"))
        fv = F.concat(NB.feature_pairs(feats), F.array(
            F.struct(F.lit("ca").alias("f"), F.least(F.floor(F.get("conf", F.col("pr.a")) * 10), F.lit(9)).cast("int").cast("string").alias("v")),
            F.struct(F.lit("cb").alias("f"), F.least(F.floor(F.get("conf", F.col("pr.b")) * 10), F.lit(9)).cast("int").cast("string").alias("v"))))
        fl = rows.select(id_col, F.col("pr.a").alias("a"), F.col("pr.b").alias("b"), F.explode(fv).alias("p")).select(id_col, "a", "b", "p.f", "p.v")
        m = fl.join(NB.maybe_broadcast(pw.weights, pw.n_weights), ["a", "b", "f", "v"]).select(id_col, "a", "b", "t", F.col("w").alias("x"))
    else:
        fv = F.concat(NB.feature_pairs(feats), conf_bins("conf", L))
        fl = x.select(id_col, F.explode(fv).alias("p")).select(id_col, "p.f", "p.v")
        m = fl.join(NB.maybe_broadcast(pw.weights, pw.n_weights), ["f", "v"]).select(id_col, "a", "b", "t", F.col("w").alias("x"))
    base = df.select(id_col, F.explode(pw.const_array()).alias("c")).select(id_col, "c.a", "c.b", "c.t", F.col("c.kc").alias("x"))
    s = m.unionByName(base).groupBy(id_col, "a", "b").agg(
        F.sum(F.when(F.col("t") == 1, F.col("x"))).alias("s1"), F.sum(F.when(F.col("t") == 0, F.col("x"))).alias("s0"))
    return _two_stage_vote(s, br, df, L, t, id_col)


def _two_stage_vote(s: DataFrame, br: NB.NBModel, df: DataFrame, L: int, t: float, id_col: str) -> DataFrame:
    b = to_arrays(predict_br(br, df, id_col), ("conf", "bip"), id_col)
    x = s.join(b, id_col)
    ca, cb = F.get("conf", F.col("a")), F.get("conf", F.col("b"))
    both = (ca > t) & (cb > t)
    va = F.when(both, (F.col("s1") >= F.col("s0")).cast("int")).when(ca > t, 1).otherwise(0)
    vb = F.when(both, (F.col("s1") < F.col("s0")).cast("int")).when(ca > t, 0).when(cb > t, 1).otherwise(0)
    nv = F.when(~(ca > t) & ~(cb > t), 1).otherwise(0)
    x = x.select(id_col, "a", "b", va.alias("va"), vb.alias("vb"), nv.alias("nv"))
    x = x.unionByName(df.select(id_col, F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("va"), F.lit(0).alias("vb"), F.lit(0).alias("nv")))
    g = x.groupBy(id_col).agg(
        F.array(*[F.sum(F.when(F.col("a") == j, F.col("va")).when(F.col("b") == j, F.col("vb")).otherwise(0)) for j in range(L)]).alias("votes"),
        F.array(*[F.sum(F.when((F.col("a") == j) | (F.col("b") == j), F.col("nv")).otherwise(0)) for j in range(L)]).alias("novote"),
    ).join(b, id_col)
    votes = F.zip_with("votes", "bip", lambda v, bb: v + bb)
    virt = F.aggregate(F.col("bip"), F.lit(0), lambda acc, bb: acc + (1 - bb))
    g = g.select(id_col, votes.alias("v"), virt.alias("virt"), "novote", "conf")
    conf = F.transform(F.sequence(F.lit(0), F.lit(L - 1)), lambda j: F.when(
        F.get("v", j) >= F.col("virt"), F.get("v", j).cast("double") / (F.lit(L) - F.get("novote", j))).otherwise(F.get("conf", j) / F.lit(float(L))))
    return g.select(id_col, conf.alias("conf"), F.transform("v", lambda v: (v >= F.col("virt")).cast("int")).alias("bip"))


# ------------------------------------------------------------------ include labels, multi-class


def fit_include_labels(mlf: MLFrame, train: DataFrame) -> NB.NBModel:
    """One binary model over (features + label name) rows."""
    from polytag.operators import transform as TR

    rows = TR.include_labels(mlf.with_df(train)).filter(F.col("class").isNotNull())
    rows = rows.select(*mlf.features, "label", F.col("class").alias("t"))
    return NB.fit_nb(rows, [], [*mlf.features, "label"], classes=train.sparkSession.range(2).select(F.col("id").cast("int").alias("t")))


def predict_include_labels(model: NB.NBModel, mlf: MLFrame, df: DataFrame) -> DataFrame:
    """(id, j, conf, bip): the single model scored once per (row, label); positive iff P(1) >= P(0)."""
    names = F.array(*[F.lit(n) for n in mlf.labels])
    x = df.select(mlf.id_col, *mlf.features, F.posexplode(names).alias("j", "label"))
    x = x.withColumn("_rid", F.struct(F.col(mlf.id_col).alias("id"), "j"))
    p = NB.nb_binary_scores(model, x, "_rid")
    return p.select(F.col("_rid.id").alias(mlf.id_col), F.col("_rid.j").cast("int").alias("j"),
                    F.col("p1").alias("conf"), (F.col("s1") >= F.col("s0")).cast("int").alias("bip"))


def fit_multiclass(mlf: MLFrame, train: DataFrame, kind: str = "copy_weight") -> NB.NBModel:
    """Single-label model on a multi-class transformation (copy, copy_weight, ignore, select_max,
    select_min, select_random); class = label index."""
    from polytag.operators import transform as TR

    m2 = mlf.with_df(train)
    if kind == "copy":
        rows, w = TR.copy(m2), None
    elif kind == "copy_weight":
        rows, w = TR.copy(m2, weighted=True), "weight"
    elif kind == "ignore":
        rows, w = TR.ignore(m2), None
    elif kind in ("select_max", "select_min"):
        rows, w = TR.select_by_frequency(m2, most=kind == "select_max"), None
    else:
        rows, w = TR.select_random(m2), None
    rows = rows.withColumn("t", F.col("j"))
    return NB.fit_nb(rows, [], list(mlf.features), weight=w)


def predict_multiclass(model: NB.NBModel, df: DataFrame, L: int, id_col: str = "id") -> DataFrame:
    """(id, conf ARRAY): posterior of each label's class (0 for a class never trained); ranking only."""

    def scored(tup: DataFrame, key: str) -> DataFrame:
        s = NB.nb_scores(model, tup, key)
        g = s.groupBy(key).agg(F.max("s").alias("mx"), F.collect_list(F.struct("t", "s")).alias("cs"))
        g = g.select(key, F.transform("cs", lambda e: F.struct(e["t"].alias("t"), F.exp(e["s"] - F.col("mx")).alias("e"))).alias("ps"))
        g = g.select(key, "ps", F.aggregate("ps", F.lit(0.0), lambda a, e: a + e["e"]).alias("norm"))
        conf = F.transform(F.sequence(F.lit(0), F.lit(L - 1)), lambda j: F.aggregate(
            "ps", F.lit(0.0), lambda a, e: a + F.when(e["t"] == j, e["e"]).otherwise(0.0)) / F.col("norm"))
        return g.select(key, conf.alias("conf"))

    return on_feature_tuples(model.features, df, id_col, scored)


# ------------------------------------------------------------------ label-subset learners (RAkEL family)


def fit_subsets(mlf: MLFrame, groups: list[list[int]], train: DataFrame) -> NB.NBModel:
    """One label-powerset model per label group (a single-label group is a binary model); all
    groups from one count keyed by ``g``."""
    gl = F.array(*[F.struct(F.lit(i).alias("g"), F.array(*[F.lit(j) for j in grp]).alias("labs")) for i, grp in enumerate(groups)])
    x = compact_rows(train.filter(~F.exists(mlf.y_col, lambda v: v.isNull())), mlf.features, mlf.y_col)
    x = x.select(*mlf.features, mlf.y_col, "_w", F.explode(gl).alias("gr"))
    rows = x.select(F.col("gr.g").alias("g"), LS.bits(F.transform("gr.labs", lambda j: F.get(mlf.y_col, j))).alias("t"), "_w", *mlf.features)
    m = NB.fit_nb(rows, ["g"], list(mlf.features), weight="_w")
    m.groups = groups  # type: ignore[attr-defined]
    return m


def predict_subsets(model: NB.NBModel, df: DataFrame, L: int, threshold: float = 0.5, seed: int = 7, id_col: str = "id") -> DataFrame:
    """(id, conf ARRAY, bip ARRAY): each group's best label set (ties: seeded hash) votes for its labels;
    conf = vote share over the groups containing the label, bip = share >= threshold (a partition
    gives the group's own decision); a label in no group gets 0."""
    groups = model.groups  # type: ignore[attr-defined]
    fk = NB.feature_key(model.features)
    tup = df.select(fk.alias("_fk"), *model.features).dropDuplicates(["_fk"])
    s = NB.nb_scores(model, tup, "_fk")
    mx = s.groupBy("_fk", "g").agg(F.max("s").alias("mx"), F.collect_list(F.struct("t", F.col("s").alias("e"))).alias("cs"))
    tops = ranked_classes(model, F.filter("cs", lambda e: e["e"] == F.col("mx")), F.col("g"))
    # a group with one best set votes alike for all rows of a tuple; a row only breaks the ties of the others
    labs = F.array(*[F.array(*[F.lit(j) for j in grp]) for grp in groups])
    mx = mx.select("_fk", F.get(labs, F.col("g")).alias("lab"), tops.alias("tops"))

    def vote(j, lab, bits):
        at = F.array_position(lab, j).cast("int")
        return F.when(at > 0, bits.substr(at, F.lit(1)).cast("double")).otherwise(0.0)

    alone = F.size("tops") == 1
    per = mx.groupBy("_fk").agg(
        F.array(*[F.sum(F.when(alone, vote(F.lit(j), F.col("lab"), F.get("tops", F.lit(0))["t"])).otherwise(0.0)) for j in range(L)]).alias("votes"),
        F.collect_list(F.when(~alone, F.struct("lab", "tops"))).alias("tied"))
    per, n_tup = NB.materialize(tup.select("_fk").join(per, "_fk", "left").select(
        "_fk", F.coalesce("votes", F.array_repeat(F.lit(0.0), L)).alias("votes"), "tied"))
    g = df.select(id_col, fk.alias("_fk")).join(NB.maybe_broadcast(per, n_tup), "_fk")
    drawn = F.transform(F.coalesce("tied", F.array()), lambda e: F.struct(e["lab"].alias("lab"), tied_best(e["tops"], F.col(id_col), seed)["t"].alias("t")))
    g = g.select(id_col, "votes", drawn.alias("drawn")).select(id_col, F.transform("votes", lambda v, j: F.aggregate(
        "drawn", v, lambda a, e: a + vote(j, e["lab"], e["t"]))).alias("votes"))
    cover = [sum(1 for grp in groups if j in grp) for j in range(L)]
    conf = F.transform("votes", lambda v, j: F.when(F.get(F.array(*[F.lit(c) for c in cover]), j) > 0,
                                                    v / F.get(F.array(*[F.lit(float(c)) for c in cover]), j)).otherwise(0.0))
    out = g.select(id_col, conf.alias("conf"))
    return out.withColumn("bip", F.transform("conf", lambda c: (c >= F.lit(threshold)).cast("int")))


def rakel_subsets(L: int, k: int = 3, m: int | None = None, seed: int = 1) -> list[list[int]]:
    """m distinct random k-label subsets (default m = min(2L, C(L, k))); label-sized, seeded."""
    import math
    import random

    total = math.comb(L, k)
    m = min(2 * L, total) if m is None else min(m, total)
    rnd = random.Random(seed)
    seen, out = set(), []
    while len(out) < m:
        c = tuple(sorted(rnd.sample(range(L), k)))
        if c not in seen:
            seen.add(c)
            out.append(list(c))
    return out


def rakeld_partition(L: int, k: int = 3, seed: int = 1) -> list[list[int]]:
    """Random disjoint partition into groups of k; a remainder of one label joins the last group."""
    import random

    idx = list(range(L))
    random.Random(seed).shuffle(idx)
    groups = [sorted(idx[i:i + k]) for i in range(0, L, k)]
    if len(groups) > 1 and len(groups[-1]) == 1:
        groups[-2] = sorted(groups[-2] + groups.pop())
    return groups


def nb_argmax(model: NB.NBModel, df: DataFrame, seed: int = 7, id_col: str = "id") -> DataFrame:
    """(id, t): the most probable class of a single multi-class model (ties: seeded stable hash of
    the class position)."""
    fk = NB.feature_key(model.features)
    tup = df.select(fk.alias("_fk"), *model.features).dropDuplicates(["_fk"])
    s = NB.nb_scores(model, tup, "_fk")
    g = s.groupBy("_fk").agg(F.max("s").alias("mx"), F.collect_list(F.struct("t", F.col("s").alias("e"))).alias("cs"))
    g, n = NB.materialize(g.select("_fk", ranked_classes(model, F.filter("cs", lambda e: e["e"] == F.col("mx"))).alias("tops")))
    rows = df.select(id_col, fk.alias("_fk")).join(NB.maybe_broadcast(g, n), "_fk")
    return rows.select(id_col, tied_best(F.col("tops"), F.col(id_col), seed)["t"].alias("t"))


def fit_meta_labeler(mlf: MLFrame, train: DataFrame) -> NB.NBModel:
    """Meta-labeler (content mode, nominal class): predicts the number of labels from the features."""
    rows = train.filter(~F.exists(mlf.y_col, lambda v: v.isNull())).select(*mlf.features, LS.size(mlf.y_col).alias("t"))
    return NB.fit_nb(rows, [], list(mlf.features))


# ------------------------------------------------------------------ hierarchy: HMC and HOMER


def tree_parents(tree: DataFrame) -> dict[int, int | None]:
    """idx -> parent idx from a label-tree edge table (label-sized)."""
    return {r["idx"]: r["parent_idx"] for r in tree.select("idx", "parent_idx").collect()}


def fit_hmc(mlf: MLFrame, train: DataFrame, parents: dict[int, int | None]) -> NB.NBModel:
    """One binary model per tree node, trained on the rows where its parent is set (all rows for
    top nodes); every node from one count keyed by ``j``.  ``mlf.y`` must hold every node."""
    under = lambda j: F.lit(True) if parents.get(j) is None else F.get(mlf.y_col, F.lit(parents[j])) == 1
    x = label_counts(train, mlf.features, mlf.y_col, mlf.L, under)
    spark = train.sparkSession
    classes = _binary_classes(spark, spark.range(mlf.L).select(F.col("id").cast("int").alias("j")))
    return NB.fit_nb(x, ["j"], list(mlf.features), classes, weight="_w")


def predict_hmc(model: NB.NBModel, df: DataFrame, L: int, parents: dict[int, int | None], id_col: str = "id") -> DataFrame:
    """Top-down: a node is positive iff its own model says so and its parent is positive; under a
    negative node every descendant is negative and takes that node's confidence.  (The reference
    leaves a rejected node's own confidence at 0; here it keeps its model's confidence.)  Once per distinct feature tuple."""
    return on_feature_tuples(model.features, df, id_col, lambda t, k: _predict_hmc(model, t, L, parents, k))


def _predict_hmc(model: NB.NBModel, df: DataFrame, L: int, parents: dict[int, int | None], id_col: str) -> DataFrame:
    depth = {}

    def dep(j):
        if j not in depth:
            p = parents.get(j)
            depth[j] = 1 if p is None else dep(p) + 1
        return depth[j]

    order = sorted(range(L), key=lambda j: (dep(j), j))
    b = to_arrays(predict_br(model, df, id_col), ("conf", "bip"), id_col)
    par = F.array(*[F.lit(-1 if parents.get(j) is None else parents[j]) for j in range(L)])
    init = F.struct(F.array_repeat(F.lit(0.0), L).alias("c"), F.array_repeat(F.lit(0), L).alias("b"))

    def step(acc, j):
        p = F.get(par, j)
        ok = (p < 0) | (F.get(acc["b"], p) == 1)
        cj = F.when(ok, F.get("conf", j)).otherwise(F.get(acc["c"], p))
        bj = F.when(ok, F.get("bip", j)).otherwise(F.lit(0))
        return F.struct(F.transform(acc["c"], lambda v, i: F.when(i == j, cj).otherwise(v)).alias("c"),
                        F.transform(acc["b"], lambda v, i: F.when(i == j, bj).otherwise(v)).alias("b"))

    res = F.aggregate(F.array(*[F.lit(j) for j in order]), init, step)
    return b.select(id_col, res["c"].alias("conf"), res["b"].alias("bip"))


def with_meta_labels(mlf: MLFrame, tree: DataFrame) -> tuple[MLFrame, dict[int, int | None]]:
    """Append one label per inner node of ``tree`` = OR of the leaf labels below it (any depth)."""
    parents = tree_parents(tree)
    kids: dict[int, list[int]] = {}
    for c, p in parents.items():
        if p is not None:
            kids.setdefault(p, []).append(c)
    inner = sorted(k for k in kids if k >= mlf.L)

    def leaves(n):
        if n < mlf.L:
            return [n]
        return [x for c in kids.get(n, []) for x in leaves(c)]

    y = F.col(mlf.y_col)
    meta = [F.greatest(*[F.coalesce(y[x], F.lit(0)) for x in leaves(n)], F.lit(0)) for n in inner]
    # re-index inner nodes to L, L+1, ... in sorted order
    remap = {n: mlf.L + i for i, n in enumerate(inner)}
    par2 = {remap.get(c, c): (None if p is None else remap.get(p, p)) for c, p in parents.items()}
    df = mlf.df.withColumn(mlf.y_col, F.concat(y, F.array(*meta)))
    return mlf.with_df(df, labels=tuple(mlf.labels) + tuple(f"meta{n}" for n in inner)), par2


def homer(mlf: MLFrame, train: DataFrame, k: int = 3, method: str = "balanced", seed: int = 1) -> DataFrame:
    """HOMER: build a label tree, add meta-labels, run HMC, drop the meta outputs."""
    from polytag.operators import cluster as CL

    tree = CL.label_tree(mlf.with_df(train), k, method, seed)
    hm, par = with_meta_labels(mlf, tree)
    tr2 = hm.df.join(train.select(mlf.id_col), mlf.id_col)
    model = fit_hmc(hm, tr2, par)
    out = predict_hmc(model, hm.df, hm.L, par)
    return out.select(mlf.id_col, F.slice("conf", 1, mlf.L).alias("conf"), F.slice("bip", 1, mlf.L).alias("bip"))


# ------------------------------------------------------------------ chains over clusters and ensembles


def predict_chains(mlf: MLFrame, train: DataFrame, chains: list[list[int]], df: DataFrame) -> DataFrame:
    """One local chain per label group (each label in exactly one chain); outputs scattered back by
    label index and summed across chains."""
    models = [fit_cc(mlf, ch, train) for ch in chains if ch]
    return on_feature_tuples(mlf.features, df, mlf.id_col, lambda t, k: _scattered(mlf, models, t, k))


def _scattered(mlf: MLFrame, models: list, df: DataFrame, id_col: str) -> DataFrame:
    out = df.select(id_col)
    for i, m in enumerate(models):
        out = out.join(_predict_cc(m, df, mlf.L, id_col).select(id_col, F.col("conf").alias(f"c{i}"), F.col("bip").alias(f"b{i}")), id_col)
    owner = {lab: i for i, m in enumerate(models) for lab in m.chain}
    conf = F.array(*[F.get(f"c{owner[j]}", F.lit(j)) if j in owner else F.lit(0.0) for j in range(mlf.L)])
    bip = F.array(*[F.get(f"b{owner[j]}", F.lit(j)) if j in owner else F.lit(0) for j in range(mlf.L)])
    return out.select(id_col, conf.alias("conf"), bip.alias("bip"))


def clustered_chains(mlf: MLFrame, train: DataFrame, k: int = 3, iters: int = 100, seed: int = 1, init: list | None = None) -> DataFrame:
    """Cluster the labels by cosine k-modes, order each cluster farthest-from-centre first and fit one
    local chain per cluster (the chain sees only its own cluster's labels: no leak of other clusters)."""
    from polytag.operators import cluster as CL

    cl = CL.kmodes_cosine(mlf.with_df(train), k, iters, 0, seed, init).collect()
    chains: dict[int, list[tuple[int, int]]] = {}
    for r in cl:
        chains.setdefault(r["cluster"], []).append((r["pos"], r["j"]))
    ordered = [[j for _, j in sorted(v)] for _, v in sorted(chains.items())]
    return predict_chains(mlf, train, ordered, mlf.df)


def ecc(mlf: MLFrame, train: DataFrame, m: int = 5, use_conf: bool = True, seed: int = 1) -> DataFrame:
    """Ensemble of classifier chains: m random label orders, each on a Poisson(1) bag of the training
    rows (weights from a seeded hash, no row moves); conf = mean confidence (or vote share), bip at 0.5."""
    import random

    from polytag.functions.labelsets import MINSTD_M, stable_hash2
    from polytag.operators.split import poisson1_thresholds

    rnd = random.Random(seed)

    def weight(i):
        u = stable_hash2(mlf.id_col, F.lit(i), seed) / F.lit(float(MINSTD_M))
        return sum(F.when(u >= F.lit(t), 1).otherwise(0) for t in poisson1_thresholds()).cast("double")

    # one pass over the rows gives the weights of all bags
    bags, _ = NB.materialize(train.groupBy(*mlf.features, mlf.y_col).agg(*[F.sum(weight(i)).alias(f"_bw{i}") for i in range(m)]))
    models = []
    for i in range(m):
        chain = list(range(mlf.L))
        rnd.shuffle(chain)
        models.append(fit_cc(mlf, chain, bags, weight=f"_bw{i}"))

    def mean_of_chains(tup: DataFrame, key: str) -> DataFrame:
        x = tup.select(key)
        for i, model in enumerate(models):
            p = _predict_cc(model, tup, mlf.L, key)
            x = x.join(p.select(key, (F.col("conf") if use_conf else F.col("bip").cast("array<double>")).alias(f"v{i}")), key)
        mean = F.array(*[sum(F.get(f"v{i}", F.lit(j)) for i in range(m)) / F.lit(float(m)) for j in range(mlf.L)])
        return x.select(key, mean.alias("conf"))

    x = on_feature_tuples(mlf.features, mlf.df, mlf.id_col, mean_of_chains)
    return x.withColumn("bip", LS.bipartition("conf", 0.5))


def eps(mlf: MLFrame, train: DataFrame, m: int = 5, pct: float = 66.0, p: int = 30, b: int = 2, seed: int = 1) -> DataFrame:
    """Ensemble of pruned sets: m pruned-set models on random pct % subsets; conf = vote share, bip >= 0.5."""
    from polytag.functions.labelsets import MINSTD_M, stable_hash2
    from polytag.operators import transform as TR

    outs = []
    for i in range(m):
        u = stable_hash2(mlf.id_col, F.lit(i), seed) / F.lit(float(MINSTD_M))
        sub = train.filter(u * 100 < F.lit(pct))
        pr = TR.prune_ps(mlf.with_df(sub), p=p, strategy="A", b=b)
        model = fit_lp(mlf, sub, pruned=pr)
        outs.append(predict_lp(model, mlf.df, mlf.L, conf_mode=2).select("id", F.col("bip").alias(f"v{i}")))
    x = outs[0]
    for o in outs[1:]:
        x = x.join(o, "id")
    share = F.array(*[sum(F.get(f"v{i}", F.lit(j)) for i in range(m)) / F.lit(float(m)) for j in range(mlf.L)])
    x = x.select("id", share.alias("conf"))
    return x.withColumn("bip", LS.bipartition("conf", 0.5))


# ------------------------------------------------------------------ stacking, IBLR, clustering-based, CSS


def _fold_keyed_br(mlf: MLFrame, train: DataFrame, folds: int, seed: int) -> tuple[NB.NBModel, DataFrame, DataFrame]:
    """BR models for every fold at once: a row counts for every fold but its own (model key
    (fold, j)); returns the model, the training rows with their fold, and these compacted: (features..., y, _fold, _w)."""
    from polytag.functions.labelsets import stable_hash

    tr = train.withColumn("_fold", F.pmod(stable_hash(mlf.id_col, seed), F.lit(folds)).cast("int"))
    c, _ = NB.materialize(compact_rows(tr, [*mlf.features, "_fold"], mlf.y_col))
    x = c.select(*mlf.features, "_fold", "_w", F.posexplode(mlf.y_col).alias("j", "t")).filter(F.col("t").isNotNull())
    x = x.select(*mlf.features, "_w", F.col("j").cast("int").alias("j"), "t",
                 F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("_fold"))).alias("fold"))
    spark = train.sparkSession
    keys = spark.range(folds).select(F.col("id").cast("int").alias("fold")).select("fold", F.explode(F.sequence(F.lit(0), F.lit(mlf.L - 1))).alias("j"))
    classes = _binary_classes(spark, keys)
    return NB.fit_nb(x, ["fold", "j"], list(mlf.features), classes, weight="_w"), tr, c


def _fold_confs(model: NB.NBModel, c: DataFrame) -> DataFrame:
    """(_fk, _fold, conf ARRAY): every feature tuple scored by the BR models of every fold."""
    tup = c.select(NB.feature_key(model.features).alias("_fk"), *model.features).dropDuplicates(["_fk"])
    p = NB.nb_binary_scores(model, tup, "_fk").select(F.struct("_fk", "fold").alias("_at"), "j", F.col("p1").alias("conf"))
    return to_arrays(p, ("conf",), "_at").select("_at._fk", F.col("_at.fold").alias("_fold"), "conf")


def out_of_fold_br(mlf: MLFrame, train: DataFrame, folds: int = 3, seed: int = 1) -> DataFrame:
    """(id, conf ARRAY): every training row scored by the BR model that did not see it; all fold
    models come from one count (the fold is part of the model key)."""
    model, tr, c = _fold_keyed_br(mlf, train, folds, seed)
    conf, n = NB.materialize(_fold_confs(model, c))
    rows = tr.select(mlf.id_col, "_fold", NB.feature_key(mlf.features).alias("_fk"))
    return rows.join(NB.maybe_broadcast(conf, n), ["_fk", "_fold"]).select(mlf.id_col, "conf")


def stacking(mlf: MLFrame, train: DataFrame, folds: int = 3, seed: int = 1, include_features: bool = True) -> DataFrame:
    """Two-level stacking: level 1 BR with out-of-fold confidences; level 2 one model per label on the
    binned level-1 confidences of all labels (+ the features).  Test rows get level-1 confidences
    from the BR fitted on all training rows.  Both levels see a row's features, labels and fold alone, so equal rows count once."""
    model, _, c = _fold_keyed_br(mlf, train, folds, seed)
    tr2 = c.withColumn("_fk", NB.feature_key(mlf.features)).join(_fold_confs(model, c), ["_fk", "_fold"])
    feats = list(mlf.features) if include_features else []
    fv_type = "array<struct<f:string,v:string>>"
    base = (NB.feature_pairs(feats) if feats else F.array()).cast(fv_type)
    bins = conf_bins("conf", mlf.L).cast(fv_type)
    rows = tr2.select("_w", F.concat(base, bins).alias("_fv"), F.posexplode(mlf.y_col).alias("j", "t")).filter(F.col("t").isNotNull())
    spark = train.sparkSession
    classes = _binary_classes(spark, spark.range(mlf.L).select(F.col("id").cast("int").alias("j")))
    lvl2 = NB.fit_nb(rows.withColumn("j", F.col("j").cast("int")), ["j"], feats, classes, weight="_w", pairs="_fv")
    br = fit_br(mlf, train)

    def scored(tup: DataFrame, key: str) -> DataFrame:
        x = tup.join(to_arrays(predict_br(br, tup, key), ("conf",), key), key)
        fl = x.select(key, F.explode(F.concat(base, bins)).alias("p")).select(key, "p.f", "p.v")
        m = fl.join(NB.maybe_broadcast(lvl2.weights, lvl2.n_weights), ["f", "v"]).select(key, "j", "t", F.col("w").alias("x"))
        cst = tup.select(key, F.explode(lvl2.const_array()).alias("c")).select(key, "c.j", "c.t", F.col("c.kc").alias("x"))
        s = m.unionByName(cst).groupBy(key, "j").agg(F.sum(F.when(F.col("t") == 1, F.col("x"))).alias("s1"),
                                                     F.sum(F.when(F.col("t") == 0, F.col("x"))).alias("s0"))
        s = s.select(key, "j", (1 / (1 + F.exp(F.col("s0") - F.col("s1")))).alias("conf"), (F.col("s1") >= F.col("s0")).cast("int").alias("bip"))
        return to_arrays(s, ("conf", "bip"), key)

    return on_feature_tuples(mlf.features, mlf.df, mlf.id_col, scored)


def iblr(mlf: MLFrame, train: DataFrame, k: int = 10, vec: str = "embedding", add_features: bool = False) -> DataFrame:
    """IBLR: neighbour label shares (k neighbours; leave-one-out on the training rows) are the
    inputs of one logistic regression per label (pyspark.ml)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from polytag.operators import knn as KN

    ranges = KN.vector_ranges(train, vec)
    tr_nb = KN.neighbour_label_counts(KN.knn(train, train, k, vec, exclude_self=True, ranges=ranges), train, mlf.L)
    all_nb = KN.neighbour_label_counts(KN.knn(mlf.df, train, k, vec, exclude_self=False, ranges=ranges), train, mlf.L)

    def feats(cnt_df, rows):
        x = rows.join(cnt_df.withColumnRenamed("qid", mlf.id_col), mlf.id_col)
        share = F.transform("cnt", lambda c: c / F.lit(float(k)))
        inp = F.concat(share, F.col(vec).cast("array<double>")) if add_features else share
        return x.select(mlf.id_col, mlf.y_col, array_to_vector(inp).alias("features"))

    tr = feats(tr_nb, train).cache()
    te = feats(all_nb, mlf.df)
    out = te.select(mlf.id_col, "features")
    for j in range(mlf.L):
        lr = LogisticRegression(featuresCol="features", labelCol="label", probabilityCol=f"_p{j}", predictionCol=f"_y{j}",
                                rawPredictionCol=f"_r{j}", maxIter=50)
        model = lr.fit(tr.select("features", F.col(mlf.y_col)[j].cast("double").alias("label")).filter(F.col("label").isNotNull()))
        out = model.transform(out).withColumn(f"_c{j}", vector_to_array(f"_p{j}")[1]).drop(f"_p{j}", f"_y{j}", f"_r{j}")
    tr.unpersist()
    conf = F.array(*[F.col(f"_c{j}") for j in range(mlf.L)])
    return out.select(mlf.id_col, conf.alias("conf")).withColumn("bip", LS.bipartition("conf", 0.5))


def cluster_then_fit(mlf: MLFrame, train: DataFrame, numeric: list[str], k: int = 5, seed: int = 1) -> DataFrame:
    """k-means (pyspark.ml) on numeric features, then one BR model set per cluster, all from one
    count keyed by (cluster, label); each row is scored by its own cluster's models."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    va = VectorAssembler(inputCols=numeric, outputCol="_raw")
    sc = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(va.transform(train))
    km = KMeans(k=k, seed=seed).fit(sc.transform(va.transform(train)))
    lab = lambda d: km.transform(sc.transform(va.transform(d))).select(mlf.id_col, F.col("prediction").cast("int").alias("cluster"))
    trc = train.join(lab(train), mlf.id_col)
    rows = trc.select(*mlf.features, "cluster", F.posexplode(mlf.y_col).alias("j", "t")).filter(F.col("t").isNotNull()).withColumn("j", F.col("j").cast("int"))
    spark = train.sparkSession
    keys = spark.range(k).select(F.col("id").cast("int").alias("cluster")).select("cluster", F.explode(F.sequence(F.lit(0), F.lit(mlf.L - 1))).alias("j"))
    model = NB.fit_nb(rows, ["cluster", "j"], list(mlf.features), _binary_classes(spark, keys))
    allc = mlf.df.join(lab(mlf.df), mlf.id_col)
    p = NB.nb_binary_scores(model, allc, mlf.id_col).join(allc.select(mlf.id_col, F.col("cluster").alias("_c")), mlf.id_col)
    p = p.filter(F.col("cluster") == F.col("_c")).select(mlf.id_col, "j", F.col("p1").alias("conf"), (F.col("s1") >= F.col("s0")).cast("int").alias("bip"))
    return to_arrays(p, ("conf", "bip"), mlf.id_col)


def css_select(mlf: MLFrame, kappa: int | None = None, seed: int = 1):
    """Column subset selection: kappa labels sampled (without replacement, seeded) with probability
    proportional to their leverage in the top-kappa right singular vectors of Y; Y'Y is the Gram
    matrix (one pass), so only L x L numbers are decomposed.  Returns (chosen, leverage, P) with
    P = pinv(Y_C) Y = G_CC^-1 G_C. (kappa x L) recovering every label from the chosen ones."""
    import numpy as np

    from polytag.operators import cluster as CL

    L = mlf.L
    kappa = max(2, round(0.1 * L)) if kappa is None else kappa
    _, G = CL.gram(mlf)
    w, Vt = np.linalg.eigh(G)
    top = Vt[:, np.argsort(w)[::-1][:kappa]]
    lev = (top ** 2).sum(axis=1) / kappa
    rnd = np.random.default_rng(seed)
    p = lev / lev.sum() if lev.sum() > 0 else np.full(L, 1.0 / L)
    chosen = sorted(int(c) for c in rnd.choice(L, size=kappa, replace=False, p=p))
    P = np.linalg.pinv(G[np.ix_(chosen, chosen)]) @ G[chosen, :]
    return chosen, lev, P


def css_learner(mlf: MLFrame, train: DataFrame, kappa: int | None = None, seed: int = 1) -> DataFrame:
    """Learn the chosen labels with BR and recover all labels by the projection; positive iff
    ceil(conf) = 1 (0 < conf <= 1)."""
    chosen, _, P = css_select(mlf.with_df(train), kappa, seed)
    sub = mlf.with_df(train.select(mlf.id_col, *mlf.features, F.array(*[F.col(mlf.y_col)[c] for c in chosen]).alias(mlf.y_col)),
                      labels=tuple(mlf.labels[c] for c in chosen))
    pc = to_arrays(predict_br(fit_br(sub, sub.df), mlf.df), ("conf",))
    conf = F.array(*[sum(F.get("conf", F.lit(i)) * F.lit(float(P[i, j])) for i in range(len(chosen))) for j in range(mlf.L)])
    x = pc.select(mlf.id_col, conf.alias("conf"))
    return x.withColumn("bip", F.transform("conf", lambda c: (F.ceil(c) == 1).cast("int")))
