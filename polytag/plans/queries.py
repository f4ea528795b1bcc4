"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads the driver tables through a view, runs one operator over the
whole view and returns scalar columns with explicit names; doubles are rounded
to 6 places so a second engine can compare values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from polytag.operators import stats as ST
from polytag.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def r6(df: DataFrame) -> DataFrame:
    """Round every floating column to 6 places."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), 6).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------- 2.3 statistics


@query("labelset_counts")
def q_labelset_counts(spark, d):
    return ST.labelset_counts(V.v_order(spark, d)).select("bits", F.col("n_labels").cast("int").alias("n_labels"), "count")


@query("label_cardinality")
def q_label_cardinality(spark, d):
    return r6(ST.label_cardinality(V.v_userday(spark, d)))


@query("label_priors")
def q_label_priors(spark, d):
    return r6(ST.label_priors(V.v_tree(spark, d)))


@query("cardinality_histogram")
def q_cardinality_histogram(spark, d):
    return ST.cardinality_histogram(V.v_tree(spark, d))


@query("ml_summary")
def q_ml_summary(spark, d):
    return r6(ST.ml_summary(V.v_order(spark, d)))


@query("label_cooccurrence")
def q_label_cooccurrence(spark, d):
    return ST.label_cooccurrence(V.v_tree(spark, d))


@query("label_phi")
def q_label_phi(spark, d):
    return r6(ST.label_phi(V.v_userday(spark, d)).select("i", "j", "phi"))


@query("phi_histogram")
def q_phi_histogram(spark, d):
    return ST.phi_histogram(V.v_tree(spark, d))


@query("uncorrelated_labels")
def q_uncorrelated_labels(spark, d):
    return ST.uncorrelated_labels(V.v_order(spark, d), 0.05)


@query("top_correlated_labels")
def q_top_correlated_labels(spark, d):
    return ST.top_correlated_labels(V.v_tree(spark, d), 3)


@query("phi_diagram")
def q_phi_diagram(spark, d):
    return r6(ST.phi_diagram(V.v_tree(spark, d), 0.05))


@query("chi2_pairs")
def q_chi2_pairs(spark, d):
    return r6(ST.chi2_pairs(V.v_order(spark, d)))


@query("label_mutual_information")
def q_label_mutual_information(spark, d):
    return r6(ST.label_mutual_information(V.v_userday(spark, d)))


@query("label_cosine_distance")
def q_label_cosine_distance(spark, d):
    return r6(ST.label_cosine_distance(V.v_order(spark, d)))


@query("conditional_dependence")
def q_conditional_dependence(spark, d):
    from polytag.operators import dependence as DP

    return r6(DP.conditional_dependence(V.v_userday(spark, d), k=10, seed=1))


# ---------------------------------------------------------------- 2.2 projection, validation, label-set functions

from polytag.frame import MLFrame  # noqa: E402
from polytag.functions import labelsets as LS  # noqa: E402
from polytag.operators import hierarchy as HI  # noqa: E402
from polytag.operators import scaling as SC  # noqa: E402


@query("label_columns")
def q_label_columns(spark, d):
    m = V.v_order(spark, d)
    w = m.wide()
    roles = [("id", "id")] + [(f, "feature") for f in m.features] + [(lab, "label") for lab in m.labels]
    counts = w.agg(*[F.count(F.col(c)).alias(c) for c, _ in roles])
    return counts.select(
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("name"), F.lit(i).alias("pos"), F.lit(r).alias("role"), F.col(c).alias("n_nonnull"))
            for i, (c, r) in enumerate(roles)
        ]))
    )


@query("labels_by_position")
def q_labels_by_position(spark, d):
    w = V.v_order(spark, d).wide()
    m = MLFrame.labels_by_position(w, 6)
    return m.df.select("id", LS.bits("y").alias("bits"))


@query("drop_labels")
def q_drop_labels(spark, d):
    m = V.v_order(spark, d)
    return m.wide().drop(*m.labels)


@query("keep_labels")
def q_keep_labels(spark, d):
    m = V.v_order(spark, d)
    keep = ["AF", "NO", "RF"]
    idx = [m.label_index(k) for k in keep]
    return m.df.select("id", LS.bits(F.array(*[F.col("y")[i] for i in idx])).alias("bits"))


@query("rows_missing_labels")
def q_rows_missing_labels(spark, d):
    return HI.rows_missing_labels(V.v_doc(spark, d))


@query("label_depth")
def q_label_depth(spark, d):
    return HI.label_depth(V.label_tree(spark, d))


@query("label_descendants")
def q_label_descendants(spark, d):
    return HI.label_descendants(V.label_tree(spark, d))


@query("ml_validate")
def q_ml_validate(spark, d):
    from polytag.operators import transform as TR

    m = TR.hierarchical(V.v_tree(spark, d))
    return HI.validate(m, required_labels=list(m.labels))


@query("labelset_bits")
def q_labelset_bits(spark, d):
    m = V.v_order(spark, d)
    b = LS.bits("y")
    return m.df.select("id", b.alias("bits"), (LS.from_bits(b) == F.col("y")).alias("roundtrip"))


@query("labelset_size")
def q_labelset_size(spark, d):
    return V.v_tree(spark, d).df.select("id", LS.size("y").alias("size"))


def _scored_userday(spark, d):
    m = V.v_userday(spark, d)
    return m.df.select("id", "y", LS.synthetic_scores("id", m.L).alias("score"))


@query("labelset_hamming")
def q_labelset_hamming(spark, d):
    s = _scored_userday(spark, d)
    return s.select("id", LS.hamming("y", LS.bipartition("score", 0.5)).alias("hamming"))


@query("labelset_intersection")
def q_labelset_intersection(spark, d):
    s = _scored_userday(spark, d)
    return s.select("id", LS.bits(LS.intersection("y", LS.bipartition("score", 0.5))).alias("bits"))


@query("labelset_subsets")
def q_labelset_subsets(spark, d):
    c = ST.labelset_counts(V.v_order(spark, d))
    return LS.explode_subsets(c.select("bits", "y"), "y").select("bits", LS.bits("sub").alias("sub_bits"))


@query("rank_from_scores")
def q_rank_from_scores(spark, d):
    s = _scored_userday(spark, d)
    return s.select("id", F.posexplode(LS.ranks("score")).alias("j", "rank"))


@query("bipartition_at")
def q_bipartition_at(spark, d):
    s = _scored_userday(spark, d)
    return s.select("id", LS.bits(LS.bipartition("score", 0.5)).alias("bits"))


@query("argmax_random_tie")
def q_argmax_random_tie(spark, d):
    s = _scored_userday(spark, d)
    return s.select("id", LS.argmax_hash_tie("score", "id", seed=3).alias("j"))


@query("minmax_scale")
def q_minmax_scale(spark, d):
    m = V.v_order(spark, d)
    out = SC.minmax_scale(m.df, ["o_totalprice", "n_lines", "sum_qty"], -1.0, 1.0)
    return r6(out.select("id", "o_totalprice", F.col("n_lines").cast("double").alias("n_lines"), F.col("sum_qty").cast("double").alias("sum_qty")))


# ---------------------------------------------------------------- 2.4 transformations

from polytag.operators import transform as TR  # noqa: E402


@query("tr_binary_relevance")
def q_tr_binary_relevance(spark, d):
    return TR.binary_relevance(V.v_order(spark, d)).withColumn("j", F.col("j").cast("int"))


@query("tr_label_powerset")
def q_tr_label_powerset(spark, d):
    return TR.label_powerset(V.v_order(spark, d))


@query("tr_pairwise")
def q_tr_pairwise(spark, d):
    return TR.pairwise(V.v_userday(spark, d)).select("id", "a", "b", "class")


@query("tr_include_labels")
def q_tr_include_labels(spark, d):
    return TR.include_labels(V.v_userday(spark, d)).select("id", "label", "class")


@query("tr_copy")
def q_tr_copy(spark, d):
    return TR.copy(V.v_userday(spark, d)).select("id", "j", "class")


@query("tr_copy_weight")
def q_tr_copy_weight(spark, d):
    return r6(TR.copy(V.v_userday(spark, d), weighted=True).select("id", "j", "class", "weight"))


@query("tr_ignore")
def q_tr_ignore(spark, d):
    return TR.ignore(V.v_userday(spark, d)).select("id", "j", "class")


@query("tr_select_max")
def q_tr_select_max(spark, d):
    return TR.select_by_frequency(V.v_tree(spark, d), most=True).select("id", "j", "class")


@query("tr_select_min")
def q_tr_select_min(spark, d):
    return TR.select_by_frequency(V.v_tree(spark, d), most=False).select("id", "j", "class")


@query("tr_select_random")
def q_tr_select_random(spark, d):
    return TR.select_random(V.v_tree(spark, d), seed=5).select("id", "j", "class")


@query("tr_multiclass_schema")
def q_tr_multiclass_schema(spark, d):
    m = V.v_userday(spark, d)
    n = TR.copy(m).groupBy("j").agg(F.count(F.lit(1)).alias("n_rows"))
    return TR.multiclass_schema(m).join(n, "j", "left").select("j", "class", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query("tr_single_target")
def q_tr_single_target(spark, d):
    t = V.v_target(spark, d)
    return r6(TR.single_target(t, ["o_totalprice", "n_lines", "prio"], 1))


@query("tr_chain")
def q_tr_chain(spark, d):
    t = V.v_target(spark, d)
    return r6(TR.chain_step(t, ["o_totalprice", "n_lines", "prio"], [2, 0, 1], 3))


@query("tr_hierarchical")
def q_tr_hierarchical(spark, d):
    m = TR.hierarchical(V.v_tree(spark, d))
    return m.df.select("id", LS.bits("y").alias("bits"))


@query("tr_prune_ppt")
def q_tr_prune_ppt(spark, d):
    return TR.prune_ppt(V.v_tree(spark, d), p=3, strategy="replace")


@query("tr_prune_ps_a")
def q_tr_prune_ps_a(spark, d):
    return TR.prune_ps(V.v_tree(spark, d), p=3, strategy="A", b=2)


@query("tr_prune_ps_b")
def q_tr_prune_ps_b(spark, d):
    return TR.prune_ps(V.v_tree(spark, d), p=3, strategy="B", b=1)


# ---------------------------------------------------------------- 2.5 splits and sampling

from polytag.operators import split as SP  # noqa: E402


@query("cv_folds")
def q_cv_folds(spark, d):
    return SP.cv_folds(V.v_userday(spark, d), k=10, seed=1)


@query("strat_label_powerset")
def q_strat_label_powerset(spark, d):
    return SP.strat_label_powerset(V.v_order(spark, d), k=5, seed=2)


@query("strat_iterative")
def q_strat_iterative(spark, d):
    return SP.iterative_stratification(V.v_order(spark, d), k=5, seed=2)


@query("holdout_split")
def q_holdout_split(spark, d):
    return SP.holdout_split(V.v_order(spark, d), pct=67.0, seed=3)


@query("sample_bootstrap")
def q_sample_bootstrap(spark, d):
    return SP.bootstrap_weights(V.v_userday(spark, d), models=5, seed=4)


@query("sample_subset")
def q_sample_subset(spark, d):
    return SP.subset_sample(V.v_userday(spark, d), models=5, pct=67.0, seed=5)


# ---------------------------------------------------------------- 2.10 evaluation

from polytag.operators import evaluate as EV  # noqa: E402


def scored(spark, d, view="v_userday"):
    """A view with deterministic tied scores as predictions: conf, bip (>= 0.5) and rank."""
    m = V.VIEWS[view](spark, d)
    df = m.df.select("id", "y", LS.synthetic_scores("id", m.L).alias("conf"))
    return EV.with_predictions(df)


def _one(measure_df: DataFrame, name: str) -> DataFrame:
    return r6(measure_df.select(F.lit(name).alias("measure"), F.col(name).cast("double").alias("value")))


def _reg_row(name):
    def fn(spark, d):
        return _one(EV.example_measures(scored(spark, d)), name)

    return fn


for _m in ("hamming_loss", "subset_accuracy", "ex_precision", "ex_recall", "ex_specificity", "ex_fmeasure",
           "ex_accuracy", "average_precision", "one_minus_ap", "coverage", "one_error", "is_error",
           "error_set_size", "ranking_loss", "log_loss", "mse", "rmse"):
    QUERIES[f"ev_{_m}"] = _reg_row(_m)


def _reg_label(kind, stat):
    def fn(spark, d):
        conf = EV.label_confusion(scored(spark, d))
        if kind == "micro":
            mm = EV.micro_macro(conf).filter(F.col("measure") == f"micro_{stat}")
            return r6(mm)
        pl = EV.per_label_measures(conf).select("j", F.col(stat).alias("value"))
        mean = pl.agg(F.avg("value").alias("value")).select(F.lit(None).cast("int").alias("j"), "value")
        return r6(pl.unionByName(mean))

    return fn


for _k in ("micro", "macro"):
    for _s in ("precision", "recall", "fmeasure", "specificity"):
        QUERIES[f"ev_{_k}_{_s}"] = _reg_label(_k, _s)


@query("ev_map")
def q_ev_map(spark, d):
    c = EV.label_ap_curves(scored(spark, d))
    per = c.select("j", F.col("ap").alias("value"))
    return r6(per.unionByName(per.agg(F.avg("value").alias("value")).select(F.lit(None).cast("int").alias("j"), "value")))


def _curve(name):
    def fn(spark, d):
        return r6(EV.curve_measures(scored(spark, d)).filter(F.col("measure") == name))

    return fn


for _m in ("gmap", "miap", "gmiap", "micro_auc"):
    QUERIES[f"ev_{_m}"] = _curve(_m)


@query("ev_macro_auc")
def q_ev_macro_auc(spark, d):
    per = EV.label_auc(scored(spark, d)).select("j", F.col("auc").alias("value"))
    return r6(per.unionByName(per.agg(F.avg("value").alias("value")).select(F.lit(None).cast("int").alias("j"), "value")))


@query("ev_hierarchical_loss")
def q_ev_hierarchical_loss(spark, d):
    m = TR.hierarchical(V.v_tree(spark, d))
    edges = {r["idx"]: r["parent_idx"] for r in m.tree.select("idx", "parent_idx").collect()}
    anc = []
    for j in range(m.L):
        a, p = [], edges.get(j)
        while p is not None:
            a.append(p)
            p = edges.get(p)
        anc.append(a)
    df = EV.with_predictions(m.df.select("id", "y", LS.synthetic_scores("id", m.L).alias("conf")))
    return r6(EV.hierarchical_loss(df, anc))


@query("ev_ir_guarded")
def q_ev_ir_guarded(spark, d):
    """Guarded ratios per row of the scored view, summarised by their distinct values."""
    s = scored(spark, d)
    x = s.select(
        EV._count2("y", "bip", lambda u, v: (u == 1) & (v == 1)).alias("tp"),
        EV._count2("y", "bip", lambda u, v: (u == 0) & (v == 1)).alias("fp"),
        EV._count2("y", "bip", lambda u, v: (u == 1) & (v == 0)).alias("fn"),
        EV._count2("y", "bip", lambda u, v: (u == 0) & (v == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    g = x.groupBy("tp", "fp", "fn", "tn").agg(F.count(F.lit(1)).alias("n"))
    return r6(g.select(
        F.col("tp").cast("int").alias("tp"), F.col("fp").cast("int").alias("fp"), F.col("fn").cast("int").alias("fn"),
        F.col("tn").cast("int").alias("tn"), "n",
        EV.ir_precision(tp, fp, fn).alias("precision"), EV.ir_recall(tp, fp, fn).alias("recall"),
        EV.ir_fmeasure(tp, fp, fn).alias("fmeasure"), EV.ir_specificity(tn, fp, fn).alias("specificity"),
    ))


@query("ev_all")
def q_ev_all(spark, d):
    return r6(EV.evaluate(scored(spark, d)))


@query("ev_all_missing")
def q_ev_all_missing(spark, d):
    """All measures on v_doc, where unlabelled documents have missing labels (left out)."""
    return r6(EV.evaluate(scored(spark, d, "v_doc")))


# ---------------------------------------------------------------- 2.7 learners (count-based naive Bayes base)

from polytag.operators import learners as LN  # noqa: E402


def _materialized_split(m):
    """The view checkpointed once (a learner reads it several times: fit counts, scoring, joins;
    re-deriving it would re-aggregate the fact table each time) and its 67 % training part."""
    from polytag.operators.nb import materialize

    df, _ = materialize(m.df)
    m = m.with_df(df)
    # same rule as holdout_split(pct=67, seed=3), as a filter instead of a self-join
    train = m.df.filter(SP.uniform(m.id_col, 3) * 100 < F.lit(67.0))
    return m, train


def order_split(spark, d):
    """v_order with its 67 % training part (seeded holdout)."""
    return _materialized_split(V.v_order(spark, d))


def _long_out(arr_df: DataFrame, with_bip: bool = True) -> DataFrame:
    cols = [F.posexplode(F.arrays_zip("conf", "bip") if with_bip else F.arrays_zip("conf")).alias("j", "z")]
    x = arr_df.select("id", *cols)
    out = [F.col("id"), F.col("j").cast("int").alias("j"), F.col("z.conf").alias("conf")]
    if with_bip:
        out.append(F.col("z.bip").cast("int").alias("bip"))
    return r6(x.select(*out))


@query("ln_binary_relevance")
def q_ln_binary_relevance(spark, d):
    m, train = order_split(spark, d)
    model = LN.fit_br(m, train)
    return r6(LN.predict_br(model, m.df))


@query("ln_label_powerset")
def q_ln_label_powerset(spark, d):
    m, train = order_split(spark, d)
    model = LN.fit_lp(m, train)
    return _long_out(LN.predict_lp(model, m.df, m.L, conf_mode=1))


@query("ln_classifier_chain")
def q_ln_classifier_chain(spark, d):
    m, train = order_split(spark, d)
    model = LN.fit_cc(m, [0, 1, 2, 3, 4, 5], train)
    return _long_out(LN.predict_cc(model, m.df, m.L))


@query("ln_pairwise")
def q_ln_pairwise(spark, d):
    m, train = order_split(spark, d)
    model = LN.fit_pairwise(m, train)
    return _long_out(LN.predict_pairwise(model, m.df, m.L), with_bip=False)


@query("ln_calibrated_ranking")
def q_ln_calibrated_ranking(spark, d):
    m, train = order_split(spark, d)
    return _long_out(LN.predict_clr(LN.fit_br(m, train), LN.fit_pairwise(m, train), m.df, m.L))


@query("ln_two_stage_voting")
def q_ln_two_stage_voting(spark, d):
    m, train = order_split(spark, d)
    return _long_out(LN.predict_tsva(LN.fit_br(m, train), LN.fit_pairwise(m, train), m.df, m.L, 0.2))


@query("ln_two_stage_chain")
def q_ln_two_stage_chain(spark, d):
    m, train = order_split(spark, d)
    br = LN.fit_br(m, train)
    pw = LN.fit_pairwise_stacked(m, br, train, pruned=False)
    return _long_out(LN.predict_two_stage_chain(br, pw, m.df, m.L, 0.2))


@query("ln_two_stage_pruned_chain")
def q_ln_two_stage_pruned_chain(spark, d):
    m, train = order_split(spark, d)
    br = LN.fit_br(m, train)
    pw = LN.fit_pairwise_stacked(m, br, train, pruned=True)
    return _long_out(LN.predict_two_stage_chain(br, pw, m.df, m.L, 0.2))


@query("ln_include_labels")
def q_ln_include_labels(spark, d):
    m, train = order_split(spark, d)
    return r6(LN.predict_include_labels(LN.fit_include_labels(m, train), m, m.df))


@query("ln_multiclass")
def q_ln_multiclass(spark, d):
    m, train = order_split(spark, d)
    return _long_out(LN.predict_multiclass(LN.fit_multiclass(m, train, "copy_weight"), m.df, m.L), with_bip=False)


@query("ln_pruned_sets")
def q_ln_pruned_sets(spark, d):
    m, train = order_split(spark, d)
    pr = TR.prune_ps(m.with_df(train), p=30, strategy="A", b=2)
    model = LN.fit_lp(m, train, pruned=pr)
    return _long_out(LN.predict_lp(model, m.df, m.L, conf_mode=2))


@query("ln_ppt")
def q_ln_ppt(spark, d):
    m, train = order_split(spark, d)
    pr = TR.prune_ppt(m.with_df(train), p=30, strategy="replace")
    model = LN.fit_lp(m, train, pruned=pr)
    return _long_out(LN.predict_lp(model, m.df, m.L, conf_mode=2, threshold=0.21))


SUBSET_PARTITION = [[0, 1], [2, 3], [4], [5]]


@query("ln_subset_partition")
def q_ln_subset_partition(spark, d):
    m, train = order_split(spark, d)
    model = LN.fit_subsets(m, SUBSET_PARTITION, train)
    return _long_out(LN.predict_subsets(model, m.df, m.L))


@query("ln_rakel_d")
def q_ln_rakel_d(spark, d):
    m, train = order_split(spark, d)
    model = LN.fit_subsets(m, LN.rakeld_partition(m.L, 3, seed=11), train)
    return _long_out(LN.predict_subsets(model, m.df, m.L))


@query("ln_rakel")
def q_ln_rakel(spark, d):
    m, train = order_split(spark, d)
    model = LN.fit_subsets(m, LN.rakel_subsets(m.L, 3, seed=12), train)
    return _long_out(LN.predict_subsets(model, m.df, m.L))


@query("ln_ensemble_partitions")
def q_ln_ensemble_partitions(spark, d):
    from polytag.operators import partitions as PT

    m, train = order_split(spark, d)
    return _long_out(PT.ensemble_of_partitions(m, train, m.df, m=10, diverse=True, seed=1))


@query("label_groups_greedy")
def q_label_groups_greedy(spark, d):
    from polytag.operators import partitions as PT

    m = V.v_userday(spark, d)
    groups, _ = PT.greedy_label_clustering(m, m.df, folds=10, seed=1)
    rows = [(j, gi, ",".join(str(x) for x in g)) for gi, g in enumerate(groups) for j in g]
    return spark.createDataFrame(rows, "j int, grp int, members string")


@query("predict_unlabelled")
def q_predict_unlabelled(spark, d):
    m = V.v_doc(spark, d)
    labelled = m.df.filter(F.forall("y", lambda x: x.isNotNull()))
    unl = m.df.filter(F.exists("y", lambda x: x.isNull()))
    return r6(LN.predict_br(LN.fit_br(m, labelled), unl))


# ---------------------------------------------------------------- 2.7 learners on decision trees

from polytag.operators.tree import TreeBase, quantile_edges  # noqa: E402


@query("ln_tree_binary_relevance")
def q_ln_tree_binary_relevance(spark, d):
    m, train = order_split(spark, d)
    return r6(LN.predict_br(LN.fit_br(m, train, base=TreeBase(depth=2, min_leaf=5, criterion="gain")), m.df))


@query("ln_tree_classifier_chain")
def q_ln_tree_classifier_chain(spark, d):
    m, train = order_split(spark, d)
    model = LN.fit_cc(m, [0, 1, 2, 3, 4, 5], train, base=TreeBase(depth=2, min_leaf=5, criterion="gain"))
    return _long_out(LN.predict_cc(model, m.df, m.L))


@query("ln_tree_numeric")
def q_ln_tree_numeric(spark, d):
    """Deep pruned trees with cuts on the numeric columns, gain ratio, all labels at once."""
    m, train = order_split(spark, d)
    numeric = ("o_totalprice", "sum_qty", "n_lines")
    m = MLFrame(m.df, m.labels, ("f_prio", "f_status", *numeric))
    base = TreeBase(depth=6, min_leaf=5, prune=True, numeric=quantile_edges(train, numeric, 16))
    return r6(LN.predict_br(LN.fit_br(m, train, base=base), m.df))


from polytag.operators import boost as BO  # noqa: E402

MH_ROUNDS = 5


@query("ln_adaboost_mh")
def q_ln_adaboost_mh(spark, d):
    m, train = order_split(spark, d)
    return r6(BO.predict_mh(BO.fit_mh(m, train, MH_ROUNDS), m.df))


@query("ln_adaboost_mh_rounds")
def q_ln_adaboost_mh_rounds(spark, d):
    """The chosen feature, its normaliser and the bound on the training Hamming loss, round by round."""
    m, train = order_split(spark, d)
    return r6(spark.createDataFrame(BO.fit_mh(m, train, MH_ROUNDS).rounds, "round int, feature string, z double, bound double"))


# ---------------------------------------------------------------- 2.7 neighbour learners

from polytag.operators import knn as KN  # noqa: E402


def vec_split(spark, d):
    return _materialized_split(V.v_vec(spark, d))


@query("knn_neighbors")
def q_knn_neighbors(spark, d):
    m = V.v_vec(spark, d)
    nb = KN.knn(m.df, m.df, 10, vec="embedding", exclude_self=True)
    return r6(nb.select(F.col("qid").alias("id"), F.col("rank").cast("int").alias("rank"), F.col("rid").alias("nid"), "dist"))


@query("knn_neighbors_cells")
def q_knn_neighbors_cells(spark, d):
    """The same neighbours by pivot cells, the form that large references take."""
    from polytag.operators.nb import materialize

    df, _ = materialize(V.v_vec(spark, d).df.select("id", "embedding"))
    nb = KN.knn(df, df, 10, vec="embedding", exclude_self=True, method="cells")
    return r6(nb.select(F.col("qid").alias("id"), F.col("rank").cast("int").alias("rank"), F.col("rid").alias("nid"), "dist"))


@query("ln_mlknn")
def q_ln_mlknn(spark, d):
    m, train = vec_split(spark, d)
    model = KN.fit_mlknn(train, m.L, k=10, vec="embedding")
    return r6(KN.predict_mlknn(model, train, m.df, vec="embedding"))


def _brknn(ext):
    def fn(spark, d):
        m, train = vec_split(spark, d)
        return _long_out(KN.predict_brknn(train, m.df, m.L, k=10, ext=ext, vec="embedding"))

    return fn


QUERIES["ln_brknn"] = _brknn("none")
QUERIES["ln_brknn_a"] = _brknn("a")
QUERIES["ln_brknn_b"] = _brknn("b")


@query("ln_dmlknn")
def q_ln_dmlknn(spark, d):
    m, train = vec_split(spark, d)
    return r6(KN.predict_dmlknn(train, m.df, m.L, k=10, delta=6, vec="embedding"))


@query("ln_ranking_perceptron")
def q_ln_ranking_perceptron(spark, d):
    from polytag.operators import neural as NN

    m, train = vec_split(spark, d)
    W = NN.fit_ranking_perceptron(train, m.L, vec="embedding", rule="uniform", epochs=10)
    return _long_out(NN.linear_scores(W, m.df, vec="embedding"), with_bip=False)


@query("ln_ranking_net")
def q_ln_ranking_net(spark, d):
    from polytag.operators import neural as NN

    m, train = vec_split(spark, d)
    model = NN.fit_ranking_net(train, m.L, vec="embedding", epochs=100)
    w, _ = TH.linear_threshold_function(NN.net_scores(model, train, vec="embedding").join(train.select("id", "y"), "id"), m.L)
    s = NN.net_scores(model, m.df, vec="embedding")
    t = sum((F.get("conf", F.lit(j)) * float(w[j]) for j in range(m.L)), F.lit(float(w[m.L])))
    return _long_out(s.withColumn("bip", F.transform("conf", lambda c: (c >= t).cast("int"))))


@query("knn_select_k")
def q_knn_select_k(spark, d):
    m, train = vec_split(spark, d)
    return r6(KN.select_k(train, m.L, kmax=10, vec="embedding").select(F.col("k").cast("int").alias("k"), "hamming_loss", "best"))


# ---------------------------------------------------------------- 2.9 thresholding

from polytag.operators import threshold as TH  # noqa: E402


@query("th_one")
def q_th_one(spark, d):
    return r6(TH.one_threshold(scored(spark, d)).select(F.col("stage").cast("int").alias("stage"), F.col("k").cast("int").alias("k"),
                                                        "threshold", "hamming_loss", "chosen"))


@query("th_rcut")
def q_th_rcut(spark, d):
    return r6(TH.rcut(scored(spark, d), 5))


@query("th_scut")
def q_th_scut(spark, d):
    return r6(TH.scut_hamming(scored(spark, d)))


@query("th_expected_f")
def q_th_expected_f(spark, d):
    return TH.expected_f(scored(spark, d), 5)


@query("th_expected_measure")
def q_th_expected_measure(spark, d):
    s = scored(spark, d)
    out = TH.expected_measure_cut(s, 5, "ex_fmeasure")
    return r6(out.select("id", "n", "threshold", F.array_join(F.transform("bip", lambda b: b.cast("string")), "").alias("bits")))


@query("th_predicted")
def q_th_predicted(spark, d):
    return r6(TH.predicted_threshold_target(scored(spark, d)).select("id", "threshold", F.col("errors").cast("int").alias("errors")))


@query("th_meta_labeler")
def q_th_meta_labeler(spark, d):
    m, train = order_split(spark, d)
    n = LN.nb_argmax(LN.fit_meta_labeler(m, train), m.df).select("id", F.col("t").alias("n"))
    s = EV.with_predictions(m.df.select("id", "y", LS.synthetic_scores("id", m.L).alias("conf"))).join(n, "id")
    b = TH.apply_top_n(s.drop("bip"))
    return b.select("id", F.posexplode("bip").alias("j", "bip")).select("id", F.col("j").cast("int").alias("j"), "bip")


@query("th_linear_function")
def q_th_linear_function(spark, d):
    _, coef = TH.linear_threshold_function(scored(spark, d), 5)
    return r6(coef)


# ---------------------------------------------------------------- 2.6 feature ranking and selection

from polytag.operators import features as FS  # noqa: E402


def _fs_base(spark, d):
    m = V.v_order(spark, d)
    return m, FS.score_per_label(m)


@query("fs_score_per_label")
def q_fs_score_per_label(spark, d):
    _, s = _fs_base(spark, d)
    return r6(s)


@query("fs_normalize")
def q_fs_normalize(spark, d):
    _, s = _fs_base(spark, d)
    dl = FS.normalise(s, "info_gain", "dl").select(F.lit("dl").alias("norm"), "j", "feature", "score")
    dm = FS.normalise(s, "info_gain", "dm").select(F.lit("dm").alias("norm"), "j", "feature", "score")
    return r6(dl.unionByName(dm))


@query("fs_combine")
def q_fs_combine(spark, d):
    _, s = _fs_base(spark, d)
    s = s.withColumn("score", F.col("info_gain"))
    out = None
    for how in ("max", "min", "avg"):
        c = FS.combine(s, how).select(F.lit(how).alias("comb"), "feature", "score")
        out = c if out is None else out.unionByName(c)
    return r6(out)


@query("fs_rank_mode")
def q_fs_rank_mode(spark, d):
    m, s = _fs_base(spark, d)
    return r6(FS.combine(FS.rank_scores(s, "info_gain", len(m.features)), "avg"))


@query("fs_score_powerset")
def q_fs_score_powerset(spark, d):
    return r6(FS.score_powerset(V.v_order(spark, d)))


@query("fs_score_multiclass")
def q_fs_score_multiclass(spark, d):
    return r6(FS.score_multiclass(V.v_order(spark, d), "copy"))


def _ranked(spark, d):
    _, s = _fs_base(spark, d)
    return FS.ranker(FS.combine(FS.normalise(s, "info_gain", "dm"), "avg"))


@query("fs_ranker")
def q_fs_ranker(spark, d):
    return r6(_ranked(spark, d).select(F.col("rank").cast("int").alias("rank"), "feature", "score"))


@query("fs_top_k")
def q_fs_top_k(spark, d):
    return FS.top_k(_ranked(spark, d), 3)


@query("fs_threshold")
def q_fs_threshold(spark, d):
    return FS.by_threshold(_ranked(spark, d), 0.2)


@query("fs_top_pct")
def q_fs_top_pct(spark, d):
    return FS.top_percent(_ranked(spark, d), 40.0)


@query("fs_apply")
def q_fs_apply(spark, d):
    m = V.v_order(spark, d)
    chosen = [r["feature"] for r in FS.top_k(_ranked(spark, d), 3).collect()]
    out = FS.apply(m, chosen)
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in out.features])
    return out.df.select("id", F.inline(cells))


# ---------------------------------------------------------------- 2.11 multi-target regression

from polytag.operators import regress as RG  # noqa: E402

REG_FEATURES = ["o_totalprice", "n_lines", "prio"]


def target_split(spark, d):
    from polytag.operators.nb import materialize

    t, _ = materialize(V.v_target(spark, d))
    u = SP.uniform("id", 3) * 100 < F.lit(67.0)
    return t, t.filter(u), t.filter(~u)


def _pred_long(df: DataFrame) -> DataFrame:
    # predictions reach 1e5 in magnitude: 4 decimals is all a double computed two ways agrees on
    return df.select("id", F.posexplode("pred").alias("j", "pred")).select("id", F.col("j").cast("int").alias("j"), F.round("pred", 4).alias("pred"))


@query("rg_single_target")
def q_rg_single_target(spark, d):
    t, tr, _ = target_split(spark, d)
    return _pred_long(RG.single_target(t, ["o_totalprice"], 3, tr)[1])


@query("rg_chain_simple")
def q_rg_chain_simple(spark, d):
    t, tr, _ = target_split(spark, d)
    return _pred_long(RG.chain_simple(t, REG_FEATURES, [2, 0, 1], tr))


@query("rg_chain")
def q_rg_chain(spark, d):
    t, tr, _ = target_split(spark, d)
    return _pred_long(RG.chain_cv(t, REG_FEATURES, [2, 0, 1], tr, folds=3))


@query("rg_ensemble_chains")
def q_rg_ensemble_chains(spark, d):
    t, tr, _ = target_split(spark, d)
    return _pred_long(RG.ensemble_of_chains(t, REG_FEATURES, 3, tr, m=4))


@query("rg_stacking")
def q_rg_stacking(spark, d):
    t, tr, _ = target_split(spark, d)
    return _pred_long(RG.stacking(t, REG_FEATURES, 3, tr))


@query("rg_chain_modes")
def q_rg_chain_modes(spark, d):
    """The chain with training predictions and with a sampled model's predictions as inputs."""
    t, tr, _ = target_split(spark, d)
    runs = [_pred_long(RG.regressor_chain(t, REG_FEATURES, [2, 0, 1], tr, mode)).select(F.lit(mode).alias("mode"), "*") for mode in ("train", "sample")]
    return runs[0].unionByName(runs[1])


@query("rg_stacking_cv")
def q_rg_stacking_cv(spark, d):
    t, tr, _ = target_split(spark, d)
    return _pred_long(RG.stacking(t, REG_FEATURES, 3, tr, mode="cv"))


@query("rg_random_combinations")
def q_rg_random_combinations(spark, d):
    t, tr, _ = target_split(spark, d)
    return _pred_long(RG.random_linear_combinations(t, REG_FEATURES, 3, tr, r=6, non_zero=2))


@query("rg_random_forest")
def q_rg_random_forest(spark, d):
    t, tr, _ = target_split(spark, d)
    return _pred_long(RG.random_forest(t, REG_FEATURES, 3, tr, trees=10))


def _reg_eval(spark, d):
    t, tr, te = target_split(spark, d)
    _, out = RG.single_target(te, ["o_totalprice"], 3, tr)
    mu = tr.agg(*[F.avg(F.col("target")[j]).alias(f"m{j}") for j in range(3)]).first()
    return EV.regression_measures(out, "target", "pred", [mu[f"m{j}"] for j in range(3)])


def _reg_q(col):
    def fn(spark, d):
        per = _reg_eval(spark, d).select("j", F.col(col).alias("value"))
        return r6(per.unionByName(per.agg(F.avg("value").alias("value")).select(F.lit(None).cast("int").alias("j"), "value")))

    return fn


QUERIES["ev_mae"] = _reg_q("mae")
QUERIES["ev_avg_rmse"] = _reg_q("rmse")
QUERIES["ev_relative_mae"] = _reg_q("rel_mae")
QUERIES["ev_relative_rmse"] = _reg_q("rel_rmse")


@query("rg_compare")
def q_rg_compare(spark, d):
    """Method x target table on the held-out part: MAE and RMSE."""
    t, tr, te = target_split(spark, d)
    mu = tr.agg(*[F.avg(F.col("target")[j]).alias(f"m{j}") for j in range(3)]).first()
    means = [mu[f"m{j}"] for j in range(3)]
    runs = RG.compare(te, REG_FEATURES, 3, tr, [2, 0, 1])
    out = None
    for name, df in runs.items():
        e = EV.regression_measures(df, "target", "pred", means).select(F.lit(name).alias("method"), "j", "mae", "rmse")
        out = e if out is None else out.unionByName(e)
    return r6(out)


# ---------------------------------------------------------------- 2.8 label clustering and orderings

from polytag.operators import cluster as CL  # noqa: E402


@query("sample_by_cost")
def q_sample_by_cost(spark, d):
    cen = CL.sample_by_cost(V.v_tree(spark, d), k=3, steps=2, seed=5)
    rows = [(c, j, sg) for c, mem in enumerate(cen) for j, sg in mem]
    return spark.createDataFrame(rows, "center int, j int, sign int")


@query("label_kmodes_parallel_init")
def q_label_kmodes_parallel_init(spark, d):
    m = V.v_tree(spark, d)
    return CL.kmodes_cosine(m, k=3, iters=100, init=CL.sample_by_cost(m, k=3, steps=2, seed=5))


@query("label_kmodes_cosine")
def q_label_kmodes_cosine(spark, d):
    return CL.kmodes_cosine(V.v_tree(spark, d), k=3, iters=100)


@query("label_kmeans_euclid")
def q_label_kmeans_euclid(spark, d):
    return CL.kmeans_euclid(V.v_tree(spark, d), k=3)


def _mi_chain(mode):
    def fn(spark, d):
        m = V.v_userday(spark, d)
        ch = CL.mi_chain(m, None, mode)
        return spark.createDataFrame([(p, j) for p, j in enumerate(ch)], "pos int, j int")

    return fn


QUERIES["label_chain_mi_min"] = _mi_chain("min")
QUERIES["label_chain_mi_max"] = _mi_chain("max")


@query("label_tree_balanced")
def q_label_tree_balanced(spark, d):
    return CL.label_tree(V.v_tree(spark, d), k=3, method="balanced")


@query("label_tree_cluster")
def q_label_tree_cluster(spark, d):
    return CL.label_tree(V.v_tree(spark, d), k=3, method="cluster")


@query("label_tree_random")
def q_label_tree_random(spark, d):
    return CL.random_partition(V.v_tree(spark, d), k=3, seed=4)


@query("vector_kmeans_wssse")
def q_vector_kmeans_wssse(spark, d):
    m = V.v_vec(spark, d)
    model, cost = CL.vector_kmeans(m.df, "embedding", k=5)
    x = model.transform(m.df.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    return x.groupBy(F.col("prediction").cast("int").alias("cluster")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "wssse", F.lit(round(cost, 3)))


# ---------------------------------------------------------------- 2.7 hierarchy, chains over clusters, ensembles


@query("ln_local_chain")
def q_ln_local_chain(spark, d):
    m, train = order_split(spark, d)
    chain = [4, 1, 3]
    out = LN.predict_cc(LN.fit_cc(m, chain, train), m.df, m.L)
    return _long_out(out).filter(F.col("j").isin(chain))


def tree_split(spark, d):
    return _materialized_split(TR.hierarchical(V.v_tree(spark, d)))


@query("ln_hmc")
def q_ln_hmc(spark, d):
    m, train = tree_split(spark, d)
    par = LN.tree_parents(m.tree)
    model = LN.fit_hmc(m, train, par)
    return _long_out(LN.predict_hmc(model, m.df, m.L, par))


@query("ln_homer")
def q_ln_homer(spark, d):
    m, train = order_split(spark, d)
    return _long_out(LN.homer(m, train, k=2, method="balanced"))


@query("ln_clustered_chains")
def q_ln_clustered_chains(spark, d):
    m, train = order_split(spark, d)
    return _long_out(LN.clustered_chains(m, train, k=2))


@query("ln_cosine_cluster_chains")
def q_ln_cosine_cluster_chains(spark, d):
    """Cosine k-modes label clusters (k = 3, cost-sampled seeds) on the 25-nation tree view, one local chain each."""
    m, train = _materialized_split(V.v_tree(spark, d))
    return _long_out(LN.clustered_chains(m, train, k=3, init=CL.sample_by_cost(m.with_df(train), k=3, steps=2, seed=5)))


@query("ln_ecc")
def q_ln_ecc(spark, d):
    m, train = order_split(spark, d)
    return _long_out(LN.ecc(m, train, m=4))


@query("ln_eps")
def q_ln_eps(spark, d):
    m, train = order_split(spark, d)
    return _long_out(LN.eps(m, train, m=4))


# ---------------------------------------------------------------- 2.10 evaluation of learners by cross-validation

from polytag.operators import validate as VA  # noqa: E402


def _cut_scores(spark, d):
    """Out-of-fold scores of one model a label on the orders, three folds."""
    from polytag.operators import validate as VA
    from polytag.operators.nb import materialize

    m = V.v_order(spark, d)
    pred, _ = materialize(VA.out_of_fold(m, "br", folds=3, seed=6).select("id", "fold", "y", "conf"))
    return m, pred


def _per_measure(names, one):
    out = None
    for name in names:
        x = one(name).select(F.lit(name).alias("measure"), "*")
        out = x if out is None else out.unionByName(x)
    return r6(out)


@query("th_one_measures")
def q_th_one_measures(spark, d):
    from polytag.operators import cuts as CU

    _, pred = _cut_scores(spark, d)

    def one(name):
        res = CU.one_threshold(pred, name)
        return res.join(F.broadcast(CU.final_threshold(res).select(F.col("threshold").alias("final"))))  # one row

    return _per_measure(("hamming_loss", "micro_fmeasure", "macro_fmeasure", "ex_fmeasure"), one)


@query("th_rank_measures")
def q_th_rank_measures(spark, d):
    from polytag.operators import cuts as CU

    m, pred = _cut_scores(spark, d)
    return _per_measure(("hamming_loss", "micro_fmeasure", "macro_fmeasure", "ex_fmeasure"), lambda name: CU.rank_cut(pred, m.L, name))


@query("th_label_measures")
def q_th_label_measures(spark, d):
    from polytag.operators import cuts as CU

    m, pred = _cut_scores(spark, d)

    def one(name):
        cuts = CU.label_thresholds(pred, m.L, name, sweeps=3, bins=100_000)
        return cuts.join(F.broadcast(CU.mean_thresholds(cuts).withColumnRenamed("threshold", "final")), "j")

    return _per_measure(("hamming_loss", "micro_fmeasure", "macro_fmeasure"), one)


def _meta_frame(spark, d):
    from polytag.operators import meta as ME

    m, train = order_split(spark, d)
    return ME, m, ME.meta_frame(m, train, m.df, folds=3, seed=6)


def _meta_sizes(spark, d, kinds):
    ME, m, mf = _meta_frame(spark, d)
    out = None
    for inputs, head in kinds:
        x = ME.predict_sizes(mf, m.df, inputs, head).select(F.lit(inputs).alias("inputs"), F.lit(head).alias("head"), "id", "n", LS.bits("bip").alias("bits"))
        out = x if out is None else out.unionByName(x)
    return out


@query("th_meta_sizes")
def q_th_meta_sizes(spark, d):
    """Label-set sizes from cross-fitted meta features: all three inputs, by class and by number."""
    return _meta_sizes(spark, d, [("content", "class"), ("scores", "class"), ("ranks", "class"), ("scores", "number"), ("ranks", "number")])


@query("th_meta_content_number")
def q_th_meta_content_number(spark, d):
    return _meta_sizes(spark, d, [("content", "number")])


@query("th_predicted_cut")
def q_th_predicted_cut(spark, d):
    """Each row's threshold predicted from its scores, and the labels that reach it."""
    ME, m, mf = _meta_frame(spark, d)
    out = None
    for inputs in ("scores", "ranks"):
        x = ME.predict_thresholds(mf, m.df, inputs).select(F.lit(inputs).alias("inputs"), "id", "threshold", LS.bits("bip").alias("bits"))
        out = x if out is None else out.unionByName(x)
    return r6(out)


@query("ln_logreg")
def q_ln_logreg(spark, d):
    """One logistic model per label of the orders, all fitted by the same passes."""
    from polytag.operators.logreg import LogisticBase

    m, train = order_split(spark, d)
    return r6(LN.predict_br(LN.fit_br(m, train, base=LogisticBase()), m.df))


@query("ev_cross_validate")
def q_ev_cross_validate(spark, d):
    """Five-fold cross-validation of binary relevance on the order view: mean and sd of every measure."""
    return r6(VA.cross_validate(V.v_order(spark, d), "br", folds=5, seed=6))


@query("ev_cross_validate_curves")
def q_ev_cross_validate_curves(spark, d):
    """Curve measures of binary relevance over five folds: mean and sd."""
    return r6(VA.cross_validate_curves(V.v_order(spark, d), "br", folds=5, seed=6))


@query("ev_cross_validate_labels")
def q_ev_cross_validate_labels(spark, d):
    """Every label's own set and curve measures over five folds: mean and sd."""
    return r6(VA.cross_validate_labels(V.v_order(spark, d), "br", folds=5, seed=6))


@query("ev_sweep_neighbours")
def q_ev_sweep_neighbours(spark, d):
    """Both neighbour learners for k = 8, ..., 12 over three folds from shared searches: mean and sd of the set and area measures."""
    from polytag.operators import sweep as SW

    m = V.v_vec(spark, d)
    out = SW.sweep_measures(SW.neighbour_sweep(m, "embedding", (8, 9, 10, 11, 12), folds=3, seed=6))
    return r6(out.filter(F.col("measure").isin("hamming_loss", "subset_accuracy", "micro_fmeasure", "macro_fmeasure", "macro_auc", "micro_auc")))


@query("ev_compare")
def q_ev_compare(spark, d):
    """Binary relevance, label powerset and label priors on two data sets, five folds each."""
    return r6(VA.compare({"v_order": V.v_order(spark, d), "v_userday": V.v_userday(spark, d)}, seed=6))


# ---------------------------------------------------------------- 2.1 sources and sinks (round trips through files Spark writes)

from polytag.sources import formats as IO  # noqa: E402


@query("read_arff")
def q_read_arff(spark, d):
    m = V.v_order(spark, d)
    base = IO.scratch(spark, "arff")
    IO.write_arff(m, base + "/data", relation="orders")
    IO.write_label_xml(spark, [(lab, None) for lab in m.labels], base + "/labels.xml")
    names, _ = IO.read_label_xml(spark, base + "/labels.xml")
    r = IO.read_arff_dir(spark, base + "/data", labels=names, id_col="id")
    return r.df.select(F.col("id").cast("bigint").alias("id"), LS.bits("y").alias("bits"), "f_prio", "f_status",
                       F.col("f_lines").cast("int").alias("f_lines"), F.col("f_qty").cast("int").alias("f_qty"),
                       F.col("f_price").cast("int").alias("f_price"))


@query("read_libsvm_ml")
def q_read_libsvm_ml(spark, d):
    m = V.v_order(spark, d)
    path = IO.scratch(spark, "libsvm")
    IO.write_libsvm(m.with_df(m.df.withColumn("idd", F.col("id").cast("double"))), path, ["idd", "n_lines", "sum_qty", "o_totalprice"])
    r = IO.read_libsvm_ml(spark, path, n_features=4)
    return r6(r.df.select(F.col("x1").cast("bigint").alias("id"), LS.bits("y").alias("bits"), F.col("x2").alias("n_lines"),
                          F.col("x3").alias("sum_qty"), F.col("x4").alias("o_totalprice")))


@query("read_hier_csv")
def q_read_hier_csv(spark, d):
    m = V.v_tree(spark, d)
    path = IO.scratch(spark, "hiercsv")
    nat = V.nation_labels(spark, d)
    reg = {r[0]: r[1] for r in spark.read.parquet(f"{d}/region.parquet").collect()}
    paths = F.array(*[F.when(F.col("y")[k] == 1, F.lit(f"{reg[rk]}/{nm}")) for k, nm, rk in nat])
    cell = F.array_join(F.filter(paths, lambda p: p.isNotNull()), "@")
    m.df.select(F.col("id").cast("string").alias("id"), cell.alias("class")).write.mode("overwrite").option("header", True).csv(path)
    df, _ = IO.read_hier_csv(spark, path)
    return df.select(F.col("id").cast("bigint").alias("id"), F.explode("labels").alias("label"))


@query("read_text_vectors")
def q_read_text_vectors(spark, d):
    m = V.v_vec(spark, d)
    path = IO.scratch(spark, "vectors")
    line = F.concat_ws(" ", F.col("id").cast("double").cast("string"),
                       F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " "))
    m.df.select(line.alias("value")).write.mode("overwrite").text(path)
    v = IO.read_text_vectors(spark, path)
    x = v.select(F.col("vec")[0].cast("bigint").alias("id"), F.posexplode(F.slice("vec", F.lit(2), F.size("vec"))).alias("i", "x"))
    return r6(x.select("id", F.col("i").cast("int").alias("i"), "x"))


@query("write_ml_parquet")
def q_write_ml_parquet(spark, d):
    m = TR.hierarchical(V.v_tree(spark, d))
    path = IO.scratch(spark, "mlparquet")
    IO.write_ml_parquet(m, path)
    back = IO.read_ml_parquet(spark, path)
    return back.df.select("id", LS.bits(back.y_col).alias("bits"))


@query("model_save_load")
def q_model_save_load(spark, d):
    m, train = order_split(spark, d)
    path = IO.scratch(spark, "model")
    IO.save_nb_model(LN.fit_br(m, train), path)
    return r6(LN.predict_br(IO.load_nb_model(spark, path), m.df))


# ---------------------------------------------------------------- 2.12 streaming forms

from polytag.streaming import stream as STM  # noqa: E402


@query("st_score")
def q_st_score(spark, d):
    """The BR model of ln_binary_relevance scores the orders arriving in three micro-batches."""
    m, train = order_split(spark, d)
    model = LN.fit_br(m, train)
    base = IO.scratch(spark, "st-score")
    rows = m.df.select("id", *m.features)
    files = STM.stage_files(rows, base + "/in", parts=3)
    out = STM.score_stream(spark, base + "/in", rows.schema, lambda b: LN.predict_br(model, b), base + "/out", files_per_batch=files)
    return r6(out.select("id", "j", "conf", "bip"))


@query("st_update_counts")
def q_st_update_counts(spark, d):
    """Label counts (rows per label and value) kept current over three micro-batches."""
    m = V.v_userday(spark, d)
    base = IO.scratch(spark, "st-counts")
    rows = m.df.select("id", "y")
    files = STM.stage_files(rows, base + "/in", parts=3)

    def cells(x):
        return x.select(F.posexplode("y").alias("j", "t")).select(F.col("j").cast("int").alias("j"), "t", F.lit(1).alias("n"))

    return STM.count_stream(spark, base + "/in", rows.schema, cells, base + "/out", ["j", "t"], files_per_batch=files, compact_every=2)


@query("st_running_auc")
def q_st_running_auc(spark, d):
    """ROC area per label from score counts that a stream keeps current over three micro-batches."""
    from polytag.operators import curves as CV

    base = IO.scratch(spark, "st-auc")
    rows = scored(spark, d).select("id", "y", "conf")
    files = STM.stage_files(rows, base + "/in", parts=3)

    def cells(x):
        t = F.col("t").cast("double")
        return CV.score_cells(x).select("j", "c", t.alias("pos"), (1.0 - t).alias("neg"))

    counts = STM.count_stream(spark, base + "/in", rows.schema, cells, base + "/out", ["j", "c"], ("pos", "neg"), files_per_batch=files, compact_every=2)
    return r6(CV.label_curves(counts).select("j", "auc"))


@query("st_windowed_measures")
def q_st_windowed_measures(spark, d):
    """Hamming loss and micro F1 of the tied synthetic scores per 7-day event-time window."""
    s = scored(spark, d)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.pmod("id", F.lit(100000)).cast("int"))
    x = s.select("id", day.cast("timestamp").alias("ts"),
                 EV._count2("y", "bip", lambda u, v: (u == 1) & (v == 1)).alias("tp"),
                 EV._count2("y", "bip", lambda u, v: (u == 0) & (v == 1)).alias("fp"),
                 EV._count2("y", "bip", lambda u, v: (u == 1) & (v == 0)).alias("fn"),
                 EV._count2("y", "bip", lambda u, v: (u == 0) & (v == 0)).alias("tn"),
                 F.size("y").alias("L"))
    base = IO.scratch(spark, "st-win")
    # three files in event-time order, whatever months the events cover: no row is behind the watermark of an earlier file
    span = x.agg(F.min(F.unix_timestamp("ts")).alias("lo"), F.max(F.unix_timestamp("ts")).alias("hi")).first()
    part = F.floor((F.unix_timestamp("ts") - (span["lo"] or 0)) * 3 / ((span["hi"] or 0) - (span["lo"] or 0) + 1)).cast("int")
    files = STM.stage_files(x, base + "/in", parts=3, part_col=part)
    out = STM.windowed_measures(spark, base + "/in", x.schema, base + "/out", watermark="11 days", files_per_batch=files)
    return r6(out.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "hamming_loss", "micro_f1"))


# ---------------------------------------------------------------- views (the multi-label tables every operator reads)


def _view_q(name, cols):
    def fn(spark, d):
        m = V.VIEWS[name](spark, d)
        return r6(m.df.select("id", *cols, LS.bits("y").alias("bits")))

    return fn


QUERIES["v_userday"] = _view_q("v_userday", ["n_events", "sum_value", "first_hour", "f_n", "f_hour", "f_val"])
QUERIES["v_order"] = _view_q("v_order", ["o_totalprice", "n_lines", "sum_qty", "f_prio", "f_status", "f_lines", "f_qty", "f_price"])
QUERIES["v_tree"] = _view_q("v_tree", ["n_lines", "sum_qty", "f_prio", "f_status", "f_lines", "f_qty", "f_price"])
QUERIES["v_doc"] = _view_q("v_doc", ["lang", "source", "n_chars", "f_len"])
QUERIES["v_vec"] = _view_q("v_vec", ["label"])


@query("v_target")
def q_v_target(spark, d):
    t = V.v_target(spark, d)
    return r6(t.select("id", "o_totalprice", "n_lines", "prio", *[F.col("target")[j].alias(f"t{j}") for j in range(3)]))


@query("ln_stacking")
def q_ln_stacking(spark, d):
    m, train = order_split(spark, d)
    return _long_out(LN.stacking(m, train, folds=3))


@query("ln_iblr")
def q_ln_iblr(spark, d):
    m, train = vec_split(spark, d)
    return _long_out(LN.iblr(m, train, k=10))


@query("ln_cluster_then_fit")
def q_ln_cluster_then_fit(spark, d):
    m, train = order_split(spark, d)
    return _long_out(LN.cluster_then_fit(m, train, ["o_totalprice", "n_lines", "sum_qty"], k=5))


@query("ln_css")
def q_ln_css(spark, d):
    m, train = _materialized_split(V.v_tree(spark, d))
    return _long_out(LN.css_learner(m, train, kappa=5))


@query("tr_label_subset_css")
def q_tr_label_subset_css(spark, d):
    m = V.v_tree(spark, d)
    chosen, lev, P = LN.css_select(m, kappa=5)
    rows = [(int(c), int(j), float(P[i, j]), float(lev[c])) for i, c in enumerate(chosen) for j in range(m.L)]
    return r6(spark.createDataFrame(rows, "chosen int, j int, projection double, leverage double"))
