"""Learners whose models see a row's features and labels alone count equal rows once, whatever the number of rows."""

import pytest
from pyspark.sql import functions as F

from polytag.frame import MLFrame
from polytag.operators import learners as LN
from polytag.operators import nb as NB

ROWS, FOLDS = 240, 3


@pytest.fixture(scope="module")
def frame(spark):
    # 4 feature tuples, 12 (features, labels) pairs
    n = F.col("id")
    df = spark.range(ROWS).select("id", (n % 2).cast("string").alias("f"), (n % 4).cast("string").alias("h"),
                                  F.array((n % 3 == 0).cast("int"), (n % 2).cast("int"), ((n % 6) < 2).cast("int")).alias("y"))
    return MLFrame(df, ("a", "b", "c"), ("f", "h"))


def two_stage(m, pruned):
    br = LN.fit_br(m)
    return LN.predict_two_stage_chain(br, LN.fit_pairwise_stacked(m, br, m.df, pruned), m.df, m.L)


def hmc(m):
    parents = {0: 2, 1: 2, 2: None}
    return LN.predict_hmc(LN.fit_hmc(m, m.df, parents), m.df, m.L, parents)


CASES = {
    "two_stage_chain": lambda m: two_stage(m, False),
    "two_stage_pruned_chain": lambda m: two_stage(m, True),
    "hmc": hmc,
    "ecc": lambda m: LN.ecc(m, m.df, m=2),
    "stacking": lambda m: LN.stacking(m, m.df, folds=FOLDS),
    "subsets": lambda m: LN.predict_subsets(LN.fit_subsets(m, [[0, 1], [2], [0, 2]], m.df), m.df, m.L),
    "chains": lambda m: LN.predict_chains(m, m.df, [[2, 0], [1]], m.df),
}


@pytest.mark.parametrize("name", CASES)
def test_models_count_equal_rows_once(frame, name, monkeypatch):
    seen = []
    fit = NB.fit_nb

    def counted(rows, *args, **kw):
        seen.append((rows.count(), rows.agg(F.sum(kw["weight"])).first()[0] if kw.get("weight") else rows.count()))
        return fit(rows, *args, **kw)

    monkeypatch.setattr(NB, "fit_nb", counted)
    out = CASES[name](frame).collect()
    assert sorted(r["id"] for r in out) == list(range(ROWS))
    # at most one row per (features, labels, fold) and model key
    assert seen and all(rows <= 12 * FOLDS * 3 * (FOLDS - 1) and rows < weight for rows, weight in seen)


def test_out_of_fold_scores_are_of_the_models_without_the_row(frame):
    model, tr, _ = LN._fold_keyed_br(frame, frame.df, FOLDS, 1)
    p = NB.nb_binary_scores(model, tr, "id").join(tr.select("id", "_fold"), "id").filter(F.col("fold") == F.col("_fold"))
    want = {(r["id"], r["j"]): r["p1"] for r in p.collect()}
    got = LN.out_of_fold_br(frame, frame.df, FOLDS, 1).collect()
    assert {(r["id"], j): c for r in got for j, c in enumerate(r["conf"])} == pytest.approx(want)


def test_hmc_counts_rows_under_a_set_parent_alone(spark):
    df = spark.createDataFrame([(1, "x", [1, 0, 1]), (2, "x", [1, 1, 0]), (3, "z", [0, None, 1])], "id long, f string, y array<int>")
    got = LN.label_counts(df, ["f"], "y", 3, lambda j: F.lit(True) if j == 2 else F.get("y", F.lit(2)) == 1).collect()
    assert {(r["f"], r["j"], r["t"], r["_w"]) for r in got} == {("x", 0, 1, 1.0), ("x", 1, 0, 1.0), ("x", 2, 1, 1.0), ("x", 2, 0, 1.0), ("z", 0, 0, 1.0), ("z", 2, 1, 1.0)}


def test_tied_groups_are_drawn_per_row_and_others_vote_alike(spark):
    # label 0 is 0 and 1 equally often under f = x (a tie), label 1 always 1
    df = spark.range(64).select("id", F.lit("x").alias("f"), F.array((F.col("id") % 2).cast("int"), F.lit(1)).alias("y"))
    m = MLFrame(df, ("a", "b"), ("f",))
    out = LN.predict_subsets(LN.fit_subsets(m, [[0], [1]], df), df, 2).collect()
    assert len(out) == 64 and {r["conf"][1] for r in out} == {1.0}
    assert {r["conf"][0] for r in out} == {0.0, 1.0}


def test_greedy_clustering_fits_compacted_rows(frame, monkeypatch):
    from polytag.operators import partitions as PT

    seen = []
    fit = NB.fit_nb
    monkeypatch.setattr(NB, "fit_nb", lambda rows, *a, **kw: (seen.append(rows.count()), fit(rows, *a, **kw))[1])
    groups, _ = PT.greedy_label_clustering(frame, frame.df, folds=FOLDS, seed=1)
    assert sorted(j for g in groups for j in g) == [0, 1, 2]
    assert seen and max(seen) <= 12 * FOLDS * (FOLDS - 1)


def test_signed_sums_are_those_of_the_rows(spark):
    import itertools

    import pyarrow as pa

    from polytag.operators import cluster as CL

    sets = [(list(y), n + 1) for n, y in enumerate(itertools.product((0, 1, None), repeat=3))]
    batch = pa.RecordBatch.from_arrays([pa.array([y for y, _ in sets], pa.list_(pa.int32())), pa.array([n for _, n in sets])], names=["y", "count"])
    centres = [[(0, 1), (2, -1)], [(1, 1)]]
    out = next(CL._signed_sums(centres, 3)(iter([batch]))).to_pylist()
    sign = lambda y, j: 2 * (y[j] or 0) - 1
    for r in out:
        want = sum(n * sign(y, r["j"]) * (1 if sum(s * sign(y, m) for m, s in centres[r["c"]]) >= 0 else -1) for y, n in sets)
        assert r["s"] == want
    assert len(out) == 6
