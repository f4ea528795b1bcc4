"""Statistics and transformations on hand-worked fixtures (FIXTURES.md F1, F6)."""

import pytest
from pyspark.sql import functions as F

from polytag.frame import MLFrame
from polytag.operators import split as SP
from polytag.operators import stats as ST
from polytag.operators import transform as TR


@pytest.fixture(scope="module")
def f1m(f1):
    return MLFrame(f1.select("id", "y"), ("a", "b", "c"))


def test_cardinality_priors(f1m):
    c = ST.label_cardinality(f1m).first()
    assert c["cardinality"] == pytest.approx(1.4) and c["density"] == pytest.approx(0.466667, abs=1e-6)
    pri = {r["j"]: r["prior"] for r in ST.label_priors(f1m).collect()}
    assert [pri[j] for j in range(3)] == pytest.approx([0.6, 0.4, 0.4])


def test_cooccurrence_phi_chi2(f1m):
    co = {(r["i"], r["j"]): r["n"] for r in ST.label_cooccurrence(f1m).collect()}
    assert co == {(0, 1): 1, (0, 2): 2, (1, 2): 1}
    phi = {(r["i"], r["j"]): r["phi"] for r in ST.label_phi(f1m).collect()}
    assert phi[(0, 1)] == pytest.approx(-0.166667, abs=1e-6)
    assert phi[(0, 2)] == pytest.approx(0.666667, abs=1e-6)
    assert phi[(1, 2)] == pytest.approx(0.166667, abs=1e-6)
    chi = {(r["i"], r["j"]): r["score"] for r in ST.chi2_pairs(f1m).collect()}
    assert chi[(0, 2)] == pytest.approx(2.222222, abs=1e-6)


def test_constant_label_phi_undefined(spark):
    df = spark.createDataFrame([(1, [1, 0]), (2, [0, 0]), (3, [1, 0])], "id long, y array<int>")
    m = MLFrame(df, ("a", "b"))
    phi = {(r["i"], r["j"]): r["phi"] for r in ST.label_phi(m).collect()}
    assert phi[(0, 1)] is None
    chi = ST.chi2_pairs(m).first()
    assert chi["score"] == pytest.approx(0.0001)


def test_f6_pruning(spark):
    rows = [(i, [1, 1, 0]) for i in range(3)] + [(10 + i, [1, 0, 0]) for i in range(3)] + \
           [(20 + i, [0, 1, 0]) for i in range(3)] + [(30, [1, 1, 1])]
    m = MLFrame(spark.createDataFrame(rows, "id long, y array<int>"), ("a", "b", "c"))
    a = {r["new_bits"] for r in TR.prune_ps(m, 2, "A", 1).filter("bits = '111'").collect()}
    b = {r["new_bits"] for r in TR.prune_ps(m, 2, "B", 1).filter("bits = '111'").collect()}
    p = {r["new_bits"] for r in TR.prune_ppt(m, 2).filter("bits = '111'").collect()}
    assert a == {"110"} and b == {"110"} and p == {"110"}


def test_transform_row_counts(f1m):
    assert TR.copy(f1m).count() == 7          # one row per set label
    assert TR.ignore(f1m).count() == 2        # rows 4 and 5 have exactly one label
    pw = TR.pairwise(f1m).collect()           # pairs where exactly one label is set
    assert all(r["a"] < r["b"] for r in pw)


def test_folds_balanced_and_partition_independent(f1m, spark):
    df = spark.range(103).select(F.col("id"), F.array((F.col("id") % 2).cast("int"), (F.col("id") % 3 == 0).cast("int")).alias("y"))
    m = MLFrame(df, ("a", "b"))
    f = SP.cv_folds(m, 10, seed=5)
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    f2 = SP.cv_folds(m.with_df(df.repartition(7)), 10, seed=5)
    assert sorted(f.collect()) == sorted(f2.collect())
    s = SP.strat_label_powerset(m, 5, seed=5).join(m.df.select("id", F.array_join(F.col("y").cast("array<string>"), "").alias("b")), "id")
    per = s.groupBy("b", "fold").count().groupBy("b").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in per)
