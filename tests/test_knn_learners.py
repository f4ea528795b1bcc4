"""Neighbours (F7), learners on planted data, hierarchy loss (F2)."""

import pytest
from pyspark.sql import functions as F

from polytag.frame import MLFrame
from polytag.operators import evaluate as EV
from polytag.operators import knn as KN
from polytag.operators import learners as LN


def test_f7_neighbours_tie_by_id_self_excluded(spark):
    pts = [(1, [0.0]), (2, [1.0]), (3, [2.0]), (4, [3.0]), (5, [5.0]), (6, [8.0])]
    df = spark.createDataFrame(pts, "id long, vec array<double>")
    nb = {(r["qid"], r["rank"]): r["rid"] for r in KN.knn(df, df, 2, "vec").collect()}
    assert nb[(2, 1)] == 1 and nb[(2, 2)] == 3      # equal distances: smaller id first
    assert all(q != r for (q, _), r in nb.items())  # self never a neighbour


def test_br_beats_prior_on_planted_data(spark):
    rows = [(i, "a" if i % 2 else "b", [i % 2, 1 - i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, f string, y array<int>")
    m = MLFrame(df, ("p", "q"), ("f",))
    pred = LN.to_arrays(LN.predict_br(LN.fit_br(m), df), ("conf", "bip"))
    ev = {r["measure"]: r["value"] for r in EV.evaluate(EV.with_predictions(pred.join(df.select("id", "y"), "id"))).collect()}
    assert ev["hamming_loss"] == pytest.approx(0.0)


def test_chain_equals_br_without_label_dependence(spark):
    rows = [(i, str(i % 3), [int(i % 3 == 0), int(i % 3 == 1)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, f string, y array<int>")
    m = MLFrame(df, ("p", "q"), ("f",))
    br = {r["id"]: r["bip"] for r in LN.to_arrays(LN.predict_br(LN.fit_br(m), df), ("bip",)).collect()}
    cc = {r["id"]: r["bip"] for r in LN.predict_cc(LN.fit_cc(m), df, 2).collect()}
    assert br == cc


def test_f2_hierarchical_loss(spark):
    # tree A -> {B, C}, D ; truth A,B
    anc = [[], [0], [0], []]
    df = spark.createDataFrame([(1, [1, 1, 0, 0], [1, 0, 1, 0]), (2, [1, 1, 0, 0], [0, 0, 0, 1])],
                               "id long, y array<int>, bip array<int>")
    per = EV.hierarchical_loss(df.filter("id = 1"), anc).first()[0], EV.hierarchical_loss(df.filter("id = 2"), anc).first()[0]
    assert per == (2.0, 2.0)
