"""Neighbour sweeps against a plain loop over folds and k; user measures and distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from polytag.frame import MLFrame
from polytag.functions import labelsets as LS
from polytag.operators import cuts as CU
from polytag.operators import evaluate as EV
from polytag.operators import knn as KN
from polytag.operators import sweep as SW

SCHEMA = "id long, vec array<double>, y array<int>"


def _rows(n=60, seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = rng.integers(0, 5, 3).astype(float)  # a range of 4: scaled values and their ties are exact
        out.append((i, v.tolist(), [int(v[0] + rng.random() > 3), int(v[1] > 2), int(rng.random() < 0.2)]))
    return out


def _frame(spark, rows):
    return MLFrame(spark.createDataFrame(rows, SCHEMA), ("p", "q", "r"), ("vec",))


def _plain(rows, own, ks, folds, s=1.0):
    """{(learner, k, id): (conf, bip)} by definition."""
    x = np.array([r[1] for r in rows])
    z = (x - x.min(0)) / np.where(np.ptp(x, 0) == 0, 1, np.ptp(x, 0))
    ids, y = [r[0] for r in rows], np.array([r[2] for r in rows])
    L, out = y.shape[1], {}

    def near(a, among, k):
        return sorted((b for b in among if b != a), key=lambda b: (((z[a] - z[b]) ** 2).sum(), ids[b]))[:k]

    for f in range(folds):
        train = [a for a in range(len(rows)) if own[ids[a]] != f]
        for k in ks:
            c = {a: y[near(a, train, k)].sum(0) for a in range(len(rows))}
            for a in set(range(len(rows))) - set(train):
                votes = c[a]
                ml, br = [], []
                for j in range(L):
                    prior = (s + y[train, j].sum()) / (2 * s + len(train))
                    p = [(s + sum(y[b, j] == t and c[b][j] == votes[j] for b in train)) / (s * (k + 1) + sum(y[b, j] == t for b in train)) for t in (0, 1)]
                    i, o = prior * p[1], (1 - prior) * p[0]
                    ml.append((i / (i + o), int(i >= o)))
                    q = (1 / len(train) + votes[j]) / (L / len(train) + min(k, len(train)))
                    br.append((q, int(q >= 0.5)))
                out["mlknn", k, ids[a]], out["brknn", k, ids[a]] = ml, br
    return out


def test_sweep_equals_single_models(spark):
    rows, ks = _rows(), (1, 4, 5)
    m = _frame(spark, rows)
    own = {r["id"]: r["f"] for r in m.df.select("id", F.pmod(LS.stable_hash("id", 2), F.lit(3)).alias("f")).collect()}
    want = _plain(rows, own, ks, 3)
    pred = SW.neighbour_sweep(m, "vec", ks, folds=3, seed=2)
    got = pred.collect()
    assert len(got) == len(want) == 2 * 3 * 60
    for r in got:
        for (c, b), gc, gb in zip(want[r["learner"], r["k"], r["id"]], r["conf"], r["bip"]):
            assert abs(c - gc) < 1e-9 and (b == gb or abs(c - 0.5) < 1e-9)
    table = SW.sweep_measures(pred).collect()
    keys = {(r["learner"], r["k"]) for r in table}
    assert keys == {(a, k) for a in SW.LEARNERS for k in ks} and len(table) == len({(r["learner"], r["k"], r["measure"]) for r in table})
    loss = {(r["learner"], r["k"]): r["mean"] for r in table if r["measure"] == "hamming_loss"}
    for a, k in keys:
        per = [np.mean([[gb != t for gb, t in zip(r["bip"], r["y"])] for r in got if (r["learner"], r["k"], r["fold"]) == (a, k, f)]) for f in range(3)]
        assert abs(loss[a, k] - np.mean(per)) < 1e-9


def test_odd_rows(spark):
    rows = [*_rows(8), (100, None, [1, 0, 0]), (101, [1.0, 1.0, 1.0], [None, 0, 1])]
    m = _frame(spark, rows)
    got = SW.neighbour_sweep(m, "vec", (3, 50), folds=2).collect()  # more neighbours asked for than there are rows
    assert {r["id"] for r in got} == set(range(8)) and len(got) == 8 * 2 * 2
    alone = SW.neighbour_sweep(_frame(spark, rows[:1]), "vec", (3,), folds=2).collect()
    assert {r["learner"]: {round(c, 9) for c in r["conf"]} for r in alone} == {"mlknn": {0.5}, "brknn": {round(1 / 3, 9)}}
    empty = SW.neighbour_sweep(_frame(spark, rows[8:]), "vec", (3,), folds=2)
    assert empty.count() == 0 and [f.simpleString() for f in empty.schema.fields]
    with pytest.raises(ValueError):
        SW.neighbour_sweep(m, "vec", (3,), learners=("svm",))


def test_a_distance_of_the_user(spark):
    def _manhattan(a, b):
        return np.abs(a[:, None, :] - b[None, :, :]).sum(2)

    rows = _rows()
    m = _frame(spark, rows)
    x = np.array([r[1] for r in rows])
    z = (x - x.min(0)) / np.ptp(x, 0)
    got = {}
    for r in KN.knn(m.df, m.df, 4, distance=_manhattan, block_rows=16).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = (r["rid"], r["dist"])
    for a in range(len(rows)):
        want = sorted((round(float(np.abs(z[a] - z[b]).sum()), 12), b) for b in range(len(rows)) if b != a)[:4]
        assert [round(got[a][i + 1][1], 12) for i in range(4)] == [d for d, _ in want]
    model = KN.fit_mlknn(m.df, 3, k=4, distance=_manhattan)
    assert KN.predict_mlknn(model, m.df, m.df).count() == 180
    assert KN.predict_brknn(m.df, m.df, 3, k=4, distance=_manhattan).count() == 60
    assert KN.select_k(m.df, 3, kmax=4, distance=_manhattan).count() == 4
    with pytest.raises(ValueError):
        KN.knn(m.df, m.df, 4, method="cells", distance=_manhattan)


def test_measures_of_the_user(spark, f1):
    ratio = lambda a, b, c, d: F.sqrt((a + 1.0) / (a + b + c + 1.0))
    own = [CU.Measure(f"mine_{lv}", ratio, lv) for lv in ("pooled", "label", "row")]
    df = EV.with_predictions(f1)
    rows = df.collect()
    cells = [[(int(t), int(b)) for t, b in zip(r["y"], r["bip"])] for r in rows]

    def value(zs):
        a, b, c = zs.count((1, 1)), zs.count((0, 1)), zs.count((1, 0))
        return ((a + 1) / (a + b + c + 1)) ** 0.5

    want = {"mine_row": np.mean([value(z) for z in cells]), "mine_pooled": value(sum(cells, [])),
            "mine_label": np.mean([value([z[j] for z in cells]) for j in range(3)])}
    every = {r["measure"]: r["value"] for r in EV.evaluate(df, measures=own).collect()}
    assert all(abs(every[k] - v) < 1e-12 for k, v in want.items()) and "micro_auc" in every
    # the built ones agree with the evaluation's own, and a measure of the user finds a threshold
    names = ["hamming_loss", "micro_fmeasure", "macro_recall", "ex_accuracy", "subset_accuracy"]
    again = {r["measure"]: r["value"] for r in CU.measured(df, names).collect()}
    assert all(abs(again[n] - every[n]) < 1e-12 for n in names)
    pred = df.select("id", F.lit(0).alias("fold"), "y", "conf")
    assert CU.final_threshold(CU.one_threshold(pred, own[0])).count() == 1
    assert CU.measured(df.limit(0), own).count() == 0
