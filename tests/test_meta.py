"""Meta learners: cross-fitted scores, both heads on all inputs, predicted cuts, and odd tables."""

import itertools

import numpy as np
import pytest

from polytag.frame import MLFrame
from polytag.operators import meta as ME

SCHEMA = "id long, f string, g string, y array<int>"


def _frame(spark, rows):
    return MLFrame(spark.createDataFrame(rows, SCHEMA), ("p", "q", "r"), ("f", "g"))


def _planted(n=400):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        f, g = "abc"[rng.integers(3)], "uv"[rng.integers(2)]
        size = {"a": 0, "b": 1, "c": 2}[f] + (g == "v")  # the size is a sum of what f and g say
        rows.append((i, f, g, [int(j < size) for j in range(3)]))
    return rows


def _plain_nb(rows, j, f, g):
    """P(label j) of (f, g) from counts with one added."""
    n = [sum(1 for r in rows if r[3][j] == t) for t in (0, 1)]
    s = [np.log((n[t] + 1) / (sum(n) + 2)) for t in (0, 1)]
    for at, v, width in ((1, f, 3), (2, g, 2)):
        for t in (0, 1):
            s[t] += np.log((sum(1 for r in rows if r[3][j] == t and r[at] == v) + 1) / (n[t] + width))
    return 1 / (1 + np.exp(s[0] - s[1]))


def test_scores_come_from_models_that_did_not_see_the_row(spark):
    rows = _planted(120)
    m = _frame(spark, rows)
    mf = ME.meta_frame(m, m.df, m.df, folds=3, seed=2)
    own = {r["id"]: r["o"] for r in m.df.selectExpr("id", "0 AS o").drop("o").withColumn("o", ME.F.pmod(ME.LS.stable_hash("id", 2), ME.F.lit(3))).collect()}
    by = {r[0]: r for r in rows}
    want = {(own[i], r[1], r[2]): [_plain_nb([x for x in rows if own[x[0]] != own[i]], j, r[1], r[2]) for j in range(3)] for i, r in by.items()}
    seen = mf.seen.collect()
    assert sum(r["_w"] for r in seen) == len(rows)
    for r in seen:
        assert np.allclose(r["conf"], want[(r["fold"], r["f"], r["g"])], atol=1e-8)
    for r in mf.tuples.collect():
        assert np.allclose(r["conf"], [_plain_nb(rows, j, r["f"], r["g"]) for j in range(3)], atol=1e-8)


@pytest.mark.parametrize("inputs,head", list(itertools.product(ME.INPUTS, ME.HEADS)))
def test_sizes_are_learned(spark, inputs, head):
    rows = _planted()
    m = _frame(spark, rows)
    mf = ME.meta_frame(m, m.df, m.df)
    got = ME.predict_sizes(mf, m.df, inputs, head).collect()
    size = {r[0]: sum(r[3]) for r in rows}
    assert len(got) == len(rows) and all(sum(r["bip"]) == min(3, max(0, r["n"])) for r in got)
    # on features the size is an exact sum (least squares hits it) or nearly one (naive Bayes)
    right = np.mean([r["n"] == size[r["id"]] for r in got])
    assert right == 1.0 if (inputs, head) == ("content", "number") else right >= 0.6


@pytest.mark.parametrize("inputs", ME.INPUTS)
def test_numbers_equal_numpy_least_squares(spark, inputs):
    rows = _planted(200)
    rows = [(i, f, g, [y[0], y[1], int(i % 3 == 0)]) for i, f, g, y in rows]
    m = _frame(spark, rows)
    mf = ME.meta_frame(m, m.df, m.df)

    def x(r):
        if inputs == "content":
            return [1.0, r["f"] == "b", r["f"] == "c", r["g"] == "v"]
        return [1.0, *(sorted(r["conf"]) if inputs == "ranks" else r["conf"])]

    def cut(y, conf):
        s = sorted(conf)
        best, at = len(y), 0.0
        for lo, hi in zip([s[0], *s], s):
            t = (lo + hi) / 2
            e = sum((v == 1 and c <= t) or (v == 0 and c >= t) for v, c in zip(y, conf))
            if e < best:
                best, at = e, t
        return at

    seen = mf.seen.collect()
    w = np.sqrt([r["_w"] for r in seen])
    a = np.array([x(r) for r in seen], dtype=float)
    for target, out in ((lambda r: sum(r["y"]), None), (lambda r: cut(r["y"], r["conf"]), "threshold")):
        coef = np.linalg.lstsq(a * w[:, None], w * np.array([target(r) for r in seen]), rcond=None)[0]
        want = {(r["f"], r["g"]): float(np.array(x(r), dtype=float) @ coef) for r in mf.tuples.collect()}
        got = ME.predict_thresholds(mf, m.df, inputs) if out else ME.predict_sizes(mf, m.df, inputs, "number")
        for r in got.collect():
            v = want[rows[r["id"]][1:3]]
            if out:
                assert abs(r["threshold"] - v) < 1e-6 and r["bip"] == [int(c >= r["threshold"]) for c in r["conf"]]
            else:
                assert abs(v + 0.5 - round(v + 0.5)) < 1e-6 or r["n"] == np.floor(v + 0.5)


def test_odd_tables(spark):
    rows = [(1, "a", None, [1, 0, 1]), (1, "a", None, [1, 0, 1]), (2, None, None, [None, 1, 0]), (None, "b", "u", [0, 0, 0]), (4, "b", "u", [1, 1, 1])]
    m = _frame(spark, rows)
    new = spark.createDataFrame([(9, "unseen", "u", [0, 0, 0]), *rows], SCHEMA)
    mf = ME.meta_frame(m, m.df, new)
    assert sum(r["_w"] for r in mf.seen.collect()) == 3  # a row without id belongs to no fold, one with a missing label has no size
    for inputs, head in itertools.product(ME.INPUTS, ME.HEADS):
        assert ME.predict_sizes(mf, new, inputs, head).count() == 6
    assert ME.predict_thresholds(mf, new, "ranks").count() == 6
    empty = m.df.limit(0)
    none = ME.meta_frame(m, empty, new)
    assert {r["n"] for i, h in itertools.product(ME.INPUTS, ME.HEADS) for r in ME.predict_sizes(none, new, i, h).collect()} == {0}
    assert {r["threshold"] for r in ME.predict_thresholds(none, new).collect()} == {0.0}
    with pytest.raises(ValueError):
        ME.predict_sizes(mf, new, "labels")
