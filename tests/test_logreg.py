"""Joint logistic regression against single Newton fits; passes do not grow with the labels; odd tables."""

import numpy as np
import pytest

from polytag.frame import MLFrame
from polytag.operators import learners as LN
from polytag.operators import logreg as LR

SCHEMA = "id long, f string, g string, y array<int>"


def _rows(n=300, L=4, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        f, g = "abcd"[rng.integers(4)], [None, "u", "v"][rng.integers(3)]
        z = [(f == "a") - 1.5 * (g == "u"), 2.0 * (f == "b") - 1, 6.0 * (g == "v") - 3, -3.0]
        out.append((i, f, g, [None if rng.random() < 0.05 else int(rng.random() < 1 / (1 + np.exp(-z[j % 4]))) for j in range(L)]))
    return out


def _newton(rows, j, l2):
    """A single label's fit: the constant and one column per value, by plain Newton steps."""
    names = [*[("f", v) for v in sorted({r[1] for r in rows if r[1]})], *[("g", v) for v in sorted({r[2] for r in rows if r[2]})]]
    rows = [r for r in rows if r[3][j] is not None]
    x = np.array([[1.0, *[float((r[1] if f == "f" else r[2]) == v) for f, v in names]] for r in rows])
    t = np.array([r[3][j] for r in rows])
    held = np.array([l2 * 1e-3, *[l2] * len(names)])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(held), x.T @ (p - t) + held * w)
    return w[0], dict(zip(names, w[1:]))


def _fit(spark, rows, L, base=LR.LogisticBase()):
    m = MLFrame(spark.createDataFrame(rows, SCHEMA), tuple(f"l{j}" for j in range(L)), ("f", "g"))
    return m, LN.fit_br(m, base=base)


@pytest.mark.parametrize("l2", [0.1, 5.0])
def test_coefficients_equal_single_fits(spark, l2):
    rows = _rows()
    m, model = _fit(spark, rows, 4, LR.LogisticBase(l2=l2))
    got = {(r["j"], r["f"], r["v"]): r["w"] for r in model.weights.collect()}
    const = {r["j"]: r["kc"] for r in model.const if r["t"] == 1}
    pred = {(r["id"], r["j"]): r["conf"] for r in LN.predict_br(model, m.df).collect()}
    assert len(pred) == 1200
    for j in range(4):
        c, w = _newton(rows, j, l2)
        assert abs(const[j] - c) < 1e-5 and all(abs(got[j, f, v] - b) < 1e-5 for (f, v), b in w.items())
        for i, f, g, _ in rows[:50]:
            z = c + w[("f", f)] + w.get(("g", g), 0.0)
            assert abs(pred[i, j] - 1 / (1 + np.exp(-z))) < 1e-6


def test_passes_do_not_grow_with_the_labels(spark, monkeypatch):
    passes = []
    real = LR._losses
    monkeypatch.setattr(LR, "_losses", lambda *a: passes.append(1) or real(*a))
    counts = []
    for L in (4, 16):
        passes.clear()
        _fit(spark, _rows(L=L), L)
        counts.append(len(passes))
    assert counts[1] <= counts[0] + 8 and counts[1] < 40


def test_odd_tables(spark):
    rows = [(1, "a", None, [1, 0, None]), (1, "a", None, [1, 0, None]), (None, None, None, [1, 1, None]), (3, "b", "u", [1, 0, None])]
    m, model = _fit(spark, rows, 3)
    new = spark.createDataFrame([(9, "unseen", "u", [0, 0, 0])], SCHEMA)
    p = {r["j"]: r["conf"] for r in LN.predict_br(model, new).collect()}
    assert p[0] > 0.9 and np.isfinite(p[0]) and p[1] < 0.5 and abs(p[2] - 0.5) < 1e-12  # one class only; both; no rows
    none = LN.fit_br(m, m.df.limit(0), base=LR.LogisticBase())
    assert {r["conf"] for r in LN.predict_br(none, new).collect()} == {0.5}
    with pytest.raises(ValueError):
        LR.LogisticBase().fit(m.df, ["j"], ["f"], m.df, more=1)


def test_too_many_values_are_refused(spark, monkeypatch):
    monkeypatch.setattr(LR, "MOST_COLUMNS", 3)
    with pytest.raises(ValueError, match="bin"):
        _fit(spark, _rows(50), 4)
