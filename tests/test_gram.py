"""Regression families from one scan against plain least squares on the rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polytag.functions.labelsets import stable_hash
from polytag.operators import gram as GR
from polytag.operators import regress as RG

X = ["a", "b", "c"]


def table(spark, n, missing):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        x = [rng.gauss(2e5, 3e4), rng.gauss(0, 1), float(rng.randrange(7))]
        y = [0.01 * x[0] + 5 * x[1] + rng.gauss(0, 40), 0.0, 0.0]
        y[1] = 0.5 * y[0] + 9 * x[2] + rng.gauss(0, 3)
        y[2] = y[1] - 20 * x[1] * x[2] + rng.gauss(0, 1)
        for t in range(3):
            if missing and rng.random() < 0.15:
                y[t] = rng.choice([None, math.nan])
        if missing and rng.random() < 0.05:
            x[rng.randrange(3)] = rng.choice([None, math.nan])
        rows.append((i, *x, y))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, target array<double>").repartition(4)
    folds = {r.id: r.f for r in df.select("id", F.pmod(stable_hash("id", 1), F.lit(3)).alias("f")).collect()}
    return df, [r for r in rows if all(v is not None and not math.isnan(v) for v in r[1:4])], folds


def there(v):
    return v is not None and not math.isnan(v)


def ols(x, y, w=None):
    z = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    s = np.ones(len(y)) if w is None else np.sqrt(w)
    scale = np.abs(z).max(0)
    return np.linalg.lstsq(z / scale * s[:, None], np.array(y) * s, rcond=None)[0] / scale


def said(b, x):
    return b[0] + x @ b[1:]


def plain_chain(rows, order, mode, folds, weights=None):
    x, fold = np.array([r[1:4] for r in rows]), np.array([folds[r[0]] for r in rows])
    y = np.array([[v if there(v) else math.nan for v in r[4]] for r in rows])
    w = np.ones(len(rows)) if weights is None else weights
    ins, outs, ok = x, x, np.ones(len(rows), bool)
    pred = np.zeros_like(y)
    for t in order:
        use = ok & ~np.isnan(y[:, t]) & (w > 0)
        b = ols(ins[use], y[use, t], w[use])
        pred[:, t] = said(b, outs)
        if mode == "true":
            meta, ok = y[:, t], ok & ~np.isnan(y[:, t])
        elif mode == "train":
            meta = said(b, ins)
        else:
            meta = np.zeros(len(rows))
            for f in range(3):
                meta[fold == f] = said(ols(ins[use & (fold != f)], y[use & (fold != f), t]), ins[fold == f])
        ins, outs = np.column_stack([ins, meta]), np.column_stack([outs, pred[:, t]])
    return pred


def close(df, rows, want):
    got = {r.id: r.pred for r in df.collect()}
    scale = np.abs(want).max()
    for r, p in zip(rows, want, strict=True):
        assert np.abs(np.array(got[r[0]]) - p).max() < 1e-7 * scale


@pytest.mark.parametrize("mode", ["true", "train", "cv"])
@pytest.mark.parametrize("missing", [False, True])
def test_chains(spark, mode, missing):
    df, rows, folds = table(spark, 150, missing)
    close(RG.regressor_chain(df, X, [1, 0, 2], df, mode), rows, plain_chain(rows, [1, 0, 2], mode, folds))


def test_ensembles_in_one_scan(spark):
    df, rows, folds = table(spark, 120, True)
    for sampling, weight in (("bag", lambda i: RG.poisson_weight(i, 4)), ("part", lambda i: RG.part_weight(i, 4, 67.0)), ("all", lambda i: F.lit(1.0))):
        chains = RG.random_chains(3, 3, 4)
        want = 0
        for i, order in enumerate(chains):
            w = {r.id: r.w for r in df.select("id", weight(i).alias("w")).collect()}
            want = want + plain_chain(rows, order, "true", folds, np.array([w[r[0]] for r in rows])) / len(chains)
        close(RG.ensemble_of_chains(df, X, 3, df, m=3, seed=4, sampling=sampling), rows, want)


def test_stacks_samples_and_mixes(spark):
    df, rows, folds = table(spark, 150, False)
    x, y = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    fold = np.array([folds[r[0]] for r in rows])
    full = np.column_stack([said(ols(x, y[:, t]), x) for t in range(3)])
    oof = np.zeros_like(y)
    for f in range(3):
        for t in range(3):
            oof[fold == f, t] = said(ols(x[fold != f], y[fold != f, t]), x[fold == f])
    for mode, metas in (("true", y), ("cv", oof)):
        for attributes in (True, False):
            base = x if attributes else x[:, :0]
            want = np.column_stack([said(ols(np.column_stack([base, np.delete(metas, t, 1)]), y[:, t]), np.column_stack([base, np.delete(full, t, 1)])) for t in range(3)])
            close(RG.stacking(df, X, 3, df, mode=mode, attributes=attributes), rows, want)
    # linear models of the training rows' own predictions add nothing
    close(RG.stacking(df, X, 3, df), rows, full)
    close(RG.regressor_chain(df, X, [0, 1, 2], df, "sample"), rows, full)
    close(RG.random_linear_combinations(df, X, 3, df, r=6), rows, full)
    close(RG.compare(df, X, 3, df, [0, 1, 2])["single_target"], rows, full)


def test_sweeps_and_odd_tables(spark):
    rng = np.random.default_rng(1)
    z = np.concatenate([np.ones((40, 1)), rng.normal(size=(40, 4))], axis=1)
    z[:, 3] = 2 * z[:, 1] - z[:, 2] + 5  # determined by the others
    b = GR.solve(z.T @ z)
    assert np.allclose(z[:, :4] @ b, z[:, :4] @ np.linalg.lstsq(z[:, :4], z[:, 4], rcond=None)[0])
    a = z.T @ z
    assert np.allclose(np.diag(GR.swept(GR.swept(a, 2), 2))[:2], np.diag(a)[:2])
    df, _, _ = table(spark, 30, False)
    g = GR.grams(df.limit(0), X, [F.col("target")[0]])
    assert g.cells == {} and (GR.combinations(g, np.eye(1)) == 0).all()
    same = GR.grams(df.withColumn("a", F.lit(3.0)), X, [F.lit(2.5)])
    assert np.allclose(GR.combinations(same, np.eye(1)), [[2.5, 0, 0, 0]])
    with pytest.raises(ValueError):
        RG.regressor_chain(df, X, [0, 1, 2], df, "none")
