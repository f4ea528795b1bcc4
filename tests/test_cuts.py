"""Threshold searches for any measure equal a plain search over the rows."""

import random

import pytest
from pyspark.sql import functions as F

from polytag.operators import cuts as CU

SCHEMA = "id long, fold int, y array<int>, conf array<double>"
L = 3


def plain_value(name, rows, yes):
    """The measure ``name`` of rows [(y, scores)] where yes(scores, j) tells a predicted label."""
    cells = [[(t, yes(c, j)) for j, t in enumerate(y)] for y, c in rows]

    def four(x):
        return tuple(float(sum(1 for t, p in x if (t, p) == w)) for w in ((1, True), (0, True), (1, False), (0, False)))

    def f(a, b, c, d):
        return 1.0 if a + b + c == 0 else 2 * a / (2 * a + b + c)

    def geo(a, b, c, d):
        return 0.0 if (a + c) * (b + d) == 0 else (a / (a + c) * d / (b + d)) ** 0.5

    every = four([x for r in cells for x in r])
    labels = [four([r[j] for r in cells]) for j in range(L)]
    if name == "hamming_loss":
        return (every[1] + every[2]) / sum(every)
    if name == "micro_fmeasure":
        return f(*every)
    if name == "macro_fmeasure":
        return sum(f(*x) for x in labels) / L
    if name == "macro_geo":
        return sum(geo(*x) for x in labels) / L
    if name == "subset_accuracy":
        return sum(four(r)[1] + four(r)[2] == 0 for r in cells) / len(cells)
    assert name == "ex_fmeasure"
    return sum(f(*four(r)) for r in cells) / len(cells)


# a measure of the user's own: geometric mean of recall and specificity, per label
GEO = CU.Measure("macro_geo", lambda a, b, c, d: F.when((a + c) * (b + d) == 0, 0.0).otherwise(F.sqrt(a / (a + c) * d / (b + d))), "label")
NAMES = ["hamming_loss", "micro_fmeasure", "macro_fmeasure", "ex_fmeasure", "subset_accuracy", "macro_geo"]


def as_given(name):
    return GEO if name == "macro_geo" else name


def ideal(name):
    return 0.0 if name == "hamming_loss" else 1.0


def rows_of(seed, n=60):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        y = [int(rnd.random() < p) for p in (0.6, 0.3, 0.15)]
        c = [round(min(1.0, max(0.0, 0.25 + 0.35 * t + rnd.gauss(0, 0.2))), 2) for t in y]  # many ties
        out.append((i, i % 2, y, c))
    # equal rows: a third of all at one point
    return out + [(n + i, i % 2, [1, 0, 0], [0.42, 0.42, 0.1]) for i in range(n // 2)]


def by_fold(rows):
    return {f: [(y, [round(v * 100) for v in c]) for _, g, y, c in rows if g == f] for f in (0, 1)}


@pytest.mark.parametrize("name", NAMES)
def test_one_threshold(spark, name):
    rows = rows_of(3)
    res = CU.one_threshold(spark.createDataFrame(rows, SCHEMA), as_given(name), bins=100)
    got = {(r["stage"], r["fold"], r["k"]): r for r in res.collect()}
    finals = []
    for f, part in by_fold(rows).items():
        at = lambda cut: plain_value(name, part, lambda c, j: c[j] >= cut)  # noqa: B023, E731
        grid = [10 * k for k in range(11)]
        for stage in (1, 2):
            vals = [at(x) for x in grid]
            best = min(range(11), key=lambda k: (round(abs(ideal(name) - vals[k]), 12), k))
            for k in range(11):
                r = got.pop((stage, f, k))
                assert abs(r["value"] - vals[k]) < 1e-9 and abs(r["threshold"] - grid[k] / 100) < 1e-9
                assert r["chosen"] == (k == best)
            last, grid = grid[best], [grid[best] + k - 5 for k in range(11)]
        finals.append(last / 100)
    assert not got
    assert abs(CU.final_threshold(res).first()["threshold"] - sum(finals) / 2) < 1e-9


@pytest.mark.parametrize("name", NAMES)
def test_rank_cut(spark, name):
    rows = rows_of(4)
    got = {r["t"]: r for r in CU.rank_cut(spark.createDataFrame(rows, SCHEMA), L, as_given(name), bins=100).collect()}
    vals, dist = [], []
    for t in range(L + 1):
        def yes(c, j, t=t):
            return 1 + sum((c[o], o) > (c[j], j) for o in range(L)) <= t

        v = [plain_value(name, part, yes) for part in by_fold(rows).values()]
        vals.append(sum(v) / 2)
        dist.append(round(sum(abs(ideal(name) - x) for x in v) / 2, 12))
    best = min(range(L + 1), key=lambda t: (dist[t], t))
    assert len(got) == L + 1
    for t in range(L + 1):
        assert abs(got[t]["value"] - vals[t]) < 1e-9 and got[t]["chosen"] == (t == best)


def plain_descent(name, part, sweeps):
    cuts, done = [50] * L, None
    for _ in range(sweeps):
        for j in range(L):
            def dist(cut, j=j):
                now = [cut if o == j else cuts[o] for o in range(L)]
                return round(abs(ideal(name) - plain_value(name, part, lambda c, o: c[o] >= now[o])), 12)

            cuts[j] = min(sorted({c[j] for _, c in part}), key=dist)  # the first minimum
        if cuts == done:
            break
        done = list(cuts)
    return cuts


@pytest.mark.parametrize("name", NAMES)
def test_label_thresholds(spark, name):
    rows = rows_of(5)
    res = CU.label_thresholds(spark.createDataFrame(rows, SCHEMA), L, as_given(name), sweeps=6, bins=100)
    got = {(r["fold"], r["j"]): r for r in res.collect()}
    assert len(got) == 2 * L
    for f, part in by_fold(rows).items():
        for j, cut in enumerate(plain_descent(name, part, 6)):
            lower = max((c[j] for _, c in part if c[j] < cut), default=cut)
            assert got[f, j]["cut"] == cut
            assert abs(got[f, j]["threshold"] - (cut + lower) / 200) < 1e-9


def test_chosen_cuts_do_not_lose_to_one_half(spark):
    rows = rows_of(6)
    pred = spark.createDataFrame(rows, SCHEMA)
    for name in ("micro_fmeasure", "ex_fmeasure"):
        cuts = {(r["fold"], r["j"]): r["cut"] for r in CU.label_thresholds(pred, L, name, bins=100).collect()}
        for f, part in by_fold(rows).items():
            chosen = plain_value(name, part, lambda c, j: c[j] >= cuts[f, j])  # noqa: B023
            assert chosen >= plain_value(name, part, lambda c, j: c[j] >= 50)


def test_odd_rows_and_empty_tables(spark):
    nan = float("nan")
    rows = [(1, 0, [1, 0, 1], [None, nan, 0.9]), (2, 0, [None, 1, 0], [0.1, 0.2, 0.3]), (None, 0, [0, 0, 0], [0.2, 0.2, 0.2]), (None, 0, [0, 0, 0], [0.2, 0.2, 0.2])]
    pred = spark.createDataFrame(rows, SCHEMA)
    zero = CU.one_threshold(pred, "hamming_loss").filter("stage = 1 and k = 0").first()
    # row 2 takes no part; the missing score and NaN are below a cut of 0, all others are at or above it
    assert abs(zero["value"] - 7 / 9) < 1e-9
    for name in ("micro_fmeasure", "macro_fmeasure", "ex_fmeasure"):
        assert CU.label_thresholds(pred, L, name).count() == L
        empty = spark.createDataFrame([], SCHEMA)
        assert CU.label_thresholds(empty, L, name).count() == 0
        assert CU.one_threshold(empty, name).count() == 0
        assert CU.rank_cut(empty, L, name).count() == 0


def test_apply_thresholds(spark, f1):
    out = CU.apply_thresholds(f1, [0.5, 0.7, 0.1]).orderBy("id").collect()
    assert [r["bip"] for r in out] == [[1, 0, 1], [0, 0, 1], [0, 1, 1], [1, 0, 1], [1, 1, 1]]
    assert out[0].asDict().keys() >= {"id", "y", "conf", "bip"}


def test_every_label_has_a_group(spark):
    from polytag.frame import MLFrame
    from polytag.operators import cluster as CL

    m = MLFrame(spark.createDataFrame([(1, [1, 0, 0, 0]), (2, [1, 1, 0, None])], "id long, y array<int>"), ("a", "b", "c", "d"))
    got = {r["j"]: (r["grp"], r["n"]) for r in CL.random_partition(m, k=2).collect()}
    assert {j: n for j, (_, n) in got.items()} == {0: 2, 1: 1, 2: 0, 3: 0}
    assert sorted(g for g, _ in got.values()) == [0, 0, 1, 1]
