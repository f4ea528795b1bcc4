"""Neighbours by pivot cells equal a full search; clustered data are visited sparsely."""

import numpy as np
import pytest

from polytag.operators import cells as CE
from polytag.operators import knn as KN

SCHEMA = "id long, vec array<double>"


def plain(q, r, k, exclude_self):
    ids, x = [i for i, _ in r], np.array([v for _, v in r])
    lo, rng = x.min(0), x.max(0) - x.min(0)
    x, y = CE._scaled(x, lo, rng), CE._scaled(np.array([v for _, v in q]), lo, rng)
    out = {}
    for (i, _), a in zip(q, y, strict=True):
        d = ((x - a) ** 2).sum(1)
        best = sorted((round(float(v) ** 0.5, 9), n) for v, n in zip(d, ids, strict=True) if not (exclude_self and n == i))[:k]
        out[i] = [n for _, n in best]
    return out


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 10, (12, 5))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.2, 5)).tolist()) for i in range(n)]
    # a constant dimension, and a third of all rows at one point (ties go to the smaller id)
    return [(i, [*v, 1.0]) for i, v in rows] + [(n + i, [*rows[0][1], 1.0]) for i in range(n // 2)]


def answer(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append(r["rid"])
    return out


@pytest.mark.parametrize("exclude_self", [True, False])
def test_same_neighbours_as_a_full_search(spark, exclude_self):
    rows = clustered(240, 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain(rows, rows, 6, exclude_self)
    # small blocks, so that cells and their queries are cut
    assert answer(KN.knn(df, df, 6, "vec", exclude_self=exclude_self, block_rows=32, method="cells")) == want
    assert answer(KN.knn(df, df, 6, "vec", exclude_self=exclude_self, block_rows=64, method="blocks")) == want


def test_unclustered_rows_few_rows_and_far_queries(spark):
    rng = np.random.default_rng(5)
    ref = [(i, rng.normal(size=8).tolist()) for i in range(150)]
    query = [(1000 + i, (rng.normal(size=8) * (1 + 9 * (i % 2))).tolist()) for i in range(40)]
    r, q = spark.createDataFrame(ref, SCHEMA), spark.createDataFrame(query, SCHEMA)
    assert answer(KN.knn(q, r, 5, "vec", method="cells")) == plain(query, ref, 5, True)
    few = answer(KN.knn(r.limit(3), r.limit(3), 5, "vec", method="cells"))
    assert all(len(v) == 2 for v in few.values()) and len(few) == 3
    assert KN.knn(q.limit(0), r, 5, "vec", method="cells").collect() == []


def test_clustered_queries_visit_few_cells_and_probes_find_most(spark, monkeypatch):
    rows = clustered(400, 8)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    visits = []
    search = CE._search

    def counted(queries, members, *rest):
        visits.append(queries.count())
        return search(queries, members, *rest)

    monkeypatch.setattr(CE, "_search", counted)
    want = plain(rows, rows, 5, True)
    assert answer(KN.knn(df, df, 5, "vec", method="cells")) == want
    # sqrt(600) = 24 cells: a query visits its own and a few beside it
    assert sum(visits) < 6 * len(rows)
    near = answer(KN.knn(df, df, 5, "vec", probes=3))
    recall = sum(len(set(near[i]) & set(v)) for i, v in want.items()) / sum(map(len, want.values()))
    assert recall >= 0.9


def test_cells_needed_by_many_queries_take_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    x, pivots = rng.random((20_000, 8)), rng.random((512, 8))
    limit, radius = rng.random(20_000) / 4, rng.random(512) / 4
    limit[:3] = np.inf
    radius[7] = -np.inf
    tracemalloc.start()
    got = CE._needed(x, limit, pivots, radius, 0.0, 500_000)
    cell, near = CE._nearest_pivots(x, pivots, 500_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all distances at once are 82 MB, and the bounds as much again; the answer is 10 MB
    assert peak < 40e6
    d = np.sqrt(((x[:2000, None] - pivots) ** 2).sum(2))
    bound = np.maximum(d - radius, (d - d.min(1, keepdims=True)) / 2)
    with np.errstate(invalid="ignore"):
        clear = np.abs(bound - limit[:2000, None]) > 1e-5
    assert (got[:2000] == (bound <= limit[:2000, None]))[clear].all()
    assert (cell[:2000] == d.argmin(1)).all() and np.allclose(near[:2000], d.min(1), atol=1e-7)
