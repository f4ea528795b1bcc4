"""Neighbour searches over several blocks, on sessions that deal them to many partitions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.test_cells import SCHEMA, answer, clustered, plain

from polytag.frame import MLFrame
from polytag.operators import cells as CE
from polytag.operators import knn as KN
from polytag.operators import learners as LN
from polytag.operators import nearest as NE


@pytest.fixture
def spread(spark):
    """Every hash value keeps its own partition, as on large tables."""
    set_ = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    old = {k: spark.conf.get(k) for k in set_}
    for k, v in set_.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("method", ["blocks", "cells"])
def test_blocks_meet_wherever_they_are_dealt(spread, method):
    rows = clustered(200, 4)
    df = spread.createDataFrame(rows, SCHEMA)
    assert answer(KN.knn(df, df, 5, "vec", block_rows=40, method=method)) == plain(rows, rows, 5, True)


def test_iblr_over_several_blocks(spread, monkeypatch):
    monkeypatch.setattr(KN.knn, "__defaults__", tuple(40 if x == KN.BLOCK_ROWS else x for x in KN.knn.__defaults__))
    rows = [(i, [float(i % 2) + i / 1e4, 1.0], [i % 2, 1 - i % 2]) for i in range(160)]
    df = spread.createDataFrame(rows, "id long, embedding array<double>, y array<int>")
    out = LN.iblr(MLFrame(df, ("p", "q"), ("embedding",)), df, k=5).collect()
    assert {r["id"]: list(r["bip"]) for r in out} == {i: y for i, _, y in rows}


def test_a_query_is_sent_once_per_block_not_per_cell(spread, monkeypatch):
    rng = np.random.default_rng(2)
    df = spread.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(900)], SCHEMA)
    sent = []
    search = CE._search
    monkeypatch.setattr(CE, "_search", lambda queries, *rest: sent.append(queries.count()) or search(queries, *rest))
    KN.knn(df, df, 4, "vec", block_rows=150, method="cells").count()
    # 30 cells, of which nearly all are needed by every query; about 8 blocks
    assert sum(sent) < 12 * 900


def test_rows_without_a_vector_neither_ask_nor_answer(spread):
    rows = [(1, [0.0]), (2, [1.0]), (3, None), (4, [4.0])]
    df = spread.createDataFrame(rows, SCHEMA)
    for method in ("blocks", "cells"):
        assert answer(KN.knn(df, df, 1, "vec", method=method)) == {1: [2], 2: [1], 4: [2]}


@pytest.mark.parametrize("exclude_self", [True, False])
def test_copies_make_no_long_lists_and_ties_keep_the_smallest_ids(exclude_self, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.repeat(rng.integers(0, 2, (3, 4)).astype(float), 300, 0), rng.integers(0, 3, (300, 4)).astype(float)])
    ids = rng.permutation(len(x))
    measured = []
    exact = NE._exact
    monkeypatch.setattr(NE, "_exact", lambda a, b, i, j, chunk: measured.append(len(i)) or exact(a, b, i, j, chunk))
    got = NE.nearest(x, ids, x, ids, 7, exclude_self, 100_000)
    assert isinstance(got, pa.Table)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    if exclude_self:
        np.fill_diagonal(d, np.inf)
    best = {}
    for q, r in zip(got["qid"].to_pylist(), got["rid"].to_pylist(), strict=True):
        best.setdefault(q, []).append(r)
    assert best == {int(ids[i]): [int(ids[j]) for j in np.lexsort((ids, d[i]))[:7]] for i in range(len(x))}
    assert sum(measured) < 200 * len(x)


def test_mlknn_gives_a_row_per_query_and_label(spread):
    rows = clustered(120, 6)
    df = spread.createDataFrame([(i, v, [i % 2]) for i, v in rows], "id long, vec array<double>, y array<int>")
    model = KN.fit_mlknn(df, 1, k=4)
    assert KN.predict_mlknn(model, df, df).agg(F.countDistinct("id")).first()[0] == len(rows)
