"""Curves from score counts against plain versions; counts add up over parts, folds and stream batches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polytag.frame import MLFrame
from polytag.operators import curves as CV
from polytag.operators import validate as VA
from polytag.streaming import stream as STM

SCHEMA = "id long, fold int, y array<int>, conf array<double>"


def _rows(n=300, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        y = [int(rnd.random() < p) for p in (0.3, 0.6, 0.05)]
        out.append((i, i % 3, y, [round(rnd.random() * 0.6 + 0.3 * v, 1) for v in y]))  # many ties
    return out


def _plain(cells, levels=10):
    """(ap, iap, auc) of (score, truth) pairs by definition."""
    pos = [s for s, t in cells if t]
    neg = [s for s, t in cells if not t]
    if not pos:
        return None, None, None
    points = []
    for cut in sorted(set(s for s, _ in cells), reverse=True):
        hits, all_ = sum(s >= cut for s in pos), sum(s >= cut for s, _ in cells)
        points.append((hits / len(pos), hits / all_, sum(s == cut for s in pos)))
    ap = sum(p * k for _, p, k in points) / len(pos)
    iap = np.mean([max(p for r, p, _ in points if r >= i / (levels - 1) - 1e-12) for i in range(levels)])
    auc = None if not neg else sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    return ap, iap, auc


def _close(a, b):
    return a == b or abs(a - b) < 1e-9


@pytest.mark.parametrize("bins", [None, 1000])
def test_label_curves_by_definition(spark, bins):
    rows = _rows()
    counts = CV.score_counts(spark.createDataFrame(rows, SCHEMA), ["fold"], bins)
    got = {(r["fold"], r["j"]): r for r in CV.label_curves(counts, ["fold"]).collect()}
    assert len(got) == 9
    for (f, j), r in got.items():
        want = _plain([(x[3][j], x[2][j]) for x in rows if x[1] == f])
        assert all(_close(r[k], v) for k, v in zip(CV.CURVES, want))
    area = {r["fold"]: r["micro_auc"] for r in CV.pooled_area(counts, ["fold"]).collect()}
    for f in range(3):
        assert _close(area[f], _plain([(s, t) for x in rows if x[1] == f for s, t in zip(x[3], x[2])])[2])


def test_counts_add_up(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    whole = CV.label_curves(CV.score_counts(df)).collect()
    parts = [CV.score_counts(df.filter(F.col("fold") == f)) for f in range(3)]
    again = CV.label_curves(CV.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]))).collect()
    folded = CV.label_curves(CV.merged(CV.score_counts(df, ["fold"]))).collect()
    key = lambda rs: sorted((r["j"], *(round(r[k], 12) for k in CV.CURVES)) for r in rs)
    assert key(whole) == key(again) == key(folded)


def test_odd_cells(spark):
    nan = float("nan")
    rows = [(1, 0, [1, 0], [nan, 0.5]), (2, 0, [0, 0], [0.2, None]), (3, 0, [None, 1], [0.9, 0.9]), (4, 0, [1, 0], [0.4, 0.5]), (4, 0, [1, 0], [0.4, 0.5])]
    df = spark.createDataFrame(rows, SCHEMA)
    for bins in (None, 100):
        counts = CV.score_counts(df, [], bins)
        got = {r["j"]: r for r in CV.label_curves(counts).collect()}
        want = _plain([(-1, 1), (0.2, 0), (0.4, 1), (0.4, 1)])  # the NaN score comes last, the row without a label not at all
        assert all(_close(got[0][k], v) for k, v in zip(CV.CURVES, want))
        assert got[1]["ap"] is None and got[1]["auc"] is None and got[1]["positives"] == 0
        m = {r["measure"]: r["value"] for r in CV.curve_measures(counts).collect()}
        assert np.isnan(m["gmap"]) and _close(m["map"], want[0]) and _close(m["macro_auc"], want[2])
    none = CV.score_counts(df.limit(0), ["fold"])
    assert CV.label_curves(none, ["fold"]).count() == 0 and CV.curve_measures(none, ["fold"]).count() == 0


def test_cross_validation_has_all_measures(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice("abc"), [rnd.randrange(2), rnd.randrange(2)]) for i in range(120)]
    rows = [(i, f, [int(f == "a" or y[0] and y[1]), y[1]]) for i, f, y in rows]
    m = MLFrame(spark.createDataFrame(rows, "id long, f string, y array<int>"), ("p", "q"), ("f",))
    pred = VA.out_of_fold(m, "br", 4, 2).collect()
    got = {r["measure"]: r for r in VA.cross_validate_all(m, "br", 4, 2).collect()}
    plain = {r["measure"]: r for r in VA.cross_validate(m, "br", 4, 2).collect()}
    assert set(got) == set(plain) | set(CV.MEANS)
    assert all(_close(got[k]["mean"], r["mean"]) and _close(got[k]["sd"], r["sd"]) for k, r in plain.items())
    per = {(r["j"], r["measure"]): r for r in VA.cross_validate_labels(m, "br", 4, 2).collect()}
    for j in range(2):
        ap, _, auc = zip(*(_plain([(round(r["conf"][j] * 1e6), r["y"][j]) for r in pred if r["fold"] == f]) for f in range(4)))
        assert _close(per[j, "ap"]["mean"], np.mean(ap)) and _close(per[j, "ap"]["sd"], np.std(ap)) and _close(per[j, "auc"]["mean"], np.mean(auc))


# ------------------------------------------------------------------ stateful counts

CELLS = "k string, v int"


def _count(x):
    return x.select("k", F.lit(1).alias("n"), F.col("v").cast("long").alias("total"))


def _stage(spark, src, batch, rows):
    spark.createDataFrame(rows, CELLS).coalesce(1).write.mode("overwrite").parquet(f"{src}/p{batch}")


def _want(batches):
    out = {}
    for k, v in (r for b in batches for r in b):
        n, s = out.get(k, (0, 0))
        out[k] = (n + 1, s + v)
    return out


def _run(spark, d, every=2, cells=_count):
    schema = spark.createDataFrame([], CELLS).schema
    out = STM.count_stream(spark, f"{d}/in", schema, cells, f"{d}/out", ["k"], ("n", "total"), checkpoint=f"{d}/ckpt", compact_every=every)
    return {r["k"]: (r["n"], r["total"]) for r in out.collect()}


BATCHES = [[("a", 1), ("b", -2), (None, 5)], [("a", -1), ("a", 3)], [("c", 4)], [("b", 1), (None, 1)], [("a", 1)]]


@pytest.mark.parametrize("every", [1, 2, 100])
def test_counts_go_on_after_a_restart(spark, tmp_path, every):
    for stop in (2, 4, 5):
        for i in range(stop):
            if not (tmp_path / "in" / f"p{i}").exists():
                _stage(spark, f"{tmp_path}/in", i, BATCHES[i])
        assert _run(spark, tmp_path, every) == _want(BATCHES[:stop])
    assert _run(spark, tmp_path, every) == _want(BATCHES)  # nothing new: nothing counted again


def test_reads_take_no_old_batches(spark, tmp_path):
    for i, b in enumerate(BATCHES):
        _stage(spark, f"{tmp_path}/in", i, b)
    _run(spark, tmp_path, 2)
    schema = spark.read.parquet(f"{tmp_path}/out/changes/batch=0").schema
    # folders that the newest snapshot covers are not needed any more
    for b in (0, 1):
        for f in (tmp_path / "out" / "changes" / f"batch={b}").iterdir():
            f.write_bytes(b"not read")
    got = {r["k"]: (r["n"], r["total"]) for r in STM.current_counts(spark, f"{tmp_path}/out", schema, ["k"], ("n", "total")).collect()}
    assert got == _want(BATCHES)


def test_a_replayed_batch_counts_once(spark, tmp_path, monkeypatch):
    for i, b in enumerate(BATCHES):
        _stage(spark, f"{tmp_path}/in", i, b)
    real, calls = STM.current_counts, []

    def lost(*args):
        calls.append(args)
        if len(args) == 6 and len(calls) == 2:  # the second snapshot: its batch has written its changes, but is not finished
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(STM, "current_counts", lost)
    with pytest.raises(Exception, match="lost"):
        _run(spark, tmp_path)
    assert _run(spark, tmp_path) == _want(BATCHES)


def test_no_rows(spark, tmp_path):
    _stage(spark, f"{tmp_path}/in", 0, [])
    assert _run(spark, tmp_path) == {}
