"""Range numbers of the ordered scan: found by halving, equal to a count over all bounds."""

from pyspark.sql import functions as F

from polytag.functions.ordered import _count_below, ordered_scan


def test_bounds_are_counted_by_halving(spark):
    bounds = [-2.0, -2.0, 0.5, 1.0, 1.0, 1.0, 4.0, 9.0, 9.0]
    for n in range(len(bounds) + 1):
        b = bounds[:n]
        df = spark.createDataFrame([(v, b) for v in (-3.0, -2.0, 0.0, 0.5, 1.0, 2.0, 9.0, 10.0, None)], "v double, b array<double>")
        for r in df.select("v", "b", *[_count_below("b", F.col("v"), max(1, n), e).alias(f"c{int(e)}") for e in (False, True)]).collect():
            assert r["c0"] == sum(r["v"] is not None and x < r["v"] for x in b)
            assert r["c1"] == sum(r["v"] is not None and x <= r["v"] for x in b)


def test_a_scan_looks_at_few_bounds_per_row(spark):
    df = spark.createDataFrame([(i % 3, float(i % 7), i, 1) for i in range(400)], "g int, s double, id long, one int")
    out = ordered_scan(df, ["g"], "s", "id", {"pos": ("sum", "one")}, n_ranges=64)
    rows = sorted(out.collect(), key=lambda r: (r["g"], r["s"], r["id"]))
    for g in range(3):
        own = [r["pos"] for r in rows if r["g"] == g]
        assert own == list(range(1, len(own) + 1))
    # no step over all 63 bounds of a row is left in the plan
    assert "filter(_b" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_precision_curves_come_from_one_scan(spark, monkeypatch):
    from polytag.operators import evaluate as EV

    rows = [(i, [int(i * 7 % 5 < 2), int(i * 3 % 11 == 0), 0], [(i * 13 % 10) / 10, (i * 29 % 17) / 17, 0.5]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y array<int>, conf array<double>").withColumn("bip", F.transform("conf", lambda c: (c >= 0.5).cast("int")))
    scans = []
    scan = EV.ordered_scan
    monkeypatch.setattr(EV, "ordered_scan", lambda *a, **kw: scans.append(1) or scan(*a, **kw))
    got = {r["j"]: r for r in EV.label_ap_curves(df, 10).collect()}
    assert len(scans) == 1
    for j in range(3):
        order = sorted(rows, key=lambda r: (-r[2][j], r[0]))
        hits, prec, R = 0, [], sum(r[1][j] for r in rows)
        for n, r in enumerate(order, 1):
            hits += r[1][j]
            prec.append((hits, hits / n, r[1][j]))
        if R == 0:
            assert got[j]["n_rel"] == 0 and got[j]["ap"] is None and got[j]["iap"] is None
            continue
        assert abs(got[j]["ap"] - sum(p for _, p, t in prec if t) / R) < 1e-12
        levels = [max(p for h, p, _ in prec if h * 9 >= i * R) for i in range(10)]
        assert abs(got[j]["iap"] - sum(levels) / 10) < 1e-12
