"""AdaBoost.MH against a plain version, and the fall of its bound."""

import math
import random
from collections import defaultdict

from polytag.frame import MLFrame
from polytag.operators import boost as BO

FEATURES = ("a", "b", "c")
SCHEMA = "id long, a string, b string, c string, y array<int>"


def planted(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.choice("pqrs"), rng.choice(["u", "v", None]), rng.choice("01")
        y = [int(a in "pq") if rng.random() < 0.95 else rng.randrange(2), int(a == "p") | int(b == "u"), int((a == "s") + (b == "v") + (c == "1") >= 2), 0]
        if rng.random() < 0.1:
            y[rng.randrange(4)] = None
        out.append((i, a, b, c, y))
    return out


def plain(rows, rounds):
    cells = [(dict(zip(FEATURES, r[1:4], strict=True)), j, t) for r in rows for j, t in enumerate(r[4]) if t is not None]
    d = [1 / len(cells)] * len(cells)
    e = 0.5 / len(cells)
    model, told = [], []
    for _ in range(rounds):
        best = None
        for f in sorted(FEATURES):
            w = defaultdict(lambda: [0.0, 0.0])
            for (x, j, t), q in zip(cells, d, strict=True):
                if x[f] is not None:
                    w[x[f], j][t] += q
            h = {k: 0.5 * math.log((u + e) / (v + e)) for k, (v, u) in w.items()}
            z = 1 - sum(u + v for v, u in w.values()) + sum(u * math.exp(-h[k]) + v * math.exp(h[k]) for k, (v, u) in w.items())
            if best is None or round(z, 12) < round(best[0], 12):
                best = (z, f, h)
        z, f, h = best
        model.append((f, h))
        told.append((f, z))
        d = [q * math.exp((1 - 2 * t) * h.get((x[f], j), 0.0)) / z for (x, j, t), q in zip(cells, d, strict=True)]
    return model, told


def test_rounds_and_scores_equal_a_plain_version(spark):
    rows = planted(300, 3)
    m = MLFrame(spark.createDataFrame(rows, SCHEMA).repartition(5), ("l0", "l1", "l2", "never"), FEATURES)
    model = BO.fit_mh(m, m.df.filter("id < 250"), 12)
    want, told = plain(rows[:250], 12)
    assert [(f, round(z, 9)) for _, f, z, _ in model.rounds] == [(f, round(z, 9)) for f, z in told]
    got = {(r.id, r.j): r for r in BO.predict_mh(model, m.df).collect()}
    assert len(got) == 4 * len(rows)
    for r in rows:
        x = dict(zip(FEATURES, r[1:4], strict=True))
        for j in range(4):
            s = sum(h.get((x[f], j), 0.0) for f, h in want)
            assert abs(got[r[0], j].conf - 1 / (1 + math.exp(-2 * s))) < 1e-9 and got[r[0], j].bip == int(s > 1e-9)
    bounds = [b for *_, b in model.rounds]
    assert all(p > q for p, q in zip(bounds, bounds[1:], strict=False))
    wrong = [got[r[0], j].bip != t for r in rows[:250] for j, t in enumerate(r[4]) if t is not None]
    assert sum(wrong) / len(wrong) <= bounds[-1]
    # one label needs two features: more rounds than one pay
    first = BO.predict_mh(BO.fit_mh(m, m.df, 1), m.df).collect()
    assert sum(r.bip != rows[r.id][4][1] for r in first if r.j == 1 and rows[r.id][4][1] is not None) > sum(
        got[r[0], 1].bip != r[4][1] for r in rows if r[4][1] is not None)


def test_odd_tables(spark):
    empty = MLFrame(spark.createDataFrame([], SCHEMA), ("l0", "l1"), FEATURES)
    model = BO.fit_mh(empty, empty.df, 3)
    assert model.rounds == [] and BO.predict_mh(model, empty.df).collect() == []
    rows = [(1, None, None, None, [1, 0]), (2, "p", None, None, [None, None]), (2, "p", None, None, [None, None])]
    m = MLFrame(spark.createDataFrame(rows, SCHEMA), ("l0", "l1"), FEATURES)
    model = BO.fit_mh(m, m.df, 3)
    got = BO.predict_mh(model, m.df).collect()
    assert len(got) == 6 and {(r.conf, r.bip) for r in got} == {(0.5, 0)}
