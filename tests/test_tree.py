"""Decision trees grown level by level against a plain recursive version."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from polytag.frame import MLFrame
from polytag.operators import learners as LN
from polytag.operators import tree as TREE
from polytag.operators.tree import TreeBase

FEATURES = ("a", "b", "c", "x")
EDGES = {"x": [0.2, 0.45, 0.7]}


def bins(x, edges):
    return None if x is None else sum(e < x for e in edges)


def xlogx(c):
    return c * math.log(c) if c > 0 else 0.0


def mass(n, n1):
    return xlogx(n) - xlogx(n1) - xlogx(n - n1)


def plain_tree(base, rows, names, numeric, depth=0):
    """rows (dict of values, t) -> (n, n1, split, children)."""
    n, n1 = len(rows), sum(t for _, t in rows)
    leaf = (n, n1, None, {})
    if depth == base.depth or n1 in (0, n):
        return leaf
    cands = []
    for i, f in enumerate(names):
        for b in (range(len(numeric[f])) if f in numeric else [-1]):
            parts = defaultdict(list)
            for v, t in rows:
                parts[v[f] if b < 0 else str(int(v[f] is not None and v[f] > b))].append((v, t))
            if sum(len(p) >= base.min_leaf for p in parts.values()) < 2:
                continue
            rest = sum(mass(len(p), sum(t for _, t in p)) for p in parts.values())
            gain = round((mass(n, n1) - rest) / n, 10)
            info = (xlogx(n) - sum(xlogx(len(p)) for p in parts.values())) / n
            cands.append((gain, info, i, b, parts))
    if not cands:
        return leaf
    if base.criterion == "gain_ratio":
        mean = sum(c[0] for c in cands) / len(cands)
        cands = [(round(c[0] / c[1], 10), *c[1:]) for c in cands if c[0] >= mean - 1e-9]
    best = min(cands, key=lambda c: (-c[0], c[2], c[3]))
    kids = {v: plain_tree(base, p, names, numeric, depth + 1) for v, p in best[4].items()}
    return (n, n1, (names[best[2]], best[3]), kids)


def pruned(tree):
    n, n1, split, kids = tree
    own = min(n1, n - n1) + 0.5
    if split is None:
        return tree, own
    done = {v: pruned(k) for v, k in kids.items()}
    below = sum(e for _, e in done.values())
    return ((n, n1, None, {}), own) if own <= below else ((n, n1, split, {v: k for v, (k, _) in done.items()}), below)


def walk(tree, v):
    while tree[2]:
        f, b = tree[2]
        nxt = tree[3].get(v[f] if b < 0 else str(int(v[f] is not None and v[f] > b)))
        if nxt is None:
            break
        tree = nxt
    return (tree[1] + 1) / (tree[0] + 2)


def planted(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.choice("pqr"), rng.choice(["u", "v", None]), rng.choice("01")
        x = None if rng.random() < 0.05 else round(rng.random(), 3)
        y = [int((a == "p") ^ (c == "1")), int((x or 0) > 0.45 and a != "q"), int(rng.random() < 0.3), 0]
        if rng.random() < 0.1:
            y[rng.randrange(3)] = None
        out.append((i, a, b, c, x, y))
    return out


SCHEMA = "id long, a string, b string, c string, x double, y array<int>"


@pytest.mark.parametrize("base", [TreeBase(3, 4, "gain", numeric=EDGES), TreeBase(4, 2, numeric=EDGES), TreeBase(4, 1, prune=True, numeric=EDGES)])
def test_label_trees_equal_a_plain_version(spark, base):
    rows = planted(300, 1)
    m = MLFrame(spark.createDataFrame(rows, SCHEMA).repartition(5), ("xor", "cut", "noise", "never"), FEATURES)
    train = m.df.filter("id < 240")
    got = {(r.id, r.j): r for r in LN.predict_br(LN.fit_br(m, train, base=base), m.df).collect()}
    values = [{"a": a, "b": b, "c": c, "x": bins(x, EDGES["x"])} for _, a, b, c, x, _ in rows]
    assert len(got) == 4 * len(rows)
    for j in range(4):
        tree = plain_tree(base, [(v, r[5][j]) for v, r in zip(values[:240], rows, strict=False) if r[5][j] is not None], FEATURES, EDGES)
        if base.prune:
            tree = pruned(tree)[0]
        for i, v in enumerate(values):
            assert abs(got[i, j].conf - walk(tree, v)) < 1e-9 and got[i, j].bip == int(walk(tree, v) >= 0.5), (j, i)


def test_a_parity_is_learnt_where_counts_fail(spark):
    rows = [(i, "pq"[i % 2], "uv"[i // 2 % 2], str(i % 3), None, [int(i % 2 != i // 2 % 2)]) for i in range(240)]
    m = MLFrame(spark.createDataFrame(rows, SCHEMA), ("xor",), ("c", "a", "b"))

    def right(base):
        return sum(r.bip == rows[r.id][5][0] for r in LN.predict_br(LN.fit_br(m, m.df, base=base), m.df).collect())

    assert right(TreeBase(depth=3, min_leaf=2)) == 240
    assert right(None) < 200


def test_chains_equal_a_plain_version_both_ways(spark):
    rows = planted(260, 7)
    m = MLFrame(spark.createDataFrame(rows, SCHEMA).repartition(3), ("xor", "cut", "noise", "never"), FEATURES)
    train, chain, base = m.df.filter("id < 200"), [2, 0, 3, 1], TreeBase(3, 3, "gain", numeric=EDGES)
    model = LN.fit_cc(m, chain, train, base=base)
    values = [{"a": a, "b": b, "c": c, "x": bins(x, EDGES["x"])} for _, a, b, c, x, _ in rows]
    names = [*FEATURES, *(f"lab{c}" for c in range(4))]
    conf = [[0.0] * 4 for _ in rows]
    seen = [{f"lab{c}": None for c in range(4)} for _ in rows]
    for k, lab in enumerate(chain):
        known = [{**v, **{f"lab{c}": r[5][c] if c in chain[:k] else None for c in range(4)}} for v, r in zip(values, rows, strict=True)]
        tree = plain_tree(base, [(v, r[5][lab]) for v, r in zip(known[:200], rows, strict=False) if r[5][lab] is not None], names, EDGES)
        for i, v in enumerate(values):
            conf[i][lab] = walk(tree, {**v, **seen[i]})
        for i in range(len(rows)):
            seen[i][f"lab{lab}"] = int(conf[i][lab] >= 0.5)
    for forest in (TREE.FOREST_NODES, 0):
        got = {r.id: r for r in TREE.predict_chain(model, m.df, 4, chain, forest_nodes=forest).collect()}
        assert len(got) == len(rows)
        for i in range(len(rows)):
            assert max(abs(p - q) for p, q in zip(got[i].conf, conf[i], strict=True)) < 1e-9
            assert list(got[i].bip) == [int(p >= 0.5) for p in conf[i]]


def test_odd_tables(spark):
    empty = MLFrame(spark.createDataFrame([], SCHEMA), ("l0", "l1"), FEATURES)
    base = TreeBase(3, numeric={"x": []})
    assert LN.predict_br(LN.fit_br(empty, base=base), empty.df).collect() == []
    rows = [(1, None, None, None, None, [1, None]), (2, None, None, None, None, [1, None]), (3, "new", "", "=", math.nan, [None, None])]
    m = MLFrame(spark.createDataFrame(rows, SCHEMA), ("l0", "l1"), FEATURES)
    got = {(r.id, r.j): r.conf for r in LN.predict_br(LN.fit_br(m, m.df.filter("id < 3"), base=base), m.df).collect()}
    assert Counter(round(v, 6) for v in got.values()) == {0.75: 3, 0.5: 3}
    edges = TREE.quantile_edges(m.df.withColumn("x", F.col("id")), ["x"], 4)
    assert edges["x"] == sorted(set(edges["x"]))
