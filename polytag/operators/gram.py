"""Least squares from cross-products: one scan of the rows serves every model of a regression family.

The rows' cross-products of (1, features, targets) are summed per (fold, presence of the targets, member): numpy in Arrow batches per task,
then a grouped sum.  Only these (1 + d + T)^2 numbers per key reach the driver.  Sums are taken around a shift near the means, so that they
keep their digits.  From the cross-products follow, without another scan,

* any least-squares model of a linear combination of targets on linear combinations of features and targets (``solve``, by the sweep
  operator on the correlation matrix; a variable that the others determine gets no coefficient);
* its out-of-fold forms (all folds less one);
* models on the *predictions* of earlier models: these are linear in the features (fold by fold for out-of-fold predictions), so the cross-products
  with them are V G V^T with their coefficient rows V.

So a chain or a stack is worked out on the driver from a few small matrices and composed into one coefficient row per target; predicting is a
projection.  A row with a missing feature is left out; a row with a missing target serves the models that do not use this target.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a variable of which less than this share of its variance is left is determined by the others
LEAST_SHARE = 1e-10
#: rows whose means give the shift of the sums (any value near the data serves)
SHIFT_ROWS = 1_000


@dataclass
class Grams:
    d: int
    T: int
    shift: np.ndarray  # d + T
    cells: dict[tuple[int, int, int], np.ndarray]  # (fold, presence, member) -> cross-products of (1, x, y), shifted

    @property
    def folds(self) -> list[int]:
        return sorted({f for f, _, _ in self.cells})

    def unit(self, i: int) -> np.ndarray:
        e = np.zeros(1 + self.d + self.T)
        e[i] = 1.0
        return e

    def target(self, t: int) -> np.ndarray:
        return self.unit(1 + self.d + t)

    def inputs(self) -> list[np.ndarray]:
        """The constant and the features."""
        return [self.unit(i) for i in range(1 + self.d)]

    def of(self, fold: int, member: int, need: int) -> np.ndarray:
        """Cross-products of a fold's rows that have all targets of the bit set ``need``."""
        parts = [g for (f, m, k), g in self.cells.items() if f == fold and k == member and m & need == need]
        return sum(parts, np.zeros((1 + self.d + self.T,) * 2))

    def plain(self, row: np.ndarray, mix: np.ndarray) -> np.ndarray:
        """Coefficients (1, features) in the data's own units of a shifted row that predicts the target combination ``mix``."""
        w = row[1 : 1 + self.d]
        return np.concatenate(([row[0] + mix @ self.shift[self.d :] - w @ self.shift[: self.d]], w))


def _doubles(columns: Sequence) -> Column:
    return F.array(*((F.col(c) if isinstance(c, str) else c).cast("double") for c in columns))


def grams(df: DataFrame, features: Sequence, targets: Sequence, fold: Column | None = None, weights: Sequence[Column] = ()) -> Grams:
    """One scan of ``df`` (best a written table: its first rows are read once more for the shift)."""
    d, T, members = len(features), len(targets), max(1, len(weights))
    rows = df.select(
        _doubles(features).alias("x"), _doubles(targets).alias("y"), (F.lit(0) if fold is None else fold).cast("int").alias("fold"),
        (_doubles(weights) if weights else F.array(F.lit(1.0))).alias("w"))
    rows = rows.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    near = rows.limit(SHIFT_ROWS).agg(*(F.avg(F.nanvl(F.col(c)[i], F.lit(None).cast("double"))) for c, n in (("x", d), ("y", T)) for i in range(n))).first()
    shift = np.array([v or 0.0 for v in near])
    p = 1 + d + T
    upper = np.triu_indices(p)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple[int, int, int], np.ndarray] = {}
        for b in batches:
            n = b.num_rows
            x, y, w = (b[c].flatten().to_numpy(zero_copy_only=False).reshape(n, k) for c, k in (("x", d), ("y", T), ("w", members)))
            there = ~np.isnan(y)
            z = np.concatenate([np.ones((n, 1)), x - shift[:d], np.where(there, y - shift[d:], 0.0)], axis=1)
            key = np.stack([b["fold"].to_numpy(), (there << np.arange(T)).sum(1)], axis=1)
            kinds, kind = np.unique(key, axis=0, return_inverse=True)
            for i, (f, mask) in enumerate(kinds.tolist()):
                mine = kind.ravel() == i
                for m in range(members):
                    g = (z[mine] * w[mine, m, None]).T @ z[mine]
                    at = (f, mask, m)
                    acc[at] = acc[at] + g if at in acc else g
        keys = list(acc)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32()))]
                                         + [pa.array([acc[k][upper].tolist() for k in keys], pa.list_(pa.float64()))], ["fold", "mask", "member", "g"])

    parts = rows.mapInArrow(partial, "fold int, mask bigint, member int, g array<double>")
    sums = parts.select("fold", "mask", "member", F.posexplode("g").alias("at", "v")).groupBy("fold", "mask", "member", "at").agg(F.sum("v").alias("v"))
    cells: dict[tuple[int, int, int], np.ndarray] = {}
    for r in sums.collect():  # (1 + d + T)^2 / 2 numbers per key
        g = cells.setdefault((r["fold"], r["mask"], r["member"]), np.zeros((p, p)))
        i, j = upper[0][r["at"]], upper[1][r["at"]]
        g[i, j] = g[j, i] = r["v"]
    return Grams(d, T, shift, cells)


def swept(a: np.ndarray, k: int) -> np.ndarray:
    """The sweep operator: exchanges variable ``k`` from the explained to the explaining side."""
    out = a - np.outer(a[:, k], a[k]) / a[k, k]
    out[k], out[:, k] = a[k] / a[k, k], -a[:, k] / a[k, k]
    out[k, k] = 1.0 / a[k, k]
    return out


def solve(g: np.ndarray) -> np.ndarray:
    """Coefficients of the last variable on the others (the first is the constant) from their cross-products."""
    n = g[0, 0]
    if n <= 0:
        return np.zeros(len(g) - 1)
    mean = g[0] / n
    c = (g - np.outer(g[0], g[0]) / n)[1:, 1:]
    s = np.sqrt(np.where(np.diag(c) > 1e-12 * np.diag(g)[1:], np.diag(c), 1.0))
    live = np.diag(c) > 1e-12 * np.diag(g)[1:]
    r = c / np.outer(s, s)
    used = []
    for k in range(len(r) - 1):
        if live[k] and r[k, k] > LEAST_SHARE:
            r = swept(r, k)
            used.append(k)
    w = np.zeros(len(r) - 1)
    w[used] = r[used, -1] * s[-1] / s[used]
    return np.concatenate(([mean[-1] - w @ mean[1:-1]], w))


def _products(g: Grams, rows: dict[int, list[np.ndarray]], mix: np.ndarray, member: int, need: int) -> dict[int, np.ndarray]:
    out = {}
    for f, inputs in rows.items():
        v = np.stack([*inputs, mix])
        out[f] = v @ g.of(f, member, need) @ v.T
    return out


def _next_input(g: Grams, rows: dict[int, list[np.ndarray]], t: int, mode: str, member: int, need: int, model: np.ndarray, sample: int | None) -> dict[int, np.ndarray]:
    """Per fold, target ``t`` as an input of later models: its true value or a prediction for the training rows."""
    if mode == "true":
        return {f: g.target(t) for f in rows}
    said = lambda f, b: b @ np.stack(rows[f])
    if mode == "train":
        return {f: said(f, model) for f in rows}
    if mode == "sample":
        assert sample is not None
        b = solve(sum(_products(g, rows, g.target(t), sample, need).values()))
        return {f: said(f, b) for f in rows}
    if mode != "cv":
        raise ValueError(f"no such mode: {mode}")
    parts = _products(g, rows, g.target(t), member, need)
    every = sum(parts.values())
    return {f: said(f, solve(every - parts[f])) for f in rows}


def chain(g: Grams, order: Sequence[int], mode: str = "true", member: int = 0, samples: Sequence[int] = ()) -> np.ndarray:
    """(targets, 1 + features) coefficients of a regressor chain whose earlier targets enter by ``mode``: true, train, cv or sample
    (``samples``: the members whose weights draw the sample of each link)."""
    rows = {f: g.inputs() for f in g.folds}
    final = g.inputs()
    out = np.zeros((g.T, 1 + g.d))
    need = 0
    for k, t in enumerate(order):
        need = need | 1 << t if mode == "true" else 1 << t
        model = solve(sum(_products(g, rows, g.target(t), member, need).values(), np.zeros((len(final) + 1,) * 2)))
        said = model @ np.stack(final)
        out[t] = g.plain(said, np.eye(g.T)[t])
        if k < len(order) - 1:
            for f, row in _next_input(g, rows, t, mode, member, need, model, samples[k] if samples else None).items():
                rows[f].append(row)
            final.append(said)
    return out


def stack(g: Grams, mode: str = "train", member: int = 0, samples: Sequence[int] = (), attributes: bool = True) -> np.ndarray:
    """(targets, 1 + features) coefficients of two-stage stacking: each target on the features (unless ``attributes`` is off) and the other targets' first-stage values."""
    rows = {f: g.inputs() for f in g.folds}
    first, metas = [], []
    for t in range(g.T):
        model = solve(sum(_products(g, rows, g.target(t), member, 1 << t).values(), np.zeros((g.d + 2,) * 2)))
        first.append(model @ np.stack(g.inputs()))
        metas.append(_next_input(g, rows, t, mode, member, 1 << t, model, samples[t] if samples else None))
    keep = g.inputs() if attributes else g.inputs()[:1]
    out = np.zeros((g.T, 1 + g.d))
    for t in range(g.T):
        others = [o for o in range(g.T) if o != t]
        need = (1 << g.T) - 1 if mode == "true" else 1 << t
        second = {f: [*keep, *(metas[o][f] for o in others)] for f in g.folds}
        model = solve(sum(_products(g, second, g.target(t), member, need).values(), np.zeros((len(keep) + len(others) + 1,) * 2)))
        out[t] = g.plain(model @ np.stack([*keep, *(first[o] for o in others)]), np.eye(g.T)[t])
    return out


def combinations(g: Grams, mixes: np.ndarray, member: int = 0) -> np.ndarray:
    """(mixes, 1 + features) coefficients of linear combinations of the targets on the features."""
    out = np.zeros((len(mixes), 1 + g.d))
    for i, mix in enumerate(mixes):
        need = int(sum(1 << int(t) for t in np.flatnonzero(mix)))
        rows = {f: g.inputs() for f in g.folds}
        row = np.concatenate([np.zeros(1 + g.d), mix])
        out[i] = g.plain(solve(sum(_products(g, rows, row, member, need).values(), np.zeros((g.d + 2,) * 2))) @ np.stack(g.inputs()), mix)
    return out


def predicted(coefficients: np.ndarray, features: Sequence) -> Column:
    """ARRAY of the predictions: a projection with literal coefficients."""
    xs = [(F.col(f) if isinstance(f, str) else f).cast("double") for f in features]
    return F.array(*(sum((F.lit(float(w)) * x for w, x in zip(row[1:], xs, strict=True)), F.lit(float(row[0]))) for row in coefficients))
