"""Logistic regression as a base learner: all binary models of a learner are fitted by the same passes over the rows.

Training rows become distinct value tuples with, per model key, the weight of zeros and ones.  One pass gives the loss and the gradient of
every key at its own point (numpy in Arrow batches per task, then a grouped sum: keys x columns numbers reach the driver).  The driver
takes a quasi-Newton step per key (limited memory, seeded with the cross-products of the columns); a key whose step was too long
tries a shorter one in the next pass while others go on, so the number of passes is that of the slowest key, not their sum.

Columns are 0/1, one for each (feature, value) seen in training; ``l2`` holds every weight, so the fit is unique.  The
fitted table has the form of the count models' weights: scoring, saving and loading are theirs.

Defined cases: a missing value has no column, nor has one not seen in training; a key without rows gets zeros (probability 1/2); the constant
is held by a thousandth of ``l2``, so a key with one class only stays finite.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polytag.operators import nb as NB

#: most 0/1 columns; the seed matrix holds their square on the driver, a task their product with the keys
MOST_COLUMNS = 1_000
#: most numbers (keys x columns) of one pass
MOST_CELLS = 4_000_000
#: rows x columns of one dense block in a task
BLOCK_CELLS = 4_000_000
#: steps remembered per key
MEMORY = 8


@dataclass(frozen=True)
class LogisticBase:
    l2: float = 1.0
    tolerance: float = 1e-6
    most_passes: int = 100

    def values(self, features: Sequence[str]) -> Column:
        """A row's feature values as strings, in the order of ``features`` ('' is missing)."""
        return F.array(*(F.coalesce(F.concat(F.lit("="), F.col(f).cast("string")), F.lit("")) for f in features))

    def fit(self, rows: DataFrame, keys: list[str], features: list[str], all_keys: DataFrame, more: int = 0) -> NB.NBModel:
        """``rows``: keys, t (0/1), _w, _vals (values of ``features``); ``all_keys``: every key."""
        if more:
            raise ValueError("chains of logistic models are not built")
        return fit_logistic(self, rows, keys, features, all_keys)


def _patterns(rows: DataFrame, keys: list[str], key_list: list) -> DataFrame:
    """(vals, k ARRAY, n0 ARRAY, n1 ARRAY): distinct value tuples with the weights of each key's zeros and ones."""
    ids = rows.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(key_list)], rows.select(*keys).schema.add("_k", "integer"))
    w = F.col("_w").cast("double")
    n = rows.groupBy("_vals", *keys).agg(F.sum(F.when(F.col("t") == 0, w).otherwise(0.0)).alias("n0"), F.sum(F.when(F.col("t") == 1, w).otherwise(0.0)).alias("n1"))
    n = n.join(F.broadcast(ids), keys)  # one row per model
    g = n.groupBy("_vals").agg(F.array_sort(F.collect_list(F.struct("_k", "n0", "n1"))).alias("a"))  # one entry per model
    return g.select(F.col("_vals").alias("vals"), F.col("a._k").alias("k"), F.col("a.n0").alias("n0"), F.col("a.n1").alias("n1"))


def _blocks(batch: pa.RecordBatch, columns: dict[tuple[int, str], int], n_keys: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(X, N0, N1): dense 0/1 columns (the first is the constant) and the weights per key, a few rows at a time."""
    d = 1 + len(columns)
    step = max(1, BLOCK_CELLS // max(d, n_keys))
    for s in range(0, batch.num_rows, step):
        part = batch.slice(s, step).to_pydict()
        n = len(part["vals"])
        x, n0, n1 = np.zeros((n, d)), np.zeros((n, n_keys)), np.zeros((n, n_keys))
        x[:, 0] = 1.0
        for i, vals in enumerate(part["vals"]):
            at = [columns[p, v] for p, v in enumerate(vals) if v]
            x[i, at] = 1.0
            n0[i, part["k"][i]], n1[i, part["k"][i]] = part["n0"][i], part["n1"][i]
        yield x, n0, n1


def _summed(patterns: DataFrame, partial: Callable, shape: tuple[int, int]) -> np.ndarray:
    """The sum of every task's matrix of this shape (``partial`` maps batches to it), added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = partial(batches)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(m)), pa.int32()), pa.array(m.tolist(), pa.list_(pa.float64()))], ["i", "v"])

    cells = patterns.mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    out = np.zeros(shape)
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def _losses(patterns: DataFrame, columns: dict, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per key its loss and gradient at its point: one pass."""
    n_keys, d = points.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((n_keys, 1 + d))
        for b in batches:
            for x, n0, n1 in _blocks(b, columns, n_keys):
                z = x @ points.T
                # ln(1 + e^z) and the logistic function, without overflow
                out[:, 0] += ((n0 + n1) * np.logaddexp(0.0, z) - n1 * z).sum(0)
                p = np.exp(-np.logaddexp(0.0, -z))
                out[:, 1:] += ((n0 + n1) * p - n1).T @ x
        return out

    s = _summed(patterns, partial, (n_keys, 1 + d))
    return s[:, 0], s[:, 1:]


def _totals(patterns: DataFrame, columns: dict, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Cross-products of the columns, each tuple with its greatest weight among the keys; and per key the sums of zeros and ones."""
    d = 1 + len(columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((d + 2, max(d, n_keys)))
        for b in batches:
            for x, n0, n1 in _blocks(b, columns, n_keys):
                out[:d, :d] += (x * (n0 + n1).max(1)[:, None]).T @ x
                out[d, :n_keys] += n0.sum(0)
                out[d + 1, :n_keys] += n1.sum(0)
        return out

    s = _summed(patterns, partial, (d + 2, max(d, n_keys)))
    return s[:d, :d], s[d:, :n_keys]


@dataclass
class _Key:
    """One key's search: the last accepted point, the steps that led there, and the point to try next."""

    x: np.ndarray
    seed: Callable[[np.ndarray], np.ndarray]
    f: float = np.inf
    g: np.ndarray | None = None
    direction: np.ndarray | None = None
    step: float = 1.0
    done: bool = False

    def __post_init__(self):
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.trial = self.x

    def _descent(self) -> np.ndarray:
        q, a = self.g.copy(), []
        for s, y in reversed(self.steps):
            a.append(s @ q / (s @ y))
            q -= a[-1] * y
        q = self.seed(q)
        for (s, y), b in zip(self.steps, reversed(a), strict=True):
            q += s * (b - y @ q / (s @ y))
        return -q

    def told(self, f: float, g: np.ndarray, tolerance: float) -> None:
        """Takes loss and gradient at the trial point and chooses the next one."""
        slope = 0.0 if self.direction is None else self.step * (self.g @ self.direction)
        if f > self.f + 1e-4 * slope + 1e-12 * abs(self.f):
            self.step /= 2
            self.done = self.step < 1e-10  # no lower point within rounding
        else:
            if self.direction is not None:
                s, y = self.trial - self.x, g - self.g
                if s @ y > 1e-14 * (y @ y):
                    self.steps = [*self.steps, (s, y)][-MEMORY:]
            self.x, self.f, self.g = self.trial, f, g
            self.done = bool(np.abs(g).max() <= tolerance)
            self.direction, self.step = self._descent(), 1.0
        self.trial = self.x if self.done else self.x + self.step * self.direction


def fit_logistic(base: LogisticBase, rows: DataFrame, keys: list[str], features: list[str], all_keys: DataFrame) -> NB.NBModel:
    """All models of ``rows`` (see ``LogisticBase.fit``) as a table of weights that the count models' scoring reads."""
    spark = rows.sparkSession
    key_list = sorted(tuple(r) for r in all_keys.select(*keys).distinct().collect())  # one row per model
    patterns, _ = NB.materialize(_patterns(rows, keys, key_list))
    found = patterns.select(F.posexplode("vals").alias("p", "v")).filter("v <> ''").distinct().limit(MOST_COLUMNS + 1).collect()  # refused below when cut
    if len(found) > MOST_COLUMNS or len(key_list) * (1 + len(found)) > MOST_CELLS:
        raise ValueError(f"over {MOST_COLUMNS} feature values, or over {MOST_CELLS} weights; bin the features")
    columns = {(r["p"], r["v"]): i for i, r in enumerate(sorted(found), 1)}
    d = 1 + len(columns)
    cross, (zeros, ones) = _totals(patterns, columns, len(key_list))
    # the constant's share keeps a key with one class finite; it is too small to move any other
    held = np.full(d, base.l2)
    held[0] = base.l2 * 1e-3
    # cross-products times p (1 - p) are the curvature at a constant score, where every key starts
    searches = []
    for a, b in zip(zeros, ones, strict=True):
        p = (b + 1.0) / (a + b + 2.0)
        inverse = np.linalg.inv(p * (1 - p) * cross + np.diag(held))
        x = np.zeros(d)
        x[0] = np.log(p / (1 - p)) if a + b else 0.0
        searches.append(_Key(x, lambda q, m=inverse: m @ q))
    for _ in range(base.most_passes):
        if all(s.done for s in searches):
            break
        points = np.stack([s.trial for s in searches])
        loss, grad = _losses(patterns, columns, points)
        for i, s in enumerate(searches):
            if not s.done:
                w = points[i]
                s.told(loss[i] + 0.5 * held @ (w * w), grad[i] + held * w, base.tolerance)
    schema = all_keys.select(*keys).schema
    for name, kind in (("f", "string"), ("v", "string"), ("t", "integer"), ("w", "double")):
        schema = schema.add(name, kind)
    table = [(*key, features[p], v[1:], 1, float(s.x[i])) for key, s in zip(key_list, searches, strict=True) for (p, v), i in columns.items()]
    const = [{**dict(zip(keys, key, strict=True)), "t": t, "kc": float(s.x[0]) * t} for key, s in zip(key_list, searches, strict=True) for t in (0, 1)]
    weights, n = NB.materialize(spark.createDataFrame(table, schema))
    return NB.NBModel(list(keys), list(features), weights, n, const)
