"""Ranking learners on numeric feature vectors (re-aimed for data-parallel training).

* ``fit_ranking_perceptron`` — one linear scorer per label (bias input 1) updated on the ranking
  loss by the uniform / max / random rule.  The reference makes sequential passes over all rows;
  here every epoch is one Spark job in which each partition makes its own pass from the current
  weights and the weights are averaged by row count (iterative parameter mixing).
* ``fit_ranking_net`` — one tanh hidden layer and tanh outputs trained on the pairwise exponential
  ranking error E = sum over (relevant k, irrelevant l) of exp(-(c_k - c_l)) / (|Y| |Ybar|) plus
  weight decay.  The reference updates per example; here every epoch is one full-batch gradient:
  ``mapInPandas`` computes each Arrow batch's gradient with numpy and Spark sums them.

The weights (label-sized: L x (d + 1), or (d + 1) x H + (H + 1) x L) travel in the task closure;
rows never leave the executors.  Scores are column expressions at prediction time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polytag.operators import nb as NB

PAIR_CELLS = 4_000_000  # rows x L x L numbers per gradient step (about 32 MB of doubles)


def _sum_vectors(parts: DataFrame, n_col: str, vec_col: str, size: int) -> tuple[float, np.ndarray]:
    """Sum of the per-partition vectors: exploded by position and summed per position (partial
    aggregation in every task, a vector-sized result), plus the summed row count."""
    x = parts.select(F.col(n_col).cast("double").alias("n"), F.posexplode(vec_col).alias("i", "v"))
    rows = x.groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    out = np.zeros(size)
    n = 0.0
    for r in rows:
        out[r["i"]] = r["v"]
        n = r["n"]
    return n, out


def _matrix(pdf: pd.DataFrame, vec: str) -> np.ndarray:
    X = np.vstack(pdf[vec].to_numpy()).astype(np.float64)
    return np.hstack([X, np.ones((len(X), 1))])


def _ranks(scores: np.ndarray) -> np.ndarray:
    """1 = highest score; ties go to the larger label index."""
    L = len(scores)
    order = np.lexsort((-np.arange(L), -scores))
    r = np.empty(L, dtype=np.int64)
    r[order] = np.arange(1, L + 1)
    return r


def _ranking_loss(scores: np.ndarray, y: np.ndarray) -> float:
    rel, irr = np.where(y == 1)[0], np.where(y != 1)[0]
    if len(rel) == 0 or len(irr) == 0:
        return 0.0
    r = _ranks(scores)
    return float((r[rel][:, None] > r[irr][None, :]).sum()) / (len(rel) * len(irr))


def _mmp_step(W: np.ndarray, x: np.ndarray, y: np.ndarray, rule: str, rng: np.random.Generator) -> None:
    s = W @ x
    loss = _ranking_loss(s, y)
    if loss == 0:
        return
    rel, irr = np.where(y == 1)[0], np.where(y != 1)[0]
    p = np.zeros(len(s))
    if rule == "max":
        lr = min(rel, key=lambda j: (s[j], -j))  # lowest-scored relevant label (later index on ties)
        hi = max(irr, key=lambda j: (s[j], j))  # highest-scored irrelevant label (later index on ties)
        p[lr], p[hi] = loss, -loss
    else:
        viol = [(a, b) for a in rel for b in irr if s[a] <= s[b]]
        if not viol:
            return
        wts = np.ones(len(viol)) if rule == "uniform" else rng.random(len(viol))
        wts = wts / wts.sum()
        for (a, b), w in zip(viol, wts):
            p[a] += w
            p[b] -= w
        p *= loss
    W += np.outer(p, x)


def fit_ranking_perceptron(train: DataFrame, L: int, vec: str = "vec", rule: str = "uniform", epochs: int = 10,
                           seed: int = 1, id_col: str = "id") -> np.ndarray:
    """L x (d + 1) weights.  Rows are ordered by id inside each partition so a pass is repeatable
    for a given partitioning."""
    data, _ = NB.materialize(train.select(id_col, F.col(vec).cast("array<double>").alias("v"), "y").sortWithinPartitions(id_col))
    d = int(data.select(F.size("v").alias("d")).first()["d"])
    W = np.zeros((L, d + 1))
    for ep in range(epochs):
        W0 = W.copy()

        def part(batches, W0=W0, ep=ep):
            Wp = W0.copy()
            n = 0
            rng = np.random.default_rng(seed * 1000 + ep)
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                X = _matrix(pdf, "v")
                Y = np.vstack(pdf["y"].to_numpy()).astype(np.float64)
                Y = np.nan_to_num(Y, nan=0.0)
                for i in range(len(X)):
                    _mmp_step(Wp, X[i], Y[i], rule, rng)
                n += len(X)
            if n:
                yield pd.DataFrame({"n": [n], "w": [(Wp * n).ravel().tolist()]})

        n, w = _sum_vectors(data.mapInPandas(part, "n long, w array<double>"), "n", "w", L * (d + 1))
        W = w.reshape(L, d + 1) / n
    return W


def linear_scores(W: np.ndarray, df: DataFrame, vec: str = "vec", id_col: str = "id") -> DataFrame:
    """(id, conf ARRAY<DOUBLE>): conf_j = w_j . (x, 1) as a column expression."""
    L, d1 = W.shape
    x = F.col(vec)
    conf = F.array(*[sum((F.get(x, F.lit(i)) * float(W[j, i]) for i in range(d1 - 1)), F.lit(float(W[j, d1 - 1]))) for j in range(L)])
    return df.select(id_col, conf.alias("conf"))


# ------------------------------------------------------------------ ranking net (full-batch)


def _net_forward(X: np.ndarray, W1: np.ndarray, W2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    Hh = np.tanh(X @ W1)
    H1 = np.hstack([Hh, np.ones((len(Hh), 1))])
    return Hh, np.tanh(H1 @ W2)


def net_error(X: np.ndarray, Y: np.ndarray, W1: np.ndarray, W2: np.ndarray) -> float:
    """Summed pairwise exponential ranking error of the rows with both relevant and irrelevant labels."""
    nr, ni = Y.sum(1), (1 - Y).sum(1)
    keep = (nr > 0) & (ni > 0)
    _, C = _net_forward(X[keep], W1, W2)
    Yk = Y[keep]
    E = np.exp(-(C[:, :, None] - C[:, None, :])) * (Yk[:, :, None] * (1 - Yk)[:, None, :])
    return float((E.sum((1, 2)) / (nr[keep] * ni[keep])).sum())


def net_gradient(X: np.ndarray, Y: np.ndarray, W1: np.ndarray, W2: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Gradient of ``net_error`` w.r.t. W1 and W2 over a batch (X carries the bias column), and the
    number of rows that contribute."""
    nr, ni = Y.sum(1), (1 - Y).sum(1)
    keep = (nr > 0) & (ni > 0)
    if not keep.any():
        return np.zeros_like(W1), np.zeros_like(W2), 0
    X, Y, nr, ni = X[keep], Y[keep], nr[keep], ni[keep]
    Hh, C = _net_forward(X, W1, W2)
    # dE/dc_k: relevant k: -sum_l exp(-(c_k - c_l)); irrelevant l: +sum_k exp(-(c_k - c_l)); / (|Y||Ybar|)
    E = np.exp(-(C[:, :, None] - C[:, None, :])) * (Y[:, :, None] * (1 - Y)[:, None, :])
    dC = (-E.sum(2) + E.sum(1)) / (nr * ni)[:, None]
    dZ2 = dC * (1 - C * C)
    H1 = np.hstack([Hh, np.ones((len(Hh), 1))])
    dZ1 = (dZ2 @ W2[:-1].T) * (1 - Hh * Hh)
    return X.T @ dZ1, H1.T @ dZ2, len(X)


def fit_ranking_net(train: DataFrame, L: int, vec: str = "vec", hidden_share: float = 0.2, epochs: int = 100,
                    lr: float = 0.05, decay: float = 1e-5, seed: int = 1, id_col: str = "id") -> tuple[np.ndarray, np.ndarray, list, list]:
    """(W1, W2, mins, ranges).  Inputs are scaled to [-1, 1] by the training ranges (a constant
    dimension maps to -1); hidden units = max(1, round(hidden_share * d)); weights start uniform in
    +-1/sqrt(fan-in) from a seeded generator.  Rows with no relevant or no irrelevant label carry
    no ranking error and are skipped."""
    from polytag.operators.knn import vector_ranges

    data, n = NB.materialize(train.select(F.col(vec).cast("array<double>").alias("v"), "y"))
    mins, rngs = vector_ranges(data, "v")
    d = len(mins)
    Hn = max(1, int(round(hidden_share * d)))
    g = np.random.default_rng(seed)
    W1 = g.uniform(-1, 1, (d + 1, Hn)) / np.sqrt(d + 1)
    W2 = g.uniform(-1, 1, (Hn + 1, L)) / np.sqrt(Hn + 1)
    mn, rg = np.asarray(mins), np.asarray(rngs)
    for _ in range(epochs):
        def part(batches, W1=W1.copy(), W2=W2.copy()):
            G1, G2, m = np.zeros_like(W1), np.zeros_like(W2), 0
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                X = np.vstack(pdf["v"].to_numpy()).astype(np.float64)
                X = np.where(rg > 0, 2 * (X - mn) / np.where(rg > 0, rg, 1) - 1, -1.0)
                X = np.hstack([X, np.ones((len(X), 1))])
                Y = np.nan_to_num(np.vstack(pdf["y"].to_numpy()).astype(np.float64), nan=0.0)
                step = max(1, PAIR_CELLS // max(1, L * L))  # the error tensor is rows x L x L
                for s0 in range(0, len(X), step):
                    g1, g2, k = net_gradient(X[s0:s0 + step], Y[s0:s0 + step], W1, W2)
                    G1 += g1
                    G2 += g2
                    m += k
            yield pd.DataFrame({"m": [m], "g": [np.concatenate([G1.ravel(), G2.ravel()]).tolist()]})

        size = W1.size + W2.size
        m, g = _sum_vectors(data.mapInPandas(part, "m long, g array<double>"), "m", "g", size)
        if not m:
            break
        grad = g / m
        W1 = W1 - lr * (grad[:W1.size].reshape(W1.shape) + decay * W1)
        W2 = W2 - lr * (grad[W1.size:].reshape(W2.shape) + decay * W2)
    return W1, W2, mins, rngs


def net_scores(model, df: DataFrame, vec: str = "vec", id_col: str = "id") -> DataFrame:
    """(id, conf ARRAY<DOUBLE>) of the ranking net, row-parallel in mapInPandas."""
    W1, W2, mins, rngs = model
    mn, rg = np.asarray(mins), np.asarray(rngs)

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = np.vstack(pdf["v"].to_numpy()).astype(np.float64)
            X = np.where(rg > 0, 2 * (X - mn) / np.where(rg > 0, rg, 1) - 1, -1.0)
            X = np.hstack([X, np.ones((len(X), 1))])
            _, C = _net_forward(X, W1, W2)
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), "conf": list(C)})

    return df.select(id_col, F.col(vec).cast("array<double>").alias("v")).mapInPandas(run, f"{id_col} long, conf array<double>")
