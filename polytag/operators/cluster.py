"""Label clustering and label orderings.

Labels are few (L), rows are many.  Everything row-sized stays in Spark: the
only inputs that reach the driver are label-sized summaries — the co-occurrence
(Gram) matrix of the 0/1 label columns, the mutual-information matrix, or the
k x L cosine table of one k-modes iteration — and the clustering of L items
runs there.  Label vectors over N rows are never materialised.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polytag.frame import MLFrame
from polytag.operators import stats as ST


def gram(mlf: MLFrame) -> tuple[int, np.ndarray]:
    """(N, G) with G[i, j] = rows having both labels (diagonal = label counts); L x L."""
    rows = ST.pair_table(mlf).select("i", "j", "N", "n11").collect()
    L = mlf.L
    G = np.zeros((L, L))
    n = 0
    for r in rows:
        G[r["i"], r["j"]] = r["n11"]
        n = r["N"]
    return int(n), G


def cosine_pm1(N: int, G: np.ndarray) -> np.ndarray:
    """Cosine between +-1 label columns: 1 - 2 * hamming / N, hamming = n_i + n_j - 2 n_ij."""
    d = np.diag(G)
    ham = d[:, None] + d[None, :] - 2 * G
    return 1.0 - 2.0 * ham / max(N, 1)


# ------------------------------------------------------------------ k-modes with cosine similarity


def _signed_sums(centres: list[list[tuple[int, int]]], L: int):
    """Batches of (y, count) -> (c, j, s): the dot products of every centre with every label's +-1 column, as exact integers."""
    signs = np.zeros((L, len(centres)), np.int64)
    for c, members in enumerate(centres):
        for m, sign in members:
            signs[m, c] += sign
    at = np.indices((len(centres), L), np.int32)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centres), L), np.int64)
        for b in batches:
            u = 2 * b.column(0).flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, L) - 1
            total += (np.where(u @ signs >= 0, 1, -1) * b.column(1).to_numpy()[:, None]).T @ u
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (*at, total)], names=["c", "j", "s"])

    return sums


def kmodes_cosine(mlf: MLFrame, k: int = 3, iters: int = 100, max_change: int = 0, seed: int = 1,
                  init: list[list[tuple[int, int]]] | None = None) -> DataFrame:
    """(j, cluster, pos): cosine k-modes over the +-1 label columns.

    A centre is a sign vector over rows; it is stored as its member labels and their signs and
    recomputed per distinct label set as sign(sum of signed members), 0 -> +1.  Each iteration is
    one aggregation over the label-set counts giving the k x L cosine table; every label goes to
    the centre with the smallest -ln|cos|.  The loop stops when fewer than ``max_change`` + 1
    assignments change or after ``iters`` iterations (the cap is honoured); an emptied cluster
    keeps its previous centre.  Members are listed farthest from their centre first."""
    L = mlf.L
    N, G = gram(mlf)
    cos = cosine_pm1(N, G)
    # seeds: most frequent label first, then farthest-first by |cos|
    seeds = [int(np.argmax(np.diag(G)))]
    while len(seeds) < min(k, L):
        score = np.min(np.abs(cos[:, seeds]), axis=1)
        score[seeds] = np.inf
        seeds.append(int(np.argmin(score)))
    centres = [list(c) for c in init] if init else [[(s, 1)] for s in seeds]
    counts = ST.labelset_counts(mlf).select("y", "count").cache()
    assign = [-1] * L
    dist = np.zeros(L)
    for _ in range(iters):
        cells = counts.mapInArrow(_signed_sums(centres, L), "c int, j int, s long").groupBy("c", "j").agg(F.sum("s").alias("s")).collect()
        C = np.zeros((len(centres), L))
        for r in cells:
            C[r["c"], r["j"]] = r["s"] / N
        C = np.where(C == 0, np.finfo(float).tiny, C)
        D = -np.log(np.abs(C))
        new = [int(np.argmin(D[:, j])) for j in range(L)]
        dist = np.array([D[new[j], j] for j in range(L)])
        changed = sum(1 for a, b in zip(assign, new) if a != b)
        assign = new
        nc = []
        for c in range(len(centres)):
            mem = [(j, 1 if C[c, j] > 0 else -1) for j in range(L) if assign[j] == c]
            nc.append(mem if mem else centres[c])
        centres = nc
        if changed <= max_change:
            break
    counts.unpersist()
    rows = []
    for c in range(len(centres)):
        mem = sorted([j for j in range(L) if assign[j] == c], key=lambda j: (-dist[j], j))
        rows += [(j, c, p) for p, j in enumerate(mem)]
    return mlf.df.sparkSession.createDataFrame(rows, "j int, cluster int, pos int")


# ------------------------------------------------------------------ k-means|| style seeding by cost


def _cos_cost(cos: np.ndarray) -> np.ndarray:
    """-ln|cos| with a zero cosine replaced by the smallest positive double."""
    c = np.where(cos == 0, np.finfo(float).tiny, cos)
    return -np.log(np.abs(c))


def sample_by_cost(mlf: MLFrame, k: int = 3, steps: int = 2, seed: int = 1) -> list[list[tuple[int, int]]]:
    """Initial k-modes centres over the +-1 label columns, k-means|| style: start from a seeded
    random label; for ``steps`` rounds every label's cost is its smallest -ln|cos| to a centre and
    each label becomes a centre with probability 2 k cost / sum(cost).  When more than k distinct
    centres result, a 10-iteration k-modes over those candidate labels merges them into k centres.
    Centres are returned as (label, sign) member lists.  Costs come from the L x L cosine table
    (one Spark aggregation over the rows); nothing row-sized reaches the driver."""
    L = mlf.L
    N, G = gram(mlf)
    D = _cos_cost(cosine_pm1(N, G))
    rnd = random.Random(seed)
    centres = [rnd.randrange(L)]
    costs = np.full(L, np.inf)
    new = list(centres)
    for _ in range(steps):
        costs = np.minimum(costs, D[new, :].min(axis=0))
        total = float(costs.sum())
        chosen = [j for j in range(L) if total > 0 and rnd.random() < 2.0 * k * costs[j] / total]
        centres += chosen
        new = list(dict.fromkeys(centres))
    distinct = list(dict.fromkeys(centres))
    if len(distinct) <= k:
        return [[(j, 1)] for j in distinct]
    sub = MLFrame(mlf.df.select(mlf.id_col, F.array(*[F.col(mlf.y_col)[j] for j in distinct]).alias(mlf.y_col)),
                  tuple(mlf.labels[j] for j in distinct), (), mlf.id_col, mlf.y_col)
    cl = kmodes_cosine(sub, k=k, iters=10, max_change=0, seed=seed).collect()
    groups = {}
    for r in cl:
        groups.setdefault(r["cluster"], []).append(distinct[r["j"]])
    # a centre is the sign vector of its members' sum; members enter with sign +1
    return [[(j, 1) for j in sorted(g)] for _, g in sorted(groups.items())]


# ------------------------------------------------------------------ kernel k-means on the Gram matrix


def _kernel_kmeans(K: np.ndarray, k: int, iters: int = 20, seed: int = 1, cap: int | None = None) -> list[int]:
    """k-means++ seeded kernel k-means on a kernel matrix; with ``cap`` the clusters are balanced
    (at most cap members: the farthest member of a full cluster moves to its next choice)."""
    n = K.shape[0]
    k = min(k, n)
    rnd = random.Random(seed)
    diag = np.diag(K)
    dist = lambda i, j: diag[i] + diag[j] - 2 * K[i, j]
    seeds = [rnd.randrange(n)]
    while len(seeds) < k:
        d2 = np.array([min(dist(i, s) for s in seeds) for i in range(n)])
        tot = d2.sum()
        if tot <= 0:
            rest = [i for i in range(n) if i not in seeds]
            seeds.append(rest[0])
            continue
        r, acc = rnd.random() * tot, 0.0
        for i in range(n):
            acc += d2[i]
            if acc >= r:
                seeds.append(i)
                break
    assign = [int(np.argmin([dist(i, s) for s in seeds])) for i in range(n)]
    for _ in range(iters):
        D = np.zeros((n, k))
        for c in range(k):
            mem = [i for i in range(n) if assign[i] == c]
            if not mem:
                D[:, c] = np.inf
                continue
            m = len(mem)
            D[:, c] = diag - 2 * K[:, mem].sum(axis=1) / m + K[np.ix_(mem, mem)].sum() / (m * m)
        if cap is None:
            new = [int(np.argmin(D[i])) for i in range(n)]
        else:
            new = [-1] * n
            order = sorted(range(n), key=lambda i: np.min(D[i]))
            size = [0] * k
            for i in order:
                for c in np.argsort(D[i], kind="stable"):
                    if size[c] < cap:
                        new[i] = int(c)
                        size[c] += 1
                        break
        if new == assign:
            break
        assign = new
    return assign


def kmeans_euclid(mlf: MLFrame, k: int = 3, iters: int = 20, seed: int = 1) -> DataFrame:
    """(j, cluster, pos): k-means++ on the 0/1 label columns through the Gram matrix (distances
    ||u_i - mu_C||^2 need only co-occurrence counts); members farthest first."""
    _, G = gram(mlf)
    assign = _kernel_kmeans(G, k, iters, seed)
    return _cluster_rows(mlf, G, assign)


def _cluster_rows(mlf: MLFrame, K: np.ndarray, assign: list[int]) -> DataFrame:
    rows = []
    diag = np.diag(K)
    for c in sorted(set(assign)):
        mem = [i for i in range(len(assign)) if assign[i] == c]
        m = len(mem)
        d = {i: diag[i] - 2 * K[i, mem].sum() / m + K[np.ix_(mem, mem)].sum() / (m * m) for i in mem}
        mem.sort(key=lambda i: (-d[i], i))
        rows += [(i, c, p) for p, i in enumerate(mem)]
    return mlf.df.sparkSession.createDataFrame(rows, "j int, cluster int, pos int")


# ------------------------------------------------------------------ label trees (HOMER)


def label_tree(mlf: MLFrame, k: int = 3, method: str = "balanced", seed: int = 1) -> DataFrame:
    """(label, idx, parent, parent_idx, depth): recursive split of the labels into k groups
    ('balanced': at most ceil(n/k) per group; 'cluster': unbalanced kernel k-means; 'random':
    even random split); groups of at most k labels become leaves.  Meta-labels get indices L, L+1, ..."""
    _, G = gram(mlf)
    rnd = random.Random(seed)
    rows = []
    next_idx = [mlf.L]

    def split(items: list[int], parent: int | None, pname: str | None, depth: int):
        if len(items) <= k:
            for i in items:
                rows.append((mlf.labels[i], i, pname, parent, depth))
            return
        if method == "random":
            its = items[:]
            rnd.shuffle(its)
            groups = [sorted(its[g::k]) for g in range(k)]
        else:
            sub = G[np.ix_(items, items)]
            cap = math.ceil(len(items) / k) if method == "balanced" else None
            a = _kernel_kmeans(sub, k, 20, rnd.randrange(1 << 30), cap)
            groups = [[items[i] for i in range(len(items)) if a[i] == c] for c in range(k)]
            groups = [g for g in groups if g]
            if len(groups) == 1:  # one group took all: fall back to a random split
                its = items[:]
                rnd.shuffle(its)
                groups = [sorted(its[g::k]) for g in range(k)]
        for g in groups:
            if len(g) == 1:
                rows.append((mlf.labels[g[0]], g[0], pname, parent, depth))
                continue
            idx = next_idx[0]
            next_idx[0] += 1
            name = f"meta{idx}"
            rows.append((name, idx, pname, parent, depth))
            split(g, idx, name, depth + 1)

    split(list(range(mlf.L)), None, None, 1)
    return mlf.df.sparkSession.createDataFrame(rows, "label string, idx int, parent string, parent_idx int, depth int")


def random_partition(mlf: MLFrame, k: int = 3, seed: int = 1) -> DataFrame:
    """(j, grp, n): even random partition of all labels into k groups (ntile over a seeded hash order), with each label's number
    of rows (0 for a label that no row has)."""
    from pyspark.sql.window import Window

    from polytag.functions.labelsets import stable_hash

    labels = mlf.df.sparkSession.range(mlf.L).select(F.col("id").cast("int").alias("j"))
    seen = mlf.long().filter("t = 1").groupBy(F.col("j").cast("int").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(stable_hash("j", seed), "j")  # label-sized
    return labels.join(F.broadcast(seen), "j", "left").select("j", (F.ntile(k).over(w) - 1).cast("int").alias("grp"), F.coalesce("n", F.lit(0)).alias("n"))


# ------------------------------------------------------------------ mutual-information chains


def mi_matrix(mlf: MLFrame) -> np.ndarray:
    L = mlf.L
    M = np.zeros((L, L))
    for r in ST.label_mutual_information(mlf).collect():
        M[r["i"], r["j"]] = M[r["j"], r["i"]] = r["mi"]
    return M


def mi_chain(mlf: MLFrame, labels: list[int] | None = None, mode: str = "min") -> list[int]:
    """Greedy order: start from the least dependent pair (lower index first), then repeatedly append
    the unused label with the smallest ('min') or largest ('max') MI to the last one (ties: lower index)."""
    M = mi_matrix(mlf)
    items = list(range(mlf.L)) if labels is None else list(labels)
    if len(items) <= 1:
        return items
    pairs = [(M[a, b], a, b) for ai, a in enumerate(items) for b in items[ai + 1:]]
    _, a, b = min(pairs)
    chain = [min(a, b), max(a, b)]
    while len(chain) < len(items):
        last = chain[-1]
        rest = [j for j in items if j not in chain]
        if mode == "min":
            nxt = min(rest, key=lambda j: (M[last, j], j))
        else:
            nxt = min(rest, key=lambda j: (-M[last, j], j))
        chain.append(nxt)
    return chain


def vector_kmeans(df: DataFrame, vec: str, k: int = 5, seed: int = 1, iters: int = 20):
    """k-means on feature vectors with pyspark.ml; returns (model, within-set sum of squared errors)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.select("id", array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iters).fit(x)
    return model, float(model.summary.trainingCost)
