"""Exact k-nearest neighbours and the neighbour-based learners.

``knn`` is a blocked nested loop: query rows are hashed into Q blocks and
reference rows into B blocks (each block about ``block_rows`` rows at most); every
(query block, reference block) pair meets in one ``cogroup`` task where numpy
(``nearest``) keeps only a local top-k per query.  Nothing
quadratic is materialised as rows, no group is unbounded, and nothing is
broadcast; a window over (query id) then keeps the global top-k out of the
k x B candidates.  Order is total: (distance, reference id).  Rows without a vector
neither ask nor answer.

All pairs are compared; each row is shuffled once per block of the other side (8 times, or rows / ``block_rows`` if that is more).  Beyond
``BLOCKED_ROWS`` reference rows ``knn`` searches pivot cells (``cells``), with the same result.

Distances are Euclidean on range-normalised features ((x - min) / (max - min)
from the reference set; a constant dimension contributes 0).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polytag.functions import labelsets as LS
from polytag.operators.cells import blocks, cell_knn, slim
from polytag.operators.nearest import TILE, matrix, nearest, scaled

BLOCK_ROWS = 32768
BLOCKED_ROWS = 2 * BLOCK_ROWS
#: distances (n x m) of n query rows (n x d) to m reference rows (m x d)
Distance = Callable[[np.ndarray, np.ndarray], np.ndarray]
CHUNK_CELLS = 4_000_000  # query-chunk x ref-block x dims cells per numpy step


def vector_ranges(ref: DataFrame, vec: str) -> tuple[list[float], list[float]]:
    """Per-dimension min and range of the reference vectors (one aggregation, d numbers)."""
    first = ref.select(F.size(vec).alias("d")).first()
    d = int(first["d"])
    row = ref.agg(*[F.min(F.col(vec)[i]).alias(f"a{i}") for i in range(d)], *[F.max(F.col(vec)[i]).alias(f"b{i}") for i in range(d)]).first()
    mins = [float(row[f"a{i}"]) for i in range(d)]
    rngs = [float(row[f"b{i}"]) - float(row[f"a{i}"]) for i in range(d)]
    return mins, rngs


def knn(query: DataFrame, ref: DataFrame, k: int, vec: str = "vec", id_col: str = "id", exclude_self: bool = True,
        block_rows: int = BLOCK_ROWS, ranges=None, method: str | None = None, probes: int | None = None, distance: Distance | None = None) -> DataFrame:
    """(qid, rank, rid, dist): the k nearest reference rows of every query row; ``method`` "blocks" or "cells" (default by size).

    ``probes`` gives the approximate form: that many cells per query.  ``distance`` replaces the Euclidean distance on the
    normalised vectors by any other; cells need the triangle bounds of the former, so such a search compares all blocks."""
    if distance is not None and (method == "cells" or probes):
        raise ValueError("cells search by Euclidean distance only")
    mins, rngs = ranges if ranges is not None else vector_ranges(ref, vec)
    nr = ref.count()
    if method == "cells" or probes or (method is None and distance is None and nr > BLOCKED_ROWS):
        return cell_knn(query, ref, k, vec, id_col, exclude_self, (mins, rngs), block_rows, CHUNK_CELLS, probes=probes)
    nq = query.count()
    Q, B = blocks(nq, block_rows), blocks(nr, block_rows)
    # block numbers are int on both sides: equal numbers of other types are dealt to other partitions
    at = lambda name, seed, n: F.pmod(LS.stable_hash(name, seed), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = slim(query, id_col, vec, "qid").withColumn("qb", at("qid", 101, Q)).select("qid", "v", "qb", every(B).alias("rb"))
    r = slim(ref, id_col, vec, "rid").withColumn("rb", at("rid", 202, B)).select("rid", "v", "rb", every(Q).alias("qb"))
    mn, rg = np.asarray(mins, dtype=np.float64), np.asarray(rngs, dtype=np.float64)

    def block(qp: pa.Table, rp: pa.Table) -> pa.Table:
        A, R = (scaled(matrix(t.column("v"), len(mn)), mn, rg) for t in (qp, rp))
        qids, rids = (t.column(c).to_numpy() for t, c in ((qp, "qid"), (rp, "rid")))
        return nearest(A, qids, R, rids, k, exclude_self, CHUNK_CELLS) if distance is None else by_distance(A, qids, R, rids)

    def by_distance(A: np.ndarray, qids: np.ndarray, R: np.ndarray, rids: np.ndarray) -> pa.Table:
        oq, orr, od = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for t in range(0, len(rids), TILE):
            near, names = R[t:t + TILE], rids[t:t + TILE]
            step = max(1, CHUNK_CELLS // max(1, len(names) * A.shape[1]))
            for s in range(0, len(qids), step):
                d = np.asarray(distance(A[s:s + step], near), dtype=np.float64)
                if exclude_self:
                    d = np.where(qids[s:s + step, None] == names[None, :], np.inf, d)
                for i in range(d.shape[0]):
                    order = np.lexsort((names, d[i]))[:k]
                    order = order[np.isfinite(d[i][order])]
                    oq.append(np.full(len(order), qids[s + i], dtype=np.int64))
                    orr.append(names[order])
                    od.append(d[i][order])
        return pa.table({"qid": np.concatenate(oq), "rid": np.concatenate(orr), "dist": np.concatenate(od)})

    cand = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(block, "qid long, rid long, dist double")
    w = Window.partitionBy("qid").orderBy("dist", "rid")
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "rank", "rid", "dist")


def neighbour_label_counts(nb: DataFrame, labels: DataFrame, L: int, y: str = "y", id_col: str = "id") -> DataFrame:
    """(qid, cnt ARRAY<INT>): per query, how many of its neighbours have each label."""
    x = nb.join(labels.select(F.col(id_col).alias("rid"), F.col(y).alias("ny")), "rid")
    return x.groupBy("qid").agg(F.array(*[F.sum(F.coalesce(F.get("ny", F.lit(j)), F.lit(0))) for j in range(L)]).alias("cnt"))


# ------------------------------------------------------------------ ML-kNN


def fit_mlknn(train: DataFrame, L: int, k: int = 10, s: float = 1.0, vec: str = "vec", ranges=None, distance: Distance | None = None) -> dict:
    """Priors and neighbour-count likelihoods per label (label-sized tables), self excluded."""
    ranges = ranges or vector_ranges(train, vec)
    n = train.count()
    c = [int(x) for x in train.agg(F.array(*[F.sum(F.coalesce(F.col("y")[j], F.lit(0))) for j in range(L)]).alias("c")).first()["c"]]
    prior = [(s + c[j]) / (s * 2 + n) for j in range(L)]
    nb = knn(train, train, k, vec, exclude_self=True, ranges=ranges, distance=distance)
    cnt = neighbour_label_counts(nb, train, L)
    x = cnt.join(train.select(F.col("id").alias("qid"), "y"), "qid").select(F.posexplode(F.arrays_zip("cnt", "y")).alias("j", "z"))
    h = x.groupBy("j", F.col("z.cnt").alias("d"), F.col("z.y").alias("t")).count().collect()
    C1 = [[0] * (k + 1) for _ in range(L)]
    C0 = [[0] * (k + 1) for _ in range(L)]
    for r in h:
        (C1 if r["t"] == 1 else C0)[r["j"]][r["d"]] += r["count"]
    P1 = [[(s + C1[j][d]) / (s * (k + 1) + sum(C1[j])) for d in range(k + 1)] for j in range(L)]
    P0 = [[(s + C0[j][d]) / (s * (k + 1) + sum(C0[j])) for d in range(k + 1)] for j in range(L)]
    return {"prior": prior, "P1": P1, "P0": P0, "k": k, "L": L, "ranges": ranges, "distance": distance}


def predict_mlknn(model: dict, train: DataFrame, df: DataFrame, vec: str = "vec") -> DataFrame:
    """(id, j, conf, bip): conf = in / (in + out); positive iff in >= out (the reference breaks an
    exact tie at random)."""
    L, k = model["L"], model["k"]
    nb = knn(df, train, k, vec, exclude_self=False, ranges=model["ranges"], distance=model["distance"])
    cnt = neighbour_label_counts(nb, train, L)
    pr = F.array(*[F.lit(p) for p in model["prior"]])
    p1 = F.array(*[F.array(*[F.lit(v) for v in row]) for row in model["P1"]])
    p0 = F.array(*[F.array(*[F.lit(v) for v in row]) for row in model["P0"]])
    x = cnt.select("qid", F.posexplode("cnt").alias("j", "d"))
    pin = F.get(pr, F.col("j")) * F.get(F.get(p1, F.col("j")), F.col("d"))
    pout = (1 - F.get(pr, F.col("j"))) * F.get(F.get(p0, F.col("j")), F.col("d"))
    return x.select(F.col("qid").alias("id"), F.col("j").cast("int").alias("j"), (pin / (pin + pout)).alias("conf"),
                    (pin >= pout).cast("int").alias("bip"))


# ------------------------------------------------------------------ BR-kNN


def predict_brknn(train: DataFrame, df: DataFrame, L: int, k: int = 10, ext: str = "none", vec: str = "vec",
                  seed: int = 3, ranges=None, distance: Distance | None = None) -> DataFrame:
    """(id, conf ARRAY, bip ARRAY): conf_j = (1/n + votes_j) / (L/n + k); 'none' thresholds at 0.5,
    'a' adds the top label when none passes, 'b' keeps the round(mean labels of the neighbours) top
    labels (ties at the cut broken by a seeded hash)."""
    n = train.count()
    nb = knn(df, train, k, vec, exclude_self=False, ranges=ranges, distance=distance)
    cnt = neighbour_label_counts(nb, train, L)
    kk = nb.groupBy("qid").agg(F.count(F.lit(1)).alias("kk"))
    x = cnt.join(kk, "qid")
    total = F.lit(L / max(1, n)) + F.col("kk")
    conf = F.transform("cnt", lambda c: (F.lit(1.0 / max(1, n)) + c) / total)
    x = x.select(F.col("qid").alias("id"), conf.alias("conf"),
                 F.floor(F.aggregate("cnt", F.lit(0).cast("bigint"), lambda a, c: a + c) / total + 0.5).cast("int").alias("avg"))
    if ext == "none":
        return x.select("id", "conf", LS.bipartition("conf", 0.5).alias("bip"))
    if ext == "a":
        top = LS.argmax_hash_tie("conf", "id", seed)
        b = F.transform("conf", lambda c, j: F.when((c >= 0.5) | ((F.array_max("conf") < 0.5) & (j == top)), 1).otherwise(0))
        return x.select("id", "conf", b.alias("bip"))
    # ext b: the avg labels with the highest confidence; order (conf desc, hash) breaks ties
    keyed = F.transform("conf", lambda c, j: F.struct((-c).alias("nc"), LS.stable_hash2(F.col("id"), j, seed).alias("h"), j.alias("j")))
    chosen = F.transform(F.slice(F.array_sort(keyed), 1, F.greatest(F.col("avg"), F.lit(0))), lambda e: e["j"])
    b = F.transform("conf", lambda c, j: F.when(F.array_contains(chosen, j), 1).otherwise(0))
    return x.select("id", "conf", b.alias("bip"))


def select_k(train: DataFrame, L: int, kmax: int = 10, vec: str = "vec", ranges=None, distance: Distance | None = None) -> DataFrame:
    """(k, hamming_loss, best): leave-one-out Hamming loss of BR-kNN for k = 1..kmax from one
    neighbour search (running label counts over the neighbour rank); the lowest loss wins, the
    smaller k on ties."""
    n = train.count()
    nb = knn(train, train, kmax, vec, exclude_self=True, ranges=ranges, distance=distance)
    x = nb.join(train.select(F.col("id").alias("rid"), F.col("y").alias("ny")), "rid")
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("qid", "rank", *[F.sum(F.coalesce(F.get("ny", F.lit(j)), F.lit(0))).over(w).alias(f"c{j}") for j in range(L)])
    x = x.join(train.select(F.col("id").alias("qid"), "y"), "qid")
    wrong = sum(
        F.when(((F.lit(1.0 / n) + F.col(f"c{j}")) / (F.lit(L / n) + F.col("rank")) >= 0.5).cast("int") != F.get("y", F.lit(j)), 1).otherwise(0)
        for j in range(L))
    h = x.groupBy(F.col("rank").alias("k")).agg((F.sum(wrong) / (F.count(F.lit(1)) * L)).alias("hamming_loss"))
    w2 = Window.orderBy("hamming_loss", "k")
    return h.withColumn("best", F.row_number().over(w2) == 1)


# ------------------------------------------------------------------ DML-kNN


def _count_key(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def predict_dmlknn(train: DataFrame, df: DataFrame, L: int, k: int = 10, s: float = 1.0, delta: int = 6, vec: str = "vec",
                   ranges=None) -> DataFrame:
    """(id, j, conf, bip).  Training rows vote for label q only when their neighbour-count vector is
    within +-delta of the query's on *every* label and equal on label q:
    in = prior_q (s + V_q) / (s L + C_q), out = (1 - prior_q) (s + NV_q) / (s L + NC_q).

    Work happens on *distinct* count vectors (at most (k+1)^L, and at most the row count), so a hot
    vector is one row: training vectors carry (rows, positives per label); query vectors meet them
    in a band join keyed on the first two counts (query side exploded over the +-delta window, an
    equi-join, no broadcast), the remaining labels are a filter."""
    ranges = ranges or vector_ranges(train, vec)
    n = train.count()
    c = [int(x) for x in train.agg(F.array(*[F.sum(F.coalesce(F.col("y")[j], F.lit(0))) for j in range(L)]).alias("c")).first()["c"]]
    prior = [(s + c[j]) / (s * 2 + n) for j in range(L)]
    ci = neighbour_label_counts(knn(train, train, k, vec, exclude_self=True, ranges=ranges), train, L)
    tv = ci.join(train.select(F.col("id").alias("qid"), "y"), "qid").groupBy("cnt").agg(
        F.count(F.lit(1)).alias("nr"), F.array(*[F.sum(F.coalesce(F.get("y", F.lit(j)), F.lit(0))) for j in range(L)]).alias("pos"))
    ct = neighbour_label_counts(knn(df, train, k, vec, exclude_self=False, ranges=ranges), train, L)
    qv = ct.select(F.col("cnt").alias("qc")).distinct()
    band = list(range(min(L, 2)))
    tvk = tv.select("cnt", "nr", "pos", *[F.col("cnt")[b].alias(f"b{b}") for b in band])
    qvk = qv
    for b in band:
        qvk = qvk.withColumn(f"b{b}", F.explode(F.sequence(F.greatest(F.col("qc")[b] - delta, F.lit(0)),
                                                           F.least(F.col("qc")[b] + delta, F.lit(k)))))
    pairs = qvk.join(tvk, [f"b{b}" for b in band]).filter(
        F.forall(F.zip_with("cnt", "qc", lambda a, b: F.abs(a - b) <= delta), lambda ok: ok))
    eq = [F.get("cnt", F.lit(q)) == F.get("qc", F.lit(q)) for q in range(L)]
    votes = pairs.groupBy(_count_key(F.col("qc")).alias("ck")).agg(
        F.array(*[F.sum(F.when(eq[q], F.get("pos", F.lit(q))).otherwise(0)) for q in range(L)]).alias("V"),
        F.array(*[F.sum(F.when(eq[q], F.col("nr") - F.get("pos", F.lit(q))).otherwise(0)) for q in range(L)]).alias("NV"))
    x = ct.select("qid", "cnt", _count_key(F.col("cnt")).alias("ck")).join(votes, "ck", "left")
    x = x.select("qid", F.posexplode("cnt").alias("j", "d"), "V", "NV")
    pr = F.get(F.array(*[F.lit(p) for p in prior]), F.col("j"))
    cc = F.get(F.array(*[F.lit(float(v)) for v in c]), F.col("j"))
    v = F.coalesce(F.get("V", F.col("j")), F.lit(0))
    nv = F.coalesce(F.get("NV", F.col("j")), F.lit(0))
    pin = pr * (F.lit(s) + v) / (F.lit(s * L) + cc)
    pout = (F.lit(1.0) - pr) * (F.lit(s) + nv) / (F.lit(s * L) + (F.lit(float(n)) - cc))
    conf = F.when(pin + pout == 0, pin).otherwise(pin / (pin + pout))
    return x.select(F.col("qid").alias("id"), F.col("j").cast("int").alias("j"), conf.alias("conf"), (pin >= pout).cast("int").alias("bip"))
