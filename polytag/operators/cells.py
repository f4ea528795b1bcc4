"""Exact k-nearest neighbours by pivot cells, without comparing all pairs.

Every reference row belongs to the cell of its nearest pivot (pivots: a bounded number of reference rows with the smallest hash).  A query first
searches the nearest cells that together hold enough rows; its k-th distance there is its radius.  Then it visits the other cells that may hold a row
within the radius, by two triangle bounds: d(q, pivot) - cell radius, and half the difference of the distances to the cell's and the nearest
pivot.  A final ranking keeps the k best of both rounds, so the result is that of a full search, ties included (by reference id).

Cells that lie together are packed into blocks of about ``block_rows`` rows at most (a larger cell is cut by hash), and the queries that ask a block into
blocks as well.  A query goes once to every block of which it may need a cell, with its radius, and the task finds the cells from that: what is shuffled is
every row at most once per block of the other side (about 8, or rows / ``block_rows`` if that is more), never once per cell.  Within a task only cells that some
query of a tile needs are compared.  Where the data do not cluster all pairs are.  The written tables are reliable checkpoints;
pivots and cell counts (``cells`` rows) are all that reaches the driver.  ``probes`` gives the approximate form: each query searches
that many cells (and as many as hold k rows) and no more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polytag.functions import labelsets as LS
from polytag.operators import nb as NB
from polytag.operators.nearest import TILE, matrix, nearest
from polytag.operators.nearest import scaled as _scaled

MOST_CELLS = 1024
#: a search over more than BLOCKS * TILE rows is cut into that many blocks at least, for as many tasks
BLOCKS = 8


def block_size(rows: int, block_rows: int) -> int:
    return min(block_rows, max(TILE, math.ceil(rows / BLOCKS)))


def blocks(rows: int, block_rows: int) -> int:
    return max(1, math.ceil(rows / block_size(rows, block_rows)))


def slim(rows: DataFrame, id_col: str, vec: str, name: str) -> DataFrame:
    """(``name``, v) of the rows that have a vector; floats stay floats, as they take half the room."""
    v = F.col(vec) if dict(rows.dtypes)[vec] == "array<float>" else F.col(vec).cast("array<double>")
    return rows.filter(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias(name), v.alias("v"))


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances, off by at most ``_off``."""
    d2 = x @ pivots.T
    d2 *= -2
    d2 += np.einsum("qd,qd->q", x, x)[:, None]
    d2 += np.einsum("qd,qd->q", pivots, pivots)
    return np.sqrt(np.maximum(d2, 0, out=d2), out=d2)


def _off(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """A bound of the rounding error per row: a root near zero keeps half the digits of the squared norms."""
    return 1e-8 * (x.shape[1] + 64) * (np.sqrt(np.einsum("qd,qd->q", x, x)) + math.sqrt(np.einsum("qd,qd->q", pivots, pivots).max()))


def _parts(x: np.ndarray, pivots: np.ndarray, chunk: int) -> Iterator[slice]:
    """Rows whose distances to all pivots are at most ``chunk`` numbers or so."""
    step = max(1, chunk // max(1, len(pivots)))
    return (slice(s, s + step) for s in range(0, len(x), step))


def _nearest_pivots(x: np.ndarray, pivots: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pivot, its distance) of every row."""
    cell, near = np.empty(len(x), np.int64), np.empty(len(x))
    for p in _parts(x, pivots, chunk):
        d = _to_pivots(x[p], pivots)
        cell[p] = d.argmin(1)
        near[p] = d.min(1)
    return cell, near


def _needed(x: np.ndarray, limit: np.ndarray, pivots: np.ndarray, radius: np.ndarray, slack: float, chunk: int) -> np.ndarray:
    """rows x cells: the cells that may hold a row within the row's limit."""
    out = np.empty((len(x), len(pivots)), bool)
    # bounds are lowered by more than the rounding errors of both sides
    most = limit * (1 + 1e-9) + 1e-9 + 2 * _off(x, pivots) + slack
    for p in _parts(x, pivots, chunk):
        d = _to_pivots(x[p], pivots)
        bound = d - d.min(1, keepdims=True)
        bound /= 2
        d -= radius
        np.less_equal(np.maximum(bound, d, out=d), most[p, None], out=out[p])
    return out


def pack(pivots: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of every cell: cells by their nearest of a few pivots, filled up to ``most`` rows; a larger cell has its own blocks."""
    lead = _to_pivots(pivots, pivots[: max(1, math.isqrt(len(pivots)))]).argmin(1)
    first, many = np.zeros(len(size), np.int64), np.ones(len(size), np.int64)
    at, held = 0, 0
    for c in np.argsort(lead, kind="stable"):
        if held and held + size[c] > most:
            at, held = at + 1, 0
        first[c], many[c] = at, max(1, math.ceil(size[c] / most))
        held += size[c]
        if many[c] > 1:
            at, held = at + many[c], 0
    return first, many


def _search(queries: DataFrame, members: DataFrame, per: dict[int, int], most: int, compare) -> DataFrame:
    """(qid, rid, dist): ``compare`` of every block (``rb``) and the queries that ask it, cut into parts of at most ``most`` or so."""
    asked = {r["rb"]: r["n"] for r in queries.groupBy("rb").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row per block
    parts = F.array(*(F.lit(max(1, math.ceil(asked.get(b, 0) / most))) for b in range(max(per) + 1)))
    part = F.get(parts, F.col("rb"))
    q = queries.withColumn("qb", F.pmod(LS.stable_hash("qid", 101), part).cast("int"))
    r = members.withColumn("qb", F.explode(F.sequence(F.lit(0), part - 1)))
    return q.groupBy("rb", "qb").cogroup(r.groupBy("rb", "qb")).applyInArrow(compare, "qid long, rid long, dist double")


def cell_knn(query: DataFrame, ref: DataFrame, k: int, vec: str, id_col: str, exclude_self: bool, ranges: tuple[list[float], list[float]],
             block_rows: int, chunk: int, cells: int | None = None, probes: int | None = None) -> DataFrame:
    """(qid, rank, rid, dist): the k nearest reference rows of every query row; see the module."""
    mins, rngs = (np.asarray(x, np.float64) for x in ranges)
    dims = len(mins)
    members = slim(ref, id_col, vec, "rid")
    n_ref = members.count()
    wanted = cells or max(1, min(MOST_CELLS, math.isqrt(n_ref)))
    first = members.orderBy(LS.stable_hash("rid", 303), "rid").limit(wanted).select("v").collect()
    pivots = _scaled(np.array([r["v"] for r in first], np.float64).reshape(len(first), dims), mins, rngs)
    n_cells = len(pivots)
    if not n_cells:
        return query.sparkSession.createDataFrame([], "qid long, rank int, rid long, dist double")
    v_type = dict(members.dtypes)["v"]

    def vectors(t: pa.Table | pa.RecordBatch) -> np.ndarray:
        column = t.column("v")
        return _scaled(matrix(column if isinstance(column, pa.ChunkedArray) else pa.chunked_array([column]), dims), mins, rngs)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, d = _nearest_pivots(vectors(b), pivots, chunk)
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(d)], names=["rid", "v", "cell", "d"])

    members, _ = NB.materialize(members.mapInArrow(assign, f"rid long, v {v_type}, cell int, d double"))
    stats = {r["cell"]: (r["n"], r["d"]) for r in members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).collect()}
    size = np.array([stats[c][0] if c in stats else 0 for c in range(n_cells)])
    radius = np.array([stats[c][1] if c in stats else -math.inf for c in range(n_cells)])
    slack = float(2 * _off(np.array([np.ones(dims)]), pivots)[0])  # reference rows lie in the unit cube
    enough, least = k + int(exclude_self), probes or 1
    most = block_size(n_ref, block_rows)
    block, per_cell = pack(pivots, size, most)
    ints = lambda x: F.get(F.array(*(F.lit(int(n)) for n in x)), F.col("cell"))
    members = members.select("rid", "v", "cell", (ints(block) + F.pmod(LS.stable_hash("rid", 202), ints(per_cell))).cast("int").alias("rb"))
    per = {int(b) + i: 1 for b, n in zip(block, per_cell, strict=True) for i in range(n)}

    def named(rows: Iterator[np.ndarray]) -> pa.Array:
        """The blocks of the cells of every row."""
        lists = [np.unique(np.concatenate([np.arange(block[c], block[c] + per_cell[c]) for c in cells_])) if len(cells_) else [] for cells_ in rows]
        return pa.array(lists, pa.list_(pa.int32()))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, own = vectors(b), []
            for p in _parts(x, pivots, chunk):
                order = np.argsort(_to_pivots(x[p], pivots), axis=1, kind="stable")
                many = np.minimum(np.maximum((np.cumsum(size[order], axis=1) < enough).sum(1) + 1, least), n_cells)
                own += [o[:n].astype(np.int32) for o, n in zip(order, many, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("v"), pa.array(own, pa.list_(pa.int32())), named(own)], names=["qid", "v", "cells", "rbs"])

    def first_round(qp: pa.Table, rp: pa.Table) -> pa.Table:
        own = np.zeros((len(qp), n_cells), bool)
        lists = qp.column("cells").to_pylist()
        own[np.repeat(np.arange(len(lists)), [len(c) for c in lists]), np.array([c for x in lists for c in x], np.int64)] = True
        return compared(qp, rp, own, None)

    def compared(qp: pa.Table, rp: pa.Table, own: np.ndarray, limit: np.ndarray | None) -> pa.Table:
        x = vectors(qp)
        # queries of one cell are compared together
        order = np.lexsort((qp.column("qid").to_numpy(), _nearest_pivots(x, pivots, chunk)[0]))
        return nearest(x[order], qp.column("qid").to_numpy()[order], vectors(rp), rp.column("rid").to_numpy(), k, exclude_self, chunk,
                       None if limit is None else limit[order], rp.column("cell").to_numpy(), own[order], probes is not None)

    def needed(x: np.ndarray, limit: np.ndarray) -> np.ndarray:
        return _needed(x, limit, pivots, radius, slack, chunk) & (size > 0)

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            open_ = needed(vectors(b), b.column("limit").to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros((0, n_cells), bool)
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("v"), b.column("limit"), named(np.flatnonzero(o) for o in open_)], names=["qid", "v", "limit", "rbs"])

    def second_round(qp: pa.Table, rp: pa.Table) -> pa.Table:
        limit = qp.column("limit").to_numpy()
        return compared(qp, rp, needed(vectors(qp), limit), limit)

    asked, _ = NB.materialize(slim(query, id_col, vec, "qid").mapInArrow(begin, f"qid long, v {v_type if dict(query.dtypes)[vec] == 'array<float>' else 'array<double>'}, cells array<int>, rbs array<int>"))
    one = _search(asked.select("qid", "v", "cells", F.explode("rbs").alias("rb")), members, per, most, first_round)
    by_rank = Window.partitionBy("qid").orderBy("dist", "rid")
    one, _ = NB.materialize(one.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k))
    if probes is None:
        # the first round only gives radii; a query without k rows there has none
        limits = one.filter(F.col("rank") == k).select(F.col("qid").alias("_q"), F.col("dist").alias("limit"))
        more = asked.join(limits, F.col("qid") == F.col("_q"), "left").select("qid", "v", F.coalesce("limit", F.lit(math.inf)).alias("limit"))
        more = more.mapInArrow(further, f"qid long, v {dict(asked.dtypes)['v']}, limit double, rbs array<int>")
        more, _ = NB.materialize(more.select("qid", "v", "limit", F.explode("rbs").alias("rb")))
        two = _search(more, members, per, most, second_round)
        one = two.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k)
    return one.select("qid", "rank", "rid", "dist")
