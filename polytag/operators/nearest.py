"""The k nearest rows of one block, for the neighbour searches: bounded memory whatever a block holds.

Squared norms and one matrix product give all distances of a tile (``TILE`` reference rows by some queries) up to a known rounding error; pairs that may
still be among a query's k best are taken by a threshold and measured again from the differences, so results do not depend on the rounding of the product.
Of equal reference vectors only the smallest ids can be among the k best; the others are left out first, so that copies make no long lists of ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

TILE = 4096


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """The (rows x dims) matrix of an array column without nulls; other lengths raise."""
    parts = [c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in column.chunks]
    return (np.concatenate(parts) if parts else np.zeros(0)).reshape(len(column), dims)


def scaled(m: np.ndarray, mins: np.ndarray, rngs: np.ndarray) -> np.ndarray:
    out = (m - mins) / np.where(rngs == 0, 1.0, rngs)
    out[:, rngs == 0] = 0.0
    return out


def _first_of_equals(b: np.ndarray, rids: np.ndarray, most: int) -> np.ndarray:
    """Positions of the rows that are finite and have one of the ``most`` smallest ids of their vector."""
    at = np.flatnonzero(np.isfinite(b).all(1))
    if len(at) <= most or not b.shape[1]:
        return at
    at = at[np.argsort(rids[at], kind="stable")]
    rows = np.ascontiguousarray(b[at] + 0.0)
    _, group = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    g, ids = group[order], rids[at][order]
    start = np.concatenate(([True], g[1:] != g[:-1]))
    run = np.cumsum(start | np.concatenate(([True], ids[1:] != ids[:-1])))
    first = run[np.flatnonzero(start)]
    return at[np.sort(order[run - first[np.cumsum(start) - 1] < most])]


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, chunk: int) -> np.ndarray:
    out = np.empty(len(i))
    step = max(1, chunk // max(1, a.shape[1]))
    for s in range(0, len(i), step):
        diff = a[i[s : s + step]] - b[j[s : s + step]]
        out[s : s + step] = np.einsum("qd,qd->q", diff, diff)
    return out


def nearest(a: np.ndarray, qids: np.ndarray, b: np.ndarray, rids: np.ndarray, k: int, exclude_self: bool, chunk: int,
            limit: np.ndarray | None = None, cells: np.ndarray | None = None, asked: np.ndarray | None = None, strict: bool = False) -> pa.Table:
    """(qid, rid, dist): the k best of ``b`` for every row of ``a``, by (distance, id).

    ``limit``: distances that no wanted row exceeds.  ``cells`` (of the reference rows) and ``asked`` (queries x cells): cells that no
    query of a tile asks for are not compared; with ``strict`` a query is answered from its own cells alone."""
    keep = _first_of_equals(b, rids, k + 1)
    b, rids = b[keep], rids[keep]
    cells = None if cells is None else cells[keep]
    if cells is not None:
        by_cell = np.argsort(cells, kind="stable")
        b, rids, cells = b[by_cell], rids[by_cell], cells[by_cell]
    fine = np.flatnonzero(np.isfinite(a).all(1))
    many = max(1, min(512, chunk // max(1, min(TILE, len(b)))))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(fine), many):
        q = fine[lo : lo + many]
        x, ids = a[q], qids[q]
        own = None if asked is None else asked[q]
        open_ = None if own is None else np.flatnonzero(own.any(0)[cells])
        norm = np.einsum("qd,qd->q", x, x)
        low = np.full(len(q), np.inf) if limit is None else (limit[q] * (1 + 1e-9) + 1e-9) ** 2
        found = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        for s in range(0, len(b) if open_ is None else len(open_), TILE):
            tile = slice(s, s + TILE) if open_ is None else open_[s : s + TILE]
            y, names = b[tile], rids[tile]
            other = np.einsum("qd,qd->q", y, y)
            error = 2e-15 * (x.shape[1] + 8) * (norm + other.max())
            d2 = x @ y.T
            d2 *= -2
            d2 += norm[:, None]
            d2 += other
            if exclude_self:
                d2[ids[:, None] == names] = np.inf
            if strict:
                d2[~own[:, cells[tile]]] = np.inf
            unknown = np.flatnonzero(np.isinf(low))
            if len(unknown) and len(names) > k:
                low[unknown] = np.partition(d2[unknown], k - 1, axis=1)[:, k - 1] + error[unknown]
            i, j = np.nonzero(d2 <= (low + error)[:, None])
            real = np.isfinite(d2[i, j])
            i, j = i[real], j[real]
            if not len(i):
                continue
            i, d, r = np.concatenate((found[0], i)), np.concatenate((found[1], _exact(x, y, i, j, chunk))), np.concatenate((found[2], names[j]))
            order = np.lexsort((r, d, i))
            i, d, r = i[order], d[order], r[order]
            first = np.searchsorted(i, np.arange(len(q)))
            rank = np.arange(len(i)) - first[i]
            best = rank < k
            found = (i[best], d[best], r[best])
            last = rank == k - 1
            low[i[last]] = np.minimum(low[i[last]], d[last])
        out.append((ids[found[0]], found[2], np.sqrt(found[1])))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in (np.int64, np.int64, np.float64)]
    return pa.table(dict(zip(("qid", "rid", "dist"), (pa.array(c) for c in cols), strict=True)))
