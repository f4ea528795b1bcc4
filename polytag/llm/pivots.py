"""Exact nearest entries of integer vectors with a pivot table (LAESA).

The distances of every vector to a few fixed pivots are computed once and written beside the vector.  For any entry
(centroid, codebook entry) whose distances to the same pivots are known, |d(x, p) - d(e, p)| <= d(x, e) for each pivot; the greatest
of these differences is the entry's lower bound.  ``nearest`` visits a vector's entries by rising bound, in waves, with exact integer
distances, and stops where the next bound exceeds the best distance found.  Bounds are lowered by more than their
rounding error, so the result (ties included: the lower index) is that of a full search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: integer components are held within these bounds, so squared distances of up to 64 components fit in 64 bits
LARGEST = 1 << 27
#: cells (rows x entries) that one step of ``nearest`` holds
CELLS = 1 << 20


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components."""
    fine = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * component), all floors down, as array<bigint> within +-LARGEST."""
    held = lambda e: F.least(F.greatest(e.cast("double") * scale, F.lit(float(-LARGEST))), F.lit(float(LARGEST)))
    return F.transform(vector, lambda e: F.floor(held(e)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) of a list column whose rows all have ``width`` values."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def farthest(points: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the points (fewer if there are fewer): the first, then always the one farthest from those taken (ties: the first)."""
    if not len(points):
        return points
    taken, gap = [0], ((points - points[0]) ** 2).sum(1)
    while len(taken) < min(count, len(points)):
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[taken[-1]]) ** 2).sum(1))
    return points[taken]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances (rows, pivots) of integer vectors."""
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((x - p) ** 2).sum(1))
    return out


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, squared distance, distances evaluated) of every row of ``x``."""
    step = max(1, CELLS // max(1, len(entries)))
    if len(x) > step:
        parts = [nearest(x[lo : lo + step], to_pivots[lo : lo + step], entries, pivots) for lo in range(0, len(x), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), sum(p[2] for p in parts)
    n, k = len(x), len(entries)
    found, best = np.full(n, k, np.int64), np.full(n, np.iinfo(np.int64).max)
    if not n:
        return found, best, 0
    own = distances(entries, pivots)
    bound = np.zeros((n, k))
    for j in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, j, None] - own[None, :, j]), out=bound)
    # a difference of roots is off by less than 1e-15 of the roots, its square by less than this
    slack = 1e-14 * (to_pivots.max(1) + own.max()) ** 2 + 1e-6
    bound = bound * bound - slack[:, None]
    order = np.argsort(bound, axis=1, kind="stable")
    rows, lo, width, evaluated = np.arange(n), 0, 2, 0
    while len(rows):
        tried = order[rows, lo : lo + width]
        exact = ((x[rows, None, :] - entries[tried]) ** 2).sum(2)
        evaluated += exact.size
        least = exact.min(1)
        first = np.where(exact == least[:, None], tried, k).min(1)
        better = (least < best[rows]) | ((least == best[rows]) & (first < found[rows]))
        best[rows[better]], found[rows[better]] = least[better], first[better]
        lo, width = lo + width, width * 2
        if lo >= k:
            break
        rows = rows[bound[rows, order[rows, lo]] <= best[rows]]
    return found, best, evaluated


def summed(batches_of_codes, groups: int, entries: int, width: int):
    """Sums of member vectors per (group, entry) over all (group, codes, vectors) of a task: counts and sums."""
    count = np.zeros((groups, entries), np.int64)
    total = np.zeros((groups, entries, width), np.int64)
    for g, codes, x in batches_of_codes:
        count[g] += np.bincount(codes, minlength=entries)
        np.add.at(total[g], codes, x)
    return count, total


SUMS_SCHEMA = "part int, entry int, n bigint, s array<bigint>"


def sums_batch(count: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    part, entry = np.nonzero(count)
    s = total[part, entry]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * s.shape[1]), pa.array(s.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), lists], ["part", "entry", "n", "s"])


def moved(partial: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries (parts, entries, width) after one round: floor of the exact mean of the members; entries without members stay."""
    width = books.shape[2]
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    rows = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(wide(F.col("s")[i]) for i in range(width))).alias("s")).collect()
    out = books.copy()
    for r in rows:
        out[r["part"], r["entry"]] = [int(v) // r["n"] for v in r["s"]]
    return out
