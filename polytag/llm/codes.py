"""Vector code compression: product codes whose nearest entries are found with a pivot table.

Vectors become integers and are cut into ``PARTS`` equal consecutive parts; each part position has a codebook of at most ``ENTRIES``
entries, which starts as that part of the vectors with the smallest ids.  The distances of every part to ``PIVOTS`` fixed entries of its first
codebook (spread out, farthest first) are computed once and written beside the integers.  Each of ``ROUNDS`` rounds assigns all parts with
``pivots.nearest`` and replaces every used entry by the floor of its members' mean; one row per entry leaves a task, and the
codebooks (bounded by parts x entries) are all that the driver holds.  Rounds read the written table, so nothing is recomputed after a loss.

Cases: vectors that are null or hold null, NaN or infinite components are dropped, and so are vectors of another length than most vectors of the
table have (ties: the longer; only lengths that the parts divide count); components beyond +-2^27 after scaling are held there; a repeated id is
a vector for each of its rows (the first entries take equal ids in the order of their components); null ids come last; fewer vectors than entries give smaller codebooks; null
labels are one label; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pivots
from .lookup import looked_up
from .store import Scratch

PARTS, ENTRIES, ROUNDS, SCALE, PIVOTS = 4, 256, 4, 1024, 8


@dataclass
class Compressed:
    """``codes``: vec_id, label, entry indexes per part, squared error (a written table); ``books``: (parts, entries, width) integers."""

    codes: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for v in self.books.ravel().tolist()).encode()).hexdigest()

    def restored(self) -> DataFrame:
        """vec_id and the integer vector that the codes stand for."""
        books = self.books

        def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = pivots.matrix(b["codes"], len(books))
                v = np.concatenate([books[p][codes[:, p]] for p in range(len(books))], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([b["vec_id"], lists], ["vec_id", "vector"])

        return self.codes.select("vec_id", "codes").mapInArrow(restore, "vec_id bigint, vector array<bigint>")


def _length(vectors: DataFrame, parts: int) -> int:
    sizes = vectors.groupBy(F.size("v").alias("n")).count().filter((F.col("n") > 0) & (F.col("n") % parts == 0))
    top = sizes.orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return top[0]["n"] if top else 0


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, n_pivots: int = PIVOTS) -> Compressed:
    """vectors (vec_id, embedding, label) -> their codes and codebooks."""
    scratch = Scratch(vectors.sparkSession, "codes")
    whole = vectors.filter(pivots.usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), pivots.integers(F.col("embedding"), scale).alias("v"))
    length = _length(whole, parts)
    whole = whole.filter(F.size("v") == length)
    width = length // parts
    first = [r["v"] for r in whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    fixed = [pivots.farthest(books[p], n_pivots) for p in range(parts)]
    count = len(first) and len(fixed[0])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pivots.matrix(b["v"], length)
            d = np.concatenate([pivots.distances(x[:, p * width : (p + 1) * width], fixed[p]) for p in range(parts)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], b["v"], lists], ["vec_id", "label", "v", "d"])

    table = scratch.write(whole.mapInArrow(measure, "vec_id bigint, label int, v array<bigint>, d array<double>"), "pivots")

    def assigned(b: pa.RecordBatch, now: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        x, d = pivots.matrix(b["v"], length), pivots.matrix(b["d"], parts * count)
        for p in range(parts):
            own = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
            codes, far, _ = pivots.nearest(own, d[:, p * count : (p + 1) * count], now[p], fixed[p])
            yield p, codes, own, far

    for _ in range(rounds if len(first) else 0):
        now = books

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            yield pivots.sums_batch(*pivots.summed(((p, c, x) for b in batches for p, c, x, _ in assigned(b, now)), parts, now.shape[1], width))

        books = pivots.moved(table.select("v", "d").mapInArrow(sums, pivots.SUMS_SCHEMA), books)
    last = books

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(assigned(b, last))
            codes = np.stack([c for _, c, _, _ in found], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * parts), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], lists, pa.array(sum(f for _, _, _, f in found))], ["vec_id", "label", "codes", "error"])

    codes = scratch.write(table.mapInArrow(encode, "vec_id bigint, label int, codes array<int>, error bigint"), "codes")
    return Compressed(codes, books)


def digest_columns(done: Compressed) -> DataFrame:
    """vec_id, the code in hex, its error, the error of its label and the digest of all codebooks."""
    scratch = Scratch(done.codes.sparkSession, "codes")
    largest = F.lit(2**63 - 1).cast("decimal(38,0)")
    labels = scratch.write(done.codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), largest).cast("long").alias("label_error")), "labels")
    rows = done.codes.withColumn("code", F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), "")))
    out = looked_up(rows, labels, "label", spread=F.col("vec_id"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(done.digest()).alias("codebooks_sha256"))
