"""Centroid clustering of integer vectors with a pivot table.

Vectors become integers; the first centroids are those with the smallest hash of their id.  The distances of every vector to ``PIVOTS``
fixed first centroids (spread out, farthest first) are computed once and written beside it.  Each of ``ROUNDS`` rounds finds the
nearest centroid of every vector with ``pivots.nearest`` (bounds from the pivot distances, exact integer distances for the centroids that
survive) and replaces every centroid with members by the floor of their mean.  Per task one row per centroid leaves; the driver holds
the centroids only.  Rounds read the written table.

Cases: vectors that are null, of another length than ``dims``, or with null, NaN or infinite components are dropped; components beyond +-2^27 after scaling are
held there; a repeated id is a vector for each of its rows (equal ids rank by their components); null ids are never first centroids unless others
lack; fewer vectors than centroids give fewer centroids; an empty table gives an empty result.
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
from .store import Scratch

DIMS, CLUSTERS, ROUNDS, SCALE, PIVOTS, SEED = 64, 16, 3, 64, 8, 1


@dataclass
class Clustered:
    """``members``: vec_id, cluster, squared distance (a written table); ``centroids``: (clusters, dims) integers."""

    members: DataFrame
    centroids: np.ndarray


def cluster(vectors: DataFrame, dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, n_pivots: int = PIVOTS, seed: int = SEED) -> Clustered:
    """vectors (vec_id, embedding) -> their clusters and the final centroids."""
    scratch = Scratch(vectors.sparkSession, "centroids")
    fit = pivots.usable(F.col("embedding")) & (F.size("embedding") == dims)
    whole = vectors.filter(fit).select(F.col("vec_id").cast("long").alias("vec_id"), pivots.integers(F.col("embedding"), scale).alias("v"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = [r["v"] for r in whole.orderBy(drawn.asc_nulls_last(), "v").limit(clusters).select("v").collect()]
    centroids = np.array(first, np.int64).reshape(len(first), dims)
    fixed = pivots.farthest(centroids, n_pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = pivots.distances(pivots.matrix(b["v"], dims), fixed)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], lists], ["vec_id", "v", "d"])

    table = scratch.write(whole.mapInArrow(measure, "vec_id bigint, v array<bigint>, d array<double>"), "pivots")

    def assigned(b: pa.RecordBatch, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = pivots.matrix(b["v"], dims)
        found, far, _ = pivots.nearest(x, pivots.matrix(b["d"], len(fixed)), now, fixed)
        return found, x, far

    for _ in range(rounds if len(first) else 0):
        now = centroids

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            parts = (assigned(b, now) for b in batches)
            yield pivots.sums_batch(*pivots.summed(((0, found, x) for found, x, _ in parts), 1, len(now), dims))

        centroids = pivots.moved(table.select("v", "d").mapInArrow(sums, pivots.SUMS_SCHEMA), centroids[None])[0]
    last = centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, _, far = assigned(b, last)
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(found.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    members = scratch.write(table.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint"), "members")
    return Clustered(members, centroids)


def digest_columns(done: Clustered) -> DataFrame:
    """vec_id, cluster, distance, the summed distances of the cluster and of all, and the digest of the final centroid."""
    spark = done.members.sparkSession
    wide, largest = F.sum(F.col("distance").cast("decimal(38,0)")), 2**63 - 1
    sums = {r["cluster"]: int(r["s"]) for r in done.members.groupBy("cluster").agg(wide.alias("s")).collect()}
    total = min(sum(sums.values()), largest)
    digests = [hashlib.sha256(",".join(str(v) for v in c).encode()).hexdigest() for c in done.centroids.tolist()]
    rows = [(i, min(sums[i], largest), total, h) for i, h in enumerate(digests) if i in sums]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # at most one row per centroid
    return done.members.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
