"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes (two bits a byte, so the last 16 count).  Chunk borders are normalised: a chunk has at
least ``LEAST`` bytes, up to ``NORMAL`` a border needs a hash with 7 zero bits, beyond it 4 suffice, and it ends at ``MOST``.  Borders thus depend on the
bytes just before them only, and text that is shifted by an edit falls into the same chunks again.  The fingerprint is
the set of distinct chunks, each a 48-bit digest with the chunk's length, written as 16 hex digits, sorted; the
likeness of A to B is the share of A's chunk length whose chunks B has (containment).

``neighbour_fingerprints`` compares every text with an edited version of it and with its neighbour in id order.
Rows are dealt by id range, sorted there, and streamed; each range also gets a copy of the
next range's first row, so no row of another task is needed and no range is held whole.

Cases: a null text is empty; an empty text has the empty fingerprint, likeness 1 to an empty one and 0 to
any other; rows with equal ids follow each other by a hash of their text; null ids come last; a
single row is its own neighbour; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import CHUNK_BYTES, RangeHash, mix64

LEAST, NORMAL, MOST = 16, 40, 192
HARD, EASY = np.uint32(0xFE000000), np.uint32(0xF0000000)
#: rows of one id range, about, and the most ranges there are (a range is streamed, so its size is not bounded by memory)
RANGE_ROWS, MOST_RANGES = 500, 8192

_GEAR = (mix64(np.arange(256, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(7)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: sum over the last 16 bytes of code << 2 * distance, by doubling the window."""
    h = _GEAR[data]
    width = 1
    while width < 16:
        if len(h) > width:
            h[width:] += h[:-width] << np.uint32(2 * width)
        width *= 2
    return h


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all rows: (ends, first chunk of each row + total); all rows advance a chunk at a time together."""
    n = len(data)
    h = gear(data)
    at = np.arange(n + 1, dtype=np.int64)

    def following(mask: np.uint32) -> np.ndarray:
        hit = np.full(n + 1, n, np.int64)
        hit[:n] = np.where(h & mask == 0, at[:n], n)
        return np.minimum.accumulate(hit[::-1])[::-1]

    hard, easy = following(HARD), following(EASY)
    live = np.flatnonzero(offsets[1:] > offsets[:-1])
    pos = offsets[live]
    rows, ends = [], []
    while len(live):
        stop = offsets[live + 1]
        one = hard[np.minimum(pos + LEAST - 1, n)]
        two = easy[np.minimum(pos + NORMAL - 1, n)]
        end = np.where(one < pos + NORMAL - 1, one + 1, np.minimum(two + 1, pos + MOST))
        end = np.minimum(end, stop)
        rows.append(live)
        ends.append(end)
        on = end < stop
        live, pos = live[on], end[on]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    row, end = np.concatenate(rows), np.concatenate(ends)
    order = np.argsort(end, kind="stable")
    return end[order], np.searchsorted(row[order], np.arange(len(offsets)))


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct chunks of every text as digest << 16 | length."""
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends, first = cuts(data, offsets)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
    length = ends - starts
    word = (RangeHash(data)(starts, ends) << np.uint64(16)) | length.astype(np.uint64)
    return [np.unique(word[first[i] : first[i + 1]]) for i in range(len(texts))]


def written(chunks_: np.ndarray) -> str:
    return chunks_.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's length in chunks that b has too."""
    if not len(a):
        return float(not len(b))
    low = np.uint64(0xFFFF)
    return float((np.intersect1d(a, b, assume_unique=True) & low).sum() / (a & low).sum())


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pid, visitor, doc_id, text) in order -> results; a row waits for the one after it."""
    waiting: tuple | None = None
    for batch in batches:
        pids, visits, ids, texts = (batch.column(i).to_pylist() for i in range(4))
        lo = 0
        while lo < len(batch):
            hi, size = lo, 0
            while hi < len(batch) and (hi == lo or size < CHUNK_BYTES):
                size += len(texts[hi])
                hi += 1
            prints = fingerprints([t.encode() for t in texts[lo:hi]])
            line = ([waiting] if waiting else []) + [(pids[i], visits[i], ids[i], texts[i], prints[i - lo]) for i in range(lo, hi)]
            pairs = [(x, y) for x, y in zip(line, line[1:], strict=False) if x[0] == y[0] and not x[1]]
            edited = [edit(x[3], y[3]).encode() for x, y in pairs]
            out = []
            for (x, y), text, chunks_ in zip(pairs, edited, fingerprints(edited), strict=True):
                out.append((x[2], len(x[3]), hashlib.sha256(text).hexdigest(), written(x[4]), written(chunks_), likeness(x[4], chunks_), likeness(x[4], y[4])))
            waiting = line[-1]
            lo = hi
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)],
                    names=[f.split()[0] for f in _OUT.split(", ")],
                )


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """documents -> one row per row with its fingerprint, its edited text's, and the likenesses (see _OUT)."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = plain.count()
    ranges = max(1, min(rows // RANGE_ROWS, MOST_RANGES))
    edges = plain.select("doc_id").stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    bounds = np.unique(np.array(edges or [], float))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        # larger ids first; null ids after all others
        out = len(bounds) - np.searchsorted(bounds, ids.fillna(0).to_numpy(float), "left")
        return pd.Series(np.where(ids.isna(), len(bounds) + 1, out).astype(np.int32))

    keyed = plain.withColumn("pid", range_of("doc_id")).withColumn("tie", F.xxhash64("text"))
    # the first row of every range: its id (null for the last range) and tie; at most one per range
    head = keyed.groupBy("pid").agg(F.min_by(F.struct("doc_id", "tie"), F.struct((-F.col("doc_id")).alias("d"), "tie")).alias("h")).orderBy("pid").collect()
    if not head:
        return spark.createDataFrame([], _OUT)
    after = [(head[i]["pid"], h["h"]["doc_id"], h["h"]["tie"]) for i, h in enumerate(head[1:] + head[:1])]
    visitors = spark.createDataFrame(after, "to int, head_id long, head_tie long")
    visiting = plain.withColumn("tie", F.xxhash64("text")).join(
        F.broadcast(visitors), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    ).dropDuplicates(["to"])
    every = keyed.select("pid", F.lit(False).alias("visitor"), "doc_id", "text", "tie").unionAll(
        visiting.select(F.col("to").alias("pid"), F.lit(True), "doc_id", "text", "tie")
    )
    lanes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = every.repartition(lanes, "pid").sortWithinPartitions("pid", "visitor", F.col("doc_id").desc_nulls_last(), "tie")
    return dealt.select("pid", "visitor", "doc_id", "text").mapInArrow(_compare, _OUT)
