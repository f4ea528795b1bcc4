"""Benchmark decontamination: spaced-seed hashing.

A seed is a fixed mask over consecutive words: the hash of the words at the mask's marked positions, so a substituted
word at an unmarked one leaves it unchanged.  ``MASKS`` were chosen by enumeration so that whatever words of a stretch differ,
as long as the stretch passes the verification, some mask at some offset marks none of them: ``MASKS`` for stretches of
``WINDOW`` words, ``SHORT_MASKS`` (by the item's length) for items shorter than that.

1. The benchmark's seeds become a table (hash, item, position) and a bitmap of fixed size (``FILTER_BITS`` bits
   whatever the benchmark holds, two of them set per seed), built by Spark's bitmap aggregates.
2. Each document's seeds, of the masks that the benchmark's items use, are tested against the bitmap (broadcast: its size is
   fixed); only those that pass leave the task, with the hashes of the words around them, hits that lie close together in
   one row with one stretch of words.
3. Passing seeds meet the benchmark's in an equi-join on the hash, which removes the bitmap's false positives.
4. Around every hit the document's and the item's words are laid side by side on the hit's diagonal, and the
   longest aligned stretch in which every ``WINDOW`` consecutive words agree in at least ``AGREE`` is measured.  A
   stretch of at least ``WINDOW`` words (or the whole item, if shorter) is a verified overlap.

Items of fewer than eight words hold no seed and are not searched for.  Null and empty texts have no seeds; a null
doc_id is reported as null; equal items are reported each; repeated rows are reported once per (doc_id, item_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, with_row_numbers
from .text import chunks, lists, mix64, word_hashes

#: fixed seed masks; 1 marks a word that is hashed.  Any 3 words of 13 may differ.
MASKS = (
    "11101111", "1111010011", "1101001111", "11100101011", "11111011", "110100011011", "11001100111", "110110010101", "101101111", "111000101011", "101111000101",
)
#: masks for items of fewer words than the window, of which 1 (8 words) or 2 (9 to 12 words) may differ
SHORT_MASKS = {
    8: ("1011111", "11110101", "11101011"),
    9: ("1110111", "111111", "11011011", "110101011", "111000111", "101101101", "101110011", "111100101", "1011111", "110011101"),
    10: ("1110111", "11011011", "1101001011", "111111", "111000111"),
    11: ("1110111", "111001011", "1001011101", "11001100101"),
    12: ("11101011", "1001001111", "100101100011"),
}
ALL_MASKS = tuple(dict.fromkeys((*MASKS, *(m for masks in SHORT_MASKS.values() for m in masks))))
#: bits of the prefilter: 2^27 bits (16 MB) however large the benchmark
FILTER_BITS = 27
#: words kept on either side of a hit
AROUND = 64
WINDOW, AGREE = 13, 10


def seeds(hashes: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start word) of the seed at every start whose span stays in its row; ``first`` = row borders."""
    span = len(mask)
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    at = np.flatnonzero(left >= span)
    out = np.full(n, len(mask) * 131 + int(mask, 2), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            out ^= hashes[j : j + n]
            out *= np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
    return mix64(out[at]), at


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text) -> (item_id, seed hash, position, mask): the masks for the item's length."""
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offs in chunks(batch.column(1)):
            hashes, first = word_hashes(data, offs)
            size = np.diff(first)
            for k, mask in enumerate(ALL_MASKS):
                lengths = [n for n, masks in (*SHORT_MASKS.items(), (WINDOW, MASKS)) if mask in masks]
                value, at = seeds(hashes, first, mask)
                row = np.searchsorted(first, at, "right") - 1
                mine = np.isin(np.minimum(size, WINDOW)[row], lengths)
                value, at, row = value[mine], at[mine], row[mine]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).take(pa.array(row)), pa.array(value.view(np.int64)), pa.array(at - first[row]), pa.array(np.full(len(at), k, np.int32))],
                    names=["item_id", "seed", "item_at", "mask"],
                )


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in chunks(batch.column(1)):
            hashes, first = word_hashes(data, offs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), lists(hashes.view(np.int64), first, pa.int64())], names=["item_id", "item_words"]
            )


def seed_filter(item_seeds: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Packed bitmap of the places given by the seeds' low ``bits`` bits and the ``bits`` above: at most 2^(bits - 15) blocks of 4 KB come to the driver."""
    low = (1 << bits) - 1
    places = F.expr(f"explode(array(seed & {low}, shiftrightunsigned(seed, {bits}) & {low}))")
    blocks = item_seeds.select(places.alias("p")).groupBy(F.expr("p div 32768").alias("block")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in blocks.toLocalIterator():
        out[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


_HITS = "doc_id long, words_at long, words array<long>, seeds array<long>, places array<long>"


def _may_hold(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 != 0


def _document_hits(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, bits: int, masks: list[str]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> stretches of words with the seeds in them that pass the bitmap."""
    low = np.uint64((1 << bits) - 1)
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offs in chunks(batch.column(1)):
            hashes, first = word_hashes(data, offs)
            found, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for mask in masks:
                value, at = seeds(hashes, first, mask)
                ok = np.flatnonzero(_may_hold(bitmap, value & low))
                ok = ok[_may_hold(bitmap, value[ok] >> np.uint64(bits) & low)]
                found.append(value[ok])
                places.append(at[ok])
            at = np.concatenate(places)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, value = at[order], np.concatenate(found)[order]
            row = np.searchsorted(first, at, "right") - 1
            # a stretch: hits of one row less than AROUND words apart
            heads = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (np.diff(at) >= AROUND))))
            hits = np.append(heads, len(at))
            own = row[heads]
            begin = np.maximum(first[own], at[heads] - AROUND)
            size = np.minimum(first[own + 1], at[hits[1:] - 1] + AROUND) - begin
            borders = np.concatenate(([0], np.cumsum(size)))
            take = np.arange(borders[-1]) + np.repeat(begin - borders[:-1], size)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo).take(pa.array(own)), pa.array(begin - first[own]), lists(hashes[take].view(np.int64), borders, pa.int64()),
                 lists(value.view(np.int64), hits, pa.int64()), lists(at - first[row], hits, pa.int64())],
                names=["doc_id", "words_at", "words", "seeds", "places"],
            )


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, window: int = WINDOW, agree: int = AGREE) -> tuple[int, int, int]:
    """(start in doc, aligned length, agreeing words) of the longest stretch on one diagonal, length 0 if none.

    ``doc[i]`` faces ``item[i - diagonal]``.  Every run of ``window`` words in the stretch agrees in at least ``agree``
    (an item shorter than the window: in the same share of it), and the stretch begins and ends on an agreeing word.
    """
    lo, hi = max(0, diagonal), min(len(doc), diagonal + len(item))
    if hi <= lo:
        return 0, 0, 0
    same = doc[lo:hi] == item[lo - diagonal : hi - diagonal]
    w = min(window, len(item))
    if len(same) < w:
        return 0, 0, 0
    need = -(-agree * w // window)
    total = np.concatenate(([0], np.cumsum(same)))
    good = total[w:] - total[:-w] >= need
    if not good.any():
        return 0, 0, 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], good.astype(np.int8), [0]))))
    best = (0, 0, 0)
    for a, b in zip(edge[::2], edge[1::2] - 1 + w, strict=True):
        on = np.flatnonzero(same[a:b])
        length = int(on[-1] - on[0] + 1)
        if length > best[1]:
            best = (int(lo + a + on[0]), length, len(on))
    return best


_FOUND = "doc_id long, item_id long, doc_word long, n_aligned long, n_agreeing long, n_item_words long"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {n: batch.column(n) for n in ("doc_id", "item_id", "doc_at", "item_at", "words_at", "words", "item_words")}
        out: list[tuple] = []
        for i in range(len(batch)):
            doc = cols["words"][i].values.to_numpy()
            item = cols["item_words"][i].values.to_numpy()
            base = cols["words_at"][i].as_py()
            start, length, agreeing = overlap(doc, item, cols["doc_at"][i].as_py() - base - cols["item_at"][i].as_py())
            if length:
                out.append((cols["doc_id"][i].as_py(), cols["item_id"][i].as_py(), base + start, length, agreeing, len(item)))
        cols_out = list(zip(*out, strict=True)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols_out], names=[f.split()[0] for f in _FOUND.split(", ")])


def contaminated(docs: DataFrame, benchmark: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """documents, benchmark (item_id, text) -> one row per (doc_id, item_id) with a verified overlap.

    doc_word is the overlap's first word in the document, n_aligned its length, n_agreeing its equal words,
    n_item_words the item's length and coverage = n_agreeing / n_item_words; of several overlaps the longest.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    item_seeds = scratch.write(items.mapInArrow(_item_seeds, "item_id long, seed long, item_at long, mask int"), "seeds")
    # at most one row per mask
    masks = [ALL_MASKS[r["mask"]] for r in item_seeds.select("mask").distinct().orderBy("mask").collect()]
    item_words = items.mapInArrow(_item_words, "item_id long, item_words array<long>")
    bitmap = spark.sparkContext.broadcast(seed_filter(item_seeds, bits))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hits = scratch.write(texts.mapInArrow(lambda it: _document_hits(it, bitmap.value, bits, masks), _HITS), "hits")
    # a doc_id may come with several texts: a stretch is told apart by its words too
    stretch = F.xxhash64("words").alias("stretch")
    # one row per document, stretch, item and diagonal
    lines = (
        hits.select("doc_id", "words_at", stretch, F.explode(F.arrays_zip(F.col("seeds").alias("seed"), F.col("places").alias("doc_at"))).alias("h"))
        .select("doc_id", "words_at", "stretch", "h.seed", "h.doc_at").join(item_seeds, "seed")
        .groupBy("doc_id", "words_at", "stretch", "item_id", (F.col("doc_at") - F.col("item_at")).alias("diagonal"))
        .agg(F.min("doc_at").alias("doc_at"), F.min("item_at").alias("item_at"))
    )
    stretches = hits.select("doc_id", "words_at", stretch, "words").dropDuplicates(["doc_id", "words_at", "stretch"])
    same = lines["doc_id"].eqNullSafe(stretches["doc_id"]) & (lines["words_at"] == stretches["words_at"]) & (lines["stretch"] == stretches["stretch"])
    met = lines.join(stretches, same).select(lines["doc_id"], "item_id", "doc_at", "item_at", lines["words_at"], "words").join(item_words, "item_id")
    found = met.mapInArrow(_verify, _FOUND)
    best = F.max(F.struct("n_aligned", "n_agreeing", (-F.col("doc_word")).alias("first"), "n_item_words"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", (-F.col("b.first")).alias("doc_word"), "b.n_aligned", "b.n_agreeing", "b.n_item_words",
        (F.col("b.n_agreeing") / F.col("b.n_item_words")).alias("coverage"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a verified overlap, all columns as given; every row is judged by its own text, whatever its doc_id."""
    rows, number = with_row_numbers(docs, Scratch(docs.sparkSession, "decontaminate"))
    hit = contaminated(rows.select(F.col(number).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_hit")).distinct()
    return rows.join(hit, F.col(number) == F.col("_hit"), "left_anti").select(*(F.col(c) for c in docs.columns))
