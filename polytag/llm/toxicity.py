"""Toxicity: a sparse logistic classifier with a counterfactual penalty.

A text is the set of its words, their five-byte beginnings (so unseen endings of a known stem count) and its word pairs,
hashed to ``SLOTS`` weights.  Training minimises the logistic loss of the labelled sample, an L1 term that keeps few
weights, and the counterfactual term: in every labelled sentence that names a group, the name is swapped for each other
name of its set, and the squared change of the sentence's score is penalised.  A name that merely
occurs more often in toxic rows then earns no weight of its own; words that are toxic whoever they are said of keep theirs.

Cases: a null or empty text has no features and scores the base rate; with no labelled row every score is 0; repeated and
null-id rows are scored like any other (held_out is null for a null id).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import crc_rest
from .text import LOWER, RangeHash, chunks, lists, mix64, runs
from .training import FOLDS, HELD_OUT, SAMPLE_ROWS, sampled_documents

SLOTS = 1 << 20
STEM_BYTES = 5
CUT = 0.3

#: fixed values: sets of group names that may stand for one another, lower case
IDENTITY_SETS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("disabled", "deaf", "blind", "old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "flüchtlinge", "einwanderer"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "réfugiés", "étrangers"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "refugiados", "extranjeros"),
)

#: bytes of a word: letters, digits, apostrophe, underscore, and every byte of a non-ASCII character
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39, 95, *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all rows, repeats kept: (slots, row of each)."""
    starts, ends, first = runs(_IN_WORD[data], offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hashed = RangeHash(LOWER[data])
    word = hashed(starts, ends)
    long_ = ends - starts > STEM_BYTES
    stem = mix64(hashed(starts[long_], starts[long_] + STEM_BYTES) ^ np.uint64(1))
    pair = np.zeros(0, np.uint64)
    inner = np.zeros(0, bool)
    if len(word) > 1:
        inner = row[1:] == row[:-1]
        pair = mix64(word[:-1][inner] * np.uint64(3) + word[1:][inner])
    ids = np.concatenate((word, stem, pair)) & np.uint64(slots - 1)
    return ids.astype(np.int64), np.concatenate((row, row[long_], row[1:][inner] if len(word) > 1 else row[:0]))


def distinct_features(data: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature slots of every row: (slots, row offsets)."""
    ids, row = features(data, offsets, slots)
    both = np.unique(row * slots + ids)
    return both % slots, np.searchsorted(both // slots, np.arange(len(offsets)))


_SENTENCE = re.compile(r"[^.!?\n]+")


def counterfactuals(text: str, sets: tuple[tuple[str, ...], ...]) -> list[tuple[str, str]]:
    """(sentence, sentence with one group name swapped), for every name in the text and every other name of its set."""
    other = {w: [x for x in s if x != w] for s in sets for w in s}
    low = text.lower()
    if not any(w in low for w in other):
        return []
    out = []
    for m in _SENTENCE.finditer(low):
        s = m[0]
        for w in re.finditer(r"\w+", s):
            out += [(s, s[: w.start()] + x + s[w.end() :]) for x in other.get(w[0], ())]
    return out


def _training_rows(batches: Iterator[pa.RecordBatch], sets: tuple[tuple[str, ...], ...]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, label) -> (doc_id, label, features) and, for each swap, (doc_id, null, added then -removed slots)."""
    for batch in batches:
        for lo, hi, data, offs in chunks(batch.column(1)):
            ids, first = distinct_features(data, offs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), lists(ids.astype(np.int32), first, pa.int32())],
                names=["doc_id", "label", "features"],
            )
        swaps: dict[tuple[int, ...], int] = {}
        for text in batch.column(1).to_pylist():
            for a, b in counterfactuals(text or "", sets):
                _, _, d, o = next(chunks(pa.array([a + "\n" + b])))
                o = np.array([0, len(a.encode()), len(d)])
                f, at = distinct_features(d, o)
                was, now = f[: at[1]], f[at[1] :]
                delta = (*np.setdiff1d(now, was).tolist(), *(-1 - np.setdiff1d(was, now)).tolist())
                swaps[delta] = swaps.get(delta, 0) + 1
        flat = [k for k, n in swaps.items() for _ in range(n)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([None] * len(flat), pa.int64()), pa.array([None] * len(flat), pa.int32()), pa.array(flat, pa.list_(pa.int32()))],
            names=["doc_id", "label", "features"],
        )


def fit(
    rows: list[np.ndarray], y: np.ndarray, swaps: list[np.ndarray], l1: float = 4e-4, l2: float = 1e-4,
    counterfactual: float = 1.0, least_rows: int = 5, steps: int = 300, slots: int = SLOTS,
) -> tuple[np.ndarray, float]:
    """(weights, bias) minimising mean logistic loss + l1 |w| + l2/2 |w|^2 + counterfactual/2 mean (w . swap)^2.

    Accelerated proximal gradient from zero; features in fewer than ``least_rows`` rows keep weight 0.  The
    result depends on the rows' order only through rounding.
    """
    w_all = np.zeros(slots, np.float32)
    n = len(rows)
    if n == 0:
        return w_all, -np.inf
    rate = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(rate / (1 - rate)))
    col = np.concatenate(rows).astype(np.int32)
    used = np.flatnonzero(np.bincount(col, minlength=slots) >= least_rows)
    place = np.full(slots, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    if y.min() == y.max() or len(used) == 0:
        return w_all, bias
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    col = place[col]
    keep = col >= 0
    col, owner = col[keep], owner[keep]
    signed = np.concatenate(swaps).astype(np.int64) if swaps else np.zeros(0, np.int64)
    s_owner = np.repeat(np.arange(len(swaps)), [len(s) for s in swaps]) if swaps else np.zeros(0, np.int64)
    sign = np.where(signed < 0, -1.0, 1.0)
    s_col = place[np.where(signed < 0, -1 - signed, signed)]
    s_keep = s_col >= 0
    s_col, s_owner, sign = s_col[s_keep], s_owner[s_keep], sign[s_keep]
    m, d = len(swaps), len(used)
    # common features move the score of nearly all rows: centre them by scaling the step of each by its frequency
    share = np.bincount(col, minlength=d) / n
    scale = 1.0 / np.sqrt(np.maximum(share, 1e-12))
    scale = np.minimum(scale, 12.0)

    def scores(v: np.ndarray) -> np.ndarray:
        return np.bincount(owner, (v * scale)[col], n)

    def gradient(v: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        r = (1 / (1 + np.exp(-np.clip(scores(v) + b, -30, 30))) - y) / n
        g = np.bincount(col, r[owner], d) * scale + l2 * v
        if m:
            change = np.bincount(s_owner, sign * (v * scale)[s_col], m)
            g += counterfactual / m * np.bincount(s_col, sign * change[s_owner], d) * scale
        return g, float(r.sum())

    v, b = np.zeros(d), bias
    prev, prev_b, step = v, b, 1.0
    # largest curvature by a few power iterations
    x = np.ones(d) / np.sqrt(d)
    for _ in range(12):
        z = np.bincount(col, scores(x)[owner], d) * scale / (4 * n)
        if m:
            z += counterfactual / m * np.bincount(s_col, sign * np.bincount(s_owner, sign * (x * scale)[s_col], m)[s_owner], d) * scale
        top = float(np.linalg.norm(z))
        x = z / max(top, 1e-12)
    rate_ = 1.0 / (1.2 * top + l2 + 0.25)
    t = 1.0
    for _ in range(steps):
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        mom = (t - 1) / t2
        look, look_b = v + mom * (v - prev), b + mom * (b - prev_b)
        g, gb = gradient(look, look_b)
        prev, prev_b = v, b
        v = look - rate_ * g
        v = np.sign(v) * np.maximum(np.abs(v) - rate_ * l1 * scale, 0)
        b = look_b - step * gb
        t = t2
    w_all[used] = v * scale
    return w_all, float(b)


def _fitted(batches: Iterator[pa.RecordBatch], settings: dict[str, float]) -> Iterator[pa.RecordBatch]:
    """All training rows (one task) -> one row: the weights that are not 0, and the bias."""
    label, doc_id, parts = [], [], []
    for batch in batches:
        label.append(batch.column(1).to_numpy(zero_copy_only=False).astype(float))
        doc_id.append(batch.column(0).to_numpy(zero_copy_only=False).astype(float))
        col = batch.column(2)
        at, values = col.offsets.to_numpy(), col.values.to_numpy()
        parts += [values[at[i] : at[i + 1]] for i in range(len(col))]
    y = np.concatenate(label) if label else np.zeros(0)
    ids = np.concatenate(doc_id) if doc_id else np.zeros(0)
    # an order that does not depend on how the rows arrived
    known = sorted(np.flatnonzero(~np.isnan(y)).tolist(), key=lambda i: (ids[i], len(parts[i]), y[i]))
    swaps = sorted((parts[i] for i in np.flatnonzero(np.isnan(y))), key=lambda a: a.tolist())
    weights, bias = fit([parts[i] for i in known], y[known], swaps, **settings)
    used = np.flatnonzero(weights)
    yield pa.RecordBatch.from_arrays(
        [pa.array([used.astype(np.int32).tolist()], pa.list_(pa.int32())), pa.array([weights[used].tolist()], pa.list_(pa.float32())), pa.array([bias])],
        names=["slot", "weight", "bias"],
    )


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, sets: tuple[tuple[str, ...], ...] = IDENTITY_SETS, **settings: float) -> tuple[np.ndarray, float]:
    """Fit on the bounded labelled sample: the features of at most ``rows`` documents meet in one task, whose weights come to the driver."""
    made = sampled_documents(docs, labels, "toxic", rows).mapInArrow(lambda it: _training_rows(it, sets), "doc_id long, label int, features array<int>")
    r = made.repartition(1).mapInArrow(lambda it: _fitted(it, settings), "slot array<int>, weight array<float>, bias double").first()
    weights = np.zeros(SLOTS, np.float32)
    if r is None:
        return weights, -np.inf
    weights[r["slot"]] = r["weight"]
    return weights, r["bias"]


def _scores(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in chunks(batch.column(1)):
            ids, row = features(data, offs)
            told = weights[ids] != 0
            both = np.unique(row[told] * SLOTS + ids[told])
            total = np.bincount(both // SLOTS, weights[both % SLOTS], hi - lo) + bias
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-total)))], names=["doc_id", "score"]
                )


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, score of every row.  The weights are ``SLOTS`` floats whatever the data, so they are broadcast."""
    held = docs.sparkSession.sparkContext.broadcast((weights, bias))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _scores(it, *held.value), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = CUT, **settings: float) -> DataFrame:
    """documents, labels -> doc_id, held_out, score, predicted (1 if score >= cut), one row per document."""
    weights, bias = train(docs, labels, **settings)
    return score(docs, weights, bias).select(
        "doc_id", (crc_rest(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents that score below ``cut``, all columns as given."""
    weights, bias = train(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast((weights, bias))
    place = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slim = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column(place)], names=["doc_id", "text"])
            found = [b.column(1).to_numpy() for b in _scores(iter([slim]), *held.value)]
            yield batch.filter(pa.array(np.concatenate(found) < cut)) if found else batch

    return docs.mapInArrow(clean, docs.schema)
