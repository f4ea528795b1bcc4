"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage is encoded from counts of its byte classes, of pairs of
adjacent byte classes and of word properties (language-independent); a gated attention

    h = tanh(W x + b),  a = softmax over the document's passages of  w . (tanh(V h) * sigmoid(U h))

weighs the passages, and the document's score is sigmoid(c . sum(a h) + d).  Only documents carry labels: which
passages decide is learned.  The bounded labelled sample is encoded on the executors; the small network (a few thousand numbers, broadcast)
is fitted in one task by Adam with gradients written out by hand.  Scoring encodes every passage of every whole text.

Cases: a null or empty text is one empty passage; with no labelled row every score is 0; with one class only the score is
its smoothed rate; repeated and null-id rows are scored like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import crc_rest
from .text import LOWER, RangeHash, chunks, lists, words
from .training import FOLDS, HELD_OUT, sampled_documents

PASSAGE_WORDS = 64
SAMPLE_ROWS = 6_000
HIDDEN, GATE = 16, 8
CUT = 0.7

#: byte classes: 0 other control, 1 separator, 2 lower, 3 upper, 4 digit, 5 sentence mark, 6 bracket or quote, 7 other sign, 8 non-ASCII
_CLASS = np.zeros(256, np.int64)
_CLASS[[32, 9, 10, 11, 12, 13]] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 2, 3, 4
_CLASS[[33, 44, 45, 46, 58, 59, 63]] = 5
_CLASS[[34, 39, 40, 41, 91, 93, 96, 123, 125]] = 6
_CLASS[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 124, 126]] = 7
_CLASS[128:] = 8
CLASSES = 9
INPUTS = CLASSES + CLASSES * CLASSES + 8


def encode(data: np.ndarray, offsets: np.ndarray, width: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Passages of all rows: (passages x INPUTS floats, first passage of each row + total); at least one per row."""
    starts, ends, first = words(data, offsets)
    counts = np.diff(first)
    per = np.maximum(1, -(-counts // width))
    at = np.concatenate(([0], np.cumsum(per)))
    n = int(at[-1])
    row = np.repeat(np.arange(len(counts)), counts)
    passage = at[row] + (np.arange(len(row)) - first[row]) // width
    # bytes belong to the passage of the last word begun; leading separators to the row's first passage
    byte_at = np.repeat(at[:-1], np.diff(offsets))
    if len(starts):
        seen = np.zeros(len(data), np.int64)
        seen[starts] = 1
        last = np.cumsum(seen) - 1
        byte_row = np.repeat(np.arange(len(counts)), np.diff(offsets))
        ok = (last >= 0) & (last >= first[byte_row])
        byte_at[ok] = passage[last[ok]]
    kind = _CLASS[data]
    size = np.maximum(np.bincount(byte_at, minlength=n), 1)[:, None]
    single = np.bincount(byte_at * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES) / size
    inner = byte_at[1:] == byte_at[:-1]
    pair = np.bincount((byte_at[1:] * CLASSES * CLASSES + kind[:-1] * CLASSES + kind[1:])[inner], minlength=n * CLASSES**2).reshape(n, CLASSES**2) / size
    length = (ends - starts).astype(float)
    total = np.maximum(np.bincount(passage, minlength=n), 1).astype(float)
    mean = lambda v: np.bincount(passage, v, n) / total
    hashed = RangeHash(LOWER[data])(starts, ends)
    again = np.zeros(len(starts))
    if len(starts) > 1:
        again[1:] = (hashed[1:] == hashed[:-1]) & (row[1:] == row[:-1])
    distinct = np.zeros(n)
    if len(starts):
        order = np.lexsort((hashed, passage))
        h, p = hashed[order], passage[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (p[1:] != p[:-1])))
        distinct = np.bincount(p[new], minlength=n) / total
    signs = np.concatenate(([0], np.cumsum((kind == 7) | (kind == 6))))
    marked = (signs[ends] - signs[starts] > 0).astype(float)
    alone = ((signs[ends] - signs[starts]) == (ends - starts)).astype(float)
    extra = np.stack(
        [mean(length) / 8, np.sqrt(np.maximum(mean(length**2) - mean(length) ** 2, 0)) / 8, mean(again), distinct, mean(marked), mean(alone),
         mean((length <= 3).astype(float)), np.log1p(total) / np.log1p(width)], axis=1)
    return np.concatenate((single, pair, extra), axis=1).astype(np.float32), at


class Network(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    W: np.ndarray
    b: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    d: np.ndarray


def forward(net: Network, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Document logits and what the gradient needs; ``first``: first passage of each document + total."""
    z = (x - net.mean) * net.scale
    h = np.tanh(z @ net.W + net.b)
    t, s = np.tanh(h @ net.V), 1 / (1 + np.exp(-(h @ net.U)))
    e = (t * s) @ net.w
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[doc])
    a = e / np.add.reduceat(e, first[:-1])[doc]
    bag = np.add.reduceat(a[:, None] * h, first[:-1])
    return bag @ net.c + net.d[0], (z, h, t, s, a, bag, doc)


def gradient(net: Network, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float) -> tuple[float, list[np.ndarray]]:
    """Weighted mean logistic loss (+ decay/2 |.|^2) and its gradient in W, b, V, U, w, c, d."""
    logit, (z, h, t, s, a, bag, doc) = forward(net, x, first)
    loss = float(np.mean(weight * (np.logaddexp(0, logit) - y * logit)))
    g = weight * (1 / (1 + np.exp(-logit)) - y) / len(y)
    dc, dd = bag.T @ g, np.array([g.sum()])
    dbag = g[:, None] * net.c
    da = (dbag[doc] * h).sum(1)
    dh = a[:, None] * dbag[doc]
    de = a * (da - np.add.reduceat(a * da, first[:-1])[doc])
    dw = (t * s).T @ de
    dts = de[:, None] * net.w
    dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
    dV, dU = h.T @ dt, h.T @ ds
    dh += dt @ net.V.T + ds @ net.U.T
    dpre = dh * (1 - h * h)
    grads = [z.T @ dpre, dpre.sum(0), dV, dU, dw, dc, dd]
    for k, p in enumerate((net.W, net.b, net.V, net.U, net.w, net.c)):
        loss += decay / 2 * float((p * p).sum())
        grads[k] = grads[k] + decay * p
    return loss, grads


def start(inputs: int, mean: np.ndarray, scale: np.ndarray, seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    make = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    return Network(mean, scale, make(inputs, HIDDEN), np.zeros(HIDDEN), make(HIDDEN, GATE), make(HIDDEN, GATE), make(GATE), make(HIDDEN), np.zeros(1))


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Network | float:
    """The fitted network, or the score of every document where there is nothing to tell apart."""
    n = len(y)
    if n == 0:
        return 0.0
    if y.min() == y.max():
        return float((y.sum() + 0.5) / (n + 1))
    net = start(x.shape[1], x.mean(0), 1 / np.maximum(x.std(0), 1e-3), seed)
    weight = np.ones(n)
    params = [p.copy() for p in net[2:]]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rng, step = np.random.default_rng(seed + 1), 0
    sizes = np.diff(first)
    steps = max(epochs * -(-n // batch), 600)
    while step < steps:
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            pick = np.sort(order[lo : lo + batch])
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in pick])
            _, grads = gradient(net, x[rows], np.concatenate(([0], np.cumsum(sizes[pick]))), y[pick], weight[pick], decay)
            step += 1
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                params[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            net = Network(net.mean, net.scale, *params)
            if step >= steps:
                break
    return net


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in chunks(batch.column(1)):
            x, at = encode(data, offs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), lists(x.reshape(-1), at * INPUTS, pa.float32())],
                names=["doc_id", "label", "x"],
            )


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All training rows (one task) -> one row: the network's numbers, or the one score there is."""
    rows = []
    for batch in batches:
        col = batch.column(2)
        at, flat = col.offsets.to_numpy(), col.values.to_numpy()
        rows += [(i, at[k + 1] - at[k], y, flat[at[k] : at[k + 1]].reshape(-1, INPUTS)) for k, (i, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))]
    rows.sort(key=lambda r: r[:3])  # an order that does not depend on how the rows arrived
    net: Network | float = 0.0
    if rows:
        net = fit(np.concatenate([r[3] for r in rows]), np.concatenate(([0], np.cumsum([len(r[3]) for r in rows]))), np.array([float(r[2]) for r in rows]))
    one = isinstance(net, float)
    parts = [] if one else [np.asarray(p, float).reshape(-1).tolist() for p in net]
    yield pa.RecordBatch.from_arrays([pa.array([parts], pa.list_(pa.list_(pa.float64()))), pa.array([net if one else None], pa.float64())], names=["parts", "score"])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network | float:
    """Fit on the bounded labelled sample (its encoded passages meet in one task, whose network comes to the driver)."""
    made = sampled_documents(docs, labels, "quality", rows).mapInArrow(_encoded, "doc_id long, label int, x array<float>")
    r = made.repartition(1).mapInArrow(_fitted, "parts array<array<double>>, score double").first()
    if r is None or r["score"] is not None:
        return 0.0 if r is None else r["score"]
    shapes = [(INPUTS,), (INPUTS,), (INPUTS, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), (1,)]
    return Network(*(np.array(p).reshape(s) for p, s in zip(r["parts"], shapes, strict=True)))


def _scores(batches: Iterator[pa.RecordBatch], net: Network | float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in chunks(batch.column(1)):
            if isinstance(net, float):
                out = np.full(hi - lo, net)
            else:
                x, at = encode(data, offs)
                out = 1 / (1 + np.exp(-np.clip(forward(net, x, at)[0], -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out)], names=["doc_id", "score"])


def quality(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """documents, labels -> doc_id, held_out, score, predicted (1 if score >= cut), one row per document."""
    net = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _scores(it, net.value), "doc_id long, score double")
    return scored.select(
        "doc_id", (crc_rest(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )
