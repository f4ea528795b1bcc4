"""Language-model scoring: logistic mixing of hashed-context bit predictors, with an exact unigram baseline.

The text (A-Z lower-cased, UTF-8 bytes, then an end symbol) is coded bit by bit: every byte is a path in the Huffman tree that
belongs to the byte before it (trees from the training counts, every symbol has a path), so a byte takes about
three binary decisions.  Three predictors give the log-odds of each decision: by the byte before (exact), by the three bytes before, and
by up to six bytes of the word so far; the latter two are hash tables of context and tree node.  Their counts come from all
training documents by one aggregation, and the tables hold every (context, node) of it: they are at most half full whatever the
corpus holds (2^``SLOT_BITS`` slots or more), a slot carries 24 further bits of the hash, and a pair that finds its slot taken goes to the next.  Only
a context seen once in all predicts nothing and is left out.

The mixer is online: p = sigmoid(sum of w_k * log-odds_k), weights chosen by a gate (which predictors know the context, depth
in the tree) and moved after every bit by its error; a final map from p to an observed rate (24 buckets) is adapted the
same way and averaged in.  Every ``SEGMENT`` bytes mixer and map start again from weights and rates learned in training, so the segments of all
documents of a batch advance side by side, a long document is no long chain, and a score does not depend on the batch.

The weights to start from are those of least log loss per gate (a logistic regression, by Newton steps over counted decisions), the rates
those observed with them.  They are learned from every decision of every training document.  The predictors see these documents as new ones: texts
are in two parts (by a hash of the text, so copies are together), and the counts of a document's own part are taken off first.  A decision's facts depend on
the symbol, its contexts and the part alone, so they come from the counts, not from another pass over the texts.

Baseline: sum over tokens (words, then one end) of log10((c + 1) / (N + V + 1)).  The most frequent words' counts are
broadcast (at most ``HEAD_WORDS``); the others are looked up by a join of (text, word) pairs, equal texts once.

Cases: a null or empty text is only its end; documents with a null id are scored but not learned from (held_out is null);
repeated rows are learned from as often as they occur and score alike; with no training row every count is 0.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, crc_rest
from .text import CHUNK_BYTES, IS_SEP, LOWER, RangeHash, chunks, lists, mix64, word_hashes

FOLDS, HELD_OUT = 7, 2
END = 256
SYMBOLS = 257
#: the smallest tables; they double with the distinct (context, node) pairs
SLOT_BITS = 23
SEGMENT = 512
HEAD_WORDS = 1 << 17
HEAD_SLOTS = 1 << 20
#: entries of counts that a task holds before it passes them on
HELD_KEYS = 1_000_000
#: bytes of text whose segments advance together
TOGETHER = 3 * CHUNK_BYTES // 2
#: bytes (whole rows) or symbols that are worked on at once: the wide intermediate arrays of a step are held for so many, not for a whole chunk
BLOCK = 1 << 17

#: steps whose facts are gathered at once
STEPS = 8

_END_WORD = np.uint64(0x5EED0FE2D)
#: kinds of counts
WORDS, ORDER1, ORDER3, PREFIX = 0, 1, 2, 3
#: log-odds are kept as int8 in steps of 1 / STEP
STEP = 15.0
#: weights of a gate that training says nothing about
START_WEIGHTS = (0.15, 0.30, 0.65)
RATE = 0.015
GATES, BUCKETS = 16, 24
#: steps of log-odds from bucket to bucket, and the bounds of mixed log-odds
WIDTH, MOST = 0.7, 8.35
#: start weights are learned from one training document in so many, that is from all; the weight of ``START_WEIGHTS`` and of the plain rates in decisions
LEARN_SHARE, PRIOR = 1, 16.0
#: parts of the texts: a part's documents meet predictors that have counted the other part only
PARTS = 2
NEWTON_STEPS = 12


#: a symbol with its contexts is one number: symbol (9 bits), then the word so far if it has three bytes or more (48 bits, and its length up to 7
#: above them; the three bytes before are its lowest), else the three bytes before (24 bits, how many there are above them) and the word's length
_PART = 60  # the bit of a symbol's number, above its context, where its part is
_WORD_MASK = np.array([(1 << 8 * min(n, 6)) - 1 for n in range(8)], np.int64)
#: by the word's length: what of the bytes before is in a number, and what is set above them
_KEPT = np.array([_WORD_MASK[max(n, 3)] for n in range(8)], np.int64)
_ABOVE = np.array([3 << 24 | n << 26 if n < 3 else n << 48 for n in range(8)], np.int64)


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows lo..hi, whole rows, about ``BLOCK`` bytes each."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK, "right")) - 1)
        yield lo, hi
        lo = hi


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows with their contexts, each row followed by END: (numbers that ``contexts`` reads, new offsets)."""
    new = offsets + np.arange(len(offsets))
    key = np.empty(int(new[-1]), np.int64)
    for lo, hi in _blocks(offsets):
        key[new[lo] : new[hi]] = _coded(data[offsets[lo] : offsets[hi]], new[lo : hi + 1] - new[lo])
    return key, new


def _coded(data: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The numbers of one block of rows; new: offsets of its symbols."""
    n = int(new[-1])
    ends = new[1:] - 1
    inside = np.ones(n, bool)
    inside[ends] = False
    # eight bytes of nothing, then the bytes, each row followed by one of nothing
    low = np.zeros(n + 8, np.uint8)
    low[8:][inside] = LOWER[data]
    # bytes since the last separator or the row's start, 7 at most: the run of other bytes that ends at a byte, in steps of 1, 2 and 4 bytes
    run = np.zeros(n + 8, np.uint8)
    run[8:] = ~IS_SEP[low[8:]] & inside
    for step in (1, 2, 4):
        run[step:] += np.where(run[step:] == step, np.minimum(run[:-step], min(step, 3)), np.uint8(0))
    since = run[7:-1]
    # the eight bytes before, the last of them lowest
    bytes_before = np.ndarray((n,), ">u8", low, strides=(1,)).astype(np.int64)
    symbol = low[8:].astype(np.int64)
    symbol[ends] = END
    key = bytes_before & _KEPT.take(since)
    key |= _ABOVE.take(since)
    for place in range(3):
        first = new[:-1] + place
        first = first[first < new[1:]]
        key[first] = bytes_before[first] & ((1 << 8 * place) - 1) | place << 24 | since[first].astype(np.int64) << 26
    key <<= 9
    key |= symbol
    return key


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of all rows, block by block."""
    hashes, first = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for lo, hi in _blocks(offsets):
        own, at = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        hashes.append(own)
        first.append(first[-1][-1] + at[1:])
    return np.concatenate(hashes), np.concatenate(first)


def contexts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, byte before (END at a row's start), three bytes before, word so far) of numbers made by ``coded``."""
    symbol, context = key & 511, key >> 9
    long = context >= 3 << 48
    three = np.where(long, (context & 0xFFFFFF) | 3 << 24, context & ((1 << 26) - 1))
    before = np.where(three >> 24 == 0, END, three & 0xFF)
    since = np.where(long, 0, context >> 26)
    # at a word's start the context is the separator itself (or the text's start), so the byte before is always its lowest byte
    start = np.where(before == END, 9 << 48, (three & 0xFF) | 8 << 48)
    word = np.where(long, context, np.where(since == 0, start, (three & _WORD_MASK[since & 7]) | since << 48))
    return symbol, before, three, word


def _from_counts(kind: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which counts are of a symbol with all its contexts, each symbol once; their numbers as ``coded`` makes them).

    A word so far of three bytes or more holds the three bytes before; if it is shorter, these hold the separator (or the start) before it."""
    context = key >> 9
    # bytes since the last separator, as far as the three bytes before tell
    since = (context >> 24) & 3
    for back in (2, 1, 0):
        since = np.where(IS_SEP[(context >> 8 * back) & 0xFF] & (context >> 24 > back), back, since)
    used = np.where(kind == PREFIX, (context >= 3 << 48) & (context < 8 << 48), (kind == ORDER3) & (since < 3))
    return used, np.where(kind == PREFIX, key, key | since << 35)[used]


def _parts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The part of every row's text."""
    raw = memoryview(np.ascontiguousarray(data))
    return np.array([zlib.crc32(raw[lo:hi]) % PARTS for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers, which of them each one is): what depends on a symbol and its contexts alone is found once for a chunk."""
    found = pa.array(key).dictionary_encode()
    # else Arrow's pool keeps the hash table's memory for later
    pa.default_memory_pool().release_unused()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def _reduced(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, with their summed numbers; empties ``parts``, column by column."""
    columns = [list(c) for c in zip(*parts, strict=True)]
    parts.clear()
    key = np.concatenate(columns.pop(0))
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    out = [key[new]]
    del key
    while columns:
        n = np.concatenate(columns.pop(0))[order]
        out.append(np.add.reduceat(n, new) if len(new) else n)
    return tuple(out)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.diff(np.append(new, len(keys)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (kind, key, n, odd): words and (context, symbol) pairs, combined within the task; odd: of n those in texts of the second part (0 for words)."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {k: [] for k in (WORDS, ORDER3, PREFIX)}
    order1 = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)

    def rows(kind: int, key: np.ndarray, n: np.ndarray, odd: np.ndarray) -> pa.RecordBatch:
        columns = [np.full(len(key), kind, np.int32), key.view(np.int64), n.astype(np.int64, copy=False), odd.astype(np.int64, copy=False)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "key", "n", "odd"])

    for batch in batches:
        for lo, hi, data, offs in chunks(batch.column(0)):
            hashes, _ = _words(data, offs)
            key, new = coded(data, offs)
            key <<= 1
            key |= np.repeat(_parts(data, offs), np.diff(new))
            key, many = _counted(key)
            odd = many * (key & 1)
            symbol, before, three, word = contexts(key >> 1)
            for total, n in zip(order1, (many, odd), strict=True):
                total += np.bincount(before * SYMBOLS + symbol, n, SYMBOLS * SYMBOLS).astype(np.int64)
            words, times = _counted(np.append(hashes, np.full(hi - lo, _END_WORD)).view(np.int64))
            for kind, part in ((WORDS, (words, times, np.zeros_like(times))), (ORDER3, _reduced([((three << 9) | symbol, many, odd)])), (PREFIX, _reduced([((word << 9) | symbol, many, odd)]))):
                held[kind].append(part)
                # the first part is what was reduced before; at most half as many entries wait beside it
                if sum(len(p[0]) for p in held[kind][1:]) > HELD_KEYS // 2:
                    held[kind].append(_reduced(held[kind]))
                    if len(held[kind][0][0]) > HELD_KEYS:
                        yield rows(kind, *held[kind].pop())
    for kind, parts in held.items():
        if parts:
            yield rows(kind, *_reduced(parts))
    used = np.flatnonzero(order1[0])
    yield rows(ORDER1, used, *order1[:, used])


class Codes:
    """One Huffman tree per byte before: for (before, symbol) the nodes passed and the bits taken."""

    def __init__(self, order1: np.ndarray):
        """order1: SYMBOLS x SYMBOLS counts of (byte before, symbol)."""
        nodes, bits, starts, lengths = [], [], np.zeros(SYMBOLS * SYMBOLS, np.int64), np.zeros(SYMBOLS * SYMBOLS, np.int64)
        at = 0
        # a byte before that was never seen shares the tree of the total counts
        total = order1.sum(0)
        shared: tuple[list[list[int]], list[list[int]]] | None = None
        for b in range(SYMBOLS):
            if order1[b].any() or shared is None:
                paths = self._paths(order1[b] * 64 + total * 64 // max(1, int(total.sum())) + 1 if order1[b].any() else total + 1)
                if not order1[b].any():
                    shared = paths
            else:
                paths = shared
            for s in range(SYMBOLS):
                k = b * SYMBOLS + s
                starts[k], lengths[k] = at, len(paths[0][s])
                nodes += [b * SYMBOLS + x for x in paths[0][s]]
                bits += paths[1][s]
                at += len(paths[0][s])
        self.nodes, self.bits = np.array(nodes, np.int32), np.array(bits, np.int8)
        self.depth = np.concatenate([np.arange(n) for n in lengths]).astype(np.int8)
        self.starts, self.lengths = starts.astype(np.int32), lengths.astype(np.int32)

    @staticmethod
    def _paths(weight: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
        heap = [(int(w), s) for s, w in enumerate(weight)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        fresh = SYMBOLS
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[1]], parent[b[1]] = (fresh, 0), (fresh, 1)
            heapq.heappush(heap, (a[0] + b[0], fresh))
            fresh += 1
        nodes, bits = [], []
        for s in range(SYMBOLS):
            up, way, x = [], [], s
            while x in parent:
                x, bit = parent[x]
                up.append(x - SYMBOLS)
                way.append(bit)
            nodes.append(up[::-1])
            bits.append(way[::-1])
        return nodes, bits

    def expand(self, before: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into nodes/bits/depth of every decision, symbol number of every decision)."""
        k = before * SYMBOLS + symbol
        n = self.lengths[k]
        ends = np.cumsum(n)
        owner = np.repeat(np.arange(len(k), dtype=np.int32), n)
        return np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32) + (self.starts[k] - (ends - n).astype(np.int32))[owner], owner


def context_hash(context: np.ndarray, kind: int) -> np.ndarray:
    """64-bit hash of contexts, to be combined with a node.  Contexts as a part meets them have its number above (at bit 55)."""
    return mix64(context.view(np.uint64) * np.uint64(2) + np.uint64(kind & 1))


def pair_hash(hashed: np.ndarray, node: np.ndarray) -> np.ndarray:
    """64-bit hash of (context, node): its high bits are the slot, its low 24 bits the check."""
    h = node.astype(np.uint64)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= hashed
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Table:
    """Open addressing: a cell is 24 check bits and 8 bits of log-odds (never 0, so a cell of 0 is empty)."""

    def __init__(self, entries: int, least_bits: int):
        self.bits = max(least_bits, (2 * entries).bit_length())
        self.cells = np.zeros(1 << self.bits, np.uint32)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, pair: np.ndarray, odds: np.ndarray) -> None:
        cell = (pair.astype(np.uint32) << np.uint32(8)) | odds.view(np.uint8)
        at, last = self._slot(pair), len(self.cells) - 1
        while len(at):
            free = self.cells[at] == 0
            self.cells[at[free]] = cell[free]
            # of several that wrote to one free slot the last is there, the others go on
            left = ~(free & (self.cells[at] == cell))
            at, cell = (at[left] + 1) & last, cell[left]

    def look(self, pair: np.ndarray) -> np.ndarray:
        """Log-odds (int8), 0 where the pair is not in the table."""
        at = self._slot(pair)
        cell = self.cells[at]
        check = pair.astype(np.uint32) & np.uint32(0xFFFFFF)
        wrong = (cell >> np.uint32(8)) != check
        out = (cell & np.uint32(0xFF)).astype(np.uint8).view(np.int8)
        out[wrong] = 0
        more = np.flatnonzero(wrong & (cell != 0))
        at, last = at[more], len(self.cells) - 1
        while len(more):
            at = (at + 1) & last
            cell = self.cells[at]
            right = (cell >> np.uint32(8)) == check[more]
            out[more[right]] = (cell[right] & np.uint32(0xFF)).astype(np.uint8).view(np.int8)
            go = ~right & (cell != 0)
            more, at = more[go], at[go]
        return out


def _to_pairs(batches: Iterator[pa.RecordBatch], codes: Codes) -> Iterator[pa.RecordBatch]:
    """(kind, context, symbols, counts, odd counts) -> packed (without, kind, pairs, hashes, log-odds) of all nodes of these contexts.

    Beside the pairs of all counts there are those that each part meets (``without``): its own counts are taken off."""
    for batch in batches:
        kind, context = (batch.column(c).to_numpy() for c in (0, 1))
        offsets = batch.column(2).offsets.to_numpy()
        symbol, n, odd = (batch.column(c).flatten().to_numpy() for c in (2, 3, 4))
        owner = np.repeat(np.arange(len(kind)), np.diff(offsets))
        for part, own in ((None, np.zeros_like(n)), (0, n - odd), (1, odd)):
            left = n - own
            # a context seen once in all is unknown, and one that the part does not have is never asked for
            known = np.add.reduceat(left, offsets[:-1]) > 1
            if part is not None:
                known &= np.add.reduceat(own, offsets[:-1]) > 0
            for k in (ORDER3, PREFIX):
                mine = ((kind == k) & known)[owner]
                if not mine.any():
                    continue
                ctx = context[owner[mine]]
                # the byte before is the context's lowest byte, unless the text starts here
                before = np.where(ctx >> (24 if k == ORDER3 else 48) == (0 if k == ORDER3 else 9), END, ctx & 0xFF)
                index, at = codes.expand(before, symbol[mine])
                pair = pair_hash(context_hash(ctx | (part or 0) << 55, k)[at], codes.nodes[index])
                order = np.argsort(pair)
                pair, many, one = pair[order], left[mine][at][order], codes.bits[index][order] == 1
                new = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
                n0, n1 = np.add.reduceat(np.where(one, 0, many), new), np.add.reduceat(np.where(one, many, 0), new)
                kept = n0 + n1 > 0
                if part is not None:
                    # nor is a node that no symbol of the part passes
                    kept &= np.add.reduceat(own[mine][at][order], new) > 0
                pair, odds = pair[new][kept], _log_odds(n0[kept], n1[kept])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part is not None]), pa.array([k], pa.int32()), pa.array([len(pair)], pa.int64()), pa.array([pair.tobytes()], pa.binary()), pa.array([odds.tobytes()], pa.binary())],
                    names=["without", "kind", "pairs", "hashes", "odds"],
                )


def _log_odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    x = np.log((n1 + 0.2) / (n0 + 0.2))
    q = np.clip(np.rint(x * STEP), -127, 127)
    # a known context is never exactly 0, which means unknown
    return np.where((q == 0) & (n0 + n1 > 0), 1, q).astype(np.int8)


class Predictors:
    """Log-odds of every decision by the byte before (an array) and by the hashed contexts (tables)."""

    def __init__(self, codes: Codes, order1: np.ndarray, tables: dict[int, Table]):
        """order1: counts of (byte before, symbol), flat; of one set, or of those that each part meets, one after the other."""
        first = []
        for counts in order1.reshape(-1, SYMBOLS * SYMBOLS):
            seen = np.flatnonzero(counts)
            index, owner = codes.expand(seen // SYMBOLS, seen % SYMBOLS)
            # a node's counts are those of the symbols below it
            n = np.zeros((2, SYMBOLS * SYMBOLS))
            np.add.at(n, (codes.bits[index], codes.nodes[index]), counts[seen][owner])
            first.append(_log_odds(n[0], n[1]))
        self.first, self.tables = np.concatenate(first), tables

    def facts(self, codes: Codes, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of decisions of every symbol, their facts one after the other): a fact is three log-odds and, as its highest byte, 2 * gate + bit."""
        # a symbol has a few decisions, each with a hash of 8 bytes
        parts = [self._facts(codes, key[lo : lo + BLOCK // 4]) for lo in range(0, len(key), BLOCK // 4)]
        sizes, facts = zip(*parts, strict=True) if parts else ([np.zeros(0, np.int32)], [np.zeros(0, "<u4")])
        return np.concatenate(sizes), np.concatenate(facts)

    def _facts(self, codes: Codes, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = key >> _PART
        symbol, before, three, word = contexts(key & ((1 << _PART) - 1))
        index, owner = codes.expand(before, symbol)
        nodes = codes.nodes[index]
        out = np.empty((len(index), 4), np.uint8)
        out[:, 0] = self.first[nodes + (part * SYMBOLS * SYMBOLS)[owner]].view(np.uint8)
        gate = np.minimum(codes.depth[index], 3)
        for k, (kind, context) in enumerate(((ORDER3, three), (PREFIX, word)), 1):
            odds = self.tables[kind].look(pair_hash(context_hash(context | part << 55, kind)[owner], nodes))
            out[:, k] = odds.view(np.uint8)
            gate += np.int8(4 * k) * (odds != 0)
        out[:, 3] = 2 * gate + codes.bits[index]
        return codes.lengths[before * SYMBOLS + symbol], out.view("<u4").ravel()


class Model:
    """What a scoring task needs; its tables grow with the distinct (context, node) pairs of the corpus, at 8 to 16 bytes each."""

    def __init__(self, codes: Codes, predictors: Predictors, weights: np.ndarray, rates: np.ndarray, head_key: np.ndarray, head_n: np.ndarray, end_n: int):
        self.codes, self.predictors, self.weights, self.rates = codes, predictors, weights, rates
        self.head_key, self.head_n, self.end_n = head_key, head_n, end_n

    @property
    def tables(self) -> dict[int, Table]:
        return self.predictors.tables


def _counts(texts: DataFrame) -> DataFrame:
    """(kind, key, n, odd) of all texts.  ``_count`` has combined them within its task, so they are dealt by key first: to aggregate them before as well
    would hold a map of all the task's keys in the executor's heap and join next to none."""
    return texts.select(F.col("text").cast("string")).mapInArrow(_count, "kind int, key long, n long, odd long").repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("odd").alias("odd"))


def _order1(counts: DataFrame) -> np.ndarray:
    """Counts of (byte before, symbol): all, and those in texts of the second part."""
    out = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
    one = counts.filter(F.col("kind") == ORDER1).select("key", "n", "odd").toArrow()
    for k in range(2):
        out[k, one.column(0).to_numpy()] = one.column(1 + k).to_numpy()
    return out


def _tables(packed: DataFrame, bits: int) -> dict[int, Table]:
    sizes = {r["kind"]: r["pairs"] for r in packed.groupBy("kind").agg(F.sum("pairs").alias("pairs")).collect()}
    tables = {k: Table(sizes.get(k, 0), bits) for k in (ORDER3, PREFIX)}
    for r in packed.toLocalIterator():
        tables[r["kind"]].add(np.frombuffer(bytes(r["hashes"]), np.uint64), np.frombuffer(bytes(r["odds"]), np.int8))
    return tables


def _plain_rates() -> np.ndarray:
    return 1 / (1 + np.exp(((BUCKETS - 1) / 2 - np.arange(BUCKETS)) * WIDTH))


def _decisions(batches: Iterator[pa.RecordBatch], codes: Codes, predictors: Predictors) -> Iterator[pa.RecordBatch]:
    """(kind, key, n, odd) as ``_counts`` gives them, or (text) -> (fact, n): how often every fact occurs, combined within the task."""

    def asked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of symbols with their part, and how often they occur."""
        if batch.num_columns == 1:
            for _, _, data, offs in chunks(batch.column(0)):
                key, new = coded(data, offs)
                key, which = distinct(key | np.repeat(_parts(data, offs), np.diff(new)) << _PART)
                yield key, np.bincount(which, minlength=len(key))
        else:
            used, key = _from_counts(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            n, odd = (batch.column(c).to_numpy()[used] for c in (2, 3))
            for part, own in enumerate((n - odd, odd)):
                yield key[own > 0] | part << _PART, own[own > 0]

    held: list[tuple[np.ndarray, ...]] = []
    waiting = 0
    for batch in batches:
        for key, n in asked(batch):
            for lo in range(0, len(key), BLOCK):
                size, facts = predictors.facts(codes, key[lo : lo + BLOCK])
                held.append(_reduced([(facts.astype(np.int64), np.repeat(n[lo : lo + BLOCK], size))]))
                waiting += len(held[-1][0])
                if waiting > HELD_KEYS // 2:
                    held.append(_reduced(held))
                    waiting = 0
                    if len(held[0][0]) > HELD_KEYS:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], names=["fact", "n"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _reduced(held)], names=["fact", "n"])


def _learned(lesson: DataFrame, scratch: Scratch, codes: Broadcast, predictors: Predictors) -> tuple[np.ndarray, np.ndarray]:
    """(weights (3 x GATES), rates (BUCKETS)) to start from: the weights of least log loss per gate, and the rates observed with them.

    lesson: (text), with ``_counted``, what ``_counts`` gives of these texts, which tells all their decisions."""
    held = lesson.sparkSession.sparkContext.broadcast(predictors)
    counted = lesson._counted.filter(F.col("kind").isin(ORDER3, PREFIX)).select("kind", "key", "n", "odd")
    table = scratch.write(counted.mapInArrow(lambda it: _decisions(it, codes.value, held.value), "fact long, n long").groupBy("fact").agg(F.sum("n").alias("n")), "facts")
    odds = [F.shiftright(F.shiftleft(F.col("fact"), 56 - 8 * k), 56) / STEP for k in range(3)]
    facts = table.select(*(o.alias(f"x{k}") for k, o in enumerate(odds)), F.shiftright("fact", 25).cast("int").alias("gate"), F.shiftright("fact", 24).bitwiseAND(1).alias("bit"), "n")

    def mixed(w: np.ndarray):
        return sum(F.get(F.array(*(F.lit(float(v)) for v in w[k])), F.col("gate")) * F.col(f"x{k}") for k in range(3))

    prior = np.repeat(np.array(START_WEIGHTS)[:, None], GATES, axis=1)
    best, now = prior.copy(), prior.copy()
    loss = np.full(GATES, np.inf)
    for _ in range(NEWTON_STEPS):
        p, n, bit = F.col("p"), F.col("n"), F.col("bit")
        known = facts.withColumn("z", mixed(now)).withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
        # -ln p of the bit that came, without overflow
        z = F.when(bit == 1, -F.col("z")).otherwise(F.col("z"))
        sums = [F.sum(n * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))))]
        sums += [F.sum(n * (p - bit) * F.col(f"x{j}")) for j in range(3)]
        sums += [F.sum(n * p * (1 - p) * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(3) for j in range(i, 3)]
        moved = 0.0
        for r in known.groupBy("gate").agg(*sums).collect():  # a row per gate
            g, (cost, *grad), upper = r[0], r[1:5], r[5:]
            off = now[:, g] - prior[:, g]
            cost += PRIOR / 2 * float(off @ off)
            if cost > loss[g]:
                # the step went too far
                step = (best[:, g] - now[:, g]) / 2
            else:
                best[:, g], loss[g] = now[:, g], cost
                h = np.zeros((3, 3))
                h[np.triu_indices(3)] = upper
                h = h + np.triu(h, 1).T + PRIOR * np.eye(3)
                step = -np.linalg.solve(h, np.array(grad) + PRIOR * off)
            now[:, g] = now[:, g] + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 5e-4:
            break
    # rounded, as the order in which Spark adds must not show
    weights = np.round(best, 3)
    z = F.least(F.greatest(mixed(weights), F.lit(-MOST)), F.lit(MOST))
    rates = _plain_rates() * PRIOR
    many = np.full(BUCKETS, PRIOR)
    for r in facts.groupBy(F.floor(z / WIDTH + BUCKETS / 2).alias("bucket")).agg(F.sum(F.col("n") * F.col("bit")).alias("ones"), F.sum("n").alias("n")).collect():
        rates[r["bucket"]] += r["ones"]
        many[r["bucket"]] += r["n"]
    scratch.drop(table)
    held.destroy()
    return weights, np.round(rates / many, 6)


def train(docs: DataFrame, scratch: Scratch, bits: int = SLOT_BITS) -> tuple[Model, DataFrame, int, int]:
    """-> (model, words (key, n), N, V) of the documents that may be learned from."""
    learn = docs.filter(crc_rest(F.col("doc_id"), FOLDS) != HELD_OUT)
    counts = scratch.write(_counts(learn), "counts")
    lesson = learn.select(F.col("text").cast("string").alias("text"))
    lesson._counted = counts  # type: ignore[attr-defined]
    words = counts.filter(F.col("kind") == WORDS).select("key", "n")
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    order1, odd1 = _order1(counts)
    codes = Codes(order1.reshape(SYMBOLS, SYMBOLS))
    held = docs.sparkSession.sparkContext.broadcast(codes)
    # a context has at most SYMBOLS symbols, so its list is bounded
    by_context = counts.filter(F.col("kind").isin(ORDER3, PREFIX)).groupBy("kind", F.shiftright("key", 9).alias("context")).agg(
        F.collect_list(F.col("key").bitwiseAND(511)).alias("symbols"), F.collect_list("n").alias("counts"), F.collect_list("odd").alias("odd"),
        F.sum("n").alias("total")).filter("total > 1").drop("total")
    packed = scratch.write(by_context.mapInArrow(lambda it: _to_pairs(it, held.value), "without boolean, kind int, pairs long, hashes binary, odds binary"), "pairs")
    # the first part meets the counts of the second, and the other way round
    weights, rates = _learned(lesson, scratch, held, Predictors(codes, np.stack((odd1, order1 - odd1)), _tables(packed.filter("without"), 10)))
    predictors = Predictors(codes, order1, _tables(packed.filter("not without"), bits))
    scratch.drop(packed)
    held.destroy()
    head_key, head_n = np.zeros(HEAD_SLOTS, np.uint64), np.zeros(HEAD_SLOTS, np.int64)
    top = words.orderBy(F.desc("n"), "key").limit(HEAD_WORDS).toArrow()
    key, many = top.column(0).to_numpy().view(np.uint64)[::-1], top.column(1).to_numpy()[::-1]
    place = (key & np.uint64(HEAD_SLOTS - 1)).astype(np.int64)
    # of words that share a slot the more frequent stays; the others are looked up by the join
    head_key[place], head_n[place] = key, many
    end = words.filter(F.col("key") == int(_END_WORD)).first()
    return Model(codes, predictors, weights, rates, head_key, head_n, end["n"] if end else 0), words, size["n"], size["v"]


def _mixed(lanes: int, steps: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], start: np.ndarray, rates: np.ndarray, unit: float = 1.0) -> Iterator[np.ndarray]:
    """Online mixing of lanes side by side: step by step the probability given to the bit that came, for the first lanes, as many as the step has.

    A step: log-odds in ``unit``s (lanes x 4, the fourth 0), bits (0 or 1, all float32), slots (lane * GATES + gate).  start: 3 x GATES weights, rates: BUCKETS."""
    # the weights of a slot lie together (a fourth is not used), so they are read and written as one 16-byte item
    weights = np.zeros((lanes, GATES, 4), np.float32)
    weights[:, :, :3] = start.T * unit
    weights = weights.reshape(-1, 4).view(np.complex128).ravel()
    speed = np.float32(RATE * unit * unit)
    width = np.float32(WIDTH)
    centre = np.float32((BUCKETS - 1) / 2)
    rate = np.tile(rates.astype(np.float32), lanes)
    lane = np.arange(lanes) * BUCKETS
    for x, bit, at in steps:
        m = len(bit)
        own = weights.take(at)
        w = own.view(np.float32).reshape(-1, 4)
        part = w * x
        dot = part[:, 0] + part[:, 1]
        dot += part[:, 2]
        np.minimum(dot, np.float32(MOST), out=dot)
        np.maximum(dot, np.float32(-MOST), out=dot)
        # the adaptive map: the bucket of the mixed odds (always one of them, as the odds are bounded), its observed rate averaged in
        cell = (dot * (1 / width) + (centre + np.float32(0.5))).astype(np.intp)
        cell += lane[:m]
        np.negative(dot, out=dot)
        np.exp(dot, out=dot)
        dot += 1
        p = np.reciprocal(dot, out=dot)
        err = bit - p
        err *= speed
        for k in range(3):
            part[:, k] = err
        part *= x
        w += part
        weights[at] = own
        r = rate[cell]
        p *= np.float32(0.75)
        p += np.float32(0.25) * r
        move = bit - r
        move *= np.float32(0.02)
        move += r
        rate[cell] = move
        # probability of the bit that came: p if 1, else 1 - p
        p -= 1 - bit
        np.abs(p, out=p)
        yield np.maximum(p, np.float32(1e-5), out=p)


def mix(odds: np.ndarray, bits: np.ndarray, slot: np.ndarray, borders: np.ndarray, start: np.ndarray | None = None, rates: np.ndarray | None = None) -> np.ndarray:
    """The probability given to the bit that came, for every decision (see ``_mixed``), from given arrays.

    Decisions lie step by step, lanes of a step side by side and those still alive first (lanes by falling length): step t is
    ``borders[t]:borders[t + 1]``.  odds: 3 x decisions, bits: 0 or 1 (all float32), slot: gate * lanes + lane.
    """
    start = np.repeat(np.array(START_WEIGHTS)[:, None], GATES, axis=1) if start is None else start
    lanes = int(borders[1])
    x, at = np.zeros((len(bits), 4), np.float32), slot % lanes * GATES + slot // lanes
    x[:, :3] = odds.T
    steps = ((x[lo:hi], bits[lo:hi], at[lo:hi]) for lo, hi in zip(borders[:-1], borders[1:], strict=True))
    return np.concatenate(list(_mixed(lanes, steps, start, _plain_rates() if rates is None else rates)))


def _lanes(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 probability of every row."""
    key, new = coded(data, offsets)
    key, which = distinct(key)
    size, known = model.predictors.facts(model.codes, key)
    begin = np.cumsum(size) - size
    many = size[which]
    # the facts of all decisions, row by row, and room for a last block of steps
    facts, done = np.zeros(int(many.sum(dtype=np.int64)) + STEPS, np.uint32), 0
    for lo in range(0, len(which), BLOCK):
        n = many[lo : lo + BLOCK]
        place = np.repeat(begin[which[lo : lo + BLOCK]] - (np.cumsum(n, dtype=np.int64) - n), n)
        place += np.arange(len(place))
        facts[done : done + len(place)] = known.take(place)
        done += len(place)
    # lanes: segments of SEGMENT symbols of one row, the longest (in decisions) first
    rows = len(new) - 1
    per = -(-np.diff(new) // SEGMENT)
    lane_row = np.repeat(np.arange(rows), per)
    lane_start = new[lane_row] + (np.arange(len(lane_row)) - np.repeat(np.cumsum(per) - per, per)) * SEGMENT
    # lanes lie one after the other without gaps, as every row has a symbol
    many = np.add.reduceat(many, lane_start, dtype=np.int64)
    at = np.cumsum(many) - many
    order = np.argsort(-many, kind="stable")
    at, many, lane_row = at[order].astype(np.intp), many[order], lane_row[order]
    alive = np.searchsorted(-many, -np.arange(int(many[0])), "left")
    lanes = len(at)
    lane = np.arange(lanes) * GATES
    # the next decisions of a lane as one item, from any decision on
    following = np.ndarray((done + 1,), f"V{4 * STEPS}", facts, strides=(4,))

    def steps() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for first in range(0, len(alive), STEPS):
            m = int(alive[first])
            fact = np.ascontiguousarray(following[at[:m]].view(np.uint32).reshape(m, STEPS).T)
            at[:m] += STEPS
            slot = (fact >> np.uint32(25)).astype(np.intp)
            slot += lane[:m]
            bit = ((fact >> np.uint32(24)) & np.uint32(1)).astype(np.float32)
            fact &= np.uint32(0xFFFFFF)
            odds = fact.view(np.int8).astype(np.float32).reshape(STEPS, m, 4)
            for step, k in enumerate(alive[first : first + STEPS]):
                yield odds[step, :k], bit[step, :k], slot[step, :k]

    total = np.zeros(lanes)
    for m, p in zip(alive, _mixed(lanes, steps(), model.weights, model.rates, 1 / STEP), strict=True):
        total[:m] += np.log(p, out=p)
    return np.bincount(lane_row, total, rows) / np.log(10)


_SCORED = "doc_id long, text_key long, n_tokens long, head_known long, head_sum double, score double, words array<long>, times array<long>"


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, text) -> a row per document with what the head words give, its words not in the head, and its score."""
    for batch in batches:
        for lo, hi, data, offs in chunks(batch.column(2), TOGETHER):
            rows = hi - lo
            hashes, first = _words(data, offs)
            row = np.repeat(np.arange(rows), np.diff(first))
            place = (hashes & np.uint64(HEAD_SLOTS - 1)).astype(np.int64)
            known = model.head_key[place] == hashes
            n = np.where(known, model.head_n[place], 0)
            end = np.log10(model.end_n + 1)
            head_sum = np.bincount(row, np.where(known, np.log10(n + 1.0), 0), rows) + end
            head_known = np.bincount(row[known], minlength=rows) + (model.end_n > 0)
            order = np.lexsort((hashes[~known], row[~known]))
            h, r = hashes[~known][order], row[~known][order]
            new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))) if len(h) else np.zeros(0, np.int64)
            borders = np.searchsorted(r[new], np.arange(rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, rows), batch.column(1).slice(lo, rows), pa.array(np.diff(first) + 1), pa.array(head_known), pa.array(head_sum),
                 pa.array(_lanes(model, data, offs)), lists(h[new].view(np.int64), borders, pa.int64()), lists(np.diff(np.append(new, len(h))), borders, pa.int64())],
                names=[f.split()[0] for f in _SCORED.split(", ")],
            )


def score(docs: DataFrame, bits: int = SLOT_BITS) -> DataFrame:
    """documents -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte; one row per row."""
    scratch = Scratch(docs.sparkSession, "langmodel")
    model, words, total, distinct = train(docs, scratch, bits)
    held = docs.sparkSession.sparkContext.broadcast(model)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    scored = scratch.write(plain.mapInArrow(lambda it: _score(it, held.value), _SCORED), "scored")
    # what follows reads written tables only
    held.destroy()
    # words outside the head, once per text; a text without any has no row here
    asked = scored.filter(F.size("words") > 0).select("text_key", F.explode(F.arrays_zip("words", "times")).alias("w")).select(
        "text_key", F.col("w.words").alias("key"), F.col("w.times").alias("times")
    ).distinct()
    rest = asked.join(words, "key").groupBy("text_key").agg(F.sum("times").alias("rest_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rest_sum"))
    level = float(np.log10(total + distinct + 1))
    return scored.join(rest, "text_key", "left").select(
        "doc_id", (crc_rest(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens",
        (F.col("head_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("rest_sum", F.lit(0.0)) - F.col("n_tokens") * level).alias("base_score"), "score",
    )
