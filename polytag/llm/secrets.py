"""Secret scans: fixed patterns plus a guess-cost test of values in a credential context.

Base spans (assign, access, hex) come from fixed patterns.  Beside them, the value of any wider credential context (``pwd:``,
``auth_token =>``, ``DB_PWD=``, ``client secret is``, ...; every place where a key starts is tried) is priced: dynamic programming finds the segmentation into dictionary words
(cost: log10 of the rank, plus capitals), dates, repeats, keyboard or alphabet walks and brute-force characters that
an attacker would guess with the least work.  A value whose cheapest segmentation still needs 10^``GUESSES`` guesses or more, and
that does not overlap a base span, is added as an assign span.  Every assign value's cost is reported.

The dictionary is the corpus's own: the ``DICTIONARY`` most frequent lower-case ASCII words of all documents (one
aggregation over whole texts, then a bounded list that is broadcast).

Cases: a null text is empty; an empty text has no span; repeated rows and null ids are scanned like any other; with an
empty table the dictionary is empty and there are no rows; equal counts rank by the word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, RangeHash, chunks, runs

KINDS = ("assign", "access", "hex")
DICTIONARY = 20_000
GUESSES = 10.0
#: entries a task counts before it passes them on
HELD_WORDS = 200_000
LONGEST_WORD = 24

# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: a text without any of these (lower case) has no assign match
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_KEY = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_\x20-]?key|access[_\x20-]?key|private[_\x20-]?key|client[_\x20-]?secret|auth(?:orization)?(?:[_\x20-]?token)?|bearer|credential)s?"
#: further parts of a key: PASSWORD_PROD, token-2, secretKey
_PARTS = r"(?:[_-][A-Za-z0-9]+|(?-i:(?<=[a-z])[A-Z][a-z0-9]+)|[0-9]{1,2}){0,6}"
#: wider credential contexts: a key, an optional connecting word or sign, a value (the run of _VALUE characters that follows)
CONTEXT = re.compile(_KEY + _PARTS + r"""["'\x20]{0,3}(?::=|=>|->|[:=]|(?P<plain>\x20is\x20|\x20))["'\x20]{0,3}(?=[!-&(-~]{6})""", re.I | re.A)
_VALUE = re.compile(r"[!-&(-~]+")
#: where a key may start; contexts are tried from every such place, so a key that follows another key is not lost as its value
_START = re.compile(r"p(?=ass|wd|rivate)|s(?=ecret)|t(?=oken)|a(?=pi|ccess|uth)|c(?=lient|redential)|b(?=earer)", re.I | re.A)
_IS_KEY = re.compile(_KEY + r"""["']?(?::=|=>|->|[:=])?""", re.I | re.A)
_CONTEXT_KEYS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential")

# fixed values: keyboard rows and alphabets along which a walk is cheap
_WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "0123456789", "qazwsxedcrfvtgbyhnujmikolp")
_NEXT = {a + b for w in _WALKS for s in (w, w[::-1]) for a, b in zip(s, s[1:], strict=False)}
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:1[0-2]|0?[1-9])[-/._]?(?:3[01]|[12]\d|0?[1-9])|(?:3[01]|[12]\d|0?[1-9])[-/._]?(?:1[0-2]|0?[1-9])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses of the cheapest segmentation of ``value``."""
    n = len(value)
    low = value.lower()
    dates = {}
    for i in range(n):
        if m := _DATE.match(value, i):
            dates.setdefault(m.end(), []).append((i, math.log10(365 * 120 if m.end() - i > 4 else 120)))
    each = [math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33) for c in value]
    segment = 0.3  # a further segment: where to cut
    cost = [0.0] + [math.inf] * n
    same = walk = 0  # lengths of the repeat and of the walk that end here
    # starts of a repeat that may still be its cheapest: an earlier start gains on a later one with every further character, so a start
    # that is not cheaper than an earlier one when it first counts never will be
    starts: list[int] = []
    for j in range(1, n + 1):
        c = cost[j - 1] + each[j - 1]
        same = same + 1 if j > 1 and value[j - 1] == value[j - 2] else 1
        walk = walk + 1 if j > 1 and low[j - 2 : j] in _NEXT else 1
        if same < 3:
            starts.clear()
        else:
            best = min((cost[i] + segment + each[j - 1] + math.log10(j - i) for i in starts), default=math.inf)
            fresh = cost[j - 3] + segment + each[j - 1] + math.log10(3)
            if fresh < best:
                starts.append(j - 3)
            c = min(c, best, fresh)
        for length in range(3, min(walk, 30) + 1):
            c = min(c, cost[j - length] + segment + math.log10(2 * len(_WALKS) * 26) + math.log10(length))
        for i, g in dates.get(j, ()):
            c = min(c, cost[i] + segment + g)
        for i in range(max(0, j - LONGEST_WORD), j - 2):
            rank = ranks.get(low[i:j])
            if rank:
                part = value[i:j]
                upper = sum(x.isupper() for x in part)
                extra = 0.0 if not upper else math.log10(2) if part.istitle() or part.isupper() else math.log10(math.comb(j - i, upper) + 1)
                c = min(c, cost[i] + segment + math.log10(rank + 1) + extra)
        # any repeated unit of two or more characters: priced as the unit once
        for unit in (2, 3, 4):
            if j >= 2 * unit and value[j - unit : j] == value[j - 2 * unit : j - unit]:
                c = min(c, cost[j - unit] + segment)
        cost[j] = c
    return cost[n]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (word, count) of lower-cased ASCII words of 3 to LONGEST_WORD letters, combined within the task."""
    held: dict[str, int] = {}
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for _, _, data, offs in chunks(batch.column(0)):
            low = LOWER[data]
            starts, ends, _ = runs(letter[data], offs)
            fit = (ends - starts >= 3) & (ends - starts <= LONGEST_WORD)
            starts, ends = starts[fit], ends[fit]
            _, at, n = np.unique(RangeHash(low)(starts, ends), return_index=True, return_counts=True)
            raw = low.tobytes()
            for s, e, k in zip(starts[at].tolist(), ends[at].tolist(), n.tolist(), strict=True):
                w = raw[s:e].decode()
                held[w] = held.get(w, 0) + k
            if len(held) > HELD_WORDS:
                yield flush()
    yield flush()


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> dict[str, int]:
    """word -> rank (1 = most frequent) of the corpus's ``size`` most frequent words."""
    counted = docs.select(F.col("text").cast("string")).mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(size).collect()
    return {r["word"]: i + 1 for i, r in enumerate(top)}


def base_spans(text: str, long_hex: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, by start then kind; ``long_hex`` False: the text is known to hold no hex match."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if long_hex:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out)


def contexts(text: str) -> Iterator[tuple[int, int, int]]:
    """(start of the key, start and end of the value) of every credential context, by start; of keys before one value the first.

    A key may follow letters and digits (dbpassword) if a sign comes after it.  A value that is itself a key is none.
    """
    seen: set[int] = set()
    first = last = end = 0  # the run of value characters met last, and its end without closing marks
    for at in _START.finditer(text):
        i = at.start()
        m = CONTEXT.match(text, i)
        if not m or m.end() in seen:
            continue
        inner = i > 0 and text[i - 1].isascii() and text[i - 1].isalnum() and not (text[i - 1].islower() and text[i].isupper())
        if inner and m["plain"]:
            continue
        s = m.end()
        if not first <= s < last:
            first, last = _VALUE.match(text, s).span()
            end = first + len(text[first:last].rstrip(".,;:!?)]}\"'"))
        seen.add(s)
        stop = max(s, end)
        if not any(e - s < 40 and _IS_KEY.fullmatch(text, s, e) for e in (stop, last)):
            yield i, s, stop


def scan(text: str, ranks: dict[str, int], long_hex: bool = True, guesses: float = GUESSES) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[float]]:
    """(base spans, added spans, log10 guesses of credential-context values in order).

    A key inside another's value is not priced again where that value is already part of a span.
    """
    low = text.lower()
    base = base_spans(text, long_hex)
    added, costs = [], []
    reach = 0
    if any(k in low for k in _CONTEXT_KEYS):
        for start, s, end in contexts(text):
            if start < reach and any(b[0] <= start and end <= b[2] for b in (*base, *added[-1:])):
                continue
            reach = max(reach, end)
            cost = guess_cost(text[s:end], ranks)
            costs.append(cost)
            if cost >= guesses and all(b[2] <= start or end <= b[0] for b in base):
                if added and start < added[-1][2]:
                    added[-1] = (added[-1][0], 0, max(added[-1][2], end))
                else:
                    added.append((start, 0, end))
    return base, added, costs


_FOUND = "doc_id long, base array<struct<start:int,kind:int,end:int>>, added array<struct<start:int,kind:int,end:int>>, guesses array<double>"


def _scan(batches: Iterator[pa.RecordBatch], ranks: dict[str, int]) -> Iterator[pa.RecordBatch]:
    hexes = np.zeros(256, bool)
    hexes[[*range(48, 58), *range(97, 103)]] = True
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for lo, hi, data, offs in chunks(batch.column(1)):
            # rows with a long run of hex digits; only they are searched for it
            starts, ends, first = runs(hexes[data], offs)
            long_ = np.concatenate(([0], np.cumsum(ends - starts >= 32)))
            has = long_[first[1:]] > long_[first[:-1]]
            rows = [scan(t or "", ranks, bool(h)) for t, h in zip(batch.column(1).slice(lo, hi - lo).to_pylist(), has, strict=True)]
            named = lambda k: [[dict(zip(("start", "kind", "end"), s, strict=True)) for s in r[k]] for r in rows]  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(named(0), span), pa.array(named(1), span), pa.array([r[2] for r in rows], pa.list_(pa.float64()))],
                names=["doc_id", "base", "added", "guesses"],
            )


def find_secrets(docs: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """documents -> doc_id, base and added spans (start, kind index, end), guesses; one row per document."""
    ranks = docs.sparkSession.sparkContext.broadcast(dictionary(docs, size))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _scan(it, ranks.value), _FOUND)


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans, all spans as text, the highest guess cost."""
    names = F.array(*map(F.lit, KINDS))

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")

    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"),
        text(F.array_sort(F.concat("base", "added"))).alias("spans"), F.array_max("guesses").alias("most_guesses"),
    )
