"""Contexts and learned start weights of the language model, against plain versions."""

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import crc, frame, prose
from pyspark.sql import functions as F

from polytag.llm import langmodel


def test_contexts_equal_a_plain_version():
    rows = ["", "a", "ab", "Abc", "abcd ", " a", "a b", "ÄÖ ü", "\n\n", "longwordlongword xx yyyyyyyyyyy\tzz", None, "the  cat\tsat A"]
    (_, _, data, offsets), = langmodel.chunks(pa.array(rows))
    key, _ = langmodel.coded(data, offsets)
    want = []
    for text in rows:
        raw = bytes(langmodel.LOWER[b] for b in (text or "").encode())
        for at in range(len(raw) + 1):
            since = 0
            while since < at and not langmodel.IS_SEP[raw[at - since - 1]]:
                since += 1
            before = raw[at - 1] if at else langmodel.END
            word = int.from_bytes(raw[at - min(since, 6):at], "big") | min(since, 7) << 48 if since else (before | 8 << 48 if at else 9 << 48)
            want.append((raw[at] if at < len(raw) else langmodel.END, before, int.from_bytes(raw[max(0, at - 3):at], "big") | min(at, 3) << 24, word))
    assert [tuple(int(x) for x in r) for r in zip(*langmodel.contexts(key), strict=True)] == want
    found, which = langmodel.distinct(key)
    assert (found[which] == key).all() and len(np.unique(found)) == len(found)


def test_start_weights_are_learned_from_documents_seen_as_new(spark, monkeypatch):
    hashed = spark.range(300).filter(F.pmod(F.xxhash64("id"), F.lit(langmodel.LEARN_SHARE)) == 0).collect()
    taught = [r.id for r in hashed if crc(r.id) % 7 != 2]
    rng = random.Random(8)
    rows = [(i, prose(rng, 60) + (" qqzq qqzw qqze" if i == taught[0] else "")) for i in range(300)]
    seen = {}
    learned = langmodel._learned

    def spy(lesson, scratch, codes, predictors):
        seen.update(texts=[r.text for r in lesson.collect()], codes=codes.value, predictors=predictors)
        return learned(lesson, scratch, codes, predictors)

    monkeypatch.setattr(langmodel, "_learned", spy)
    model = langmodel.train(frame(spark, rows), langmodel.Scratch(spark, "mixing_test"), bits=12)[0]
    assert sorted(seen["texts"]) == sorted(t for i, t in rows if i in taught)

    # contexts that only these documents have are known to the model, not to the learner
    root = np.array([model.codes.nodes[model.codes.starts[ord("z") * langmodel.SYMBOLS + ord("q")]]])
    pair = langmodel.pair_hash(langmodel.context_hash(np.array([int.from_bytes(b"qqz", "big") | 3 << 24]), langmodel.ORDER3), root)
    assert model.tables[langmodel.ORDER3].look(pair)[0] != 0 and seen["predictors"].tables[langmodel.ORDER3].look(pair)[0] == 0

    (batch,) = langmodel._decisions(iter([pa.RecordBatch.from_arrays([pa.array(seen["texts"])], names=["text"])]), seen["codes"], seen["predictors"])
    fact, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    x = np.stack([(fact >> 8 * k & 255).astype(np.uint8).view(np.int8) / langmodel.STEP for k in range(3)])
    gate, bit = fact >> 25, fact >> 24 & 1
    prior = np.repeat(np.array(langmodel.START_WEIGHTS)[:, None], langmodel.GATES, axis=1)

    def loss(w):
        z = (w[:, gate] * x).sum(0) * np.where(bit == 1, -1, 1)
        return np.bincount(gate, n * np.logaddexp(0, z), langmodel.GATES) + langmodel.PRIOR / 2 * ((w - prior) ** 2).sum(0)

    least = loss(model.weights)
    assert least.sum() < loss(prior).sum()
    for k in range(3):
        for move in (-0.03, 0.03):
            other = model.weights.copy()
            other[k] += move
            assert (loss(other) >= least).all()
    # start weights and rates reach the mixer
    odds, bits = np.ones((3, 1), np.float32), np.ones(1, np.float32)
    gates = [langmodel.mix(odds, bits, np.array([g]), np.array([0, 1]), model.weights, model.rates)[0] for g in np.unique(gate)]
    assert len(set(gates)) > 1 and (np.diff(model.rates) > -0.1).all()


def _plain_contexts(text):
    """(three bytes before, word so far, symbol) of every symbol, as counts have them."""
    raw = bytes(langmodel.LOWER[b] for b in (text or "").encode())
    for at in range(len(raw) + 1):
        since = 0
        while since < at and not langmodel.IS_SEP[raw[at - since - 1]]:
            since += 1
        word = int.from_bytes(raw[at - min(since, 6):at], "big") | min(since, 7) << 48 if since else (raw[at - 1] | 8 << 48 if at else 9 << 48)
        yield int.from_bytes(raw[max(0, at - 3):at], "big") | min(at, 3) << 24, word, raw[at] if at < len(raw) else langmodel.END


def test_start_weights_are_learned_from_every_training_document(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randrange(0, 30))) for i in range(120)] + [(900, None), (901, ""), (902, "Ünseen WORDS w1x1\n\tab a"), (903, " a"), (None, "never taught")]
    rows += rows[:5]
    taught = [t or "" for i, t in rows if i is not None and crc(i) % 7 != 2]
    seen = {}
    learned = langmodel._learned

    def spy(lesson, scratch, codes, predictors):
        write = scratch.write

        def kept(df, name):
            table = write(df, name)
            seen[name] = {r.fact: r.n for r in table.collect()}
            return table

        monkeypatch.setattr(scratch, "write", kept)
        seen.update(texts=[r.text for r in lesson.collect()], codes=codes.value, predictors=predictors)
        return learned(lesson, scratch, codes, predictors)

    monkeypatch.setattr(langmodel, "_learned", spy)
    langmodel.train(frame(spark, rows).repartition(3), langmodel.Scratch(spark, "mixing_test"), bits=12)
    assert sorted(t or "" for t in seen["texts"]) == sorted(taught)
    # every decision of these texts, each of them met by predictors that have not counted its text's part
    (batch,) = langmodel._decisions(iter([pa.RecordBatch.from_arrays([pa.array(taught)], names=["text"])]), seen["codes"], seen["predictors"])
    assert seen["facts"] == dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    codes, symbols = seen["codes"], [(zlib.crc32(t.encode()) % 2, c) for t in taught for c in _plain_contexts(t)]
    assert sum(seen["facts"].values()) == sum(int(codes.lengths[(c[0] & 255 if c[0] >> 24 else langmodel.END) * langmodel.SYMBOLS + c[2]]) for _, c in symbols)
    counts = Counter((part, kind, c[kind - langmodel.ORDER3], c[2]) for part, c in symbols for kind in (langmodel.ORDER3, langmodel.PREFIX))
    asked = {(part, kind, context) for part, kind, context, _ in counts}
    assert {part for part, _, _ in asked} == {0, 1}
    known = 0
    for part, kind, context in asked:
        start = context >> (24 if kind == langmodel.ORDER3 else 48) == (0 if kind == langmodel.ORDER3 else 9)
        first = langmodel.END if start else context & 255
        root = codes.nodes[codes.starts[first * langmodel.SYMBOLS]]
        n = [0, 0]
        for symbol in range(langmodel.SYMBOLS):
            n[codes.bits[codes.starts[first * langmodel.SYMBOLS + symbol]]] += counts[1 - part, kind, context, symbol]
        pair = langmodel.pair_hash(langmodel.context_hash(np.array([context | part << 55]), kind), np.array([root]))
        want = langmodel._log_odds(np.array(n[:1]), np.array(n[1:]))[0] if sum(n) > 1 else 0
        assert seen["predictors"].tables[kind].look(pair)[0] == want
        known += sum(n) > 1
    assert known > 100


def _untrained(data, offsets):
    """A model of the given texts' order-1 counts, without hashed contexts, and an array of texts as ``_lanes`` reads them."""
    symbol, before, _, _ = langmodel.contexts(langmodel.coded(data, offsets)[0])
    order1 = np.bincount(before * langmodel.SYMBOLS + symbol, minlength=langmodel.SYMBOLS**2)
    codes = langmodel.Codes(order1.reshape(langmodel.SYMBOLS, langmodel.SYMBOLS))
    tables = {k: langmodel.Table(0, 10) for k in (langmodel.ORDER3, langmodel.PREFIX)}
    weights = np.repeat(np.array(langmodel.START_WEIGHTS)[:, None], langmodel.GATES, axis=1)
    none = np.zeros(langmodel.HEAD_SLOTS, np.int64)
    return langmodel.Model(codes, langmodel.Predictors(codes, order1, tables), weights, langmodel._plain_rates(), none.view(np.uint64), none, 0)


def _peak(call):
    """Bytes that a call allocates at most, its result among them, and the result."""
    tracemalloc.start()
    try:
        out = call()
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def test_wide_arrays_are_held_for_a_block(monkeypatch):
    rng = random.Random(3)
    texts = [prose(rng, 200) for _ in range(900)]
    (_, _, data, offsets), = langmodel.chunks(pa.array(texts), 1 << 22)
    size = len(data)
    assert size > 1 << 20
    model = _untrained(data, offsets)
    langmodel.word_hashes(data[:10], np.array([0, 10]))  # its table of powers is made once
    # the result of coded has 8 bytes a symbol, the facts of all decisions about 20
    assert _peak(lambda: langmodel.coded(data, offsets))[0] < 24 * size
    assert _peak(lambda: langmodel._words(data, offsets))[0] < 16 * size
    most, whole = _peak(lambda: langmodel._lanes(model, data, offsets))
    assert most < 36 * size
    # the size of a block does not show
    key, (hashes, first) = langmodel.coded(data, offsets)[0], langmodel._words(data, offsets)
    monkeypatch.setattr(langmodel, "BLOCK", 3000)
    assert (langmodel.coded(data, offsets)[0] == key).all()
    assert all((a == b).all() for a, b in zip(langmodel._words(data, offsets), (hashes, first), strict=True))
    assert (langmodel._lanes(model, data, offsets) == whole).all()
    plain, at = langmodel.word_hashes(data, offsets)
    assert (hashes == plain).all() and (first == at).all()


def test_lanes_equal_plain_mixing_whatever_is_gathered_at_once(monkeypatch):
    rng = random.Random(5)
    texts = ["", "a", "Ab  c", *(prose(rng, rng.randrange(1, 60)) for _ in range(30)), prose(rng, 400)]
    (_, _, data, offsets), = langmodel.chunks(pa.array(texts))
    model = _untrained(data, offsets)
    model.weights = np.round(np.random.default_rng(1).normal(0.5, 0.2, (3, langmodel.GATES)), 3)
    whole = langmodel._lanes(model, data, offsets)
    for row, text in enumerate(texts):
        key, _ = langmodel.coded(*next(iter(langmodel.chunks(pa.array([text]))))[2:])
        size, facts = model.predictors.facts(model.codes, key)
        ends, total = np.append(0, np.cumsum(size)), 0.0
        for lo in range(0, len(key), langmodel.SEGMENT):
            part = facts[ends[lo] : ends[min(len(key), lo + langmodel.SEGMENT)]]
            odds = np.stack([(part >> 8 * k & 255).astype(np.uint8).view(np.int8) for k in range(3)]).astype(np.float32) / np.float32(langmodel.STEP)
            p = langmodel.mix(odds, (part >> 24 & 1).astype(np.float32), part >> 25, np.arange(len(part) + 1), model.weights, model.rates)
            total += np.log10(p.astype(float)).sum()
        assert abs(whole[row] - total) < 1e-4 * max(1, -total)
    for steps in (1, 3, 64):
        monkeypatch.setattr(langmodel, "STEPS", steps)
        assert (langmodel._lanes(model, data, offsets) == whole).all()


def test_counts_are_summed_column_by_column():
    rng = np.random.default_rng(2)
    parts = [(np.unique(rng.integers(0, 1 << 20, 100_000)),) for _ in range(4)]
    parts = [(key, key % 5 + 1, key % 2) for key, in parts]
    want = Counter()
    for key, n, odd in parts:
        want.update({int(k): complex(a, b) for k, a, b in zip(key, n, odd, strict=True)})
    size = sum(c.nbytes for part in parts for c in part)
    most, (key, n, odd) = _peak(lambda: langmodel._reduced(parts))
    assert parts == [] and (np.diff(key) > 0).all()
    assert {int(k): complex(a, b) for k, a, b in zip(key, n, odd, strict=True)} == want
    # 2.2; with all columns put together at once 2.8
    assert most < 2.5 * size


def test_counts_are_dealt_by_key_before_they_are_aggregated(spark):
    texts = ["one two two", "one two", None, ""]
    counts = langmodel._counts(frame(spark, list(enumerate(texts))).repartition(3))
    words = sorted(r.n for r in counts.filter(F.col("kind") == langmodel.WORDS).collect())
    assert words == [2, 3, 4]
    # no aggregate between the tasks that count and the exchange
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.rindex("HashAggregate") < plan.index("Exchange hashpartitioning") < plan.index("MapInArrow")
