import random

import numpy as np
import pyarrow as pa

from helpers import crc, frame, prose
from polytag.llm import quality, toxicity
from polytag.llm.text import chunks


def labelled(spark, rows, column):
    return spark.createDataFrame([(i, int(y)) for i, y in rows], f"doc_id long, {column} int")


def test_toxic_words_and_stems_are_learned(spark):
    rng = random.Random(1)
    bad = ["vilest", "moronic", "scumbag"]
    docs, labels = [], []
    for i in range(600):
        y = rng.random() < 0.2
        words = prose(rng, 30).split(" ")
        if y:
            words[rng.randrange(30)] = rng.choice(bad) + rng.choice(["", "s", "ly"])
        docs.append((i, " ".join(words)))
        labels.append((i, y))
    out = {r.doc_id: r for r in toxicity.toxicity(frame(spark, docs), labelled(spark, labels, "toxic")).collect()}
    held = [(out[i].predicted, y) for i, y in labels if crc(i) % 4 == 2]
    assert all(out[i].held_out == (crc(i) % 4 == 2) for i, _ in labels)
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    kept = toxicity.drop_toxic(frame(spark, docs), labelled(spark, labels, "toxic"))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.predicted}


def _features(texts):
    _, _, data, offs = next(chunks(pa.array(texts)))
    ids, first = toxicity.distinct_features(data, offs)
    return [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def test_counterfactual_penalty_takes_the_weight_off_group_names():
    rng = random.Random(5)
    texts, y = [], []
    for i in range(400):
        toxic = i % 2
        # "women" occurs mostly in toxic rows, "men" mostly in others
        name = "women" if rng.random() < (0.95 if toxic else 0.05) else "men"
        texts.append(f"{prose(rng, 12)} {name} {'scum' if toxic and rng.random() < 0.6 else 'here'}")
        y.append(toxic)
    rows, y = _features(texts), np.array(y, float)
    swaps = []
    for t in texts:
        for a, b in toxicity.counterfactuals(t, (("women", "men"),)):
            fa, fb = _features([a, b])
            swaps.append(np.array([*np.setdiff1d(fb, fa), *(-1 - np.setdiff1d(fa, fb))]))
    neutral = _features(["the women are here", "the men are here"])

    def gap(c):
        w, b = toxicity.fit(rows, y, swaps, counterfactual=c)
        s = [w[f].sum() + b for f in neutral]
        return s[0] - s[1], w[_features(["scum"])[0]].sum()

    plain, fair = gap(0.0), gap(50.0)
    assert plain[0] > 1.0 and abs(fair[0]) < 0.2 * plain[0] and fair[1] > 0.5


def test_attention_gradient_matches_finite_differences():
    rng = np.random.default_rng(2)
    x, first, y = rng.normal(size=(9, 6)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    net = quality.start(6, np.zeros(6), np.ones(6))
    _, grads = quality.gradient(net, x, first, y, np.ones(3), 1e-2)
    for k, g in zip(range(2, 9), grads, strict=True):
        flat = net[k].reshape(-1)
        for j in range(0, len(flat), max(1, len(flat) // 5)):
            old = flat[j]
            flat[j] = old + 1e-5
            up = quality.gradient(net, x, first, y, np.ones(3), 1e-2)[0]
            flat[j] = old - 1e-5
            down = quality.gradient(net, x, first, y, np.ones(3), 1e-2)[0]
            flat[j] = old
            assert abs((up - down) / 2e-5 - g.reshape(-1)[j]) < 1e-5 or k == 8 and abs((up - down) / 2e-5 - g.reshape(-1)[j]) < 1e-4


def test_passages_cover_every_word_and_byte():
    texts = ["", "a " * 200, "B!! " * 64, "x"]
    _, _, data, offs = next(chunks(pa.array(texts)))
    x, first = quality.encode(data, offs)
    assert list(np.diff(first)) == [1, 4, 1, 1] and x.shape == (7, quality.INPUTS)
    assert np.allclose(x[1:, : quality.CLASSES].sum(1), 1)


def test_bad_passages_are_learned(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(300):
        good = rng.random() < 0.7
        t = prose(rng, 150) if good else prose(rng, 80) + " " + "BUY!! NOW!! " * 30
        docs.append((i, t))
        labels.append((i, good))
    out = {r.doc_id: r for r in quality.quality(frame(spark, docs), labelled(spark, labels, "quality")).collect()}
    held = [(out[i].predicted, y) for i, y in labels if crc(i) % 4 == 2]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)


def test_no_labels_and_one_class(spark):
    docs = frame(spark, [(i, "some words") for i in range(8)])
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert {r.score for r in quality.quality(docs, none).collect()} == {0.0}
    same = spark.createDataFrame([(i, 1, 1) for i in range(8)], "doc_id long, toxic int, quality int")
    assert len({r.score for r in quality.quality(docs, same).collect()}) == 1
