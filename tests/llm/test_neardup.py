import random

import numpy as np

from helpers import edited, frame, prose, shingles
from polytag.llm import neardup, text


def brute(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus():
    """Exact copies, a group of near copies of which many are only linked through others, short texts, unrelated texts."""
    rng = random.Random(7)
    base, other = prose(rng, 120), prose(rng, 60)
    rows = [(i, edited(rng, base, rng.randrange(0, 9))) for i in range(0, 120)]
    rows += [(i, edited(rng, other, rng.randrange(0, 5))) for i in range(200, 240)]
    rows += [(i, base) for i in range(300, 320)] + [(i, prose(rng, rng.randrange(1, 80))) for i in range(400, 440)]
    rows += [(500, "a b"), (501, "A B"), (502, "a b c"), (503, ""), (504, ""), (505, None)]
    passage = prose(rng, 40)
    return rows + [(i, passage + " " + prose(rng, 40)) for i in range(600, 640)]


def test_components_equal_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_keep_one_keeps_one_of_each_group(spark):
    rows = [(3, "the same five words again"), (1, "The same five words again"), (2, "other words are in this"), (2, "other words are in this"), (None, "x y")]
    kept = neardup.keep_one(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 2] and kept[0].asDict().keys() == frame(spark, rows).first().asDict().keys()


def test_repeated_ids_lose_no_text(spark):
    rng = random.Random(4)
    a, b, c = (prose(rng, 40) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c), (3, c.upper()), (3, a), (None, a), (None, a), (4, ""), (4, ""), (5, None)]
    kept = neardup.keep_one(frame(spark, rows)).collect()
    assert sorted(((r.doc_id or 0, (r.text or "").lower()) for r in kept)) == sorted([(1, a), (2, b), (3, c), (0, a), (0, a), (4, ""), (5, "")])
    found = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(frame(spark, rows)).collect() if r.doc_id)
    assert found == sorted([(1, 1), (2, 1), (2, 2), (2, 2), (3, 3), (3, 3), (3, 1), (4, 4), (4, 4), (5, 5)])


def test_a_group_with_one_common_addition(spark):
    """Hundreds of near copies, most of them not close to the central one, that share one added passage."""
    rng = random.Random(6)
    base, added = prose(rng, 140).split(" "), "all of these end on one and the same line"
    rows = []
    for i in range(220):
        w = list(base)
        for _ in range(rng.randrange(3, 7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w) + (" " + added if i % 3 else "")))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows).repartition(9)).collect()}
    assert got == brute(rows)
    assert 1 < len({c for _, c, _ in got.values()}) < 220


def test_signatures_agree_as_often_as_the_sets_are_similar():
    rng = np.random.default_rng(3)
    shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (300, 50, 50))
    x, y = np.sort(np.concatenate((shared, a))), np.sort(np.concatenate((shared, b)))
    sig = neardup.minhash(np.concatenate((x, y)), np.array([0, 350, 700]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.75) < 0.06


def test_words_and_shingles_match_plain_python():
    import pyarrow as pa

    texts = ["", " a ", "One two\tTHREE\x0bfour  five six", "é É ñ\n\n x", "a b c d", "\x1c in-word \x85"]
    for _, _, data, offs in text.chunks(pa.array(texts), budget=8):
        values, first = text.shingle_sets(data, offs, 5)
        assert len(first) == len(offs) and first[-1] == len(values)
    _, _, data, offs = next(text.chunks(pa.array(texts)))
    _, first = text.shingle_sets(data, offs, 5)
    assert list(np.diff(first)) == [len(shingles(t)) for t in texts]
