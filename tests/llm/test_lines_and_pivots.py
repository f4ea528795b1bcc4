"""Line frequency, product codes and centroids against plain versions, on small tables with skew, ties, odd rows and long texts."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SCHEMA, WORD, frame, odd_rows, prose

from polytag.llm import centroids, codes, linefreq, lookup, pivots

SEP = re.compile(r"[\x20\x09-\x0D]+")


def plain_rules(rows, least=linefreq.LEAST, share=linefreq.SHARE):
    """rows (doc_id, text, host) -> result tuples and the texts left."""
    norm = lambda x: SEP.sub(" ", re.sub("[0-9]+", "0", x.lower())).strip(" ")
    lines = [[x for x in (t or "").split("\n")] for _, t, _ in rows]
    often, hosts = Counter(), Counter(h for _, _, h in rows)
    for (_, _, h), ls in zip(rows, lines, strict=True):
        often.update({(h, norm(x)) for x in ls if WORD.search(x)})
    out, left = [], []
    for (i, t, h), ls in zip(rows, lines, strict=True):
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        full = [x for x in ls if WORD.search(x)]
        gone = [bool(WORD.search(x)) and often[h, norm(x)] > least and often[h, norm(x)] * share > hosts[h] for x in ls]
        removed = sum(len(WORD.findall(x)) for x, g in zip(ls, gone, strict=True) if g)
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        kept = not failed and 100 * removed <= 50 * len(w) and len(w) - removed >= 50
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(repeated), failed, kept, sum(gone), removed))
        left.append((i, "\n".join(x for x, g in zip(ls, gone, strict=True) if not g)) if kept else None)
    return out, [x for x in left if x]


def web_rows(seed, n=260):
    rng = random.Random(seed)
    stock = [prose(rng, 9, 50) + f" {i}" for i in range(6)]
    rows = []
    for i in range(n):
        host = "hot" if i % 3 else rng.choice(["a", "b", None, ""])
        ls = [prose(rng, rng.randrange(1, 30), 3000) for _ in range(rng.randrange(1, 9))]
        for _ in range(rng.randrange(5)):
            ls.insert(rng.randrange(len(ls) + 1), rng.choice([rng.choice(stock).upper() + " \t", rng.choice(stock).replace("1", "77"), "", " \t ", "#*| <b> & 5%", ls[0]]))
        rows.append((i, "\n".join(ls), host))
    # a group of copies that a third of a host holds, and a phrase repeated all over a text
    copy = "\n".join(prose(rng, 20, 3000) for _ in range(5))
    rows += [(n + i, copy, "hot") for i in range(90)] + [(n + 100, "say it again " * 40, "b"), (n + 101, "é ü 漢 😀 " * 3 + prose(rng, 60, 3000), None)]
    return rows


@pytest.mark.parametrize("broadcast_rows", [lookup.BROADCAST_ROWS, 0])
def test_rules_equal_a_plain_version(spark, broadcast_rows):
    rows = web_rows(5)
    docs = spark.createDataFrame([(a, t, "en", h, len(t)) for a, t, h in rows], SCHEMA).repartition(7)
    for least, share in ((linefreq.LEAST, linefreq.SHARE), (3, 12)):
        want, texts = plain_rules(rows, least, share)
        got = linefreq.quality_rules(docs, least=least, share=share, broadcast_rows=broadcast_rows).collect()
        assert sorted(map(tuple, got)) == sorted(want)
        left = linefreq.clean(docs, least=least, share=share, broadcast_rows=broadcast_rows).collect()
        assert sorted((r.doc_id, r.text) for r in left) == sorted(texts)
        assert all(r.n_chars == len(r.text) for r in left)
    assert any(r.removed_lines and r.kept for r in got) and not all(r.kept for r in got)


def test_a_long_text_and_odd_rows(spark):
    rng = random.Random(2)
    long = "\n".join("same line here" if i % 2 else f"line {i} " + prose(rng, 6, 900) for i in range(40_000))
    rows = [(1, long, "a"), (2, "x" * 1_000_000, "a"), (3, "a " * 200_000, None), (4, "\n" * 100_000, "a")]
    want, _ = plain_rules(rows)
    assert sorted(map(tuple, linefreq.quality_rules(frame(spark, [(a, t, h) for a, t, h in rows])).collect())) == sorted(want)
    odd = odd_rows(spark)
    got = linefreq.quality_rules(odd).collect()
    plain, _ = plain_rules([(r.doc_id, r.text, r.source) for r in odd.collect()])
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(plain, key=key)
    assert linefreq.clean(odd).dtypes == odd.dtypes and linefreq.clean(odd).count() == sum(r.kept for r in got)
    for empty in (odd.limit(0), spark.createDataFrame([], SCHEMA)):
        assert linefreq.quality_rules(empty).collect() == [] and linefreq.clean(empty).collect() == []


def test_the_pivot_search_is_a_full_search():
    rng = np.random.default_rng(4)
    for n, k, d, top, p in ((700, 256, 16, 300, 8), (300, 16, 64, 40, 5), (50, 3, 4, 2, 3), (40, 30, 8, pivots.LARGEST, 8), (5, 1, 2, 9, 1)):
        x = np.concatenate([rng.integers(-top, top + 1, (n, d)), np.tile(rng.integers(-top, top + 1, (1, d)), (n, 1))])
        entries = np.concatenate([rng.integers(-top, top + 1, (k - k // 4, d)), np.tile(x[:1], (k // 4, 1))])
        fixed = pivots.farthest(entries[: k // 2 + 1], p)
        found, best, evaluated = pivots.nearest(x, pivots.distances(x, fixed), entries, fixed)
        every = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        assert (best == every.min(1)).all() and (found == every.argmin(1)).all() and evaluated <= every.size
    near = np.repeat(rng.integers(-900, 900, (32, 16)), 40, axis=0)
    x = near + rng.integers(-20, 21, near.shape)
    fixed = pivots.farthest(near[::40], 8)
    assert pivots.nearest(x, pivots.distances(x, fixed), near[::40], fixed)[2] < 0.25 * len(x) * 32


def _ints(v, scale):
    return [math.floor(x * scale) for x in v]


def _fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _round(vectors, entries):
    found = [min(range(len(entries)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, entries[c], strict=True)), c)) for v in vectors]
    far = [sum((a - b) ** 2 for a, b in zip(v, entries[c], strict=True)) for v, c in zip(vectors, found, strict=True)]
    return found, far


def _moved(vectors, found, entries):
    groups = defaultdict(list)
    for v, c in zip(vectors, found, strict=True):
        groups[c].append(v)
    return [[sum(col) // len(groups[c]) for col in zip(*groups[c], strict=True)] if c in groups else e for c, e in enumerate(entries)]


def vector_rows(n, dims, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(dims)], None if i % 7 == 0 else i % 3) for i in range(n)]
    # a third of all rows hold one vector; bad rows
    rows += [(n + i, rows[0][1], 1) for i in range(n // 2)]
    bad = [None, [], [0.5] * (dims - 1), [0.5] * (dims - 1) + [None], [0.5] * (dims - 1) + [math.nan], [math.inf] + [0.5] * (dims - 1)]
    return rows + [(5000 + i, v, 1) for i, v in enumerate(bad)]


VECTORS = "vec_id long, embedding array<float>, label int"


def test_codes_equal_a_plain_version(spark):
    table = spark.createDataFrame(vector_rows(90, 8, 3), VECTORS).repartition(5)
    rows = sorted((r.vec_id, r.embedding, r.label) for r in table.collect() if _fine(r.embedding) and len(r.embedding) == 8)
    whole = [_ints(v, 1024) for _, v, _ in rows]
    code, error, books = [[] for _ in rows], [0] * len(rows), []
    for p in range(4):
        part = [v[p * 2 : p * 2 + 2] for v in whole]
        entries = part[:20]
        for _ in range(4):
            entries = _moved(part, _round(part, entries)[0], entries)
        found, far = _round(part, entries)
        books.append(entries)
        for i, (c, f) in enumerate(zip(found, far, strict=True)):
            code[i].append(c)
            error[i] += f
    by_label = Counter()
    for (_, _, label), e in zip(rows, error, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()
    done = codes.compress(table, entries=20)
    got = sorted(map(tuple, codes.digest_columns(done).collect()))
    assert got == [(i, "".join(f"{c:02x}" for c in cs), e, by_label[label], digest) for (i, _, label), cs, e in zip(rows, code, error, strict=True)]
    back = {r.vec_id: r.vector for r in done.restored().collect()}
    assert all(sum((a - b) ** 2 for a, b in zip(back[i], v, strict=True)) == e for (i, _, _), v, e in zip(rows, whole, error, strict=True))


def test_centroids_equal_a_plain_version(spark):
    table = spark.createDataFrame(vector_rows(80, 64, 9), VECTORS).repartition(4)
    rows = sorted((r.vec_id, r.embedding) for r in table.collect() if _fine(r.embedding) and len(r.embedding) == 64)
    whole = [_ints(v, 64) for _, v in rows]
    start = sorted(range(len(rows)), key=lambda i: hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest())[:16]
    entries = [whole[i] for i in start]
    for _ in range(3):
        entries = _moved(whole, _round(whole, entries)[0], entries)
    found, far = _round(whole, entries)
    of = Counter()
    for c, f in zip(found, far, strict=True):
        of[c] += f
    digest = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in entries]
    got = sorted(map(tuple, centroids.digest_columns(centroids.cluster(table)).collect()))
    assert got == [(i, c, f, of[c], sum(far), digest[c]) for (i, _), c, f in zip(rows, found, far, strict=True)]


def test_vector_tables_with_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(None, [0.25] * 64, None), (3, [1e38, -1e38] * 32, 1), (3, [0.5] * 64, 1), (3, [0.5] * 64, 1), (4, None, 2), (None, None, None)]
    odd = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("v", "d", "codes", "error", "cluster", "distance", "part", "entry", "_key", "label_error")})
    got = codes.digest_columns(codes.compress(odd)).collect()
    assert len(got) == 4 and all(r.error == 0 for r in got)
    assert len({r.code for r in got if r.vec_id == 3}) == 2 and {r.label_error for r in got} == {0}
    got = centroids.digest_columns(centroids.cluster(odd)).collect()
    assert len(got) == 4 and all(r.distance == 0 for r in got) and len({r.cluster for r in got}) == 3
    for empty in (odd.limit(0), odd.filter("embedding is null")):
        assert codes.digest_columns(codes.compress(empty)).collect() == []
        assert centroids.digest_columns(centroids.cluster(empty)).collect() == []
    doubles = spark.createDataFrame([(1, [0.1, 0.2, 0.3, 0.4]), (2, [0.5, -0.25, 1.0, 2.0]), (3, [0.5])], "vec_id int, embedding array<double>").withColumn("label", F.lit(None).cast("int"))
    assert sorted(r.vec_id for r in codes.compress(doubles).codes.collect()) == [1, 2]
