import hashlib
import random
import re

import pytest

from helpers import crc, frame, prose, tokens
from polytag.llm import mixing, pii


def brute_mix(rows, weights=(5, 2, 1)):
    size = {i: len(tokens(t)) for i, t, _ in rows}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {n: sum(size[i] for i, _, s in rows if s == n) for n in names}
    weight = {n: weights[k % 3] for k, n in enumerate(names)}
    items = []
    for n in names:
        queue = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, _, s in rows if s == n)
        upto = 0
        for digest, i in queue:
            upto += size[i]
            items += [((e * total[n] + upto) / weight[n], names.index(n), digest, i, e) for e in range(3)]
    budget, used, taken = sum(total.values()), 0, dict.fromkeys(size, 0)
    for *_, i, _e in sorted(items):
        used += size[i]
        if used > budget:
            break
        taken[i] += size[i]
    full, share = set(), {}
    while True:
        rest = budget - sum(3 * total[n] for n in full)
        w = sum(weight[n] for n in names if n not in full)
        share = {n: 3 * total[n] if n in full else rest * weight[n] / w for n in names}
        over = {n for n in names if n not in full and share[n] > 3 * total[n]}
        if not over:
            return taken, share
        full |= over


def test_mix_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(0, 60)), rng.choice(["a", "b", "b", "b", "b", None, "", "c"])) for i in range(300)]
    got = mixing.mix(frame(spark, rows), span_rows=20).collect()
    taken, share = brute_mix(rows)
    assert {r.doc_id: r.taken for r in got} == taken
    assert all(abs(r.target - share[r.source]) < 1e-6 * max(1, share[r.source]) for r in got)
    assert sorted(tuple(r) for r in mixing.mix(frame(spark, rows), span_rows=5000).collect() if r.source) == sorted(tuple(r) for r in got if r.source)
    out = mixing.mixed_documents(frame(spark, rows))
    assert {r.doc_id: r.taken for r in out.collect()} == {k: v for k, v in taken.items() if v}


BASE = dict(
    email=r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", ip=r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    card=r"[0-9]([\x20-]?[0-9])+", phone=r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")),
            "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


TRICKY = [
    "a@b.c+d@e.f x@y z@w.q. é@ü.de ünï@mail.example.com", "1.2.3.4.5.6.7.8 0001.002.3.255 256.1.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (502) 555-8498 +49 30.1234567 +1 22", "9" * 5000, "12 " * 3000, "a" * 5000, "+1" + " " * 2000 + "x", "漢字 4111111111111111漢字 a@b.co\n+15025558498",
    "card 4111 1111 1111 1111 4111 1111 1111 1111", "x..y@a-b.c--d.e", "", None,
]


def test_base_spans_equal_the_plain_patterns(spark):
    got = {r.doc_id: r for r in pii.digest_columns(pii.personal_data(frame(spark, list(enumerate(TRICKY))))).collect()}
    for i, t in enumerate(TRICKY):
        want = [f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(BASE[k], t or "") if passes(k, m[0])]
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t or "")[:80]
        assert set(want) <= set(got[i].spans.split(",")) or not want


def test_trees_learn_and_thresholds_are_calibrated():
    rows = [((0, d, 3, 4, 0, 0, 0, 2, 1, 1, c, 0, 0), float(50 * (d > 8)), float(50 * (d <= 8))) for d in range(5, 14) for c in (0, 1)]
    base, trees = pii.boost(rows, (1, 10))
    scored = [(base + sum(pii._value(t, x) for t in trees), p, n) for x, p, n in rows]
    cut = pii.threshold(scored)
    assert all((s >= cut) == (p > 0) for s, p, _ in scored)
    assert pii.boost(rows[:2], (1,))[1] == [] and pii.threshold([(1.0, 1.0, 9.0)]) == float("inf")


def test_thresholds_count_the_combinations_that_are_not_fitted_on(spark):
    def row(i, passes, digits, gaps):
        f = dict.fromkeys(pii.FEATURES, 0) | {"generator": 1, "digits": digits, "gaps": gaps}
        return i, [(0, 9, passes, tuple(f[k] for k in pii.FEATURES))]

    schema = f"doc_id long, candidates array<struct<start:int,end:int,passes:string,f:struct<{','.join(f'{k}:int' for k in pii.FEATURES)}>>>"
    common = [row(i, "phone" if i % 2 else None, 12 if i % 2 else 7, 0) for i in range(400)]
    # rare formats look like the passing ones, and fail
    rare = [row(1000 + i, None, 13 + i % 7, 1 + i // 7 % 6) for i in range(210)]
    good = pii.train(spark.createDataFrame(common, schema), 2)["phone"]
    assert good[1] and good[2] < float("inf")
    frame_ = spark.createDataFrame(common + rare, schema)
    assert pii.train(frame_, 2)["phone"][2] == float("inf")
    base, trees, cut = pii.train(frame_)["phone"]
    every = [(base + sum(pii._value(t, c[0][3]) for t in trees), c[0][2] == "phone") for i, c in common + rare if crc(i) % 4 == 2]
    assert cut == pytest.approx(pii.threshold([(round(s, 9), float(p), float(not p)) for s, p in every])) and cut < float("inf")


def test_redaction_replaces_spans_and_keeps_the_rest(spark):
    rows = [(1, "mail bob@x.org or +1 (502) 555-8498, ip 10.0.0.1."), (2, "nothing here"), (3, None)]
    out = {r.doc_id: r for r in pii.redact(frame(spark, rows)).collect()}
    assert out[1].text == "mail [EMAIL] or [PHONE], ip [IP]." and out[1].n_chars == len(out[1].text)
    assert out[2].text == "nothing here" and out[3].text is None and out[2].n_chars == 12


def test_plans_hold_no_python(spark, capsys):
    pii.redact(frame(spark, [(1, "a@b.co")])).explain()
    assert "Python" not in (shown := capsys.readouterr().out) and "Arrow" not in shown and "Pandas" not in shown


def test_equal_rows_are_taken_one_by_one(spark):
    from polytag.llm import mixing

    rows = [(0, "a b c d e", "x")] * 4 + [(i, "one two three", "y") for i in range(1, 9)] + [(None, "p q", None)] * 3
    docs = frame(spark, rows)
    mixed, out = mixing.mix(docs).collect(), mixing.mixed_documents(docs).collect()
    assert sorted(((r.doc_id or -1, r.taken) for r in out)) == sorted(((r.doc_id or -1, r.taken) for r in mixed if r.taken))
    assert sum(r.taken for r in out) == sum(r.taken for r in mixed) <= sum(r.size for r in mixed)
