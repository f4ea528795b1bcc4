"""The pipeline's stages against plain-Python versions of their decisions, each on its own input."""

import hashlib

import duckdb

import __spark_entry__ as entry
import corpus_pipeline
from helpers import shingles, tokens
from test_mixing_pii import BASE, brute_mix, passes
from test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark, tmp_path):
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        seen.append(({r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()}))
        docs = after
    (d0, d1), (_, d2), (_, d3), (_, d4), (_, d5) = seen
    from polytag.llm import toxicity

    rejected = {r.doc_id for r in toxicity.toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    assert set(d1) == set(d0) - rejected
    groups = brute([(i, r.text) for i, r in d1.items()])
    assert set(d2) == {i for i, g in groups.items() if g[2]}
    items = [tuple(tokens(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    whole = {i for i, r in d2.items() if any(m in runs(tokens(r.text), len(m)) for m in items)}
    part = {i for i, r in d2.items() if any(runs(m, 8) & runs(tokens(r.text), 8) for m in items)}
    assert whole <= set(d2) - set(d3) <= part
    for i, r in d4.items():
        if not any(passes(k, m[0]) for k in BASE for m in re.finditer(BASE[k], d3[i].text or "")):
            continue
        assert not any(passes(k, m[0]) for k in ("email", "ip", "phone") for m in re.finditer(BASE[k], r.text)) and r.n_chars == len(r.text)
    taken, share = brute_mix([(i, r.text, r.source) for i, r in d4.items()])
    assert {i: r.taken for i, r in d5.items()} == {i: n for i, n in taken.items() if n}
    assert hashlib.md5(b"").hexdigest() and shingles("") == set()


def test_sql_twins_at_the_smallest_size(spark):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("op2_fair_queue_mixing", "op3_minhash_neardup"):
        df = entry.queries()[name](spark, SF)
        got = con.execute(entry.oracle_sql()[name])
        cols = [c[0] for c in got.description]
        assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, got.fetchall()))
