"""Nulls, empty and very long texts, repeated rows, null ids, clashing columns and empty tables, for every operator and stage."""

import pytest

import corpus_pipeline
from helpers import SCHEMA, odd_rows
from polytag.llm import decontaminate, fingerprint, langmodel, licenses, mixing, neardup, pii, quality, secrets, toxicity


def tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, 1), (5, 1, 0), (None, 1, 1), (6, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "same text of seven words in all and more"), (3, "a b"), (None, "lorem ipsum dolor " * 5)], "item_id long, text string")
    return labels, bench


OPERATORS = {
    "toxicity": lambda d, l, b: toxicity.toxicity(d, l), "mixing": lambda d, l, b: mixing.mix(d), "neardup": lambda d, l, b: neardup.near_duplicates(d),
    "pii": lambda d, l, b: pii.digest_columns(pii.personal_data(d)), "quality": lambda d, l, b: quality.quality(d, l),
    "fingerprint": lambda d, l, b: fingerprint.neighbour_fingerprints(d), "secrets": lambda d, l, b: secrets.digest_columns(secrets.find_secrets(d)),
    "langmodel": lambda d, l, b: langmodel.score(d, bits=16),
}
FINDERS = {"decontaminate": lambda d, l, b: decontaminate.contaminated(d, b, bits=16), "licenses": lambda d, l, b: licenses.licenses(d)}


@pytest.mark.parametrize("name", [*OPERATORS, *FINDERS])
def test_odd_rows_and_empty_tables(spark, name):
    op = {**OPERATORS, **FINDERS}[name]
    labels, bench = tables(spark)
    docs = odd_rows(spark)
    rows = op(docs, labels, bench).collect()
    if name in OPERATORS:
        assert len(rows) == docs.count()
        by = [tuple(r) for r in rows if r.doc_id == 4]
        # a fingerprint row also tells of the row after it
        assert len(by) == 2 and (by[0] == by[1] or name == "fingerprint")
    empty = spark.createDataFrame([], SCHEMA)
    assert op(empty, labels.limit(0), bench.limit(0)).collect() == []


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    labels, bench = tables(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd_rows(spark)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, str(tmp_path))
            rows = out.collect()
            if n < len(corpus_pipeline.STAGES) - 1:
                assert out.dtypes == docs.dtypes
            assert len(rows) <= table.count()
