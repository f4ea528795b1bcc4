"""Queries added this round run end to end on sf0.001 with a stable schema (a registered query that
never runs is how a broken learner slipped through before)."""

import pytest

from datadirs import SF

NEW = [
    "ln_dmlknn", "conditional_dependence", "th_expected_measure", "strat_iterative", "ln_stacking",
    "ln_two_stage_chain", "ln_two_stage_pruned_chain", "sample_by_cost", "label_kmodes_parallel_init",
    "ln_ranking_perceptron",
]


@pytest.mark.parametrize("name", NEW)
def test_new_query_runs(spark, name):
    import __spark_entry__ as E

    q = E.queries()[name]
    df = q(spark, SF)
    schema = df.schema.simpleString()
    n = df.count()
    assert n > 0
    assert q(spark, SF).schema.simpleString() == schema
    sql = E.oracle_sql().get(name)
    if sql is not None:
        import duckdb

        con = duckdb.connect()
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                  "embeddings", "pages", "benchmark", "labels", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        rows = con.execute(sql).fetchall()
        assert len(rows) == n
