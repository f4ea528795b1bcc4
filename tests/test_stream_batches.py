"""A staged part is one micro-batch, however many files the rows need."""

from pathlib import Path

from pyspark.sql import functions as F

from polytag.streaming import stream as STM


def test_batches_do_not_grow_with_the_files(spark, tmp_path):
    rows = spark.range(0, 900, 1, 7).select("id", F.array((F.col("id") % 2).cast("int")).alias("y"))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    files = STM.stage_files(rows, src, parts=3, rows_per_file=100)
    assert files == 3 and len(list(Path(src).rglob("*.parquet"))) == 9
    got = STM.count_stream(spark, src, rows.schema, lambda x: x.select(F.explode("y").alias("t"), F.lit(1).alias("n")), out, ["t"], files_per_batch=files)
    assert {r["t"]: r["n"] for r in got.collect()} == {0: 450, 1: 450}
    assert len([p for p in Path(out, "changes").iterdir() if p.name.startswith("batch=") and p.name != "batch=-1"]) == 3


def test_few_rows_over_many_input_parts_are_one_file_a_part(spark, tmp_path):
    assert STM.stage_files(spark.range(0, 900, 1, 40), str(tmp_path / "in"), parts=3) == 1
    assert len(list(Path(tmp_path, "in").rglob("*.parquet"))) == 3
