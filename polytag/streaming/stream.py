"""Structured Streaming forms of scoring, model counts and windowed measures.

Sources are Parquet directories read with ``readStream``; sinks are written by
``foreachBatch`` into per-batch directories named by the batch id (an
overwrite per batch id makes a replayed batch idempotent).  Sums and windows
are the state of streaming aggregates in update mode.  Every query keeps its
checkpoint under the shared checkpoint folder, so a restart resumes exactly
where it stopped.  Triggers are ``availableNow``: all files present are
processed, in as many micro-batches as ``maxFilesPerTrigger`` allows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from polytag.session import scratch_path

#: rows of a staged file, as far as the session's cores give enough files
FILE_ROWS = 100_000


def stage_files(df: DataFrame, path: str, parts: int = 3, key: str = "id", part_col=None, rows_per_file: int = FILE_ROWS) -> int:
    """Write ``df`` as Parquet files to feed a stream, one sub-folder per part (split by a stable hash of
    ``key``, or by ``part_col`` when given, e.g. a time range), and return the files per part: a stream whose
    ``maxFilesPerTrigger`` is that number takes a part per batch, however many rows there are.  A part of very few rows may have fewer files;
    the next part then begins in the same batch.  The rows are derived once."""
    from polytag.functions.labelsets import stable_hash
    from polytag.operators.nb import materialize

    pc = F.pmod(stable_hash(key, 17), F.lit(parts)) if part_col is None else part_col
    x, rows = materialize(df.withColumn("_part", pc))
    files = max(1, min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / (parts * rows_per_file))))
    for p in range(parts):
        x.filter(F.col("_part") == p).drop("_part").repartition(files).write.mode("overwrite").parquet(f"{path}/p{p}")
    return files


def _run(writer, name: str, spark: SparkSession, checkpoint: str | None = None) -> None:
    where = checkpoint or scratch_path(spark, f"ckpt-{name}")
    q = writer.option("checkpointLocation", where).trigger(availableNow=True).start()
    q.awaitTermination()


def score_stream(spark: SparkSession, src: str, schema, score_fn, out: str, files_per_batch: int = 1) -> DataFrame:
    """Score rows as they arrive: ``score_fn(batch_df) -> DataFrame`` runs on every micro-batch
    (column expressions and joins with small model tables only); returns the sink as a table."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(src)

    def sink(bdf: DataFrame, bid: int) -> None:
        score_fn(bdf).write.mode("overwrite").parquet(f"{out}/batch={bid}")

    _run(stream.writeStream.foreachBatch(sink), "score", spark)
    return spark.read.parquet(out)


def count_stream(spark: SparkSession, src: str, schema, cells_fn, out: str, keys: list[str], values: tuple[str, ...] = ("n",),
                 files_per_batch: int = 1, checkpoint: str | None = None, compact_every: int = 50) -> DataFrame:
    """Keep sums current: ``cells_fn(stream)`` is a projection to ``keys`` and the numbers ``values``, whose sums per key are the state of a
    streaming aggregate (one state row per distinct key).  A micro-batch writes the new totals of the keys it changed; every
    ``compact_every`` batches the totals of all keys become a snapshot, and later reads (``current_counts``) take the
    newest snapshot and the batches after it, nothing older.

    With the same ``checkpoint`` (a folder that outlives the run) and ``out``, a later call goes on after the last finished batch.  A batch
    that is replayed after a failure starts from the state before it and overwrites its own folder, so no row counts twice.
    Returns the current totals (keys..., values...); a null key is a key; without any row the table is empty."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(src)
    totals = cells_fn(stream).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
    empty = spark.createDataFrame([], totals.schema)
    empty.write.mode("overwrite").parquet(f"{out}/changes/batch=-1")
    empty.write.mode("overwrite").parquet(f"{out}/snapshots/batch=-1")

    def sink(bdf: DataFrame, bid: int) -> None:
        bdf.write.mode("overwrite").parquet(f"{out}/changes/batch={bid}")
        if (bid + 1) % compact_every == 0:
            current_counts(spark, out, totals.schema, keys, values, bid).write.mode("overwrite").parquet(f"{out}/snapshots/batch={bid}")

    _run(totals.writeStream.outputMode("update").foreachBatch(sink), "counts", spark, checkpoint)
    return current_counts(spark, out, totals.schema, keys, values)


def current_counts(spark: SparkSession, out: str, schema, keys: list[str], values: tuple[str, ...] = ("n",), upto: int | None = None) -> DataFrame:
    """The totals that ``count_stream`` keeps under ``out`` (as of batch ``upto``): each key's latest ones.  Only the newest snapshot older than
    ``upto`` and the changes after it are read; the rest is pruned by folder name."""
    def table(name: str) -> DataFrame:
        x = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{out}/{name}")
        return x if upto is None else x.filter(F.col("batch") < upto if name == "snapshots" else F.col("batch") <= upto)

    newest = table("snapshots").agg(F.max("batch").alias("b")).first()["b"]
    newest = -1 if newest is None else newest
    x = table("snapshots").filter(F.col("batch") == newest).unionByName(table("changes").filter(F.col("batch") > newest))
    last = x.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return last.select(*keys, *[F.col("_v")[v].alias(v) for v in values])


def windowed_measures(spark: SparkSession, src: str, schema, out: str, window: str = "7 days", watermark: str = "1 day",
                      files_per_batch: int = 1) -> DataFrame:
    """Hamming loss and micro F1 per event-time window; rows later than the watermark are dropped.
    Input rows carry ``ts``, per-row confusion counts tp, fp, fn, tn and the label count L.  Windows
    are emitted in update mode; each batch writes its updated windows under its batch id and the
    result keeps the latest version of every window (replay-safe)."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(src)
    agg = (stream.withWatermark("ts", watermark)
           .groupBy(F.window("ts", window).alias("w"))
           .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("tn").alias("tn"),
                F.sum("L").alias("cells")))

    def sink(bdf: DataFrame, bid: int) -> None:
        bdf.select(F.col("w.start").alias("window_start"), "tp", "fp", "fn", "tn", "cells", F.lit(bid).alias("bid")) \
            .write.mode("overwrite").parquet(f"{out}/batch={bid}")

    _run(agg.writeStream.outputMode("update").foreachBatch(sink), "windows", spark)
    from pyspark.sql.window import Window

    x = spark.read.parquet(out)
    latest = Window.partitionBy("window_start").orderBy(F.col("bid").desc())  # one row per window and batch
    x = x.withColumn("_r", F.row_number().over(latest)).filter("_r = 1")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = F.when(tp + fp + fn == 0, 1.0).otherwise(2 * tp / (2 * tp + fn + fp))
    return x.select("window_start", ((fp + fn) / F.col("cells")).alias("hamming_loss"), f1.alias("micro_f1"))
