"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order (by a digest of the id), repeated up to
``PASSES`` times.  A document's virtual finish time in pass e is (e * source size + words of its source up to and including it) / weight:
a source of twice the weight moves through its queue twice as fast.  The mix is the beginning of all
queues merged by finish time, cut where the total budget is used up; a source whose passes have
run out leaves its share to the others, which is just the reshared target.

Scale: only slim rows (id, source, size, digest) move.  A source's running sum is taken in buckets of
the shuffle digest (their number follows the row count, a hot source is many buckets) plus the sums of the buckets before.  The
global order is cut into equal spans of virtual time, so a span holds about the same number of words; only the span
in which the budget ends is sorted row by row, and the place of the cut is one row.  Word counts are
computed once and written.

Cases: sources order by code point, null last, and weigh 5, 2, 1, 5, ...; a null or empty text has size 0 and
is taken 0 times its size; a null id shuffles as the empty id; rows that repeat an id follow each other in the queue; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Scratch, with_row_numbers

WEIGHTS = (5, 2, 1)
PASSES = 3
#: rows that one bucket or one span of virtual time holds, about
SPAN_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(source, size, ...) -> one row per source: rank, weight, source_size, level, target.

    The targets share the total by weight, none above ``passes`` times its source: sources are filled in order of
    passes * size / weight; level is the virtual time at which the rest of the budget is used up by the sources not yet full.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(by_name) - 1)
    one = one.withColumn("weight", F.array(*map(F.lit, weights))[F.col("rank") % len(weights)].cast("long"))
    one = one.withColumn("full_at", (passes * F.col("source_size")) / F.col("weight"))
    before = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    filled = one.withColumns({
        "total": F.sum("source_size").over(every),
        "taken": F.coalesce(F.sum(passes * F.col("source_size")).over(before), F.lit(0)),
        "gone": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "all_weight": F.sum("weight").over(every),
    }).withColumn("at", (F.col("total") - F.col("taken")) / (F.col("all_weight") - F.col("gone")))
    level = F.min_by(F.when(F.col("full_at") >= F.col("at"), F.col("at")), F.when(F.col("full_at") >= F.col("at"), F.struct("full_at", "rank"))).over(every)
    return filled.withColumn("level", level).select(
        "source", "rank", "weight", "source_size", "total", "level",
        F.least((passes * F.col("source_size")).cast("double"), F.col("weight") * F.col("level")).alias("target"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, span_rows: int = SPAN_ROWS, row: str | None = None) -> DataFrame:
    """documents (doc_id, source, text, ...) -> doc_id, source, text_key, size, source_size, target, taken; one row per row.

    ``row`` names a column to carry along as ``row``."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = scratch.write(
        docs.select(
            F.col("doc_id").cast("long"), F.col("source").cast("string"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("digest"), F.xxhash64(text).alias("text_key"),
            *([F.col(row).alias("row")] if row else []),
        ),
        "sizes",
    )
    rows = slim.count()
    # source-sized: one row per source, kept as a table
    targets = scratch.write(source_targets(slim, weights, passes), "targets")
    slim = slim.join(targets, slim["source"].eqNullSafe(targets["source"])).select(slim["*"], "rank", "weight", "source_size", "target", "total", "level")

    digits = 1
    while 16**digits * span_rows < rows:
        digits += 1
    slim = slim.withColumn("bucket", F.conv(F.substring("digest", 1, digits), 16, 10).cast("long"))
    sums = slim.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("rank", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    here = Window.partitionBy("rank", "bucket").orderBy("digest", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    queued = scratch.write(
        slim.withColumn("words", F.sum("size").over(here)).join(starts, ["rank", "bucket"])
        .select(*slim.columns, (F.col("start") + F.col("words")).alias("upto")),
        "queued",
    )

    # spans of virtual time: as many up to the level as there are span_rows rows, the last one open
    spans = max(16, passes * rows // span_rows)
    finish = [((e * F.col("source_size") + F.col("upto")) / F.col("weight")).alias("finish") for e in range(passes)]
    span = lambda t: F.least(F.coalesce(F.floor(t * spans / F.col("level")), F.lit(0)), F.lit(2 * spans)).cast("long")
    key = lambda e: F.struct(finish[e], "rank", "digest", "doc_id", "size", "text_key", F.lit(e).alias("pass"))
    items = queued.select("size", "total", F.explode(F.array(*(F.struct(span(finish[e]).alias("span"), key(e).alias("key")) for e in range(passes)))).alias("i"))
    items = items.select("size", "total", "i.span", "i.key")
    line = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
    full = items.groupBy("span").agg(F.sum("size").alias("words"), F.max("total").alias("total")).withColumn("upto", F.sum("words").over(line))
    edge = full.filter("upto > total").orderBy("span").select("span", (F.col("upto") - F.col("words")).alias("start"), "total").first()
    if edge is None:
        taken = F.lit(passes) if rows else F.lit(0)
    else:
        inside = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
        last = (
            items.filter(F.col("span") == edge["span"]).withColumn("upto", F.sum("size").over(inside) + edge["start"])
            .filter(F.col("upto") <= edge["total"]).agg(F.max("key").alias("k")).first()["k"]
        )
        if last is None:
            within = [F.lit(False)] * passes
        else:
            cut = F.struct(*(F.lit(last[n]).cast(t).alias(n) for n, t in (
                ("finish", "double"), ("rank", "int"), ("digest", "string"), ("doc_id", "long"), ("size", "long"), ("text_key", "long"), ("pass", "int"))))
            within = [(span(finish[e]) == edge["span"]) & (key(e) <= cut) for e in range(passes)]
        taken = sum((((span(finish[e]) < edge["span"]) | within[e]).cast("long") for e in range(passes)), F.lit(0))
    return queued.select(*(["row"] if row else []), "doc_id", "source", "text_key", "size", "source_size", "target", (F.col("size") * taken).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, all columns as given plus size, source_size, target, taken; those not taken go.  Of equal rows each is taken for itself."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows, number = with_row_numbers(docs, scratch)
    new = ("size", "source_size", "target", "taken")
    found = mix(rows, row=number).filter("taken > 0").select(F.col("row").alias("_taken_row"), *new)
    rest = [c for c in docs.columns if c not in new]
    return rows.select(number, *rest).join(found, F.col(number) == F.col("_taken_row")).select(*rest, *new)
