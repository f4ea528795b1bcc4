"""Join of many rows with a table of distinct keys, whatever the table's size and however hot a key is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a lookup table of at most so many rows of a few numbers is broadcast (tens of MB); a larger one is joined by salted shuffle
BROADCAST_ROWS = 500_000
#: a key's rows are spread over so many tasks, and its table row is sent to each of them
SALTS = 32


def if_small(table: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it is counted small, else as it is (joined by shuffle)."""
    return F.broadcast(table) if table.limit(broadcast_rows + 1).count() <= broadcast_rows else table


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", spread: Column | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` joined with ``table`` (one row per ``key``, null keys equal); ``spread`` is hashed to salt hot keys.

    ``table`` must be a written table: it is counted first.  The result has the columns of both, ``key`` once.
    """
    other = table.withColumnRenamed(key, "_key")
    if table.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(other), rows[key].eqNullSafe(F.col("_key")), how).drop("_key")
    other = other.withColumn("_other_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread if spread is not None else F.rand()), F.lit(SALTS)).cast("int"))
    on = salted[key].eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_other_salt"))
    return salted.join(other, on, how).drop("_key", "_salt", "_other_salt")
