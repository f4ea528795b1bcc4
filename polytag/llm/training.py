"""Labelled training rows for the document classifiers: a bounded sample, chosen by id alone.

``SAMPLE_ROWS`` is the documented bound: of the labelled documents that may be learned from, those with the
smallest hash of their id, at most so many.  Everything else (scoring) covers all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import crc_rest

SAMPLE_ROWS = 12_000
#: documents whose crc32(doc_id as text) modulo FOLDS is HELD_OUT are never learned from
FOLDS, HELD_OUT = 4, 2


def sample_labels(labels: DataFrame, column: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, label) of at most ``rows`` documents; a document labelled more than once counts as its largest label."""
    usable = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (crc_rest(F.col("doc_id"), FOLDS) != HELD_OUT))
    one = usable.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    return one.orderBy(F.xxhash64("_id"), "_id").limit(rows)


def sampled_documents(docs: DataFrame, labels: DataFrame, column: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label) of the sample; the id side of the join has at most ``rows`` rows, so it is broadcast."""
    picked = sample_labels(labels, column, rows)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(
        F.broadcast(picked), F.col("doc_id") == F.col("_id")
    ).select("doc_id", "text", "label")
