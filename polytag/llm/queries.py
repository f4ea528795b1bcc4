"""The registered queries of this package, one per operator: each runs its operator with production
parameters over whole tables and derives the digest columns of the result from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, codes, decontaminate, fingerprint, langmodel, licenses, linefreq, mixing, neardup, pii, quality, secrets, toxicity
from .store import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op2_fair_queue_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("source", "text_key")


@query
def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.personal_data(read_table(spark, sf_dir, "documents")))


@query
def op5_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op6_content_defined_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.neighbour_fingerprints(read_table(spark, sf_dir, "documents"))


@query
def op7_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(read_table(spark, sf_dir, "documents"))


@query
def op9_context_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.score(read_table(spark, sf_dir, "documents"))


@query
def op10_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.find_secrets(read_table(spark, sf_dir, "documents")))


@query
def op11_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linefreq.quality_rules(read_table(spark, sf_dir, "documents"))


@query
def op12_pivot_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest_columns(codes.compress(read_table(spark, sf_dir, "embeddings")))


@query
def op13_pivot_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest_columns(centroids.cluster(read_table(spark, sf_dir, "embeddings")))
