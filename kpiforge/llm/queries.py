"""The registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.llm import (bpe, clustering, hardneg, langid, linededup, minhash, packing, pii, quality, simhash,
                          tokencount, tokenfile, vecdedup)
from kpiforge.llm.common import documents, embeddings

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, write the files, read the files back."""
    return tokenfile.read_digests(spark, tokenfile.token_files(documents(spark, sf_dir)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(documents(spark, sf_dir))


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(documents(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.summary(documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.with_edits(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.edited_counts(documents(spark, sf_dir), tokencount.redactions).drop("tree")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(embeddings(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.hard_negatives(hardneg.relabelled(embeddings(spark, sf_dir)))


def op13_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_duplicates(embeddings(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_token_files, op2_language_id, op3_pii_spans, op4_byte_bpe, op5_packing, op6_quality_rules,
        op7_line_dedup, op8_fingerprints, op9_simhash, op10_token_counts,
        op11_centroid_clusters, op12_hard_negatives, op13_vector_near_dedup)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL can express an operator."""
    return {"op6_quality_rules": quality.VERDICTS_SQL, "op11_centroid_clusters": clustering.CLUSTERS_SQL,
            "op12_hard_negatives": hardneg.HARD_NEGATIVES_SQL, "op13_vector_near_dedup": vecdedup.NEAR_DUPLICATES_SQL}
