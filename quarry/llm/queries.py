"""The registered queries of these operators, each over its whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cotrain, decontaminate, fingerprint, langid, lexicon, license, neardup, repeats, sstable, toxicity
from .shared import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_evidence_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op5_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(table(spark, sf_dir, "documents"))


def op6_sstable_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.digest(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_probminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op9_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_tree_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_imatch_fingerprints,
        op2_template_decontamination,
        op3_factorization_toxicity,
        op4_evidence_language,
        op5_diagonal_licenses,
        op6_sstable_token_ids,
        op7_transducer_bpe,
        op8_probminhash_neardup,
        op9_cotraining_quality,
        op10_suffix_tree_repeats,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_template_decontamination": decontaminate.oracle(), "op5_diagonal_licenses": license.oracle()}
