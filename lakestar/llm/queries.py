"""Registered queries of the corpus operators: each runs over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lakestar.llm import (
    best_fit,
    collision_ann,
    language_id,
    license_scan,
    order_minhash,
    paragraph_sketch,
    periodic_runs,
    quality_fm,
    secret_ledger,
    soft_mix,
    spelling_variants,
    token_count,
    toxic_neighbours,
)
from lakestar.llm.common import read_table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every document."""
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def op2_language_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language_id.identify(read_table(spark, sf_dir, "documents"),
                                public_tokenizers.path("piece_bpe_32k.model"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    return token_count.token_counts(read_table(spark, sf_dir, "documents"),
                                    public_tokenizers.path("word_bpe_49k.json"))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; the run starts from an empty ledger."""
    return secret_ledger.scan(read_table(spark, sf_dir, "documents"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return order_minhash.duplicate_classes(read_table(spark, sf_dir, "documents"))


def op6_soft_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and mixing rate of every document."""
    return soft_mix.mix_rates(read_table(spark, sf_dir, "documents"),
                              read_table(spark, sf_dir, "labels"))


def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_fm.assess(read_table(spark, sf_dir, "documents"),
                             read_table(spark, sf_dir, "labels"))


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing of every document."""
    return best_fit.pack(read_table(spark, sf_dir, "documents"),
                         public_tokenizers.path("byte_bpe_50k.json"))


def op9_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return collision_ann.nearest(read_table(spark, sf_dir, "embeddings"))


def op10_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return paragraph_sketch.fingerprints(read_table(spark, sf_dir, "documents"))


def op11_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of every frequent word, some words of every document slipping a letter."""
    return spelling_variants.variants(read_table(spark, sf_dir, "documents"),
                                      spelling_variants.slips)


def op12_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxic_neighbours.assess(read_table(spark, sf_dir, "documents"),
                                   read_table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document."""
    return periodic_runs.run_digests(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_language_unigrams, op3_token_counts, op4_secret_ledger,
    op5_order_minhash, op6_soft_mix, op7_quality_fm, op8_best_fit,
    op9_collision_ann, op10_paragraph_sketch, op11_permuterm_variants, op12_toxic_neighbours,
    op13_periodic_runs)}

ORACLES: dict[str, str] = {"op4_secret_ledger": secret_ledger.oracle(),
                           "op11_permuterm_variants": spelling_variants.oracle()}
