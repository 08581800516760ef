"""Corpus pipeline: language ID, near-dedup, secret scan, source mixing, packing.

Every stage takes what its predecessor kept and returns it as a table of the columns of
``documents``; the last returns packed pieces.  Null texts have no language and go in the first
stage; an empty table passes through all stages; extra columns are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestar.llm import best_fit, language_id, order_minhash, secret_ledger, soft_mix
from lakestar.llm.common import id_mod, read_table, stored

#: Documents whose predicted language has a lower posterior are rejected.
MIN_LANGUAGE_SCORE = 0.5


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, and those no language explains, go."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    seen = docs.where(id_mod(F.col("doc_id"), language_id.FOLDS) != language_id.HELD_FOLD)
    return language_id.known_language(docs, path, language_id.learn(seen, path),
                                      MIN_LANGUAGE_SCORE)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: the document of smallest id of each class stays."""
    return order_minhash.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: every span found is replaced by a mark."""
    return secret_ledger.redacted(docs, secret_ledger.update_ledger(docs))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: rows are repeated or left out so that domains meet their token shares."""
    return soft_mix.mixed(docs, read_table(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of all that is left."""
    return best_fit.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", keep_known_language),
    ("near_dedup", keep_one_of_each),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_domains),
    ("packing", pack_sequences),
]

#: Models are learned and texts are tokenised: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline", name)
    return STAGES[-1][1](spark, docs, sf_dir)
