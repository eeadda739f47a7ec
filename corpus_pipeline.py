"""A training corpus from raw documents: quality, near-duplicates, secrets, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; each one's result is written and read again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import bpe, mixing, near, quality, secrets
from strandlake.llm.common import materialize
from strandlake.session import table

#: What mixing makes of each domain's expected tokens: clean documents are kept and a few repeated, toxic ones thinned.
#: Low quality is the first stage's work: little of it is left, and a target of its own would move clean documents' rates.
FACTORS = {"clean": 1.1, "toxic": 0.3, "low": 1.1}
RANKS = "byte_bpe_multi_50k.tiktoken"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a shingle similarity of 0.8 or more."""
    return near.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose live-looking secrets are masked."""
    return secrets.redact(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates say that bring the domains to their targets."""
    return mixing.resample(docs, table(spark, sf_dir, "labels"), lambda names: mixing.factor_targets(FACTORS, names))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the final documents."""
    return bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-duplicates", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing to target weights", mix_domains),
    ("byte-level BPE", encode_tokens),
]

#: The stages have models and hashes that SQL lacks; tests/llm/test_pipeline.py checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
