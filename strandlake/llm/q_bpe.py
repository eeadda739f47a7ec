"""op10: byte-level BPE digests of every document. SQL has no BPE; tests compare with the library."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import bpe
from strandlake.session import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


QUERIES = {"op10_bpe": op10_bpe}
ORACLES: dict[str, str] = {}
