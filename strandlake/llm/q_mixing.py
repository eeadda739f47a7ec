"""op3: document rates that bring the labelled domains to target weights. The classifier's hashes have no SQL form in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import mixing
from strandlake.session import table

#: Shares of all tokens.
WEIGHTS = {"clean": 0.85, "toxic": 0.05, "low": 0.10}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda names: mixing.share_targets(WEIGHTS, names))
    return out.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


QUERIES = {"op3_mixing": op3_mixing}
ORACLES: dict[str, str] = {}
