"""op8: secrets in every document. Match offsets have no SQL form in the oracle; tests use brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import secrets
from strandlake.session import table


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


QUERIES = {"op8_secrets": op8_secrets}
ORACLES: dict[str, str] = {}
