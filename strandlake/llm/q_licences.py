"""op6: licence notices in every document. A trained classifier has no SQL form; tests use held-out notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import licences
from strandlake.session import table


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.fit())


QUERIES = {"op6_licences": op6_licences}
ORACLES: dict[str, str] = {}
