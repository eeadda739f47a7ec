"""op7: quality scores of every document. A trained network has no SQL form; tests use held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import quality
from strandlake.session import table


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).select(
        "doc_id",
        F.expr(quality.held_out_sql("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
