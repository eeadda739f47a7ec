"""op2: visible text of every page. Rendering has no SQL form; tests use fixed layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import html_text
from strandlake.session import table


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html": op2_html}
ORACLES: dict[str, str] = {}
