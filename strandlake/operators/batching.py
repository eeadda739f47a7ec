"""Batches for model inference: length windows, token budgets, skipped records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.operators.order import row_index


def split_by_length(df: DataFrame, text: str, longest: int) -> tuple[DataFrame, DataFrame]:
    """Rows that fit, and (row, reason) of those that do not."""
    fits = F.length(text) <= longest
    skipped = df.where(~fits).withColumn("reason", F.concat(F.lit("length>"), F.lit(str(longest))))
    return df.where(fits), skipped


def length_windows(df: DataFrame, order: str, text: str, window: int) -> DataFrame:
    """The rows with `window` (of consecutive rows) and `position` in it, the longest first."""
    if window < 1:
        raise ValueError("a window needs a row")
    rows = row_index(df, order).withColumn("window", F.floor(F.col("row_index") / window))
    return rows.withColumn("position", (F.row_number().over(W.partitionBy("window").orderBy(F.desc(F.length(text)), "row_index")) - 1).cast("long"))


def budget_batches(lengths: list[int], tokens: int, size: int | None = None) -> list[int]:
    """Batch numbers of consecutive rows: (rows) * (longest + 1) stays within the budget, and rows within the size."""
    out, batch, n, longest = [], 0, 0, 0
    for length in lengths:
        wide = max(longest, length)
        if n and ((n + 1) * (wide + 1) > tokens or (size and n >= size)):
            batch, n, longest, wide = batch + 1, 0, 0, length
        out.append(batch)
        n, longest = n + 1, wide
    return out


def token_budget(windows: DataFrame, text: str, tokens: int, size: int | None = None) -> DataFrame:
    """Rows of length_windows() with a `batch` inside their window; a window is bounded, and so is each group."""
    schema = T.StructType([*windows.schema.fields, T.StructField("batch", T.LongType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        return rows.assign(batch=budget_batches(rows[text].str.len().tolist(), tokens, size))

    return windows.groupBy("window").applyInPandas(run, schema)


def generate(batches: DataFrame, id_col: str, text: str, embed, fail_fast: bool = False) -> DataFrame:
    """(id, vector, error): a user's embed(list of texts) per batch; a failing batch is halved until single rows fail."""

    def one(texts: list[str]) -> list:
        try:
            return [(v, None) for v in embed(texts)]
        except Exception as error:  # noqa: BLE001  model errors are data here
            if fail_fast:
                raise
            if len(texts) == 1:
                return [(None, f"{type(error).__name__}: {error}")]
            half = len(texts) // 2
            return one(texts[:half]) + one(texts[half:])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            got = one(rows[text].tolist()) if len(rows) else []
            yield pd.DataFrame({id_col: rows[id_col], "vector": [g[0] for g in got], "error": [g[1] for g in got]})

    return batches.select(id_col, text).mapInPandas(run, f"{id_col} {dict(batches.dtypes)[id_col]}, vector array<float>, error string")
