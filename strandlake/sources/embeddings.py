"""Stored embeddings: npy and npz files, shards, and the rules that records keep.

Parquet is the native store. npy and npz are read without pickles; pickle files,
LMDB environments and HDF5 are not read (pickles run code; h5py and lmdb are not
there): convert them to npz or Parquet.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.storage import file_system, write_bytes


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = np.load(io.BytesIO(body.as_py()), allow_pickle=False)
            if isinstance(found, np.ndarray):
                vectors, ids = found, None
            else:
                names = list(found.keys())
                key = "vectors" if "vectors" in names else next((n for n in names if n != "ids"), None)
                if key is None:
                    raise ValueError(f"{path} holds no vectors")
                vectors, ids = found[key], found["ids"] if "ids" in names else None
            if vectors.ndim != 2:
                raise ValueError(f"{path} holds an array of {vectors.ndim} dimensions, not rows of vectors")
            ids = [f"row_{i}" for i in range(len(vectors))] if ids is None else [str(i).strip() for i in ids.tolist()]
            if len(ids) != len(vectors):
                raise ValueError(f"{path} has {len(ids)} ids for {len(vectors)} vectors")
            for at in range(0, len(vectors), 4096):
                part = np.ascontiguousarray(vectors[at : at + 4096], np.float32)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(ids[at : at + 4096]), rows], names=["path", "id", "vector"])


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, vector) of npy files (ids row_0, row_1, ...) and npz files (`ids`, `vectors`); a file is read by one task."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_arrays, "path string, id string, vector array<float>")


def shard_name(number: int) -> str:
    return f"shard-{number:05d}.npz"


def write_shards(df: DataFrame, path: str, rows_per_shard: int = 10_000) -> int:
    """(id, vector) rows in the order of ids as npz shards of so many rows; their number. One shard at a time is on the driver."""
    if rows_per_shard < 1:
        raise ValueError("a shard needs a row")
    spark, ids, vectors, n = df.sparkSession, [], [], 0

    def flush() -> None:
        nonlocal ids, vectors, n
        out = io.BytesIO()
        np.savez(out, ids=np.array(ids, str), vectors=np.array(vectors, np.float32))
        write_bytes(spark, f"{path}/{shard_name(n)}", out.getvalue())
        ids, vectors, n = [], [], n + 1

    fs, folder = file_system(spark, path)
    if fs.exists(folder) and fs.listStatus(folder):
        raise ValueError(f"{path} is not empty")
    for row in df.select(F.col("id").cast("string"), "vector").orderBy("id").toLocalIterator():
        ids.append(row[0])
        vectors.append(row[1])
        if len(ids) == rows_per_shard:
            flush()
    if ids:
        flush()
    return n


def normalize_records(df: DataFrame) -> DataFrame:
    """(id, layer_index, model_reference, payload_kind, vector, matrix, pool_method) of records; ids are stripped, missing pool methods named.

    A record has a vector or a matrix, not both; blank ids, empty payloads and
    matrices of unequal rows are errors.
    """
    kind = F.when(F.col("vector").isNotNull() & F.col("matrix").isNull(), "vector").when(F.col("matrix").isNotNull() & F.col("vector").isNull(), "matrix")
    name = F.trim(F.col("id").cast("string"))
    width = F.size(F.get("matrix", F.lit(0)))
    bad = F.coalesce(name == "", F.lit(True)) | kind.isNull() | (F.coalesce(F.size("vector"), F.lit(1)) == 0) | (F.coalesce(F.size("matrix"), F.lit(1)) == 0) | F.coalesce(F.exists("matrix", lambda r: F.size(r) != width), F.lit(False))
    checked = F.when(~bad, name).otherwise(F.raise_error(F.concat(F.lit("a broken embedding record: "), F.coalesce(name, F.lit("no id")))))
    pool = F.coalesce("pool_method", F.when(kind == "matrix", "none").otherwise("unknown"))
    return df.select(checked.alias("id"), "layer_index", "model_reference", kind.alias("payload_kind"), "vector", "matrix", pool.alias("pool_method"))


def select_records(df: DataFrame, ids: list[str] | None = None, layer: int | None = None, pool_method: str | None = None, residues: tuple[int, int] | None = None) -> DataFrame:
    """Records by id, layer and pool method; `residues` (start, end), from 0 and end excluded, cuts matrices."""
    out = df
    for column, wanted in (("layer_index", layer), ("pool_method", pool_method)):
        if wanted is not None:
            out = out.where(F.col(column) == wanted)
    if ids is not None:
        out = out.where(F.col("id").isin(ids))
    if residues is not None:
        start, end = residues
        if start < 0 or end <= start:
            raise ValueError("residues must be a range (start, end) with 0 <= start < end")
        out = out.withColumn("matrix", F.slice("matrix", start + 1, end - start))
    return out


def residue_span(matrix: str, mask: str, drop_start: int = 1, drop_end: int = 1):
    """The rows of a token matrix that stand for residues: those that the mask counts, less the tokens at both ends."""
    n = F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))
    return F.slice(matrix, F.lit(drop_start + 1), F.greatest(n - (drop_start + drop_end), F.lit(0)))


def merge_results(parts: list[DataFrame]) -> DataFrame:
    """One row of several runs' (n_records, n_skipped, layers, parameters): sums, all layers, and the parameters that all share."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    entries = whole.select(F.explode(F.map_entries("parameters")).alias("e")).groupBy("e").count().where(F.col("count") == len(parts))
    shared = entries.agg(F.map_from_entries(F.sort_array(F.collect_list("e"))).alias("parameters"))
    sums = whole.agg(F.sum("n_records").alias("n_records"), F.sum("n_skipped").alias("n_skipped"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("layers")))).alias("layers"))
    return sums.join(F.broadcast(shared), F.lit(True))  # one row each
