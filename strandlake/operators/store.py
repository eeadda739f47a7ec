"""Persistent vector stores: Parquet generations with a manifest, published by a pointer."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import vec
from strandlake.operators.order import row_index
from strandlake.storage import file_system as _fs


def key_path(root: str, label: str, model_id: int, layer: int, metric: str, dim: int) -> str:
    """The folder of one collection's store or index; raises on values that name none."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", label) or label in (".", ".."):
        raise ValueError("a label has letters, digits, '.', '_' and '-' only")
    if model_id < 0 or layer < 0:
        raise ValueError("model and layer must not be negative")
    if metric not in vec.METRICS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {', '.join(vec.METRICS)}")
    if dim <= 0:
        raise ValueError("the dimension must be positive")
    return f"{root}/{label}/type_{model_id}/layer_{layer}/{metric}_{dim}"


def state(stored: Column, live: Column, valid: Column) -> Column:
    """missing, invalid, stale or current."""
    return F.when(stored.isNull(), "missing").when(~valid, "invalid").when(stored != live, "stale").otherwise("current")


def revision(vectors: DataFrame, id_col: str = "sequence_id") -> str:
    row = vectors.agg(F.count("*"), F.max(id_col)).first()
    return f"count={row[0]};max_sequence_id={row[1]}"


def build(vectors: DataFrame, root: str, overwrite: bool = False) -> dict:
    """Write a generation of (row_index, sequence_id, protein_id, vector) and point to it; a current one is reused."""
    spark = vectors.sparkSession
    live = revision(vectors)
    found = inspect(spark, root, live)
    if found["state"] == "current" and not overwrite:
        return found["manifest"]
    if found["state"] in ("stale", "invalid") and not overwrite:
        raise ValueError(f"the store at {root} is {found['state']}; pass overwrite=True to rebuild it")
    folder = f"part-{uuid.uuid4().hex}"
    n, dim = _write_part(vectors, f"{root}/{folder}", 0)
    manifest = {"parts": [folder], "revision": live, "count": n, "dim": dim}
    publish(spark, root, manifest)
    return manifest


def _write_part(vectors: DataFrame, path: str, start: int) -> tuple[int, int | None]:
    """Rows and dimensions of a part whose numbers begin at `start`, in the order of protein ids."""
    half = vec.half(vec.as_double("vector")).cast("array<float>").alias("vector")
    ready = row_index(vectors.select("sequence_id", "protein_id", half), "protein_id", "sequence_id")
    ready.withColumn("row_index", F.col("row_index") + start).select("row_index", "sequence_id", "protein_id", "vector").sortWithinPartitions("row_index").write.parquet(path)
    shape = vectors.sparkSession.read.parquet(path).agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"), F.min(F.size("vector")).alias("least")).first()
    if shape.n and shape.dim != shape.least:
        raise ValueError("vectors of different lengths")
    return shape.n, shape.dim


def publish(spark: SparkSession, root: str, manifest: dict) -> None:
    """Point to a new generation: its manifest is written whole under the next number, and the largest number counts.

    The name appears by one rename and no name is ever replaced, so a failure at
    any moment leaves the former generation in place. Manifests but the last two,
    and folders that no kept manifest names, are removed afterwards.
    """
    numbers = [n for n, _ in _manifests(spark, root)]
    number = max(numbers, default=0) + 1
    fs, staged = _fs(spark, f"{root}/_staged-{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not fs.rename(staged, _fs(spark, f"{root}/{MANIFEST}{number:012d}.json")[1]):
        raise OSError(f"could not publish generation {number} of {root}")
    for old in sorted(numbers)[:-1]:
        fs.delete(_fs(spark, f"{root}/{MANIFEST}{old:012d}.json")[1], False)
    kept = {folder for _, path in _manifests(spark, root) for m in [_read(spark, path)] for folder in [*_parts(m), *(m or {}).get("keep", [])]}
    for status in fs.listStatus(_fs(spark, root)[1]):
        name = status.getPath().getName()
        if name.startswith("part-") and name not in kept:
            fs.delete(status.getPath(), True)


MANIFEST = "manifest-"


def _manifests(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, path) of all published manifests."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted((int(n[len(MANIFEST) : -5]), f"{root}/{n}") for n in names if n.startswith(MANIFEST) and n.endswith(".json"))


def _read(spark: SparkSession, path: str) -> dict | None:
    """A manifest; None where it is broken."""
    try:
        found = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
        return found if isinstance(found, dict) else None
    except ValueError:
        return None


def _parts(manifest: dict | None) -> list[str]:
    parts = (manifest or {}).get("parts")
    return parts if isinstance(parts, list) and all(isinstance(p, str) and "/" not in p for p in parts) else []


def inspect(spark: SparkSession, root: str, live: str | None = None) -> dict:
    """State of a store and its manifest; staleness counts only where a live revision is given."""
    published = _manifests(spark, root)
    if not published:
        return {"state": "missing", "manifest": None}
    manifest = _read(spark, published[-1][1])
    parts = _parts(manifest)
    if not parts or "count" not in manifest or "revision" not in manifest:
        return {"state": "invalid", "manifest": manifest}
    there = all(_fs(spark, f"{root}/{p}")[0].exists(_fs(spark, f"{root}/{p}/_SUCCESS")[1]) for p in parts)
    if not there or _rows(spark, root, parts).count() != manifest["count"]:
        return {"state": "invalid", "manifest": manifest}
    return {"state": "stale" if live is not None and live != manifest["revision"] else "current", "manifest": manifest}


def _rows(spark: SparkSession, root: str, parts: list[str]) -> DataFrame:
    return spark.read.parquet(*(f"{root}/{p}" for p in parts))


def load(spark: SparkSession, root: str) -> DataFrame:
    """The rows of a store's current generation."""
    found = inspect(spark, root)
    if found["state"] != "current":
        raise ValueError(f"the store at {root} is {found['state']}")
    return _rows(spark, root, found["manifest"]["parts"])


def append(vectors: DataFrame, root: str) -> int:
    """Add vectors whose sequence ids the store lacks, as a further part; the number added. What is there isn't written again."""
    spark = vectors.sparkSession
    have, manifest = load(spark, root), inspect(spark, root)["manifest"]
    new = vectors.select("sequence_id", "protein_id", "vector").join(have.select("sequence_id").distinct(), "sequence_id", "left_anti")
    folder = f"part-{uuid.uuid4().hex}"
    added, dim = _write_part(new, f"{root}/{folder}", manifest["count"])
    if not added:
        _fs(spark, root)[0].delete(_fs(spark, f"{root}/{folder}")[1], True)
        return 0
    if manifest["count"] and dim != manifest["dim"]:
        raise ValueError(f"expected {manifest['dim']} dimensions, got {dim}")
    whole = manifest["count"] + added
    publish(spark, root, {**manifest, "parts": [*manifest["parts"], folder], "count": whole, "dim": dim, "revision": revision(_rows(spark, root, [*manifest["parts"], folder]))})
    return added


def batches(spark: SparkSession, root: str, rows: int) -> DataFrame:
    """The store's rows with the number of the batch of `rows` consecutive ones that each is in."""
    if rows < 1:
        raise ValueError("a batch needs a row")
    return load(spark, root).withColumn("batch", F.floor(F.col("row_index") / rows))


def query_context(stored: DataFrame, proteins: DataFrame) -> DataFrame:
    """(protein_id, vector, sequence_ids, aliases) of stored proteins: their sequences and all ids that share one; missing ids are an error."""
    asked = proteins.select("protein_id").distinct()
    own = stored.select("protein_id", "sequence_id", "vector").join(asked, "protein_id")
    if lacking := asked.join(own, "protein_id", "left_anti").limit(5).collect():
        raise ValueError(f"no stored vector of {[r[0] for r in lacking]}")
    alias = own.select("protein_id", "sequence_id").join(stored.select("sequence_id", F.col("protein_id").alias("alias")), "sequence_id").groupBy("protein_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    first = own.groupBy("protein_id").agg(F.min_by("vector", "sequence_id").alias("vector"), F.array_sort(F.collect_set("sequence_id")).alias("sequence_ids"))
    return first.join(alias, "protein_id")
