"""Lookups of a protein collection: models, proteins' fields and vectors, workload, and the choice of a search strategy.

The tables are those of a collection: models (id, name), proteins (id,
sequence_id, taxonomy_id, species), sequences (id, sequence) and vectors
(protein_id, sequence_id, model_id, layer, vector).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import vec
from strandlake.operators import index as indexes
from strandlake.operators import knn


def model_named(models: DataFrame, name: str) -> DataFrame:
    """At most one model of exactly that name."""
    return models.where(F.col("name") == name).orderBy("id").limit(1)


def resolve_model(models: DataFrame, given: int | str) -> int:
    """The id of a model given by id or name; a blank or unknown one is an error."""
    text = str(given).strip()
    if not text:
        raise ValueError("a model is needed")
    found = models.where(F.col("id") == int(text)) if text.lstrip("+-").isdigit() else models.where(F.col("name") == text)
    row = found.orderBy("id").select("id").first()
    if row is None:
        known = ", ".join(r[0] for r in models.orderBy("id").select("name").limit(20).collect())
        raise ValueError(f"no model {given!r}; there are {known}")
    return row[0]


def protein_field(proteins: DataFrame, protein_id: str, field: str, sequences: DataFrame | None = None):
    """sequence, species or taxonomy_id of a protein; None where it is missing."""
    if field not in ("sequence", "species", "taxonomy_id"):
        raise ValueError(f"unknown field {field!r}")
    own = proteins.where(F.col("id") == protein_id)
    if field == "sequence":
        if sequences is None:
            raise ValueError("sequences are needed")
        own = own.join(sequences.select(F.col("id").alias("sequence_id"), "sequence"), "sequence_id")
    row = own.select(field).first()
    return None if row is None else row[0]


def protein_vectors(vectors: DataFrame, ids: DataFrame, model_id: int, layer: int | None = None) -> DataFrame:
    """(protein_id, layer, vector) of the wanted proteins; without a layer their lowest one each."""
    own = vectors.where(F.col("model_id") == model_id).join(ids.select(F.col(ids.columns[0]).alias("protein_id")).distinct(), "protein_id", "left_semi")
    if layer is not None:
        return own.where(F.col("layer") == layer).select("protein_id", "layer", "vector")
    return own.groupBy("protein_id").agg(F.min(F.struct("layer", "sequence_id", "vector")).alias("x")).select("protein_id", "x.layer", "x.vector")


def workload(vectors: DataFrame) -> dict:
    """Rows and dimensions of a collection; vectors of different lengths are an error."""
    row = vectors.agg(F.count("*").alias("rows"), F.max(F.size("vector")).alias("dim"), F.min(F.size("vector")).alias("least")).first()
    if row.rows and row.dim != row.least:
        raise ValueError(f"vectors of {row.least} to {row.dim} dimensions")
    return {"rows": row.rows, "dim": row.dim}


STRATEGIES = ("auto", "exact", "ivfpq")
#: Products of queries, rows and dimensions beyond which an index is preferred where there is a current one.
EXACT_WORK = 10**13


@dataclass
class Diagnostics:
    """What a search did and why."""

    strategy: str
    reason: str
    rows: int
    dim: int | None
    queries: int
    k: int
    probes: int | None = None
    pool: int | None = None


def choose(strategy: str, rows: int, dim: int | None, queries: int, index: indexes.Index | None, exact_work: int = EXACT_WORK) -> tuple[str, str]:
    """The strategy to use and the reason."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; expected one of {', '.join(STRATEGIES)}")
    if strategy == "ivfpq" and index is None:
        raise ValueError("the strategy ivfpq needs an index")
    if strategy != "auto":
        return strategy, "as asked"
    work = rows * queries * (dim or 0)
    if index is not None and work > exact_work:
        return "ivfpq", f"{work} products exceed {exact_work}, and there is a current index"
    return "exact", f"{work} products" + ("" if index is None else f" are within {exact_work}")


def search(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "cosine", strategy: str = "auto", index: indexes.Index | None = None, exclusions: DataFrame | None = None, strict: bool = True, probes: int | None = None, pool: int | None = None) -> tuple[DataFrame, dict]:
    """Neighbours by the chosen strategy, and diagnostics of the choice."""
    knn.check_k(k)
    if index is not None and index.quantizer.metric != metric:
        raise ValueError(f"the index is for {index.quantizer.metric}, not {metric}")
    stats, n = workload(corpus), queries.count()
    wide = queries.agg(F.max(F.size("vector")), F.min(F.size("vector"))).first()
    if n and stats["rows"] and (wide[0], wide[1]) != (stats["dim"], stats["dim"]):
        raise ValueError(f"queries of {wide[1]} to {wide[0]} dimensions, vectors of {stats['dim']}")
    chosen, reason = choose(strategy, stats["rows"], stats["dim"], n, index)
    told = Diagnostics(chosen, reason, stats["rows"], stats["dim"], n, k)
    if chosen == "exact":
        return knn.exact(queries, corpus, k, metric, exclusions, strict), asdict(told)
    told.probes, told.pool = probes or index.manifest["probes"], max(k, indexes.POOL) if pool is None else pool
    return indexes.search(index, queries, corpus, k, told.pool, told.probes, exclusions, strict), asdict(told)


def annotate(found: DataFrame, annotations: DataFrame) -> DataFrame:
    """Neighbours with their annotations (id, term), as sorted lists; those without any have empty lists."""
    lists = annotations.distinct().groupBy("id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    return found.join(lists, "id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def random_sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n random rows, the same for a seed and a partitioning."""
    return df.orderBy(F.rand(seed)).limit(n)


def timings(df: DataFrame, seconds: str) -> DataFrame:
    """mean, min, max and stdev (0 for one row) of a column."""
    return df.agg(F.avg(seconds).alias("mean"), F.min(seconds).alias("min"), F.max(seconds).alias("max"), F.coalesce(F.stddev_samp(seconds), F.lit(0.0)).alias("stdev"))


def fit_predict(data: DataFrame, backend, label_type: str, seeds: tuple[int, ...] = (0,)) -> DataFrame:
    """(seed, id, prediction, score) of a user's backend(train frame, test frame, seed), checked.

    data: (id, split, vector, label). The backend runs once per seed in a task of its
    own and returns a frame of id, prediction and perhaps score for all test ids;
    unknown, missing or repeated ids and scores that are not finite are errors.
    """
    both = data.where(F.col("split").isin("train", "test")).select(F.explode(F.array(*(F.lit(s) for s in seeds))).alias("seed"), "id", "split", "vector", "label")
    kind = dict(data.dtypes)["id"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        seed = int(rows["seed"].iloc[0])
        train, test = (rows[rows["split"] == s].sort_values("id", ignore_index=True).drop(columns=["seed", "split"]) for s in ("train", "test"))
        if train.empty or test.empty:
            raise ValueError("a probe needs train and test rows")
        got = backend(train, test.drop(columns=["label"]), seed)
        if sorted(got["id"].tolist()) != sorted(test["id"].tolist()):
            raise ValueError("a backend must return each test id once")
        scores = got["score"].astype(float) if "score" in got else pd.Series([float("nan")] * len(got))
        if "score" in got and not np.isfinite(scores).all():
            raise ValueError("a backend's scores must be finite")
        return pd.DataFrame({"seed": seed, "id": got["id"].to_numpy(), "prediction": got["prediction"].to_numpy(), "score": scores.to_numpy()})

    return both.groupBy("seed").applyInPandas(run, f"seed int, id {kind}, prediction {label_type}, score double")


def validate_vectors(df: DataFrame, dim: int) -> DataFrame:
    """The rows; another number of dimensions is an error."""
    return df.where(vec.dimension(F.col("vector"), dim) == dim)


def batches_in_memory(texts: list[tuple[str, str]], longest: int, size: int) -> Iterator[list[tuple[str, str]]]:
    """(id, text) pairs in batches of `size`, the longest first; empty or overlong texts are errors."""
    if size < 1 or longest < 1:
        raise ValueError("size and longest must be at least 1")
    if bad := [i for i, t in texts if not t or len(t) > longest][:5]:
        raise ValueError(f"texts that are empty or longer than {longest}: {bad}")
    ordered = sorted(texts, key=lambda x: -len(x[1]))
    for at in range(0, len(ordered), size):
        yield ordered[at : at + size]
