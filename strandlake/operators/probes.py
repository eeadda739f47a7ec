"""Neighbour-transfer probes: neighbours' labels become predictions by weighted voting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEIGHTINGS = ("voting", "weighted_voting", "nearest_similarity")


def weight(distance: Column, weighting: str = "weighted_voting", metric: str = "cosine") -> Column:
    """A neighbour's weight: 1, or its similarity."""
    if weighting not in WEIGHTINGS:
        raise ValueError(f"unknown weighting {weighting!r}")
    if weighting == "voting":
        return F.lit(1.0)
    if metric == "cosine":
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - distance))
    return 1 / (1 + distance)


def weighted(neighbors: DataFrame, labels: DataFrame, weighting: str = "weighted_voting", metric: str = "cosine", cutoff: float | None = None) -> DataFrame:
    """Neighbours (query_id, id, distance) with `label` and a positive `weight`; cutoff drops farther ones."""
    if cutoff is not None:
        if cutoff < 0:
            raise ValueError("the distance cutoff must not be negative")
        neighbors = neighbors.where(F.col("distance") <= cutoff)
    return neighbors.join(labels, "id").withColumn("weight", weight(F.col("distance"), weighting, metric)).where("weight > 0")


def regression(votes: DataFrame) -> DataFrame:
    return votes.groupBy("query_id").agg((F.sum(F.col("weight") * F.col("label")) / F.sum("weight")).alias("prediction"))


def binary(votes: DataFrame, threshold: float = 0.5, weighting: str = "weighted_voting") -> DataFrame:
    """Score and prediction of label 1; with nearest_similarity the score is the largest positive weight."""
    score = F.max(F.when(F.col("label") == 1, F.col("weight")).otherwise(0.0)) if weighting == "nearest_similarity" else F.sum(F.when(F.col("label") == 1, F.col("weight")).otherwise(0.0)) / F.sum("weight")
    return votes.groupBy("query_id").agg(score.alias("score")).withColumn("prediction", (F.col("score") >= threshold).cast("int"))


def multiclass(votes: DataFrame) -> DataFrame:
    """The class with the largest summed weight; ties go to the first class in order."""
    sums = votes.groupBy("query_id", "label").agg(F.round(F.sum("weight"), 12).alias("votes"))
    order = W.partitionBy("query_id").orderBy(F.desc("votes"), "label")
    return sums.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("query_id", F.col("label").alias("prediction"), "votes")


def multilabel(votes: DataFrame, threshold: float = 0.5, weighting: str = "weighted_voting") -> DataFrame:
    """Score of each class that a neighbour has; `label` holds arrays of classes."""
    whole = votes.groupBy("query_id").agg(F.sum("weight").alias("whole"))
    each = votes.select("query_id", "weight", F.explode(F.array_distinct("label")).alias("class")).groupBy("query_id", "class").agg(F.sum("weight").alias("w"), F.max("weight").alias("top"))
    score = F.col("top") if weighting == "nearest_similarity" else F.col("w") / F.col("whole")
    return each.join(whole, "query_id").select("query_id", "class", score.alias("score")).withColumn("predicted", F.col("score") >= threshold)


def explain(votes: DataFrame) -> DataFrame:
    """Each query's neighbours, nearest first."""
    return votes.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("distance", "id", "weight", "label"))).alias("neighbors"))
