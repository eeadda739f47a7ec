"""Deterministic dataset splits: by hash, within strata, and by held-out classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.order import group_index, row_index, running_sum


def ratios(train: float = 0.8, val: float = 0.1, test: float = 0.1) -> tuple[float, float, float]:
    """Non-negative ratios rescaled to sum to one."""
    whole = train + val + test
    if min(train, val, test) < 0 or whole <= 0:
        raise ValueError("ratios must not be negative and must not all be zero")
    return train / whole, val / whole, test / whole


def split_sizes(n: Column, train: float = 0.8, val: float = 0.1, test: float = 0.1) -> tuple[Column, Column]:
    """(n_val, n_test) of n rows: half-even rounding; ten rows or more have one at least, two to nine one test row; one stays in train."""
    train, val, test = ratios(train, val, test)
    n_val, n_test = F.bround(n * F.lit(val)), F.bround(n * F.lit(test))
    if val > 0:
        n_val = F.when((n >= 10) & (n_val < 1), 1).otherwise(n_val)
    if test > 0:
        n_test = F.when((n >= 2) & (n_test < 1), 1).otherwise(n_test)
    n_test = F.least(n_test, F.greatest(n - 1, F.lit(0)))
    return F.least(n_val, F.greatest(n - 1 - n_test, F.lit(0))).cast("long"), n_test.cast("long")


def _digest(salt: str, id_col: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(salt), F.col(id_col).cast("string")), 256)


def _named(at: Column, n: Column, train: float, val: float, test: float) -> Column:
    """The split of place `at` (from 0) among n rows: test first, then val, then train."""
    n_val, n_test = split_sizes(n, train, val, test)
    return F.when(at < n_test, "test").when(at < n_test + n_val, "val").otherwise("train")


def hash_split(df: DataFrame, id_col: str, salt: str = "split", train: float = 0.8, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """The rows with a `split` by the order of sha256(salt:id): exact counts without one task for all rows."""
    if not salt:
        raise ValueError("a salt is needed")
    numbered = row_index(df, _digest(salt, id_col), name="_at")
    n = numbered.agg(F.count("*").alias("_n"))
    return numbered.join(F.broadcast(n), F.lit(True)).withColumn("split", _named(F.col("_at"), F.col("_n"), train, val, test)).drop("_at", "_n")  # one row


def stratified_split(df: DataFrame, id_col: str, field: str, fallback: str, salt: str = "split", min_group: int = 10, missing: str = "none", train: float = 0.8, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """Groups of min_group rows split alone; rarer rows regroup by the fallback field, and what is left is one pool.

    Groups' sizes are aggregated and joined back, and rows are numbered by range
    partitions over (group, hash), so a group may hold most of the rows.
    """
    if min_group < 1:
        raise ValueError("min_group must be at least 1")
    clean = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(missing))
    named = df.withColumn("_a", clean(field)).withColumn("_b", clean(fallback))
    # Sizes come from the small table of (stratum, fallback) counts.
    pairs = named.groupBy("_a", "_b").agg(F.count("*").alias("_n"))
    first = pairs.groupBy("_a").agg(F.sum("_n").alias("_na"))
    rare = pairs.join(first, "_a").where(F.col("_na") < min_group).groupBy("_b").agg(F.sum("_n").alias("_nb"))
    group = F.when(F.col("_na") >= min_group, F.concat(F.lit("a:"), "_a")).when(F.col("_nb") >= min_group, F.concat(F.lit("b:"), "_b")).otherwise("pool")
    grouped = named.join(first, "_a").join(rare, "_b", "left").withColumn("_g", group).drop("_a", "_b", "_na", "_nb")
    ranked = group_index(grouped, "_g", _digest(salt, id_col), name="_at", size="_n")
    return ranked.withColumn("split", _named(F.col("_at"), F.col("_n"), train, val, test)).drop("_g", "_at", "_n")


def holdout_classes(df: DataFrame, field: str, fraction: float, strategy: str = "random", salt: str = "split") -> DataFrame:
    """(class): classes in order until they hold max(1, round(n * fraction)) rows, the crossing one included."""
    counts = df.groupBy(F.coalesce(field, F.lit("none")).alias("class")).agg(F.count("*").alias("n"))
    digest = F.sha2(F.concat_ws(":", F.lit(salt), F.lit("holdout"), "class"), 256)
    if strategy not in ("random", "rarest_first"):
        raise ValueError(f"unknown strategy {strategy!r}")
    order = [digest] if strategy == "random" else [F.col("n"), digest]
    summed = running_sum(counts, "n", *order)
    whole = counts.agg(F.sum("n").alias("_w"))
    return summed.join(F.broadcast(whole), F.lit(True)).where(F.col("before") < F.greatest(F.lit(1), F.bround(F.col("_w") * fraction))).select("class")  # one row


def holdout_split(df: DataFrame, id_col: str, field: str, fraction: float = 0.1, strategy: str = "random", salt: str = "split", train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Held-out classes are the test split; the rest splits by hash into train and val."""
    held = holdout_classes(df, field, fraction, strategy, salt).withColumn("_held", F.lit(True))
    marked = df.withColumn("class", F.coalesce(field, F.lit("none"))).join(held, "class", "left").drop("class")
    rest = hash_split(marked.where("_held is null").drop("_held"), id_col, salt, train, val, 0.0)
    return rest.unionByName(marked.where("_held").drop("_held").withColumn("split", F.lit("test")))


def validate(df: DataFrame, id_col: str = "id", text_col: str = "sequence", split_col: str = "split") -> DataFrame:
    """One row with counts of every kind of invalid row."""
    ids = df.groupBy(id_col).count().agg(F.count_if(F.col("count") > 1).alias("repeated_ids"))
    rows = df.agg(F.count("*").alias("n"), F.count_if(F.col(id_col).isNull()).alias("null_ids"), F.count_if(F.coalesce(F.length(text_col), F.lit(0)) == 0).alias("empty_texts"), F.count_if(~F.coalesce(F.col(split_col), F.lit("")).isin("train", "val", "test")).alias("bad_splits"))
    return rows.join(ids, F.lit(True))  # one row each


def subclass_holdout(df: DataFrame, fraction: float = 0.1, salt: str = "split") -> DataFrame:
    """(id, parent, child) rows with a `split` whose held-out subclasses never occur in train.

    A subclass is a (parent, child) pair. Parents with two children or more lend
    theirs, the rarest first, then by sha256(salt:parent:child); the last one in
    that order always stays in train. Those lent are test until `fraction` of the
    eligible rows is reached, the crossing one included, and then val as far, where
    there are three candidates. Other subclasses are train.
    """
    counts = df.groupBy("parent", "child").agg(F.count("*").alias("n"))
    digest = F.sha2(F.concat_ws(":", F.lit(salt), "parent", "child"), 256)
    order = F.struct("n", digest.alias("h"))
    siblings = counts.groupBy("parent").agg(F.count("*").alias("_k"), F.max(order).alias("_last"))
    eligible = counts.join(siblings, "parent").where("_k >= 2")
    whole = eligible.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_rows"), F.count("*").alias("_candidates"))
    lent = running_sum(eligible.where(order != F.col("_last")).select("parent", "child", "n"), "n", "n", digest)
    wanted = F.greatest(F.lit(1), F.bround(F.col("_rows") * fraction))
    sized = lent.join(F.broadcast(whole), F.lit(True))  # one row
    taken = sized.where(F.col("before") < wanted).agg(F.coalesce(F.max(F.col("before") + F.col("n")), F.lit(0)).alias("_test"))
    placed = sized.join(F.broadcast(taken), F.lit(True)).select(  # one row
        "parent",
        "child",
        F.when(F.col("_rows") < 2, "train").when(F.col("before") < wanted, "test").when((F.col("_candidates") >= 3) & (F.col("before") - F.col("_test") < wanted), "val").alias("_s"),
    )
    return df.join(placed, ["parent", "child"], "left").withColumn("split", F.coalesce("_s", F.lit("train"))).drop("_s")
