"""Taxonomy trees: nodes(tax_id, parent_id, rank, name); the root is its own parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.storage import materialize


def normalize_id(raw: Column) -> Column:
    """Blank, nan and infinite ids become ''; integral numbers lose their fraction."""
    text = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    number = text.try_cast("double")
    bad = F.lower(text).isin("", "nan", "inf", "-inf", "infinity", "-infinity", "none")
    whole = number.isNotNull() & (F.abs(number) < 9e15) & (number == F.floor(number))
    return F.when(bad, "").when(whole, number.cast("long").cast("string")).otherwise(text)


def closure(nodes: DataFrame) -> DataFrame:
    """(tax_id, ancestor, up) of all ancestors and the node itself (up 0), of any depth.

    Paths double: the ancestor 2^k levels up comes from two steps of 2^(k-1), so
    rounds grow with the logarithm of the depth, and each (node, ancestor) is made
    once. Nodes on or under a cycle have no root; they keep themselves alone, at
    depth 0. They are those that still have an ancestor beyond as many levels as
    there are nodes.
    """
    every = nodes.select("tax_id").distinct()
    up = nodes.where("parent_id is not null and parent_id <> tax_id").select("tax_id", F.col("parent_id").alias("above"))
    steps = [materialize(up.join(every.select(F.col("tax_id").alias("above")), "above", "left_semi"), "tree-steps")]
    n = nodes.count()
    while not steps[-1].isEmpty():
        last = steps[-1]
        if 1 << (len(steps) - 1) > n:  # no path is that long: what is left runs in circles
            steps = [materialize(s.join(last, "tax_id", "left_anti"), "tree-steps") for s in steps]
            break
        steps.append(materialize(last.select("tax_id", F.col("above").alias("mid")).join(last.select(F.col("tax_id").alias("mid"), "above"), "mid").select("tax_id", "above"), "tree-steps"))
    reach = every.select("tax_id", F.col("tax_id").alias("ancestor"), F.lit(0).alias("up"))
    for k, far in enumerate(steps):
        further = far.select("tax_id", F.col("above").alias("mid")).join(reach.select(F.col("tax_id").alias("mid"), "ancestor", "up"), "mid").select("tax_id", "ancestor", (F.col("up") + (1 << k)).alias("up"))
        reach = materialize(reach.unionAll(further), "tree-closure")
    return reach


def depths(closed: DataFrame) -> DataFrame:
    """(tax_id, depth); the root's is 0."""
    return closed.groupBy("tax_id").agg(F.max("up").alias("depth"))


def with_depth(closed: DataFrame) -> DataFrame:
    """The closure with each ancestor's depth."""
    return closed.join(depths(closed).select(F.col("tax_id").alias("ancestor"), "depth"), "ancestor")


def lca(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """(a, b, lca, lca_depth, depth_a, depth_b): the deepest common ancestor, then the largest id."""
    c = with_depth(closed)
    d = depths(closed)
    left = pairs.select("a", "b").distinct().join(c.select(F.col("tax_id").alias("a"), "ancestor", "depth"), "a")
    both = left.join(c.select(F.col("tax_id").alias("b"), "ancestor"), ["b", "ancestor"])
    best = both.groupBy("a", "b").agg(F.max(F.struct("depth", "ancestor")).alias("m"))
    out = best.select("a", "b", F.col("m.ancestor").alias("lca"), F.col("m.depth").alias("lca_depth"))
    return out.join(d.select(F.col("tax_id").alias("a"), F.col("depth").alias("depth_a")), "a").join(d.select(F.col("tax_id").alias("b"), F.col("depth").alias("depth_b")), "b")


def branch_length() -> Column:
    return F.col("depth_a") + F.col("depth_b") - 2 * F.col("lca_depth")


def wu_palmer() -> Column:
    both = F.col("depth_a") + F.col("depth_b")
    return F.when(both == 0, 1.0).otherwise(2 * F.col("lca_depth") / both)


def normalized_depth() -> Column:
    deepest = F.greatest("depth_a", "depth_b")
    return F.when(deepest == 0, 1.0).otherwise(F.col("lca_depth") / deepest)


def entity_counts(annotations: DataFrame, closed: DataFrame) -> DataFrame:
    """(ancestor, n): distinct entities annotated at or under each node; annotations: (entity, tax_id)."""
    return annotations.distinct().join(closed, "tax_id").select("ancestor", "entity").distinct().groupBy("ancestor").agg(F.count("*").alias("n"))


def information(counts: DataFrame, total: Column) -> DataFrame:
    """(ancestor, ic): -ln of a node's share of all entities; 0 without any."""
    p = F.col("n") / total
    return counts.select("ancestor", F.when(p > 0, F.abs(-F.log(p))).otherwise(0.0).alias("ic"))


def subtree_sizes(closed: DataFrame) -> DataFrame:
    return closed.groupBy("ancestor").agg(F.count("*").alias("n"))


def lin(pairs_lca: DataFrame, ic: DataFrame) -> DataFrame:
    """Pairs with lin = 2 IC(lca) / (IC a + IC b); 1 where the denominator is 0."""
    named = lambda node, name: ic.select(F.col("ancestor").alias(node), F.col("ic").alias(name))
    out = pairs_lca.join(named("a", "ic_a"), "a", "left").join(named("b", "ic_b"), "b", "left").join(named("lca", "ic_lca"), "lca", "left").na.fill(0.0, ["ic_a", "ic_b", "ic_lca"])
    both = F.col("ic_a") + F.col("ic_b")
    return out.withColumn("lin", F.when(both == 0, 1.0).otherwise(2 * F.col("ic_lca") / both))


def lineage(closed: DataFrame) -> DataFrame:
    """(tax_id, lineage): ids from the root to the node."""
    return closed.groupBy("tax_id").agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("up", "ancestor")))), lambda x: x["ancestor"]), ">").alias("lineage"))


def nearest_at_rank(closed: DataFrame, nodes: DataFrame, rank: str) -> DataFrame:
    """(tax_id, clade): the nearest ancestor or self of a rank."""
    if not rank.strip():
        raise ValueError("a rank must not be blank")
    at = closed.join(nodes.where(F.col("rank") == rank).select(F.col("tax_id").alias("ancestor")), "ancestor")
    order = W.partitionBy("tax_id").orderBy("up")
    return at.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("tax_id", F.col("ancestor").alias("clade"))


def names(groups: DataFrame, named: DataFrame) -> DataFrame:
    """(key, names, joined) of groups (key, ids) by a table (id, name): sorted names, unknown ids left out."""
    asked = groups.select("key", F.explode_outer("ids").alias("id"))
    found = asked.join(named.select("id", "name"), "id", "left").groupBy("key").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return found.select("key", "names", F.array_join("names", "; ").alias("joined"))
