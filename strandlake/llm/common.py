"""Pieces that several operators share: connected components, and the shared storage of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.storage import discard, fresh_path, materialize, shared_dir

__all__ = ["connected_components", "discard", "fresh_path", "join_spread", "join_unique", "materialize", "shared_dir"]

#: A hub has more than a HUBS-th of all edge ends or rows, so that there are fewer than HUBS of them.
HUBS = 1000
#: Edge ends or rows of one key that a task may hold without further ado.
PLAIN = 100_000


def join_unique(rows: DataFrame, unique: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """A left join of `total` rows with a table of one row a key and `weight`, the key's number of rows (dropped).

    Keys with more than a HUBS-th of the rows, fewer than HUBS, are joined by
    broadcast, and rows without a key aren't shuffled, so no task gets a large
    share of the rows. The unique side's rows should be small.
    """
    most = max(total // HUBS, 1)
    told = [c for c in unique.columns if c not in (key, weight)]
    hot = F.broadcast(unique.where(F.col(weight) > most).select(key, *told, F.lit(True).alias("_hot")))
    marked = rows.join(hot, key, "left")
    done = F.col("_hot").isNotNull() | F.col(key).isNull()
    left = marked.where(~done).select(*rows.columns)
    return marked.where(done).select(*rows.columns, *told).unionAll(left.join(unique.where(F.col(weight) <= most).drop(weight), key, "left").select(*rows.columns, *told))


def join_spread(rows: DataFrame, unique: DataFrame, key: str) -> DataFrame:
    """An inner join with a table of one row a key, whose rows may be large.

    The unique rows of keys with more than a HUBS-th of the rows are copied, one
    for each such share, fewer than 2 * HUBS copies in all, and the keys' rows are
    dealt to them by hash, so no task gets a large share of the rows.
    """
    counts = materialize(rows.groupBy(key).agg(F.count("*").alias("_n")), "join-counts")
    most = max(1, (counts.agg(F.sum("_n")).first()[0] or 0) // HUBS)
    hot = F.broadcast(counts.where(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    others = [c for c in rows.columns if c != key]
    left = rows.join(hot, key, "left").select(*rows.columns, F.pmod(F.xxhash64(*others), parts).cast("int").alias("_part"))
    right = unique.join(hot, key, "left").select(*unique.columns, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    return left.join(right, [key, "_part"]).drop("_part")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge list (u, v); component is the smallest node reachable.

    Alternating large-star and small-star rounds: each aggregates the smallest
    neighbour of a node with map-side partial aggregation and joins it back. Hubs,
    fewer than HUBS, are joined by broadcast, so no hub's neighbours meet in one
    task; any other node has at most a HUBS-th of all edge ends, or PLAIN of them.
    The driver sees
    two numbers a round. Null ends and loops are ignored; an empty edge list gives
    an empty result.
    """
    pairs = (
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    pairs = materialize(pairs, "edges")
    seen = None
    for _ in range(max_rounds):
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or state[0] == 0:
            break
        seen = tuple(state)
        half = _star(pairs, state[0], large=True)
        if 2 * state[0] > PLAIN:  # hubs are planned apart: one step a plan
            half = materialize(half, "edges")
        nxt = materialize(_star(half, state[0], large=False), "edges")
        discard(pairs)
        discard(half)
        pairs = nxt
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _star(pairs: DataFrame, n: int, large: bool) -> DataFrame:
    """One star step on n edges, or fewer, with u > v."""
    around = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("degree"))
    most = max(2 * n // HUBS, PLAIN)
    if 2 * n <= most:  # no node can have more
        near = around.join(least.select("u", "m"), "u")
    else:
        # The sum of degrees is 2 n at most, so fewer than HUBS nodes have a larger one than 2 n / HUBS.
        hubs = F.broadcast(least.where(F.col("degree") > most).select("u", F.col("m").alias("hub")))
        marked = around.join(hubs, "u", "left")
        near = marked.where("hub is not null").select("u", "v", F.col("hub").alias("m")).unionAll(
            marked.where("hub is null").select("u", "v").join(least.where(F.col("degree") <= most).select("u", "m"), "u")
        )
    if large:  # every larger neighbour of a node moves to the smallest one
        moved = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # a node and its smaller neighbours move to the smallest one
        moved = near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return moved.where("u <> v").distinct()
