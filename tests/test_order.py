"""Row numbers and running sums over many real partitions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from strandlake.operators import batching, dag, order, splits, tree


@pytest.fixture(scope="module")
def wide(spark):
    """1,000,000 rows with a payload, over more partitions than the session shuffles to."""
    return spark.range(0, 1_000_000, 1, 23).select(F.col("id"), F.sha2(F.col("id").cast("string"), 512).alias("payload"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000).alias("hot"))


def test_row_index_keeps_every_row(wide):
    got = order.row_index(wide, "payload")
    row = got.agg(F.count("*"), F.count_distinct("row_index"), F.min("row_index"), F.max("row_index"), F.count_distinct("id")).first()
    assert tuple(row) == (1_000_000, 1_000_000, 0, 999_999, 1_000_000)
    # In order: no number's key is below the key of the number before it.
    ends = got.groupBy(F.floor(F.col("row_index") / 1000).alias("b")).agg(F.min("payload").alias("lo"), F.max("payload").alias("hi")).orderBy("b").collect()
    assert all(x.hi <= y.lo for x, y in zip(ends, ends[1:], strict=False))


def test_hot_keys(wide):
    got = order.group_index(wide, "hot", "id", name="at", size="n").groupBy("hot").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.count_distinct("at").alias("d")).collect()
    assert all((r.c, r.lo, r.hi, r.d) == (r.n, 0, r.n - 1, r.n) for r in got) and sum(r.c for r in got) == 1_000_000


def test_running_sum_and_ranks(spark):
    values = [(i * 7919 % 101, float(i % 13)) for i in range(3000)]
    df = spark.createDataFrame(values, "v long, g double").repartition(9)
    numbered = order.row_index(df, "v", name="at")
    got = {r["at"]: (r.v, r.before) for r in order.running_sum(numbered, "v", "at").collect()}
    total = 0
    for k, v in enumerate(sorted(v for v, _ in values)):
        assert got[k] == (v, total)
        total += v
    ranks = {(r.g, r["rank"]) for r in order.average_ranks(df, "g", "rank").collect()}
    flat = sorted(g for _, g in values)
    assert ranks == {(g, flat.index(g) + (flat.count(g) + 1) / 2) for g in set(flat)}


def test_splits_and_windows_lose_nothing(wide):
    some = wide.where("id < 400000")
    got = {r.split: r["count"] for r in splits.hash_split(some, "id").groupBy("split").count().collect()}
    assert got == {"train": 320_000, "val": 40_000, "test": 40_000}
    strata = splits.stratified_split(some.withColumn("f", F.col("hot").cast("string")).withColumn("b", F.lit("x")), "id", "f", "b").groupBy("f", "split").count().collect()
    assert sum(r["count"] for r in strata) == 400_000
    windows = batching.length_windows(some, "id", "payload", 64).groupBy("window").agg(F.count("*").alias("n"), F.count_distinct("position").alias("d"), F.max("position").alias("m"))
    assert windows.where("n <> 64 or d <> 64 or m <> 63").isEmpty() and windows.count() == 6250


def test_stratified_matches_plain_python(spark):
    rows = [(i, f"s{i % 5}" if i % 7 else f"r{i}", f"b{i % 2}" if i % 3 else f"c{i}") for i in range(300)]
    got = {r.id: r.split for r in splits.stratified_split(spark.createDataFrame(rows, "id long, f string, b string").repartition(5), "id", "f", "b").collect()}
    count = lambda xs: {x: xs.count(x) for x in set(xs)}
    na = count([f for _, f, _ in rows])
    nb = count([b for _, f, b in rows if na[f] < 10])
    groups: dict = {}
    for i, f, b in rows:
        groups.setdefault("a" + f if na[f] >= 10 else "b" + b if nb[b] >= 10 else "pool", []).append(i)
    for ids in groups.values():
        ids.sort(key=lambda i: hashlib.sha256(f"split:{i}".encode()).hexdigest())
        n = len(ids)
        n_val, n_test = (max(1, round(n * 0.1)) if n >= 10 else round(n * 0.1)), (max(1, round(n * 0.1)) if n >= 2 else round(n * 0.1))
        n_test = min(n_test, n - 1)
        n_val = min(n_val, max(0, n - 1 - n_test))
        for k, i in enumerate(ids):
            assert got[i] == ("test" if k < n_test else "val" if k < n_test + n_val else "train")


def test_subclass_holdout_follows_the_greedy_rule(spark):
    rows = [(i, f"p{i % 4}", f"c{(i * i) % 37}") for i in range(600)]  # a child may have several parents
    got = splits.subclass_holdout(spark.createDataFrame(rows, "id long, parent string, child string")).collect()
    sizes: dict = {}
    for _, p, c in rows:
        sizes[p, c] = sizes.get((p, c), 0) + 1
    left = {p: sum(q == p for q, _ in sizes) for p, _ in sizes}
    eligible = sorted((k for k in sizes if left[k[0]] >= 2), key=lambda k: (sizes[k], hashlib.sha256(f"split:{k[0]}:{k[1]}".encode()).hexdigest()))
    wanted, placed = max(1, round(sum(sizes[k] for k in eligible) * 0.1)), {}
    for split in ("test", "val"):
        n = 0
        for k in eligible:
            if n < wanted and k not in placed and left[k[0]] > 1:
                placed[k], left[k[0]], n = split, left[k[0]] - 1, n + sizes[k]
    assert {(r.parent, r.child, r.split) for r in got} == {(*k, placed.get(k, "train")) for k in sizes} and len(got) == 600


def test_deep_trees_and_cycles(spark):
    chain = [(str(i), str(max(0, i - 1)), "n", "") for i in range(150)]
    closed = tree.closure(spark.createDataFrame([*chain, ("x", "y", "n", ""), ("y", "x", "n", ""), ("z", "x", "n", "")], "tax_id string, parent_id string, rank string, name string"))
    assert closed.count() == 150 * 151 // 2 + 3
    depth = dict(map(tuple, tree.depths(closed).collect()))
    assert depth["149"] == 149 and depth["x"] == depth["z"] == 0
    ladder = [(f"a{i}", f"{s}{i + 1}") for i in range(20) for s in "ab"] + [(f"b{i}", f"{s}{i + 1}") for i in range(20) for s in "ab"]
    up = dag.closure(spark.createDataFrame([("lone",)], "term string"), spark.createDataFrame(ladder, "child string, parent string"))
    assert {r.ancestor: r.dist for r in up.where("term = 'a0'").collect()} == {"a0": 0} | {f"{s}{i}": i for i in range(1, 21) for s in "ab"}
    with pytest.raises(RuntimeError):
        dag.closure(spark.createDataFrame([("q",)], "term string"), spark.createDataFrame([("q", "r"), ("r", "q")], "child string, parent string"))
