"""Operators against plain Python: toy graphs, alignments, metrics, splits, stores and streams."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import vec
from strandlake.operators import align, batching, dag, knn, metrics, relational, splits, store, tree
from strandlake.sources import text as sources
from strandlake.streaming import ingest

TOY = [("1", "1", "no rank", "root"), ("2", "1", "domain", "Bacteria"), ("3", "2", "genus", "A"), ("4", "2", "genus", "B"), ("5", "3", "species", "a"), ("6", "1", "domain", "Archaea")]


def vectors(spark, n=120, dims=8):
    rng = np.random.default_rng(3)
    rows = [(i % 100, [float(x) for x in rng.normal(size=dims)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)


@pytest.mark.parametrize("metric", vec.METRICS)
def test_knn_equals_brute_force(spark, metric):
    rows, corpus = vectors(spark)
    queries = corpus.dropDuplicates(["id"]).select(F.col("id").alias("query_id"), "vector").where("query_id < 12")
    got = {(r.query_id, r["rank"]): (r.id, r.distance) for r in knn.exact(queries, corpus, 7, metric, queries.select("query_id", F.col("query_id").alias("id"))).collect()}
    for q, v in ((r.query_id, r.vector) for r in queries.collect()):
        best = {}
        for i, w in rows:
            a, b = np.array(v), np.array(w)
            d = {"l2": np.linalg.norm(a - b), "inner_product": -(a @ b), "cosine": 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)}[metric]
            if i != q:
                best[i] = min(d, best.get(i, 9e9))
        for k, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:7], 1):
            assert got[q, k][0] == i and abs(got[q, k][1] - d) < 1e-9


def test_knn_strict_and_errors(spark):
    _, corpus = vectors(spark, 5)
    queries = corpus.select(F.col("id").alias("query_id"), "vector")
    with pytest.raises(ValueError):
        knn.exact(queries, corpus, 9)
    assert knn.exact(queries, corpus, 9, strict=False).count() == 25
    with pytest.raises(ValueError):
        knn.exact(queries, corpus, 0)
    with pytest.raises(ValueError):
        vec.distance("hamming", F.lit(1), F.lit(2))


@pytest.mark.parametrize("metric", vec.METRICS)
def test_many_queries_in_a_grid(spark, metric):
    """Blocks of queries beside parts of the corpus give what one broadcast gives; copies and exclusions included."""
    _, corpus = vectors(spark, 300)
    queries = corpus.dropDuplicates(["id"]).select(F.col("id").alias("query_id"), "vector")
    whole = knn.rank(knn.candidates(queries, corpus, 9, metric), 9)
    cut = knn.rank(knn.candidates(queries, corpus, F.lit(9), metric, query_bytes=1500, part_bytes=3000), 9)
    key = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.distance, 9)) for r in df.collect())
    assert key(whole) == key(cut) and len(key(cut)) == 900
    near = [knn.candidates(queries, corpus, 1, metric, limit=0.4, **sizes).distinct().count() for sizes in ({}, {"query_bytes": 1500, "part_bytes": 3000})]
    assert near[0] == near[1] > 0


def test_candidates_are_dropped_within_a_task(monkeypatch):
    monkeypatch.setattr(knn, "GATHERED", 40)
    rng = np.random.default_rng(0)
    q, x, ids = rng.normal(size=(5, 4)), rng.normal(size=(900, 4)), rng.integers(0, 300, 900)
    best = knn.Best(list(range(5)), q, np.array([1, 2, 3, 4, 5]), "l2", None)
    for at in range(0, 900, 50):
        best.add(ids[at : at + 50], x[at : at + 50])
    got = {}
    for b in best.batches(knn.pa.int64(), knn.pa.int64()):
        for r in b.to_pylist():
            got.setdefault(r["query_id"], {})[r["id"]] = r["distance"]
    for i in range(5):
        least = {}
        for n, v in zip(ids.tolist(), np.linalg.norm(x - q[i], axis=1), strict=True):
            least[n] = min(v, least.get(n, 9e9))
        want = sorted((d, n) for n, d in least.items())[: i + 1]
        found = sorted((d, n) for n, d in got[i].items())[: i + 1]
        assert [n for _, n in found] == [n for _, n in want] and np.allclose([d for d, _ in found], [d for d, _ in want])


@pytest.mark.parametrize("metric", vec.METRICS)
def test_index_life_and_recall(spark, tmp_path, metric):
    from strandlake.operators import index

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(size=32) * 0.3]) for i in range(2000)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    queries = corpus.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    root = f"file://{tmp_path}/index"
    with pytest.raises(ValueError):
        index.build(corpus, root, metric, parts=5)
    with pytest.raises(ValueError):
        index.build(corpus.limit(3), root, metric, lists=9)
    with pytest.raises(ValueError):
        index.load(spark, root)
    first = corpus.where("id < 1800")
    manifest = index.build(first, root, metric)
    assert manifest["count"] == 1800 and index.build(first, root, metric) == manifest
    found = index.load(spark, root)
    assert index.append(corpus, root) == 200 and index.append(corpus, root) == 0
    found = index.load(spark, root)
    assert found.codes.count() == 2000 and found.codes.select("id").distinct().count() == 2000
    got = knn.quality(index.search(found, queries, corpus, 10), knn.exact(queries, corpus, 10, metric))
    assert got.agg(F.avg("recall")).first()[0] >= 0.9
    # Without clusters most lists are needed, and the index knows.
    loose = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=32)]) for i in range(1500)], "id long, vector array<double>")
    index.build(loose, f"file://{tmp_path}/loose", metric)
    asked = loose.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    again = knn.quality(index.search(index.load(spark, f"file://{tmp_path}/loose"), asked, loose, 10), knn.exact(asked, loose, 10, metric))
    assert again.agg(F.avg("recall")).first()[0] >= 0.9
    for bad in ({"probes": 0}, {"probes": 10_000}, {"pool": 2}):
        with pytest.raises(ValueError):
            index.search(found, queries, corpus, 10, **bad)
    # A rebuild that fails leaves the published generation.
    with pytest.raises(ValueError):
        index.build(corpus.withColumn("id", F.col("id") + 1), root, metric)
    with pytest.raises(ValueError):
        index.build(corpus, root, metric, parts=7, overwrite=True)
    assert index.load(spark, root).manifest["count"] == 2000


def test_half_matches_numpy(spark):
    values = [0.0, 1.0, -1.0, 1 / 3, 65504.0, 65520.0, 1e-8, 6e-8, 5.96e-8, 0.1, 1023.5, 2049.0, 2051.0, -0.33333]
    got = spark.createDataFrame([(values,)], "v array<double>").select(vec.half(F.col("v"))).first()[0]
    assert got == np.array(values).astype(np.float16).astype(float).tolist()


def test_splitmix_matches_python(spark):
    def plain(x):
        m = (1 << 64) - 1
        z = (x + 0x9E3779B97F4A7C15) & m
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
        return z ^ (z >> 31)

    got = [r.id for r in relational.splitmix_sample(spark.range(500).toDF("id"), "id", 20).collect()]
    assert sorted(got) == sorted(sorted(range(500), key=plain)[:20])


def test_toy_taxonomy(spark):
    nodes = spark.createDataFrame(TOY, "tax_id string, parent_id string, rank string, name string")
    closed = tree.closure(nodes)
    assert dict(map(tuple, tree.depths(closed).collect())) == {"1": 0, "2": 1, "3": 2, "4": 2, "5": 3, "6": 1}
    assert {r.tax_id: r.lineage for r in tree.lineage(closed).collect()}["5"] == "1>2>3>5"
    pairs = spark.createDataFrame([("5", "4"), ("5", "6"), ("3", "3")], "a string, b string")
    got = {(r.a, r.b): (r.lca, r.w, r.l) for r in tree.lca(pairs, closed).select("a", "b", "lca", tree.wu_palmer().alias("w"), tree.branch_length().alias("l")).collect()}
    assert got == {("5", "4"): ("2", 2 / 5, 3), ("5", "6"): ("1", 0.0, 4), ("3", "3"): ("3", 1.0, 0)}


def test_toy_dag(spark):
    terms = spark.createDataFrame([(t,) for t in "1234"], "term string")
    edges = spark.createDataFrame([("2", "1"), ("3", "1"), ("4", "2"), ("4", "3")], "child string, parent string")
    closed = dag.closure(terms, edges)
    assert {(r.term, r.ancestor): r.dist for r in closed.collect()}["4", "1"] == 2 and closed.count() == 9
    pairs = spark.createDataFrame([("2", "4"), ("4", "2"), ("1", "4"), ("4", "1"), ("2", "3"), ("2", "2")], "a string, b string")
    assert [r.relation for r in dag.relation(pairs, closed).orderBy("a", "b").collect()] == ["ancestor", "same", "non-related", "parent", "descendant", "child"]
    ann = spark.createDataFrame([("x", "4"), ("y", "2"), ("z", "3"), ("w", "nope")], "entity string, term string")
    counts = dict(map(tuple, dag.term_counts(ann, closed).collect()))
    assert counts == {"1": 3, "2": 2, "3": 2, "4": 1}


def test_dag_predicates_and_absent_counts(spark):
    terms = spark.createDataFrame([(t,) for t in "1234"], "term string")
    edges = spark.createDataFrame([("2", "1"), ("3", "1"), ("4", "2"), ("4", "3")], "child string, parent string")
    closed = dag.closure(terms, edges)
    pairs = spark.createDataFrame([("2", "4"), ("4", "2"), ("1", "4"), ("4", "1"), ("2", "3"), ("2", "2")], "a string, b string")
    kinds = ("is_parent", "is_child", "is_ancestor", "is_descendant", "same_path")
    names = lambda df: {r.a + r.b: {k for k in kinds if r[k]} for r in df.collect()}
    expected = {"24": {"is_parent", "is_ancestor", "same_path"}, "42": {"is_child", "is_descendant", "same_path"}, "14": {"is_ancestor", "same_path"}, "41": {"is_descendant", "same_path"}, "23": set(), "22": {"same_path"}}
    assert names(dag.predicates(pairs, closed)) == expected
    assert names(dag.predicates(pairs, closed, include_self=True)) == expected | {"22": {"is_ancestor", "is_descendant", "same_path"}}
    assert dag.predicates(pairs.limit(0), closed).count() == 0
    for a, b in [("2", "9"), ("9", "9"), ("2", None)]:
        with pytest.raises(Exception, match="unknown term"):
            dag.predicates(spark.createDataFrame([(a, b)], "a string, b string"), closed).collect()
    counts = dag.term_counts(spark.createDataFrame([("x", "4")], "entity string, term string"), closed)
    assert {r.term: r.ic for r in dag.information(counts, "1").collect()} == dict.fromkeys("1234", 0.0)
    assert dag.information(counts.limit(0), "1").collect() == []
    with pytest.raises(Exception, match="no count of the root"):
        dag.information(counts.where("term <> '1'"), "1").collect()


def plain_score(a, b, gap_open=10, gap_extend=1):
    s = align.MATRICES["blosum62"][np.ix_(align._codes(a), align._codes(b))]
    best = np.zeros((len(a) + 1, len(b) + 1))
    up, left = np.full_like(best, -1e9), np.full_like(best, -1e9)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            up[i, j] = max(best[i - 1, j] - gap_open, up[i - 1, j] - gap_extend)
            left[i, j] = max(best[i, j - 1] - gap_open, left[i, j - 1] - gap_extend)
            best[i, j] = max(0, best[i - 1, j - 1] + s[i - 1, j - 1], up[i, j], left[i, j])
    return int(best.max())


def test_alignment():
    letters = "ARNDCQEGHILKMFPSTWYV"
    same = align.align(letters, letters)
    assert same["identity"] == 100.0 and same["gaps"] == 0 and same["length"] == 20
    assert align.align(letters, letters[:9] + "W" + letters[10:])["identity"] == 95.0
    gap = align.align(letters, letters[:10] + letters[11:], mode="global")
    assert gap["gaps"] == 1 and gap["matches"] == 19
    rng = random.Random(1)
    for _ in range(30):
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(2))
        got = align.align(a, b)
        assert got["score"] == plain_score(a, b) and got["query"].replace("-", "") in a and got["ref"].replace("-", "") in b
    with pytest.raises(ValueError):
        align.align("", "A")
    with pytest.raises(ValueError):
        align.align("A", "A", matrix="pam0")


def test_hash_split_is_exact_and_stable(spark):
    ids = [f"p{i}" for i in range(57)]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r.id: r.split for r in splits.hash_split(df.repartition(5), "id").collect()}
    order = sorted(ids, key=lambda i: hashlib.sha256(f"split:{i}".encode()).hexdigest())
    assert got == {i: "test" if k < 6 else "val" if k < 12 else "train" for k, i in enumerate(order)}
    assert splits.hash_split(df.limit(2), "id").groupBy("split").count().count() == 2
    with pytest.raises(ValueError):
        splits.ratios(-1, 1, 1)


def test_metrics_edges(spark):
    none = spark.createDataFrame([(0, 0.4), (0, 0.2)], "t int, s double")
    assert tuple(metrics.auroc_auprc(none, "t", "s").first()) == (0.0, 0.0)
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "t int, s double")
    roc, pr = metrics.auroc_auprc(tied, "t", "s").first()
    assert abs(roc - 0.875) < 1e-12 and abs(pr - (0.5 + 0.5 * 2 / 3)) < 1e-12
    grid = spark.createDataFrame([(i / 100,) for i in range(101)], "s double")
    assert [r[0] for r in grid.select(metrics.bucket(F.col("s"))).collect()] == list(range(101))


def test_batching_and_generation(spark):
    assert batching.budget_batches([5, 5, 5, 50, 1], 20, None) == [0, 0, 0, 1, 2]
    df = spark.createDataFrame([(i, "x" * (i % 13 + 1)) for i in range(40)], "id long, s string")
    rows = batching.token_budget(batching.length_windows(df, "id", "s", 16), "s", 60, 4).collect()
    for key in {(r.window, r.batch) for r in rows}:
        part = [len(r.s) for r in rows if (r.window, r.batch) == key]
        assert len(part) <= 4 and len(part) * (max(part) + 1) <= 60

    def embed(texts):
        if any(len(t) == 13 for t in texts):
            raise MemoryError("too long")
        return [[float(len(t))] for t in texts]

    got = {r.id: (r.vector, r.error) for r in batching.generate(df, "id", "s", embed).collect()}
    assert got[0] == ([1.0], None) and got[12] == (None, "MemoryError: too long") and len(got) == 40


def test_store_life(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    df = spark.createDataFrame([(i, f"P{i}", [i / 3, 1.0]) for i in range(30)], "sequence_id long, protein_id string, vector array<double>")
    assert store.inspect(spark, root)["state"] == "missing"
    manifest = store.build(df, root)
    assert manifest["count"] == 30 and store.inspect(spark, root, store.revision(df))["state"] == "current"
    assert [r.protein_id for r in store.load(spark, root).orderBy("row_index").collect()] == sorted(f"P{i}" for i in range(30))
    more = df.unionAll(spark.createDataFrame([(99, "P99", [0.0, 1.0])], df.schema))
    assert store.inspect(spark, root, store.revision(more))["state"] == "stale"
    assert store.append(more, root) == 1 and store.append(more, root) == 0 and store.load(spark, root).count() == 31
    assert sorted(r.row_index for r in store.load(spark, root).collect()) == list(range(31))
    assert {r.batch: r["count"] for r in store.batches(spark, root, 8).groupBy("batch").count().collect()} == {0: 8, 1: 8, 2: 8, 3: 7}
    # What a failed build left behind is not seen, and is gone after the next publication.
    more.write.parquet(f"{root}/part-abandoned")
    assert store.inspect(spark, root)["state"] == "current"
    assert store.build(more, root, overwrite=True)["count"] == 31 and not (tmp_path / "store/part-abandoned").exists()
    context = store.query_context(store.load(spark, root), spark.createDataFrame([("P99",), ("P3",)], "protein_id string"))
    assert {(r.protein_id, tuple(r.aliases)) for r in context.collect()} == {("P99", ("P99",)), ("P3", ("P3",))}
    with pytest.raises(ValueError):
        store.query_context(store.load(spark, root), spark.createDataFrame([("nobody",)], "protein_id string"))
    (tmp_path / "store/manifest-000000000099.json").write_text("{broken")
    assert store.inspect(spark, root)["state"] == "invalid"


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fasta").write_text(">s1 A->G variant\nMKV\nLA\n>s2\nGG\n")
    got = {r.id: r.sequence for r in sources.read_fasta(spark, str(tmp_path / "in/a.fasta")).collect()}
    assert got == {"s1": "MKVLA", "s2": "GG"}
    (tmp_path / "t.tsv").write_text("id\tx\na\t1\n")
    assert sources.read_table(spark, str(tmp_path / "t.tsv"), "id string, x int", ["id"]).first().x == 1
    with pytest.raises(ValueError):
        sources.read_table(spark, str(tmp_path / "t.tsv"), "id string", ["missing"])
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    df.write.parquet(str(tmp_path / "src"))
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "src"))
        ingest.ingest(stream, str(tmp_path / "out"), "id", str(tmp_path / "ck")).awaitTermination()
        df.unionAll(spark.createDataFrame([(3, "c")], df.schema)).write.mode("append").parquet(str(tmp_path / "src"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_replayed_batches_change_nothing(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a"), (None, "n"), (None, "m"), (1, "a")], "id long, v string")
    for _ in range(2):
        ingest.append_unseen(batch, str(tmp_path / "grown"), "id")
    assert sorted((r.id is None, r.id) for r in spark.read.parquet(str(tmp_path / "grown")).collect()) == [(False, 1), (True, None)]


def test_every_query_has_a_name_and_an_oracle_or_reason():
    import __spark_entry__

    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 120
    assert all(queries[n].__doc__ for n in set(queries) - set(oracles) if not n.startswith("op"))


def test_subclass_holdout(spark):
    rows = [(i, f"p{i % 4}", f"p{i % 4}/c{i % 12}") for i in range(240)]
    got = splits.subclass_holdout(spark.createDataFrame(rows, "id long, parent string, child string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.child, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values()) and len(got) == 240
    assert {r.parent for r in got if r.split == "train"} == {f"p{k}" for k in range(4)}
    assert sum(r.split == "test" for r in got) >= 24 and sum(r.split == "val" for r in got) >= 24


def test_linear_probe(spark):
    from strandlake.operators import linear

    rng = np.random.default_rng(2)
    rows = [(i, (x := rng.normal(size=4)).tolist(), int(x[0] + x[1] > 0), "test" if i % 4 == 0 else "train") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int, split string")
    got = linear.classify(df).collect()
    assert len(got) == 75 and sum(r.label == r.prediction for r in got) >= 70
    with pytest.raises(ValueError):
        linear.classify(df.withColumn("label", F.lit(1)))
