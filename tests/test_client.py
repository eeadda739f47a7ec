"""Lookups, the choice of a strategy, probe backends and multilabel metrics against plain Python."""

import numpy as np
import pandas as pd
import pytest

from strandlake.operators import client, index, knn, metrics


def test_lookups(spark):
    models = spark.createDataFrame([(1, "esm"), (2, "prott5")], "id int, name string")
    assert client.resolve_model(models, " 2 ") == 2 and client.resolve_model(models, "esm") == 1
    assert client.model_named(models, "esm").count() == 1 and client.model_named(models, "ESM").count() == 0
    for bad in ("", "  ", "esm2", 9):
        with pytest.raises(ValueError):
            client.resolve_model(models, bad)
    proteins = spark.createDataFrame([("P1", 7, "9606", "human")], "id string, sequence_id int, taxonomy_id string, species string")
    sequences = spark.createDataFrame([(7, "MK")], "id int, sequence string")
    assert client.protein_field(proteins, "P1", "sequence", sequences) == "MK" and client.protein_field(proteins, "P1", "species") == "human"
    assert client.protein_field(proteins, "P9", "taxonomy_id") is None
    vectors = spark.createDataFrame([("P1", 7, 1, 3, [1.0]), ("P1", 7, 1, 0, [2.0]), ("P1", 7, 2, 0, [3.0])], "protein_id string, sequence_id int, model_id int, layer int, vector array<float>")
    ids = spark.createDataFrame([("P1",), ("P1",), ("P2",)], "id string")
    assert [r.vector for r in client.protein_vectors(vectors, ids, 1).collect()] == [[2.0]]
    assert [r.vector for r in client.protein_vectors(vectors, ids, 1, 3).collect()] == [[1.0]]
    assert client.workload(vectors) == {"rows": 3, "dim": 1}


def test_routing_and_diagnostics(spark, tmp_path):
    rng = np.random.default_rng(1)
    corpus = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)], "id long, vector array<double>")
    queries = corpus.limit(5).selectExpr("id as query_id", "vector")
    found, told = client.search(queries, corpus, 5)
    assert told["strategy"] == "exact" and (told["rows"], told["dim"], told["queries"]) == (200, 8, 5) and found.count() == 25
    root = f"file://{tmp_path}/index"
    index.build(corpus, root, parts=4, codes=16)
    built = index.load(spark, root)
    approximate, told = client.search(queries, corpus, 5, strategy="ivfpq", index=built)
    assert told["strategy"] == "ivfpq" and told["pool"] == index.POOL and knn.quality(approximate, found).agg({"recall": "avg"}).first()[0] >= 0.9
    assert client.choose("auto", 10**7, 1024, 10**4, built)[0] == "ivfpq" and client.choose("auto", 10**7, 1024, 10**4, None)[0] == "exact"
    for bad in ({"strategy": "gpu"}, {"strategy": "ivfpq"}, {"metric": "l2", "index": built}):
        with pytest.raises(ValueError):
            client.search(queries, corpus, 5, **bad)
    with pytest.raises(ValueError):
        client.search(queries.selectExpr("query_id", "slice(vector, 1, 3) as vector"), corpus, 5)


def test_probe_backends(spark):
    data = spark.createDataFrame([(i, "test" if i % 3 == 0 else "train" if i % 3 == 1 else "val", [float(i)], i % 2) for i in range(30)], "id long, split string, vector array<double>, label int")

    def parity(train, test, seed):
        assert "label" not in test and len(train) == 10
        return pd.DataFrame({"id": test["id"], "prediction": [int(v[0]) % 2 for v in test["vector"]], "score": [float(seed)] * len(test)})

    got = client.fit_predict(data, parity, "int", (1, 2)).collect()
    assert len(got) == 20 and all(r.prediction == r.id % 2 and r.score == r.seed for r in got)
    for broken in (lambda a, b, s: parity(a, b, s).iloc[1:], lambda a, b, s: parity(a, b, s).assign(score=float("inf")), lambda a, b, s: parity(a, b, s).assign(id=0)):
        with pytest.raises(Exception, match="backend"):
            client.fit_predict(data, broken, "int").collect()


def test_multilabel_metrics_match_plain_python(spark):
    rng = np.random.default_rng(4)
    y, s = rng.random((40, 5)) < 0.3, np.round(rng.random((40, 5)), 1)
    y[:, 4] = False
    rows = [(i, f"t{k}", float(s[i, k]), bool(y[i, k])) for i in range(40) for k in range(5)]
    df = spark.createDataFrame(rows, "entity long, term string, score double, y boolean")
    truth, classes = df.where("y").select("entity", "term"), df.select("term").distinct()
    want = []
    for k in range(5):
        total, tp, n = 0.0, 0, 0
        for score in sorted(set(s[:, k]), reverse=True):
            at = s[:, k] == score
            p = int(y[at, k].sum())
            tp, n = tp + p, n + int(at.sum())
            total += p * tp / n
        want.append(total / y[:, k].sum() if y[:, k].any() else 0.0)
    assert metrics.average_precision(truth, df.select("entity", "term", "score"), classes).first()[0] == pytest.approx(np.mean(want))
    predicted = df.where("score >= 0.5").select("entity", "term")
    assert metrics.exact_match(truth, predicted, df.select("entity")).first()[0] == pytest.approx(((s >= 0.5) == y).all(axis=1).mean())


def test_small_helpers(spark):
    assert [len(b) for b in client.batches_in_memory([("a", "xx"), ("b", "x"), ("c", "xxx")], 3, 2)] == [2, 1]
    for bad in ([("a", "")], [("a", "xxxx")]):
        with pytest.raises(ValueError):
            list(client.batches_in_memory(bad, 3, 2))
    t = spark.createDataFrame([(2.0,)], "s double")
    assert tuple(client.timings(t, "s").first()) == (2.0, 2.0, 2.0, 0.0)
    df = spark.range(100)
    assert {r.id for r in client.random_sample(df, 10, 3).collect()} == {r.id for r in client.random_sample(df, 10, 3).collect()}
