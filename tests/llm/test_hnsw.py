import numpy as np
import pytest

from strandlake.llm import hnsw


def vectors(n=700, dims=16):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, dims))
    x = centres[rng.integers(0, 60, n)] + rng.normal(size=(n, dims)) * rng.choice([0.02, 0.15, 0.6], (n, 1))
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(5000 + i, rows[3][1]) for i in range(50)] + [(6000, None), (6001, []), (6002, [0.0] * dims), (6003, [float("nan")] + [1.0] * (dims - 1)), (6004, [None] + [1.0] * (dims - 1)), (None, rows[3][1]), (6005, [1.0, 2.0]), (6006, [2.0, 4.0])]
    return [*rows, rows[9], rows[9]]


def brute(rows):
    units = []
    for _, v in rows:
        a = None if v is None or None in v else np.array(v)
        units.append(a / np.linalg.norm(a) if a is not None and len(a) and np.isfinite(a).all() and a.any() else None)
    linked = [[j for j, b in enumerate(units) if j != i and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.95] for i, a in enumerate(units)]
    names = list(range(len(rows)))
    todo = True
    while todo:
        todo = False
        for i, js in enumerate(linked):
            low = min([names[i], *(names[j] for j in js)])
            if low != names[i]:
                names[i], todo = low, True
    least = {}
    for name, (i, _) in zip(names, rows, strict=True):
        if i is not None:
            least[name] = min(i, least.get(name, i))
    return [(i, len(js), least.get(name)) for (i, _), js, name in zip(rows, linked, names, strict=True)]


@pytest.mark.parametrize(("kind", "sizes"), [("double", {"min_shards": 3}), ("double", {"min_shards": 1}), ("double", {"min_shards": 1, "shard_bytes": 8000}), ("float", {})])
def test_matches_brute_force(spark, kind, sizes):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", f"cast(embedding as array<{kind}>) as embedding", "1 as node", "2 as copies", "3 as n_links", "4 as digest").repartition(4)
    if kind == "float":
        rows = [(r.vec_id, r.embedding) for r in df.collect()]
    found = hnsw.near_duplicates(df, **sizes).collect()
    assert sorted((tuple(r)[:3] for r in found), key=str) == sorted(brute(rows), key=str)
    assert all(r.audit_recall >= hnsw.AUDIT_RECALL for r in found)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_and_no_false_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 32))
    x = unit(np.concatenate([x, x + rng.normal(size=x.shape) * 0.1]))
    shard = hnsw.Shard(np.arange(len(x)), np.ones(len(x), np.int64), x)
    found = {(int(q), int(shard.nodes[n])) for r, c in shard.pairs(x, hnsw.BEAM) for q, n in zip(r, c, strict=True)}
    truth = x @ x.T >= 0.95
    assert all(truth[q, n] for q, n in found) and len(found) >= 0.97 * truth.sum()
    again = hnsw.Shard.load(shard.dump())
    assert {(int(q), int(again.nodes[n])) for r, c in again.pairs(x, hnsw.BEAM) for q, n in zip(r, c, strict=True)} == found


def test_dense_cloud_never_holds_its_pairs():
    """20,000 jittered copies of one vector: 4e8 links, a forest of 19,999."""
    import tracemalloc

    rng = np.random.default_rng(2)
    x = rng.normal(size=(1, 16)) + rng.normal(size=(20_000, 16)) * 0.01
    shard = hnsw.Shard(np.arange(len(x)), np.ones(len(x), np.int64), x)
    tracemalloc.start()
    edges, linked = [], 0
    for at in range(0, len(x), hnsw.STRETCH):
        ids = np.arange(at, min(len(x), at + hnsw.STRETCH))
        parts = shard.answer(ids, unit(x[ids]))
        linked += int(parts[0][2].sum())
        edges += list(zip(parts[1][0].tolist(), parts[1][1].tolist(), strict=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert linked == 20_000 * 19_999 and len(edges) == 19_999 and len({v for e in edges for v in e}) == 20_000
    assert peak < 400 << 20


def test_empty(spark):
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
