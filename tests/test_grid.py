"""Work that must not grow with the square of the input in one task or one row: sweeps in one pass, cells, pairs added up where they are made."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import align, correlate, dag, knn, metrics, relational


def test_sweep_in_one_pass(spark):
    """Plain and weighted sweeps of marked pairs equal plain loops; an entity without scores counts, one without weight only in the plain one."""
    terms = spark.createDataFrame([("a",), ("b",), ("m",), ("r",)], "term string")
    closed = dag.closure(terms, spark.createDataFrame([("a", "m"), ("b", "m"), ("m", "r")], "child string, parent string"))
    labels = [(1, "a"), (1, "a"), (2, "b"), (3, "a"), (4, "x")]
    scores = [(1, "a", 0.9), (1, "b", 0.35), (2, "a", 0.5), (2, "b", 0.2), (5, "a", 1.0), (1, "a", 0.9)]
    weight = {"a": 2.0, "m": 0.5}
    up = {"a": {"a", "m"}, "b": {"b", "m"}}
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    weights = frame(list(weight.items()), "term string, weight double")
    marked = dag.propagate_marks(frame(labels, "entity long, term string"), frame(scores, "entity long, term string, score double"), closed, ["r"], weights)
    got = {(r.kind, round(r.threshold * 100)): r for r in metrics.sweep(marked, 101, ("plain", "weighted")).collect()}
    truth, best = {}, {}
    for e, t in labels:
        for x in up.get(t, ()):
            truth.setdefault(e, set()).add(x)
    for e, t, s in scores:
        for x in up[t]:
            best[e, x] = max(s, best.get((e, x), 0))
    for kind, w in (("plain", lambda t: 1.0), ("weighted", lambda t: weight.get(t, 0.0))):
        for i in range(101):
            held = [e for e in truth if sum(map(w, truth[e])) > 0]
            ps, rs, n = 0.0, 0.0, 0
            for e in held:
                hit = {t for (x, t), s in best.items() if x == e and s >= i / 100}
                tp, p = sum(map(w, hit & truth[e])), sum(map(w, hit))
                ps, rs, n = ps + (tp / p if p else 0), rs + tp / sum(map(w, truth[e])), n + (p > 0)
            if (kind, i) in got:
                assert got[kind, i].precision == pytest.approx(ps / n if n else 0) and got[kind, i].recall == pytest.approx(rs / len(held))
            else:
                assert n == 0
    plain = metrics.marks(dag.propagate_labels(frame(labels, "entity long, term string"), closed, ["r"]), dag.propagate_scores(frame(scores, "entity long, term string, score double"), closed, ["r"]), weights)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, marked.collect()))


@pytest.mark.parametrize("metric", ["l2"])
def test_cells_keep_their_size(spark, monkeypatch, metric):
    """More rows make more cells, not larger ones, and the same neighbours as one broadcast."""
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)], "id long, vector array<float>")
    asked = rows.select(F.col("id").alias("query_id"), "vector")
    own = asked.select("query_id", F.col("query_id").alias("id"))
    key = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.distance, 9)) for r in df.collect())
    whole, sums = key(knn.exact(asked, rows, 5, metric, own)), sorted(map(tuple, knn.summary(asked, rows, 9.0, metric).collect()))
    pairs = knn.within(asked, rows, 0.3, metric)
    monkeypatch.setattr(knn, "FEW", 0)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 100)
    monkeypatch.setattr(knn, "PART_ROWS", 200)
    assert knn.candidates(asked, rows, 5, metric).rdd.getNumPartitions() == 8
    assert key(knn.exact(asked, rows, 5, metric, own)) == whole
    got = sorted(map(tuple, knn.summary(asked, rows, 9.0, metric).collect()))
    assert [g[:2] for g in got] == [s[:2] for s in sums] and np.allclose([g[2] for g in got], [s[2] for s in sums]) and {g[1] for g in got} == {399}
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_a_frequent_key_is_cut(spark):
    """A key of many rows meets many cells, and every pair comes once; null keys pair with nothing."""
    df = spark.createDataFrame([(i, 1 if i < 90 else 2 if i < 95 else None) for i in range(100)], "id long, key int")
    pairs = relational.alias_pairs(df, "key", "id", 10)
    want = sorted((a, b) for lo, hi in ((0, 90), (90, 95)) for a in range(lo, hi) for b in range(lo, hi))
    assert sorted(map(tuple, pairs.collect())) == want


def test_equal_pairs_are_aligned_once(spark, monkeypatch):
    pairs = spark.createDataFrame([(i, "AR" * (1 + i % 2), "ARN") for i in range(40)], "id long, a string, b string").coalesce(1)
    seen = spark.sparkContext.accumulator(0)
    real = align.align

    def counted(*args, **kw):
        seen.add(1)
        return real(*args, **kw)

    monkeypatch.setattr(align, "align", counted)
    rows = align.align_pairs(pairs).collect()
    assert [r.score for r in sorted(rows, key=lambda r: r.id)] == [real("AR" * (1 + i % 2), "ARN")["score"] for i in range(40)]
    assert 0 < seen.value <= 2


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner_product"])
def test_pools_stay_in_their_cells(spark, tmp_path, monkeypatch, metric):
    """Only near rows leave a cell of lists and queries, not the pool; they are the nearest of all codes in the lists asked."""
    from strandlake.operators import index

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)) + 3
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    index.build(rows, f"file://{tmp_path}/i", metric, lists=10, parts=4, codes=16)
    found, asked = index.load(spark, f"file://{tmp_path}/i"), rows.select(F.col("id").alias("query_id"), "vector")
    probed, own = found.quantizer.probe(x, 4), {r.id: r.list for r in found.codes.collect()}
    d = knn.distances(x, x, metric)
    want = {q: sorted((round(d[q, n], 9), n) for n in range(400) if own[n] in probed[q])[:5] for q in range(400)}
    monkeypatch.setattr(knn, "BLOCK_ROWS", 100)
    monkeypatch.setattr(knn, "PART_ROWS", 130)
    ranked, real = [], knn.rank
    monkeypatch.setattr(knn, "rank", lambda pairs, k: ranked.append(pairs.count()) or real(pairs, k))
    got = {}
    for r in index.search(found, asked, rows, 5, pool=1 << 30, probes=4, strict=False).collect():
        got.setdefault(r.query_id, []).append((round(r.distance, 9), r.id))
    assert {q: sorted(v) for q, v in got.items()} == want and ranked[0] <= 400 * 5 * 5
    pools = index.retrieve(found, asked, 30, 4).groupBy("query_id").count()
    sizes = np.bincount([own[n] for n in range(400)])
    assert {r.query_id: r["count"] for r in pools.collect()} == {q: min(30, int(sizes[probed[q]].sum())) for q in range(400)}
    assert index.search(found, asked, rows, 5, pool=60, probes=10, exclusions=asked.select("query_id", F.col("query_id").alias("id"))).where("query_id = id").isEmpty()


def test_single_precision_scores_leave_exact_neighbours(monkeypatch):
    """Large offsets, tiny and huge vectors and nans: the neighbours by double precision, whatever the scores' precision."""
    rng = np.random.default_rng(2)
    for scale, offset in ((1.0, 1e4), (1e-20, 0.0), (1e18, 0.0), (1.0, 0.0)):
        for metric in ("l2", "inner_product", "cosine"):
            q, x = rng.normal(size=(6, 5)) * scale + offset, rng.normal(size=(3000, 5)) * scale + offset
            x[7, 0] = np.nan
            best = knn.Best(list(range(6)), q, np.full(6, 4), metric, None)
            best.add(np.arange(3000), x)
            got = [[] for _ in q]
            for b in best.batches(knn.pa.int64(), knn.pa.int64()):
                for r in b.to_pylist():
                    got[r["query_id"]].append((r["distance"], r["id"]))
            for i in range(6):
                d = knn.pair_distances(np.repeat(q[i : i + 1], 3000, axis=0), x, metric)
                assert sorted(got[i])[:4] == sorted((v, n) for n, v in enumerate(d) if n != 7)[:4]


def test_rho_of_all_pairs_without_sorting_them(spark, monkeypatch):
    """Copies, zero vectors and few values too: rho by plain ranks, whatever blocks and bins there are; no pair leaves a task."""
    import pandas as pd

    rng = np.random.default_rng(6)
    loose = rng.normal(size=(300, 6))
    tied = np.concatenate([np.repeat(rng.normal(size=(6, 6)), 40, axis=0), np.zeros((10, 6))])
    for x, sizes, digits in ((loose, (100, 1 << 18), 5), (tied, (150, 1 << 16), 5), (loose, (10**6, 300), 3), (loose[:2], (100, 100), 5)):
        label = rng.integers(0, 7, len(x))
        df = spark.createDataFrame([(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, label, strict=True))], "id long, vector array<double>, label int")
        i, j = np.triu_indices(len(x), 1)
        d = pd.Series(np.round(knn.pair_distances(x[i], x[j], "cosine"), 9)).rank()
        g = pd.Series(np.abs(label[i] - label[j])).rank()
        monkeypatch.setattr(knn, "BLOCK_ROWS", sizes[0])
        monkeypatch.setattr(correlate, "BINS", sizes[1])
        got = correlate.label_gap_rho(df, digits)
        assert got is None if len(x) == 2 else got == round(float(np.corrcoef(d, g)[0, 1]), digits)
    assert correlate.regular(df) and not correlate.regular(df.union(df)) and not correlate.regular(df.withColumn("label", F.lit(None).cast("int")))


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner_product"])
def test_tiles_keep_their_memory(monkeypatch, metric):
    """Scores of a tile are written where the last tile's were; a query without any distance makes no step sort what it has. Repeated ids and pairs that don't count too."""
    rng = np.random.default_rng(3)
    q, x, names = rng.normal(size=(40, 6)), rng.normal(size=(4000, 6)), rng.integers(0, 3000, 4000)
    q[5, 2] = np.nan
    allowed = rng.random((40, 4000)) < 0.7
    masks, drops, places, drop = [], [], knn.true_places, knn.Best._drop
    monkeypatch.setattr(knn, "true_places", lambda mask: masks.append((mask.shape, mask.ctypes.data)) or places(mask))
    monkeypatch.setattr(knn.Best, "_drop", lambda self: drops.append(1) or drop(self))
    monkeypatch.setattr(knn, "CELLS", 1 << 12)
    monkeypatch.setattr(knn, "FIRST", 256)
    monkeypatch.setattr(knn, "TILE", 16, raising=False)
    for counted in (None, allowed):
        masks.clear(), drops.clear()
        widths = np.arange(40) % 4 + 1
        best = knn.Best([f"q{i}" for i in range(40)], q, widths, metric, None)
        best.add(names, x, counted)
        got = {}
        for b in best.batches(knn.pa.string(), knn.pa.int64()):
            for r in b.to_pylist():
                got.setdefault(r["query_id"], []).append((r["distance"], r["id"]))
        for i in range(40):
            d, nearest = knn.pair_distances(np.repeat(q[i : i + 1], 4000, axis=0), x, metric), {}
            for n in np.flatnonzero(~np.isnan(d) & (counted[i] if counted is not None else True)):
                nearest[names[n]] = min(d[n], nearest.get(names[n], np.inf))
            assert sorted(got.get(f"q{i}", [])) == sorted((v, n) for n, v in nearest.items())[: widths[i]]
        assert len(drops) <= 3 and {s[0] for s, _ in masks} == {16, 8} and len({at for _, at in masks}) == 1


def test_metrics_share_a_product(spark, monkeypatch):
    """Neighbours by several metrics from one grid and mostly one product: the rows of each search alone; far offsets, copies and rows without length fall back."""
    rng = np.random.default_rng(8)
    unit = rng.normal(size=(3000, 8))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    zero = unit.copy()
    zero[::7] = 0
    monkeypatch.setattr(knn, "CELLS", 1 << 12)
    monkeypatch.setattr(knn, "FIRST", 256)
    monkeypatch.setattr(knn, "TILE", 16)
    for x, shares in ((unit, True), (unit * rng.uniform(2, 2.01, (3000, 1)), True), (unit * rng.uniform(1, 9, (3000, 1)), False), (zero, False), (unit / 100 + 50, None)):
        names, widths = rng.integers(0, 2500, len(x)), np.full(40, 4)
        several = knn.Several(list(range(40)), x[:40] * 1.5, widths, knn.vec.METRICS, None)
        for _ in several.added(names, x):
            pass
        got = sorted(tuple(r.values()) for b in several.batches(knn.pa.int64(), knn.pa.int64()) for r in b.to_pylist())
        want = []
        for m in knn.vec.METRICS:
            best = knn.Best(list(range(40)), x[:40] * 1.5, widths, m, None)
            best.add(names, x)
            want += [(*r.values(), m) for b in best.batches(knn.pa.int64(), knn.pa.int64()) for r in b.to_pylist()]
        assert got == sorted(want) and shares in (None, several.shared > 5)
    rows = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(unit[:400])], "id long, vector array<double>")
    asked = rows.select(F.col("id").alias("query_id"), "vector")
    own = asked.select("query_id", F.col("query_id").alias("id"))
    key = lambda df: sorted((r.query_id, r["rank"], r.id, r.distance) for r in df.collect())
    alone = [key(knn.exact(asked, rows, 3, m, own)) for m in ("l2", "cosine")]
    monkeypatch.setattr(knn, "FEW", 0)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 100)
    assert [key(df) for df in knn.exact_each(asked, rows, 3, ("l2", "cosine"), own)] == alone
