"""Persistent IVF-PQ indexes: coarse lists, product-quantised residual codes, exact order of a candidate pool.

An index is a store (see store.py) of two tables: `quantizer`, one row with the
coarse centres and codebooks, and `codes`, a row (list, id, code) per vector, in
parts. Centres are fitted by k-means on at most `sample` vectors, the smallest
hashes of their ids; every vector is coded. Generations are published as those of
a store are, so a failed rebuild keeps the former one.

At the build, some of the training vectors look for their nearest neighbours among
all of them: the fewest lists that hold COVERED of these are the index's own
`probes`, kept in its manifest, since data without clusters need many more than
clustered data. A search deals lists in parts of about knn.PART_ROWS codes, near
lists together and larger ones in pieces, and queries in blocks of about
knn.BLOCK_ROWS by the part of their nearest list. A block meets a part in a cell
only if one of its queries asks a list there. The cell finds each query's `pool`
best codes of the lists that it asks and works out their exact distances, so that
no pool leaves it, only the nearest rows; cells keep their size when tables grow.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import vec
from strandlake.operators import knn, store
from strandlake.storage import file_system, materialize

SAMPLE, ITERATIONS, CODES, POOL = 20_000, 12, 256, 1000
#: Share of true neighbours that the probed lists should hold, and the training vectors and neighbours that it is read from.
COVERED, ASKED, NEIGHBOURS = 0.97, 256, 50
#: Approximate distances that a cell holds at once, and queries that are sent to their lists at once.
HELD, SENT = 1 << 24, 1 << 10


def kmeans(x: np.ndarray, k: int, seed: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Centres by Lloyd's steps from distinct rows; an empty centre moves to the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = distinct[rng.choice(len(distinct), k, replace=False)].astype(np.float64)
    for _ in range(iterations):
        own, gap = assign(x, centres)
        sums, sizes = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        for empty in np.nonzero(sizes == 0)[0]:
            far = int(gap.argmax())
            centres[empty], gap[far] = x[far], -1
    return centres


def assign(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the squared distance to it."""
    own, gap = np.zeros(len(x), np.int64), np.zeros(len(x))
    for at in range(0, len(x), 8192):
        d = (x[at : at + 8192] ** 2).sum(1)[:, None] - 2 * x[at : at + 8192] @ centres.T + (centres**2).sum(1)
        own[at : at + 8192], gap[at : at + 8192] = d.argmin(1), d.min(1)
    return own, gap


@dataclass
class Quantizer:
    """Coarse centres (lists, dims) and codebooks (parts, codes, dims / parts) of residuals."""

    metric: str
    centres: np.ndarray
    books: np.ndarray

    def form(self, x: np.ndarray) -> np.ndarray:
        """Vectors as they are coded: unit length for cosine."""
        if self.metric != "cosine":
            return x
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(size == 0, 1, size)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.form(x)
        own, _ = assign(x, self.centres)
        rest = (x - self.centres[own]).reshape(len(x), len(self.books), -1)
        return own, np.stack([assign(rest[:, p], book)[0] for p, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def probe(self, q: np.ndarray, probes: int) -> np.ndarray:
        """The lists that each query asks, the nearest first."""
        q = self.form(q)
        d = -q @ self.centres.T if self.metric == "inner_product" else (self.centres**2).sum(1) - 2 * q @ self.centres.T
        return np.argsort(d, axis=1, kind="stable")[:, :probes]

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes say of their vectors."""
        return self.centres[lists] + np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)

    def right(self, decoded: np.ndarray) -> np.ndarray:
        """Decoded vectors (columns) as distances() multiplies them, in single precision."""
        if self.metric == "inner_product":
            return decoded.astype(np.float32).T
        rows = (decoded - self.centres.mean(axis=0)).astype(np.float32)
        return np.concatenate([rows, np.ones((len(rows), 1), np.float32), (rows**2).sum(axis=1)[:, None]], axis=1).T

    def distances(self, q: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Approximate distances of queries (rows) to decoded vectors; smaller is nearer."""
        q = self.form(q)
        if self.metric == "inner_product":
            return -q.astype(np.float32) @ right
        q = (q - self.centres.mean(axis=0)).astype(np.float32)
        return np.concatenate([-2 * q, (q**2).sum(axis=1)[:, None], np.ones((len(q), 1), np.float32)], axis=1) @ right


def probes_needed(quantizer: Quantizer, x: np.ndarray, seed: int) -> int:
    """The fewest lists, nearest first, that hold COVERED of the neighbours of some of the vectors."""
    q = x[np.random.default_rng(seed).choice(len(x), min(len(x), ASKED), replace=False)]
    own = assign(x, quantizer.centres)[0]
    order = quantizer.probe(q, len(quantizer.centres))
    place = np.argsort(order, axis=1)
    k = min(len(x) - 1, NEIGHBOURS)
    if k < 1:
        return 1
    near = np.argpartition(knn.distances(q, x, quantizer.metric), k, axis=1)[:, : k + 1]
    at = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(at[min(len(at) - 1, int(COVERED * len(at)))]) + 1


def train(vectors: DataFrame, metric: str, lists: int | None, parts: int, codes: int, sample: int, seed: int) -> tuple[Quantizer, int]:
    if metric not in vec.METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if not 1 <= codes <= 256:
        raise ValueError("codes must lie in [1, 256]")
    n = vectors.count()
    lists = lists or max(1, min(4096, round(max(n, 1) ** 0.5)))
    if min(n, sample) < lists:
        raise ValueError(f"{lists} lists need as many training vectors; there are {min(n, sample)}")
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select(vec.as_double("vector").alias("v")).toArrow()  # at most `sample` vectors
    x = knn._matrix(rows.column("v").combine_chunks())
    if parts < 1 or x.shape[1] % parts:
        raise ValueError(f"{x.shape[1]} dimensions do not split in {parts} parts")
    out = Quantizer(metric, np.zeros((0, x.shape[1])), np.zeros((0, 0, 0)))
    x = out.form(x)
    out.centres = kmeans(x, lists, seed)
    rest = (x - out.centres[assign(x, out.centres)[0]]).reshape(len(x), parts, -1)
    books = [kmeans(rest[:, p], codes, seed + 1 + p) for p in range(parts)]
    most = max(map(len, books))
    out.books = np.stack([np.concatenate([b, np.full((most - len(b), b.shape[1]), 1e12)]) for b in books])  # unused codes are far from everything
    return out, probes_needed(out, x, seed)


def _write_codes(vectors: DataFrame, quantizer: Quantizer, path: str) -> int:
    shared = vectors.sparkSession.sparkContext.broadcast(quantizer)

    def run(batches):
        for batch in batches:
            own, codes = shared.value.encode(knn._matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "id", "code"])

    kind = dict(vectors.dtypes)["id"]
    coded = vectors.select("id", vec.as_double("vector")).where("vector is not null").mapInArrow(run, f"list int, id {kind}, code binary")
    coded.write.parquet(path)
    return vectors.sparkSession.read.parquet(path).count()


def build(vectors: DataFrame, root: str, metric: str = "cosine", lists: int | None = None, parts: int = 8, codes: int = CODES, sample: int = SAMPLE, seed: int = 7, overwrite: bool = False) -> dict:
    """Build and publish an index of (id, vector) rows; a current one is reused, a stale or broken one needs overwrite."""
    spark, live = vectors.sparkSession, store.revision(vectors, "id")
    found = store.inspect(spark, root, live)
    if found["state"] == "current" and not overwrite:
        return found["manifest"]
    if found["state"] in ("stale", "invalid") and not overwrite:
        raise ValueError(f"the index at {root} is {found['state']}; pass overwrite=True to rebuild it")
    quantizer, probes = train(vectors, metric, lists, parts, codes, sample, seed)
    name = uuid.uuid4().hex
    row = [(metric, quantizer.centres.tolist(), quantizer.books.tolist())]
    spark.createDataFrame(row, "metric string, centres array<array<double>>, books array<array<array<double>>>").coalesce(1).write.parquet(f"{root}/part-q{name}")
    n = _write_codes(vectors, quantizer, f"{root}/part-{name}")
    manifest = {"kind": "ivfpq", "quantizer": f"part-q{name}", "parts": [f"part-{name}"], "keep": [f"part-q{name}"], "metric": metric, "dim": int(quantizer.centres.shape[1]), "lists": len(quantizer.centres), "probes": probes, "count": n, "revision": live}
    store.publish(spark, root, manifest)
    return manifest


def append(vectors: DataFrame, root: str) -> int:
    """Code the vectors whose ids the index lacks, as a further part; the number added."""
    spark, index = vectors.sparkSession, load(vectors.sparkSession, root)
    new = vectors.join(index.codes.select("id").distinct(), "id", "left_anti").select("id", "vector")
    folder = f"part-{uuid.uuid4().hex}"
    added = _write_codes(new, index.quantizer, f"{root}/{folder}")
    if not added:
        fs, path = file_system(spark, f"{root}/{folder}")
        fs.delete(path, True)
        return 0
    manifest = {**index.manifest, "parts": [*index.manifest["parts"], folder], "count": index.manifest["count"] + added}
    whole = spark.read.parquet(*(f"{root}/{p}" for p in manifest["parts"]))
    store.publish(spark, root, {**manifest, "revision": store.revision(whole, "id")})
    return added


@dataclass
class Index:
    quantizer: Quantizer
    codes: DataFrame
    manifest: dict


def load(spark: SparkSession, root: str) -> Index:
    found = store.inspect(spark, root)
    manifest = found["manifest"] or {}
    if found["state"] != "current" or manifest.get("kind") != "ivfpq":
        raise ValueError(f"the index at {root} is {'invalid' if found['state'] == 'current' else found['state']}")
    row = spark.read.parquet(f"{root}/{manifest['quantizer']}").first()
    quantizer = Quantizer(row.metric, np.array(row.centres), np.array(row.books))
    return Index(quantizer, spark.read.parquet(*(f"{root}/{p}" for p in manifest["parts"])), manifest)


def _chain(centres: np.ndarray) -> list[int]:
    """The lists in an order that keeps near ones together: each is followed by the nearest one left."""
    left, out = np.ones(len(centres), bool), [0]
    sizes = (centres**2).sum(axis=1)
    left[0] = False
    while left.any():
        d = np.where(left, sizes - 2 * centres @ centres[out[-1]], np.inf)
        out.append(int(d.argmin()))
        left[out[-1]] = False
    return out


def _parts(index: Index, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The first part of each list, and the parts that it is cut into."""
    sizes = {r[0]: r[1] for r in index.codes.groupBy("list").count().collect()}  # a row per list
    first, pieces, part, filled = np.zeros(len(index.quantizer.centres), np.int64), np.ones(len(index.quantizer.centres), np.int64), 0, 0
    for number in _chain(index.quantizer.centres):
        n = sizes.get(number, 0)
        if filled and filled + n > rows:
            part, filled = part + 1, 0
        first[number] = part
        if n > rows:
            pieces[number] = -(-n // rows)
            part, filled = part + int(pieces[number]), 0
        else:
            filled += n
    return first, pieces


def _search_cell(quantizer: Quantizer, pool: int, queries: pa.RecordBatch, rows: pa.RecordBatch, exact: bool) -> Iterator[pa.RecordBatch]:
    """One cell: queries with the lists that they ask there, and coded rows in the order of their lists."""
    wanted, q = queries.column("asked").to_pylist(), knn._matrix(queries.column("vector"))
    widths, names = queries.column("width").to_numpy().astype(int), queries.column("query_id")
    own, ids = rows.column("list").to_numpy(), rows.column("id").to_numpy(zero_copy_only=False)
    starts = np.nonzero(np.diff(own, prepend=-1))[0]
    numbers, ends = own[starts], np.append(starts[1:], len(own))
    told = np.frombuffer(b"".join(wanted), np.int32)
    place, asks = np.searchsorted(numbers, told), np.zeros((len(wanted), len(numbers) + 1), bool)
    place[numbers[np.minimum(place, len(numbers) - 1)] != told] = len(numbers)  # a list without rows here
    asks[np.repeat(np.arange(len(wanted)), [len(w) // 4 for w in wanted]), place] = True
    asks = asks[:, :-1]
    order = np.array(sorted(range(len(wanted)), key=wanted.__getitem__))
    vectors = knn._matrix(rows.column("vector")) if exact else None
    right = quantizer.right(quantizer.decode(own, np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(own), -1))) if pool < len(own) or not exact else None
    step = max(16, HELD // len(own))
    for at in range(0, len(order), step):
        some = order[at : at + step]
        used = np.nonzero(asks[some].any(axis=0))[0]
        if not len(used):
            continue
        columns = slice(None) if len(used) == len(numbers) else np.concatenate([np.arange(starts[j], ends[j]) for j in used])
        allowed = np.repeat(asks[some][:, used], (ends - starts)[used], axis=1)
        if right is not None:
            near = quantizer.distances(q[some], right[:, columns])
            np.copyto(near, np.inf, where=~allowed)
            if pool < near.shape[1]:
                allowed &= near <= np.partition(near, pool - 1, axis=1)[:, pool - 1 : pool]
        if exact:
            best = knn.Best(names.take(pa.array(some)).to_pylist(), q[some], widths[some], quantizer.metric, None)
            best.add(ids[columns], vectors[columns], allowed)
            yield from best.batches(names.type, rows.column("id").type)
        else:
            i, j = np.nonzero(allowed)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(some[i])), rows.column("id").take(pa.array(np.arange(len(own))[columns][j])), pa.array(near[i, j].astype(float))], names=["query_id", "id", "distance"])


def _cells(index: Index, queries: DataFrame, corpus: DataFrame | None, pool: int, probes: int | None) -> DataFrame:
    """(query_id, id, distance): of each part's `pool` best codes the nearest rows by exact distances to the corpus, or without one the codes themselves. queries: (query_id, width, vector)."""
    probes = index.manifest["probes"] if probes is None else probes
    if not 1 <= probes <= index.manifest["lists"]:
        raise ValueError(f"probes must lie in [1, {index.manifest['lists']}]")
    dims, spark, exact = index.manifest["dim"], queries.sparkSession, corpus is not None
    shared = spark.sparkContext.broadcast(index.quantizer)
    query_type, id_type = dict(queries.dtypes)["query_id"], dict(index.codes.dtypes)["id"]
    first, pieces = _parts(index, max(1, min(knn.PART_ROWS, knn.PART_BYTES // (8 * dims + 64))))

    def send(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SENT):
                batch = whole.slice(at, SENT)
                q = knn._matrix(batch.column(2))
                if len(q) and q.shape[1] != dims:
                    raise ValueError(f"expected {dims} dimensions, got {q.shape[1]}")
                found = shared.value.probe(q, probes)
                home, row, part, asked = first[found[:, 0]], [], [], []
                for i, lists in enumerate(found):
                    at_parts: dict[int, list[int]] = {}
                    for number in np.sort(lists).tolist():
                        for p in range(first[number], first[number] + pieces[number]):
                            at_parts.setdefault(p, []).append(number)
                    for p, those in at_parts.items():
                        row.append(i)
                        part.append(p)
                        asked.append(np.array(those, np.int32).tobytes())
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(home).take(row), pa.array(part, pa.int64()), pa.array(asked, pa.binary()), *(batch.column(c).take(row) for c in range(3))], names=["home", "part", "asked", "query_id", "width", "vector"])

    sent = queries.select("query_id", F.col("width").cast("int"), vec.as_double("vector").alias("vector")).where("vector is not null and query_id is not null").mapInArrow(send, f"home long, part long, asked binary, query_id {query_type}, width int, vector array<double>")
    met = sent.groupBy("home", "part").count().collect()  # a row per two parts that meet
    blocks = {h: -(-c // knn.BLOCK_ROWS) for h, p, c in met if h == p}
    places, n = [], 0
    for home, part, _ in sorted(map(tuple, met)):
        places.append((home, part, n, blocks[home]))
        n += blocks[home]
    if not n:
        return spark.createDataFrame([], f"query_id {query_type}, id {id_type}, distance double")
    where = F.broadcast(spark.createDataFrame(places, "home long, part long, start long, blocks long"))
    none = lambda kind: F.lit(None).cast(kind)
    left = sent.join(where, ["home", "part"]).select((F.col("start") + F.pmod(F.xxhash64("query_id"), F.col("blocks"))).alias("cell"), F.lit(-1).alias("list"), "asked", "width", "query_id", none(id_type).alias("id"), none("binary").alias("code"), "vector")
    cut = F.broadcast(spark.createDataFrame([(i, int(f), int(p)) for i, (f, p) in enumerate(zip(first, pieces, strict=True))], "list int, first long, pieces long"))
    coded = index.codes.select("list", "id", "code").distinct() if exact else index.codes
    coded = coded.join(cut, "list").withColumn("part", F.col("first") + F.pmod(F.xxhash64("id"), F.col("pieces")))
    if exact:
        coded = coded.join(corpus.select(F.col("id").cast(id_type).alias("id"), vec.as_double("vector").alias("vector")).where("vector is not null"), "id")
    else:
        coded = coded.withColumn("vector", none("array<double>"))
    right = coded.join(where, "part").select(F.explode(F.sequence(F.col("start"), F.col("start") + F.col("blocks") - 1)).alias("cell"), "list", none("binary").alias("asked"), F.lit(0).alias("width"), none(query_type).alias("query_id"), "id", "code", "vector")
    tasks = int(min(n, 1 << 15))
    ready = left.unionAll(right).repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int")).sortWithinPartitions("cell", "list")

    def scan(batches):
        cell, held = None, []

        def done():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0]
            some = int((whole.column("list").to_numpy() < 0).sum())
            if 0 < some < whole.num_rows:
                yield from _search_cell(shared.value, pool, whole.slice(0, some), whole.slice(some), exact)

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            ends = [*(np.nonzero(np.diff(numbers))[0] + 1).tolist(), len(numbers)]
            for s, e in zip([0, *ends[:-1]], ends, strict=True):
                if s < e:
                    if held and numbers[s] != cell:
                        yield from done()
                        held = []
                    cell = numbers[s]
                    held.append(batch.slice(s, e - s))
        if held:
            yield from done()

    return ready.mapInArrow(scan, f"query_id {query_type}, id {id_type}, distance double")


def retrieve(index: Index, queries: DataFrame, pool: int = POOL, probes: int | None = None) -> DataFrame:
    """(query_id, id, approximate): the pool of each query, by approximate distances of the codes in the lists that it asks."""
    found = _cells(index, queries.select("query_id", F.lit(1).alias("width"), "vector"), None, pool, probes)
    once = found.groupBy("query_id", "id").agg(F.min("distance").alias("approximate"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("approximate", "id"))
    return once.withColumn("_r", place).where(F.col("_r") <= pool).drop("_r")


def search(index: Index, queries: DataFrame, corpus: DataFrame, k: int = 10, pool: int | None = None, probes: int | None = None, exclusions: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """(query_id, id, distance, rank) by exact distances of at least the pool, max(k, POOL) unless given.

    Each part of the index that a query asks gives the `pool` best codes there, so
    the pool of all parts is among the candidates, and no pair of it is shuffled.
    """
    knn.check_k(k)
    pool = max(k, POOL) if pool is None else pool
    if pool < k:
        raise ValueError("the pool must hold k candidates")
    asked, width = queries.select("query_id", "vector"), F.lit(k)
    if exclusions is not None:
        exclusions = exclusions.select("query_id", "id").distinct()
        asked = asked.join(exclusions.groupBy("query_id").agg(F.count("*").alias("excluded")), "query_id", "left")
        width = F.lit(k) + F.coalesce("excluded", F.lit(0))
    found = _cells(index, asked.select("query_id", width.alias("width"), "vector"), corpus, pool, probes)
    if exclusions is not None:
        found = found.join(exclusions, ["query_id", "id"], "left_anti")
    out = knn.rank(found, k)
    return knn.require_k(materialize(out, "neighbours"), queries, k) if strict else out
