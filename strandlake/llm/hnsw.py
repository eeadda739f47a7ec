"""Embedding near-duplicates with one navigable small-world graph per shard.

Equal directions are one node: vectors are normalised in double precision and
grouped by the SHA-256 of the normalised vector, so thousands of copies of a
vector cost one row. Nodes are dealt to shards by hash; each shard's graph is
built in one task (at most SHARD_BYTES of vectors) and written to the shared
folder. Nodes are dealt to as many blocks, and every block queries every shard: a
cell of the two reads the graph first and then streams the block's queries, so a
task holds one graph and some queries whatever their number.

A query's beam widens while its worst member is within the threshold, and beyond
MAX_BEAM the shard is scanned for that query, so no cap on partners loses links.
A fixed share of each stretch of queries is audited against a full scan before
the others run; while the recall of the audited links is under AUDIT_RECALL the
beams start wider, and after the last round the stretch is scanned. Scans are in
single precision with a margin; cosines of all links are verified in double
precision. Links go into counts and a union-find as they are found: a cell
returns, per node, the number of linked vectors, and a spanning forest of the
links, and never holds all pairs of a dense group. The components of all forests
are united.

Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing, as do vectors of another length than their partner. Null ids count
as vectors but never name a component. Repeated rows count as vectors of their
own. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import connected_components, join_unique, materialize

THRESHOLD = 0.95
LINKS, BUILD_BEAM, BEAM, MAX_BEAM, WIDEN = 12, 32, 24, 256, 4
#: Shards of a small table, the least rows that a shard of it has, and the bytes of single-precision vectors that a shard may hold.
MIN_SHARDS, LEAST_ROWS, SHARD_BYTES = 4, 256, 64 << 20
AUDIT_SHARE, AUDIT_RECALL, AUDIT_ROUNDS = 50, 0.98, 3
BATCH = 256
#: Bytes of marks that a batch of searches may hold, queries answered together, and queries scanned together.
SEEN_BYTES, STRETCH, SCANNED = 32 << 20, 4096, 16
#: What single precision may be off by, at most.
MARGIN = 1e-4
#: Bytes of a written graph per row.
CHUNK = 4 << 20
COUNT, LINK, FOUND, TRUE = range(4)


def _top(sims: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)


class Graph:
    """Layers of neighbour lists over unit vectors, built and searched in batches.

    Nodes are numbered from the highest layer down; `order` has the numbers that
    the vectors were given in.
    """

    def __init__(self, vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 5):
        n = len(vectors)
        rng = np.random.default_rng(seed)
        tops = np.minimum((-np.log(1 - rng.random(n)) / math.log(links)).astype(int), 8)
        self.order = np.argsort(-tops, kind="stable")  # the highest nodes first: an upper layer is a prefix
        self.levels = [int((tops >= level).sum()) for level in range(int(tops.max(initial=0)) + 1)]
        self.vectors = vectors[self.order].astype(np.float32)
        self.links = [np.full((size, links * (2 if level == 0 else 1)), -1, np.int32) for level, size in enumerate(self.levels)]
        for start in self._batches(n):
            self._insert(start, min(n, start + self._step(start)), links, beam)

    @staticmethod
    def _step(start: int) -> int:
        return max(1, min(BATCH, start // 4))

    def _batches(self, n: int) -> Iterator[int]:
        start = 1
        while start < n:
            yield start
            start += self._step(start)

    def _insert(self, start: int, end: int, width: int, beam: int) -> None:
        """Link nodes start..end to nodes before them and to one another."""
        new = np.arange(start, end)
        queries = self.vectors[start:end]
        entry = np.zeros(len(new), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            here = new < self.levels[level]
            known = min(start, self.levels[level])
            if known == 0:
                continue
            sims, ids = self._beam(queries, entry, level, 1 if not here.any() else beam, known)
            entry = ids[:, 0]
            if not here.any():
                continue
            among = np.arange(start, min(end, self.levels[level]))
            inner = queries[here] @ self.vectors[among].T
            np.fill_diagonal(inner, -2)
            sims = np.concatenate([sims[here], inner], axis=1)
            ids = np.concatenate([ids[here], np.broadcast_to(among, inner.shape)], axis=1)
            sims[ids < 0] = -2
            sims, ids = _top(sims, ids, beam)
            self._connect(among, ids, sims, level, width)

    def _spread(self, node: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Neighbours that are nearer to the node than to a neighbour chosen before; the nearest fill the rest."""
        points = self.vectors[np.maximum(ids, 0)]
        between = np.matmul(points, points.transpose(0, 2, 1))
        chosen = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            blocked = ((between[:, j, :j] > sims[:, j, None]) & chosen[:, :j]).any(axis=1)
            chosen[:, j] = ~blocked & (ids[:, j] >= 0) & (sims[:, j] > -2) & (ids[:, j] != node) & (chosen[:, :j].sum(axis=1) < width)
        rank = np.where(chosen, 0, 1) + 2 * ((ids < 0) | (sims <= -2) | (ids == node[:, None]))
        order = np.argsort(rank, axis=1, kind="stable")[:, :width]
        out = np.take_along_axis(ids, order, 1)
        out[np.take_along_axis(rank, order, 1) >= 2] = -1
        return out

    def _connect(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, level: int, width: int) -> None:
        table = self.links[level]
        chosen = self._spread(nodes, ids, sims, width)
        table[nodes, : chosen.shape[1]] = chosen
        source = np.repeat(nodes, chosen.shape[1])
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        found, first, counts = np.unique(target, return_index=True, return_counts=True)
        for part in range(0, len(found), 512):
            some = slice(part, part + 512)
            self._link_back(table, found[some], first[some], counts[some], source)

    def _link_back(self, table: np.ndarray, nodes: np.ndarray, first: np.ndarray, counts: np.ndarray, source: np.ndarray) -> None:
        """Add runs of `source` to the neighbours of nodes, and thin out lists that overflow."""
        room = table.shape[1]
        column = np.arange(counts.max())[None]
        added = np.where(column < counts[:, None], source[np.minimum(first[:, None] + column, len(source) - 1)], -1)
        have = table[nodes]
        added[(added[:, :, None] == have[:, None, :]).any(axis=2) | (added == nodes[:, None])] = -1
        every = np.concatenate([have, added], axis=1)
        sims = np.matmul(self.vectors[np.maximum(every, 0)], self.vectors[nodes][:, :, None])[:, :, 0]
        sims[every < 0] = -2
        sims, every = _top(sims, every, min(every.shape[1], 2 * room))
        table[nodes] = every[:, :room]
        full = np.nonzero((every >= 0).sum(axis=1) > room)[0]
        if len(full):
            table[nodes[full]] = self._spread(nodes[full], every[full], sims[full], room)

    def _beam(self, queries: np.ndarray, entry: np.ndarray, level: int, width: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries at once: (similarities, nodes), the best first, -1 where fewer were found."""
        table, q = self.links[level], len(queries)
        rows = np.arange(q)
        seen = np.zeros((q, known), bool)
        ids = np.full((q, width), -1, np.int64)
        sims = np.full((q, width), -2.0, np.float32)
        done = np.ones((q, width), bool)
        ids[:, 0], done[:, 0] = entry, False
        sims[:, 0] = np.einsum("qd,qd->q", queries, self.vectors[entry])
        seen[rows, entry] = True
        active = rows
        while len(active):
            waiting = np.where(done[active], -3.0, sims[active])
            best = waiting.argmax(axis=1)
            go = waiting[np.arange(len(active)), best] > -2.5
            active, best = active[go], best[go]
            if not len(active):
                break
            done[active, best] = True
            near = table[ids[active, best]]
            fresh = (near >= 0) & (near < known)
            near = np.where(fresh, near, 0)
            fresh &= ~seen[active[:, None], near]
            r, c = np.nonzero(fresh)
            seen[active[r], near[r, c]] = True
            got = np.full(near.shape, -2.0, np.float32)
            got[r, c] = np.einsum("qd,qd->q", queries[active[r]], self.vectors[near[r, c]])
            all_sims = np.concatenate([sims[active], got], axis=1)
            order = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            sims[active] = np.take_along_axis(all_sims, order, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1), order, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), order, 1)
        return _top(sims, ids, width)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and nodes of a beam of that width, the best first."""
        n = len(self.vectors)
        entry = np.zeros(len(queries), np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            entry = self._beam(queries, entry, level, 1, self.levels[level])[1][:, 0]
        return self._beam(queries, entry, 0, min(width, n), n)


def units(raw: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]
    return x


class Shard:
    """A graph with its nodes' ids, numbers of copies and vectors as they were given."""

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, raw: np.ndarray):
        self.graph = Graph(units(raw).astype(np.float32))
        order = self.graph.order
        self.nodes, self.copies, self.raw = nodes[order], copies[order], raw[order]
        self._index()

    def _index(self) -> None:
        self.up = np.arange(len(self.nodes))
        self.by_id = np.argsort(self.nodes)

    def dump(self) -> bytes:
        """Without the unit vectors, which load() computes again."""
        return pickle.dumps((self.nodes, self.copies, self.raw, self.graph.links, self.graph.levels), protocol=5)

    @staticmethod
    def load(raw: bytes) -> Shard:
        self, self.graph = Shard.__new__(Shard), Graph.__new__(Graph)
        self.nodes, self.copies, self.raw, self.graph.links, self.graph.levels = pickle.loads(raw)
        self.graph.vectors = units(self.raw).astype(np.float32)
        self._index()
        return self

    def _sure(self, queries: np.ndarray, r: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of query and node whose cosine in double precision is the threshold or more."""
        keep = [np.einsum("qd,qd->q", queries[r[i : i + 65536]], units(self.raw[c[i : i + 65536]])) >= threshold for i in range(0, len(r), 65536)]
        sure = np.concatenate([np.zeros(0, bool), *keep])
        return r[sure], c[sure]

    def scan(self, queries: np.ndarray, todo: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the queries numbered `todo` by full scans, some queries at a time."""
        for at in range(0, len(todo), SCANNED):
            part = todo[at : at + SCANNED]
            r, c = np.nonzero(queries[part].astype(np.float32) @ self.graph.vectors.T >= threshold - MARGIN)
            yield self._sure(queries, part[r], c, threshold)

    def pairs(self, queries: np.ndarray, beam: int, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) of cosine `threshold` or more by widening beams, a full scan beyond MAX_BEAM; a query's pairs come together."""
        n, todo = len(self.nodes), np.arange(len(queries))
        batch = max(16, min(4 * BATCH, SEEN_BYTES // max(1, n)))
        while len(todo) and beam <= MAX_BEAM and beam < n:
            wider = []
            for at in range(0, len(todo), batch):
                part = todo[at : at + batch]
                sims, ids = self.graph.search(queries[part].astype(np.float32), beam)
                full = sims[:, -1] >= threshold - MARGIN
                wider.append(part[full])
                r, c = np.nonzero((sims >= threshold - MARGIN) & ~full[:, None])
                yield self._sure(queries, part[r], ids[r, c], threshold)
            todo, beam = np.concatenate(wider), beam * WIDEN
        yield from self.scan(queries, todo, threshold)

    def audit(self, queries: np.ndarray, threshold: float = THRESHOLD) -> tuple[int, int, int]:
        """The beam that the queries need, found by a share of them, and how many of their links it finds of how many."""
        some = queries[:: AUDIT_SHARE]
        true = sum(len(r) for r, _ in self.scan(some, np.arange(len(some)), threshold))
        for k in range(AUDIT_ROUNDS):
            beam = BEAM << k
            found = sum(len(r) for r, _ in self.pairs(some, beam, threshold))
            if found >= AUDIT_RECALL * true:
                return beam, found, true
        return MAX_BEAM + 1, true, true

    def _roots(self, at: np.ndarray) -> np.ndarray:
        """The roots of nodes in the union-find, whose paths are cut short."""
        root = self.up[at]
        while True:
            above = self.up[root]
            if (above == root).all():
                self.up[at] = root
                return root
            root = above

    def answer(self, ids: np.ndarray, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(u, v, linked, kind) columns: counts of linked vectors, a forest of links, and the audit's two numbers."""
        linked, left, right = np.zeros(len(ids), np.int64), [], []
        place = self.by_id[np.minimum(np.searchsorted(self.nodes, ids, sorter=self.by_id), len(self.nodes) - 1)]
        own = np.where(self.nodes[place] == ids, place, -1)
        beam, found, true = self.audit(queries)
        for r, c in self.pairs(queries, beam):
            other = c != own[r]
            r, c = r[other], c[other]
            if not len(r):
                continue
            linked += np.bincount(r, weights=self.copies[c], minlength=len(ids)).astype(np.int64)
            order = np.argsort(r, kind="stable")
            r, c = r[order], c[order]
            starts = np.concatenate([[0], np.nonzero(r[1:] != r[:-1])[0] + 1, [len(r)]])
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                q, roots = r[s], np.unique(self._roots(c[s:e]))
                if own[q] >= 0:  # the query is a node here: what is with it already needs no link
                    home = self._roots(own[q : q + 1])[0]
                    roots = roots[roots != home]
                else:
                    home = roots[0]
                left += [ids[q]] * len(roots)
                right += self.nodes[roots].tolist()
                self.up[roots] = home
        some = np.nonzero(linked)[0]
        one = lambda x: np.array([x], np.int64)
        return [
            (ids[some], ids[some], linked[some], COUNT),
            (np.array(left, np.int64), np.array(right, np.int64), np.zeros(len(left), np.int64), LINK),
            (one(0), one(0), one(found), FOUND),
            (one(0), one(0), one(true), TRUE),
        ]


def _digested(id_col: str, kind: type):
    """Digests of unit vectors and the vectors' bytes; null where a vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, bodies, dims = [], [], []
            for v in batch.column(1).to_pylist():
                x = None if v is None or any(c is None for c in v) else np.asarray(v, kind)
                if x is not None and len(x) and np.isfinite(x).all() and x.any():
                    digests.append(hashlib.sha256(units(x[None]).tobytes()).digest())
                    bodies.append(x.tobytes())
                    dims.append(len(x))
                else:
                    digests.append(None)
                    bodies.append(None)
                    dims.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(bodies, pa.binary()), pa.array(dims, pa.int32())], names=[id_col, "digest", "body", "dims"])

    return run


def _matrix(bodies, dims: int) -> np.ndarray:
    """Vectors from their bytes, single or double precision by their length."""
    whole = b"".join(bodies)
    return np.frombuffer(whole, np.float32 if len(whole) == 4 * dims * len(bodies) else np.float64).reshape(len(bodies), dims)


def _build(key, rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's graph, cut in chunks."""
    rows = rows.sort_values("node")
    raw = Shard(rows["node"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64), _matrix(rows["body"].tolist(), key[0])).dump()
    parts = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
    return pd.DataFrame({"dims": key[0], "shard": key[1], "part": range(len(parts)), "body": parts})


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of cells in a sorted partition: a cell's graph comes first, then its queries, which are answered as they come."""
    cell, chunks, shard, waiting = None, [], None, []

    def answers(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        ids = np.array([r[0] for r in rows], np.int64)
        for u, v, n, kind in shard.answer(ids, units(_matrix([r[1] for r in rows], cell[0]))):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n), pa.array(np.full(len(u), kind, np.int32))], names=["u", "v", "linked", "kind"])

    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)]
        bodies = batch.column(5)
        for i, (dims, number, block, part, node) in enumerate(zip(*(c.tolist() for c in columns), strict=True)):
            if (dims, number, block) != cell:
                if waiting:
                    yield from answers(waiting)
                cell, chunks, shard, waiting = (dims, number, block), [], None, []
            if part >= 0 and node < 0:
                chunks.append(bodies[i].as_py())
                continue
            if shard is None:
                if not chunks:  # a shard without nodes
                    continue
                shard, chunks = Shard.load(b"".join(chunks)), []
            waiting.append((node, bodies[i].as_py()))
            if len(waiting) == STRETCH:
                yield from answers(waiting)
                waiting = []
    if waiting:
        yield from answers(waiting)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_shards: int = MIN_SHARDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, n_links, component, audit_recall) of every vector; a linked pair has cosine of THRESHOLD or more.

    audit_recall is the share of the audited queries' links that their beams
    found, the same in every row; 1 where there were none to find.
    """
    types = dict(df.dtypes)
    kind = np.float32 if types[vector_col] == "array<float>" else np.float64
    given = df.select(F.col(id_col), F.col(vector_col).cast("array<float>" if kind is np.float32 else "array<double>"))
    vectors = materialize(given.mapInArrow(_digested(id_col, kind), f"{id_col} {types[id_col]}, digest binary, body binary, dims int"), "vectors")
    once = vectors.where("digest is not null").groupBy("digest").agg(F.count("*").alias("copies"), F.min(id_col).alias("rep"), F.first("body").alias("body"), F.first("dims").alias("dims"))
    nodes = materialize(once.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n = F.col("n")
    dealt = nodes.groupBy("dims").agg(F.count("*").alias("n")).select("dims", F.greatest(F.ceil(n * F.col("dims") * 4 / shard_bytes), F.least(F.lit(min_shards), F.ceil(n / LEAST_ROWS))).cast("int").alias("shards"))
    shards, cells = dealt.agg(F.coalesce(F.sum("shards"), F.lit(1)), F.coalesce(F.sum(F.col("shards") * F.col("shards")), F.lit(1))).first()
    total = nodes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    home = lambda salt: F.pmod(F.xxhash64("digest", F.lit(salt)), F.col("shards")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    placed = nodes.join(dealt, "dims")
    # A number of partitions is given wherever work is out of proportion to bytes, which small ones are put together by.
    graphs = materialize(placed.select("dims", home(1).alias("shard"), "node", "copies", "body").repartition(min(4 * shards, 1 << 15), "dims", "shard").groupBy("dims", "shard").applyInPandas(_build, "dims int, shard int, part int, body binary"), "graphs")
    sent = graphs.join(dealt, "dims").select("dims", "shard", every.alias("block"), "part", F.lit(-1).cast("long").alias("node"), "body")
    asked = placed.select("dims", every.alias("shard"), home(2).alias("block"), F.lit(1 << 30).alias("part"), "node", "body")
    keys = ["dims", "shard", "block"]
    ready = sent.unionAll(asked).repartition(min(4 * cells, 1 << 15), *keys).sortWithinPartitions(*keys, "part")
    found = materialize(ready.mapInArrow(_cells, "u long, v long, linked long, kind int"), "links")
    linked = found.where(F.col("kind") == COUNT).groupBy(F.col("u").alias("node")).agg(F.sum("linked").alias("others"))
    components = connected_components(found.where(F.col("kind") == LINK).select("u", "v"))
    classes = nodes.select("digest", "node", "copies", "rep").join(linked, "node", "left").join(components, "node", "left").select("digest", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "rep", F.coalesce("component", "node").alias("class"))
    named = classes.groupBy("class").agg(F.min("rep").alias("component"))
    by_digest = classes.join(named, "class").select("digest", "copies", "n_links", "component")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("linked")).otherwise(0))
    recall = found.agg(F.coalesce(F.try_divide(of(FOUND), of(TRUE)), F.lit(1.0)).alias("audit_recall"))
    out = join_unique(vectors.select(F.col(id_col).alias("_id"), "digest"), by_digest, "digest", "copies", total).join(F.broadcast(recall), F.lit(True))  # one row
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "_id").alias("component"), "audit_recall")
