"""The pipeline's form of SimHash near-duplicates: five-word shingles and an exact similarity.

A text is its lower-cased (A-Z) five-word shingles, as XXH64 hashes (seed 42).
Texts of one set of shingles are one node. Two nodes are linked when the Jaccard
similarity of their sets is LEAST or more; a class is a component of the links.

Candidates are those that the Golay keys of simhash.py link, fingerprints of the
same shingles within three bits, and those that meet in a MinHash band: two texts
of similarity 0.8 differ in about ten of 64 bits, which Golay keys of 16-bit
segments can't reach, so fingerprints alone would lose most of the pairs that
this stage owes. Exact sets decide on all candidates.

BANDS keys of ROWS minima each make a pair of similarity 0.8 meet in none of
them with a chance of 5e-6. Within a key, first every set is compared with the
key's smallest one. After their components are known, keys whose sets are in
several components are compared in runs: a run holds sets of the key of about
2 * RUN_BYTES at most (a key with more is a grid of blocks), compares each pair of
different components in the first key that it shares, and returns a forest of the
links it finds. So candidates of a large group are never rows of a table, and a
pair that met is left out only where both ends are already in one component or
their sizes alone rule LEAST out.

Null and empty texts and texts without words have the empty set and are one
class. Repeated rows and null ids are rows like others; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import connected_components, join_spread, join_unique, materialize
from strandlake.llm.simhash import first_rows, links, majority, shingle_hashes, text_sha

SEED, SHINGLE, LEAST = 42, 5, 0.8
BANDS, ROWS = 40, 6
HASHES_AT_ONCE, ROWS_AT_ONCE = 1 << 10, 256
#: Bytes of sets in a block of a key's grid, and what a row has besides its set.
RUN_BYTES, ROW_BYTES = 16 << 20, 512

_draw = np.random.default_rng(SEED)
FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band, of the minima of ROWS hash functions; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for part in range(0, len(hashes), HASHES_AT_ONCE):
        least = np.minimum(least, (hashes[part : part + HASHES_AT_ONCE, None] * FACTORS + SHIFTS).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that a task holds few sets at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _sketched(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_sha, node, size, fp, keys) of every row."""

    def sketch(text: str | None) -> tuple[int, int, int, np.ndarray]:
        hashes = shingle_hashes(text, SHINGLE)
        found = np.unique(hashes)
        return _set_id(found), len(found), majority(hashes), band_keys(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            nodes, sizes, prints, keys = zip(*(sketch(t.as_py()) for t in batch.column(2)), strict=True)
            as_long = lambda xs: pa.array(np.array(xs, np.uint64).view(np.int64))
            columns = [batch.column(0), batch.column(1), as_long(nodes), pa.array(sizes, pa.int32()), as_long(prints), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "text_sha", "node", "size", "fp", "keys"])

    return df.select(id_col, text_sha(text_col).alias("text_sha"), F.col(text_col)).mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, text_sha string, node long, size int, fp long, keys array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, hashes) of texts (node, text), one row a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(shingle_hashes(t.as_py(), SHINGLE)).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))], names=["node", "hashes"])

    return texts.select("node", "text").mapInArrow(run, "node long, hashes array<long>")


def _sets_of(asked: DataFrame, df: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """(node, hashes) of the nodes of a table (node), read from one text of each."""
    # Written, so that Spark knows its size when it joins.
    chosen = materialize(nodes.select("node", "text_sha").join(asked.distinct(), "node", "left_semi"), "near-asked")
    texts = df.select(text_sha(text_col).alias("text_sha"), F.col(text_col).alias("text")).join(chosen, "text_sha")
    return materialize(_sets(texts.groupBy("node").agg(F.first("text").alias("text"))), "near-sets")


def _verified(pairs: DataFrame, df: DataFrame, nodes: DataFrame, text_col: str, least: float) -> DataFrame:
    """The pairs (u, v) of nodes whose sets have a similarity of `least` or more."""
    pairs = materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near-pairs")
    sets = _sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")), df, nodes, text_col)
    a, b = (sets.select(F.col("node").alias(end), F.col("hashes").alias(f"h{end}")) for end in ("u", "v"))
    # A group's smallest set is an end of very many pairs.
    both = join_spread(pairs, a, "u").join(b, "v").select("u", "v", F.size("hu").alias("nu"), F.size("hv").alias("nv"), F.size(F.array_intersect("hu", "hv")).alias("both"))
    return materialize(both.where(F.col("both") / (F.col("nu") + F.col("nv") - F.col("both")) >= least).select("u", "v"), "near-links")


def compare(band: int, lead: int, nodes: np.ndarray, classes: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, keys: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between a run's sets of different classes that make them one; pairs of one block are compared in a run of that block alone."""
    label, at, links_ = classes.copy(), np.arange(len(nodes)), []
    values, counts = np.unique(classes, return_counts=True)
    most = classes == values[counts.argmax()]
    apart = blocks.min() != blocks.max()
    for i in np.nonzero(~most & (nodes != lead))[0]:
        ok = (label != label[i]) & (most | (at > i)) & (nodes != lead) & (np.minimum(sizes, sizes[i]) >= least * np.maximum(sizes, sizes[i]))
        if apart:
            ok &= blocks != blocks[i]
        j = np.nonzero(ok)[0]
        j = j[(keys[j] == keys[i]).argmax(axis=1) == band]  # elsewhere the pair is compared in another key
        if not len(j):
            continue
        flat = np.concatenate([sets[k] for k in j])
        found = sets[i][np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)] == flat
        both = np.add.reduceat(found, np.concatenate([[0], np.cumsum(sizes[j])[:-1]]), dtype=np.int64)
        for k in j[both / (sizes[i] + sizes[j] - both) >= least]:
            if label[k] != label[i]:
                links_.append((int(nodes[i]), int(nodes[k])))
                label[label == label[k]] = label[i]
    return links_


def _compared(least: float):
    """compare() on the runs of equal (key, cell) in a sorted partition; one run is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows = None, []

        def out() -> pa.RecordBatch:
            column = lambda k, kind: np.array([r[k] for r in rows], kind)
            order = np.argsort(column(2, np.int64), kind="stable")
            sets = [np.array(rows[k][7], np.int64).view(np.uint64) for k in order]
            pick = lambda k, kind: column(k, kind)[order]
            found = compare(rows[0][0], rows[0][1], pick(2, np.int64), pick(3, np.int64), pick(4, np.int64), pick(5, np.int32), np.array([rows[k][6] for k in order], np.int64), sets, least)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in _slices(batches):
            heads = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            plain = [batch.column(c).to_pylist() for c in range(2, 8)]
            keys, hashes = (batch.column(c) for c in (8, 9))
            for k, head in enumerate(heads):
                if head != name:
                    if len(rows) > 1:
                        yield out()
                    name, rows = head, []
                rows.append((*(c[k] for c in plain), keys[k].values.to_numpy().copy(), hashes[k].values.to_numpy().copy()))
        if len(rows) > 1:
            yield out()

    return run


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(id, text_sha, class) of every row."""
    rows = materialize(_sketched(df, id_col, text_col), "near-rows")
    # A set may come with several fingerprints: one in which shingles repeat has another one.
    prints = materialize(rows.where("size > 0").groupBy("fp").agg(F.min("node").alias("lead")), "near-prints")
    alike = rows.select("node", "fp").distinct().join(prints, "fp").where("node <> lead").select(F.col("lead").alias("u"), F.col("node").alias("v"))
    of = lambda end: prints.select(F.col("fp").alias(end), F.col("lead").alias(f"l{end}"))
    golay = links(prints.select("fp")).distinct().join(of("u"), "u").join(of("v"), "v").select(F.col("lu").alias("u"), F.col("lv").alias("v")).unionAll(alike).where("u <> v")
    nodes = materialize(rows.groupBy("node").agg(F.min("text_sha").alias("text_sha"), F.first("size").alias("size"), F.first("keys").alias("keys")), "near-nodes")
    keyed = nodes.select("node", "size", F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1")
    met = materialize(keyed.join(shared, "key"), "near-met")  # only sets that share a key with another
    asked = met.where("node <> lead").select(F.col("lead").alias("u"), F.col("node").alias("v")).unionAll(golay)
    found = _verified(asked, df, nodes, text_col, least)
    first = materialize(connected_components(found), "near-first")
    placed = met.where("n > 2").join(first.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    placed = materialize(placed, "near-placed")
    weight = F.sum(F.col("size").cast("long") * 8 + ROW_BYTES)
    mixed = placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n"), F.greatest(F.lit(1), F.ceil(weight / run_bytes)).cast("int").alias("side")).where("c0 <> c1")
    rest = materialize(join_unique(placed.drop("n"), mixed.select("key", "n", "side"), "key", "n", placed.count()).where("side is not null"), "near-rest")
    sets = _sets_of(rest.select("node"), df, nodes, text_col).join(nodes.select("node", "keys"), "node")
    home = F.pmod(F.xxhash64("node"), F.col("side")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("side") - 1), lambda b: F.least(home, b) * F.col("side") + F.greatest(home, b))
    ready = rest.join(sets, "node").select("key", F.explode(cells).alias("cell"), "band", "lead", "node", "c", "size", home.alias("block"), "keys", "hashes")
    more = materialize(ready.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_compared(least), "u long, v long"), "near-more")
    end = connected_components(found.unionByName(more))
    return rows.join(end.select("node", "component"), "node", "left").select(id_col, "text_sha", F.coalesce("component", "node").alias("class"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, run_bytes: int = RUN_BYTES) -> DataFrame:
    """One row of each class, with all its columns: that of the smallest id, then of the smallest text digest."""
    return first_rows(df, classify(df, id_col, text_col, least, run_bytes), id_col, text_col)
