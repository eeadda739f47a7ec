"""Spearman's rho of the distances of all pairs of vectors and the gaps of their labels, in bounded memory.

Ranks need no sorted pairs. The ranks of gaps follow from the labels' counts.
Distances are whole numbers of 1e-9; each pair is counted in a bin of these, with
the sum of its gap's rank, and the ranks of distances follow from the bins' counts.
In a bin of one value that is exact. In a wider one the true sums differ by no
more than the Cauchy-Schwarz bound, so rho lies in an interval. Bins are made
finer where pairs are, in more passes over the value range if need be, until both
ends of the interval round to one number: that is the exact result rounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import vec
from strandlake.operators import knn

#: Distances are rounded to 1 / UNIT and at most 2.
UNIT = 10**9
#: Slots of the value range (each cut in bins of equal width), bins of a pass, pairs at once, bins a row.
SLOTS, BINS, STEP, SLICE = 1 << 16, 1 << 22, 1 << 22, 1 << 16
#: Rows whose pairs tell the first pass where to make bins; every pair is counted whatever they tell.
FIRST = 1 << 10
WIDTH = -(-(2 * UNIT + 1) // SLOTS)


def whole_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine distances of all rows of unit (or zero) vectors, rounded to whole numbers of 1 / UNIT."""
    d = a @ b.T
    np.subtract(1, d, out=d)
    np.clip(d, 0, 2, out=d)
    d *= UNIT
    return np.rint(d, out=d).astype(np.int32)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def layout(counts: np.ndarray, bins: int) -> np.ndarray:
    """Bins of each slot: by its share of the pairs, one at least and a bin a value at most."""
    share = np.ceil(counts / max(1, counts.sum()) * bins)
    return np.minimum(np.maximum(share, 1), WIDTH).astype(np.int64)


def gap_ranks(counts: dict) -> tuple[list, np.ndarray, float]:
    """Labels, ranks (less the mean) of each two labels' gap, and their sum of squares over all pairs."""
    labels = sorted(counts)
    sizes = np.array([counts[k] for k in labels], float)
    values = np.array(labels, float)
    gaps = np.abs(values[:, None] - values[None])
    pairs = np.triu(sizes[:, None] * sizes[None], 1)
    np.fill_diagonal(pairs, sizes * (sizes - 1) / 2)
    distinct, place = np.unique(gaps, return_inverse=True)
    tied = np.bincount(place.ravel(), pairs.ravel(), len(distinct))
    rank = np.cumsum(tied) - tied + (tied + 1) / 2
    rank -= (tied.sum() + 1) / 2
    return labels, rank[place.reshape(gaps.shape)], float(tied @ rank**2)


def _count(ranks: np.ndarray, bins: np.ndarray, low: int, high: int, blocks: int):
    """Cells of a sorted partition: rows of one side, then of the other; pairs are counted in the bins of slots low to high."""
    base = np.concatenate([[0], np.cumsum(bins[low:high])]).astype(np.int32)
    total, cuts = int(base[-1]), bins.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(total, np.int64), np.zeros(total)

        def pairs(cell: pa.Table, own: bool) -> None:
            side = cell.column("side").to_numpy()
            x = _unit(knn._matrix(cell.column("vector").combine_chunks()))
            label = cell.column("label").to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if own:
                right = left
            if not len(left) or not len(right):
                return
            step = max(1, STEP // max(1, len(right)))
            for at in range(0, len(left), step):
                some = left[at : at + step]
                other = right[at:] if own else right
                v = whole_distances(x[some], x[other])
                slot = v // WIDTH
                weights = ranks[label[some]][:, label[other]]
                if own or high - low < SLOTS:
                    keep = (slot >= low) & (slot < high)
                    if own:
                        keep &= other[None] > some[:, None]
                    v, slot, weights = v[keep], slot[keep], weights[keep]
                v -= slot * WIDTH
                v *= cuts[slot]
                v //= WIDTH
                v += base[slot - low]
                n[:] += np.bincount(v.ravel(), minlength=total)
                s[:] += np.bincount(v.ravel(), weights.ravel(), minlength=total)

        cell, held = None, []
        for batch in batches:
            cells = batch.column(0).to_numpy()
            ends = [*(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                if a < b:
                    if held and cells[a] != cell:
                        pairs(pa.Table.from_batches(held), cell // blocks == cell % blocks)
                        held = []
                    cell = cells[a]
                    held.append(batch.slice(a, b - a))
        if held:
            pairs(pa.Table.from_batches(held), cell // blocks == cell % blocks)
        for i in range(0, total, SLICE):
            if n[i : i + SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // SLICE]), pa.array([n[i : i + SLICE].tobytes()], pa.binary()), pa.array([s[i : i + SLICE].tobytes()], pa.binary())], names=["slice", "n", "s"])

    return run


def _sums(bins: np.ndarray, low: int, high: int):
    """Of a slice of bins: pairs, rank sum, sum of mean places times rank sums, what ties take of the squares, what is open of them, pairs by slot."""
    slots = np.repeat(np.arange(low, high), bins[low:high])

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        n, s = sum(np.frombuffer(b, np.int64) for b in rows["n"]), sum(np.frombuffer(b, np.float64) for b in rows["s"])
        slot = slots[int(key[0]) * SLICE :][: len(n)]
        many = n.astype(float)
        loss, single = (many**3 - many) / 12, bins[slot] == WIDTH
        place = np.cumsum(many) - many + (many + 1) / 2
        by_slot = np.bincount(slot, many, SLOTS).astype(np.int64)
        return pd.DataFrame({"slice": [key[0]], "pairs": [int(n.sum())], "ranks": [s.sum()], "product": [float(place @ s)], "tied": [loss[single].sum()], "open": [loss[~single].sum()], "slots": [by_slot[low:high].tobytes()]})

    return run


def regular(rows: DataFrame) -> bool:
    """Whether every row has a label and an id of its own, as label_gap_rho() needs."""
    return rows.where("label is null or id is null").isEmpty() and rows.groupBy("id").count().where("count > 1").isEmpty()


def label_gap_rho(rows: DataFrame, digits: int = 5) -> float | None:
    """Spearman's rho, rounded, over all pairs of rows (id, vector, label) with labels and ids of their own. Null where rho is undefined."""
    spark = rows.sparkSession
    rows = rows.select("id", vec.as_double("vector").alias("vector"), "label").where("vector is not null and size(vector) > 0 and id is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}  # a row per label
    n = sum(counts.values())
    if n < 2:
        return None
    labels, ranks, squares = gap_ranks(counts)
    codes = F.broadcast(spark.createDataFrame([(x, i) for i, x in enumerate(labels)], f"label {dict(rows.dtypes)['label']}, code int"))
    coded = rows.join(codes, "label").select("id", "vector", F.col("code").alias("label"))
    blocks = -(-n // knn.BLOCK_ROWS)
    dealt = coded.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    # Each two blocks meet once: cell (i, j) with i <= j.
    other = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    cell = F.least("block", "j") * blocks + F.greatest("block", "j")
    side = F.when(F.col("block") <= F.col("j"), 0).otherwise(1)
    tasks = int(min(blocks * (blocks + 1) // 2, 2 * spark.sparkContext.defaultParallelism))
    number = F.least("block", "j") * blocks - F.floor(F.least("block", "j") * (F.least("block", "j") - 1) / 2) + F.greatest("block", "j") - F.least("block", "j")
    ready = other.select(cell.cast("long").alias("cell"), side.alias("side"), "id", "label", "vector", F.pmod(number, F.lit(tasks)).cast("int").alias("task"))
    ready = ready.repartitionById(tasks, "task").sortWithinPartitions("cell", "side").drop("task")
    some = coded.limit(FIRST).select("vector").toArrow().column("vector").combine_chunks()
    x = _unit(knn._matrix(some))
    slots = np.bincount((whole_distances(x, x) // WIDTH)[np.triu_indices(len(x), 1)], minlength=SLOTS)
    width = BINS
    while True:
        bins = layout(slots, width)
        edges, passes = np.cumsum(bins), []
        at = 0
        while at < SLOTS:
            end = max(at + 1, int(np.searchsorted(edges, (edges[at - 1] if at else 0) + BINS + SLOTS, "right")))
            passes.append((at, min(end, SLOTS)))
            at = passes[-1][1]
        before, product, tied, open_, found = 0, 0.0, 0.0, 0.0, []
        for low, high in passes:
            counted = ready.mapInArrow(_count(ranks, bins, low, high, blocks), "slice long, n binary, s binary")
            told = counted.groupBy("slice").applyInPandas(_sums(bins, low, high), "slice long, pairs long, ranks double, product double, tied double, open double, slots binary").collect()
            here = np.zeros(high - low, np.int64)
            for r in sorted(told, key=lambda r: r["slice"]):
                product += r.product + before * r.ranks
                before, tied, open_ = before + r.pairs, tied + r.tied, open_ + r.open
                here += np.frombuffer(r.slots, np.int64)
            found.append(here)
        slots = np.concatenate(found)
        most = (float(before) ** 3 - before) / 12 - tied  # squares of the ranks of distances if no open tie holds
        least = max(0.0, most - open_)
        if squares <= 0 or most <= 0:
            return None
        slack = math.sqrt(open_ * squares)
        ends = [p / math.sqrt(q * squares) if q > 0 else math.copysign(math.inf, p) for p in (product - slack, product + slack) for q in (least, most)]
        if open_ == 0 or round(min(ends), digits) == round(max(ends), digits):
            return round(product / math.sqrt(most * squares), digits)
        middle, scale = product / math.sqrt(most * squares), 10**digits
        room = abs((middle * scale - 0.5) - round(middle * scale - 0.5)) / scale  # to the next value that rounds otherwise
        width *= max(2, min(64, math.ceil(1.5 * (max(ends) - min(ends)) / max(room, 1e-12))))
