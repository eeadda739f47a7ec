"""Pairwise alignment with affine gaps, and what it serves: redundancy filtering.

Scores come from anti-diagonal dynamic programming in numpy; one traceback is
chosen (diagonal before gaps), so scores are comparable and strings are one of
the optimal alignments.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The BLOSUM62 substitution scores, rows and columns in this order of letters.
LETTERS = "ARNDCQEGHILKMFPSTWYVBZX*"
BLOSUM62 = """
 4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0 -2 -1  0 -4
-1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3 -1  0 -1 -4
-2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3  3  0 -1 -4
-2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3  4  1 -1 -4
 0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1 -3 -3 -2 -4
-1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2  0  3 -1 -4
-1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3 -1 -2 -1 -4
-2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3  0  0 -1 -4
-1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3 -3 -3 -1 -4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1 -4 -3 -1 -4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2  0  1 -1 -4
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1 -3 -1 -1 -4
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1 -3 -3 -1 -4
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2 -2 -1 -2 -4
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2  0  0  0 -4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0 -1 -1  0 -4
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3 -4 -3 -2 -4
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1 -3 -2 -1 -4
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4 -3 -2 -1 -4
-2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4  1 -1 -4
-1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1 -4
-4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4  1
"""
MATRICES = {"blosum62": np.array(BLOSUM62.split(), np.int32).reshape(24, 24)}
LOW = -(1 << 28)
#: Alignments that a task keeps for equal pairs to come.
KEPT = 1 << 15


def _codes(sequence: str) -> np.ndarray:
    """Letter numbers; unknown letters count as X."""
    table = np.full(128, LETTERS.index("X"))
    for i, c in enumerate(LETTERS):
        table[ord(c)] = i
    raw = np.frombuffer(sequence.upper().encode("ascii", "replace"), np.uint8)
    return table[np.minimum(raw, 127)]


def align(query: str, ref: str, mode: str = "local", gap_open: int = 10, gap_extend: int = 1, matrix: str = "blosum62") -> dict:
    """Score, statistics and strings of one optimal alignment; modes other than local align end to end."""
    if not isinstance(query, str) or not isinstance(ref, str) or not query or not ref:
        raise ValueError("sequences must be strings with a letter")
    if matrix not in MATRICES:
        raise ValueError(f"unknown matrix {matrix!r}")
    local = mode == "local"
    s = MATRICES[matrix][np.ix_(_codes(query), _codes(ref))]
    n, m = s.shape
    best, up, left = (np.full((n + 1, m + 1), LOW, np.int32) for _ in range(3))
    best[0, 0] = 0
    if local:
        best[0], best[:, 0] = 0, 0
    else:
        up[1:, 0] = -gap_open - gap_extend * np.arange(n)
        left[0, 1:] = -gap_open - gap_extend * np.arange(m)
        best[1:, 0], best[0, 1:] = up[1:, 0], left[0, 1:]
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        up[i, j] = np.maximum(best[i - 1, j] - gap_open, up[i - 1, j] - gap_extend)
        left[i, j] = np.maximum(best[i, j - 1] - gap_open, left[i, j - 1] - gap_extend)
        top = np.maximum(best[i - 1, j - 1] + s[i - 1, j - 1], np.maximum(up[i, j], left[i, j]))
        best[i, j] = np.maximum(top, 0) if local else top
    i, j = np.unravel_index(int(best.argmax()), best.shape) if local else (n, m)
    score, a, b, state = int(best[i, j]), [], [], "best"
    while (i or j) and not (local and state == "best" and best[i, j] == 0):
        if state == "best":
            if i and j and best[i, j] == best[i - 1, j - 1] + s[i - 1, j - 1]:
                i, j = i - 1, j - 1
                a.append(query[i])
                b.append(ref[j])
            else:
                state = "up" if best[i, j] == up[i, j] else "left"
        elif state == "up":
            state = "best" if i and up[i, j] == best[i - 1, j] - gap_open else "up"
            i -= 1
            a.append(query[i])
            b.append("-")
        else:
            state = "best" if j and left[i, j] == best[i, j - 1] - gap_open else "left"
            j -= 1
            a.append("-")
            b.append(ref[j])
    a, b = "".join(reversed(a)), "".join(reversed(b))
    matches = sum(x == y and x != "-" for x, y in zip(a, b, strict=True))
    gaps = a.count("-") + b.count("-")
    codes = zip(_codes(a.replace("-", "*")), _codes(b.replace("-", "*")), a, b, strict=True) if a else []
    positives = sum(x != "-" and y != "-" and MATRICES[matrix][p, q] > 0 for p, q, x, y in codes)
    length = len(a)
    share = lambda k: 100.0 * k / length if length else 0.0
    return {"score": score, "length": length, "matches": matches, "mismatches": max(0, length - matches - gaps), "gaps": gaps, "identity": share(matches), "positives": share(positives), "query": a, "ref": b}


SCHEMA = "score int, length int, matches int, mismatches int, gaps int, identity double, positives double, query string, ref string"


def align_pairs(pairs: DataFrame, mode: str = "local", **options) -> DataFrame:
    """Pairs (id, a, b) with the fields of align(); pairs with an empty side give nulls; a task keeps its last KEPT alignments, so equal pairs are aligned once."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int32()] * 5 + [pa.float64()] * 2 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = lru_cache(KEPT)(lambda a, b: align(a, b, mode, **options))
        for batch in batches:
            rows = [once(a, b) if a and b else dict.fromkeys(names) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True))], names=["id", *names])

    return pairs.select("id", "a", "b").mapInArrow(run, f"id {dict(pairs.dtypes)['id']}, {SCHEMA}")


def redundant(examples: DataFrame, hits: DataFrame, min_identity: float = 30.0, min_coverage: float = 0.8) -> DataFrame:
    """Ids of train and val rows with a hit (query, target, pident, qcov, tcov) in the test split."""
    test = examples.where("split = 'test'").select(F.col("id").alias("target"))
    close = hits.where((F.col("pident") >= min_identity) & (F.col("qcov") >= min_coverage) & (F.col("tcov") >= min_coverage)).join(test, "target", "left_semi")
    return examples.where("split <> 'test'").join(close.select(F.col("query").alias("id")).distinct(), "id", "left_semi").select("id")


def best_hits(hits: DataFrame) -> DataFrame:
    """Per query its hit of the largest (bits, pident); the first in file order wins ties."""
    return hits.groupBy("query").agg(F.max_by("target", F.struct("bits", "pident", -F.col("position"))).alias("target"), F.max(F.struct("bits", "pident")).alias("m")).select("query", "target", "m.bits", "m.pident")
