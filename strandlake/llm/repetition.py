"""Quality rules by repetition coverage.

Words are maximal runs of characters other than space and U+0009-U+000D. Every
whole text is coded as word numbers, and rolling polynomial hashes of rising
n-gram lengths are extended in numpy (one multiply-add per length). An n-gram
can only repeat where its prefix and suffix of the length before repeat, so each
length sorts the positions that the length before left. Equal hashes are
compared word by word; a collision falls back to exact grouping.

Null texts count as empty: no words, base_failed. Texts with fewer words than a
length have no n-gram of it. Repeated rows give repeated results, an empty table
an empty result. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
BASE_N = 3
MIN_WORDS = 50

#: Largest share of word characters inside n-grams found twice or more, by n-gram length.
COVERAGE_LIMITS = {3: 0.50, 5: 0.35, 7: 0.30, 10: 0.25}
#: Largest share of characters on lines that are equal to another line.
LINE_LIMIT = 0.40

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread small numbers over 64 bits."""
    z = (x.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def word_codes(words: list[bytes]) -> np.ndarray:
    """The words' numbers in order of first appearance."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def _repeated(codes: np.ndarray, at: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Those of the positions `at` whose n-gram starts at another of them too."""
    order = np.argsort(hashes, kind="stable")
    h, p = hashes[order], at[order]
    same = h[1:] == h[:-1]
    if not same.any():
        return at[:0]
    left, right = p[:-1][same], p[1:][same]
    if all((codes[left + k] == codes[right + k]).all() for k in range(n)):
        hit = np.zeros(len(h), bool)
        hit[1:] |= same
        hit[:-1] |= same
        return np.sort(p[hit])
    rows = np.lib.stride_tricks.sliding_window_view(codes, n)[at]
    _, back, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    return at[counts[back.ravel()] > 1]


def covered_words(codes: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length, which words lie in an n-gram found twice or more."""
    n_words, out = len(codes), {}
    values = _mix(codes)
    rolling, size = values, 1
    at, before = None, 0
    for n in lengths:
        mask = np.zeros(n_words + 1, np.int64)
        if n_words >= n and (at is None or len(at)):
            with np.errstate(over="ignore"):
                while size < n:
                    rolling = rolling[:-1] * MULTIPLIER + values[size:]
                    size += 1
            if at is None:
                starts = np.arange(n_words - n + 1)
            else:  # prefix and suffix of the shorter length repeat
                repeats = np.zeros(n_words, bool)
                repeats[at] = True
                starts = at[at + n <= n_words]
                starts = starts[repeats[starts + n - before]]
            at = _repeated(codes, starts, rolling[starts], n)
            np.add.at(mask, at, 1)
            np.add.at(mask, at + n, -1)
        elif at is not None or n_words < n:
            at = np.zeros(0, np.int64)
        out[n], before = np.cumsum(mask[:-1]) > 0, n
    return out


def measure(text: str | None, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, line_share, shares...)."""
    limits = limits or COVERAGE_LIMITS
    lengths = sorted({BASE_N, *limits})
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    n_dup_lines = dup_chars = line_chars = 0
    if "\n" in text:
        counts: dict[str, int] = {}
        for line in text.split("\n"):
            if line.strip(SPACES):
                counts[line] = counts.get(line, 0) + 1
        n_dup_lines = sum(c - 1 for c in counts.values())
        line_chars = sum(len(line) * c for line, c in counts.items())
        dup_chars = sum(len(line) * c for line, c in counts.items() if c > 1)
    codes = word_codes(words)
    covered = covered_words(codes, lengths)
    n_repeat = int(covered[BASE_N].sum())
    shares = dict.fromkeys(lengths, 0.0)
    if n_repeat:
        chars = np.fromiter((len(w) for w in words), np.int64, n_words) if text.isascii() else np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n_words)
        shares = {n: float(chars[m].sum()) / word_chars for n, m in covered.items()}
    line_share = dup_chars / line_chars if line_chars else 0.0
    failed = n_words < MIN_WORDS or 100 * n_repeat > 50 * n_words
    kept = not failed and line_share <= line_limit and all(shares[n] <= most for n, most in limits.items())
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat, failed, kept, line_share, *(shares[n] for n in lengths)


def repetition_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """One row of counts, coverage shares and the verdict for every row of the table."""
    limits = limits or COVERAGE_LIMITS
    shares = [f"ngram_share_{n}" for n in sorted({BASE_N, *limits})]
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_share double, " + ", ".join(f"{s} double" for s in shares)
    names = [part.split()[0] for part in schema.split(", ")]
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * (1 + len(shares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py(), limits, line_limit) for t in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return df.select(id_col, text_col).mapInArrow(run, schema)
