"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits: lower-cased (A-Z) words, n-word shingles with
repeats, XXH64 (seed 42) of each, and per bit the majority over half.

Fingerprints that differ in 3 bits or fewer are linked. A fingerprint is cut in
four 16-bit segments, a ring. Three errors leave a segment i without an error
whose successor on the ring has one at most: one segment at least has none, and
of two or more such segments at most one is followed by a segment with two
errors or more. So a key is segment i exactly plus a codeword near segment i+1:
segments are read as words of the binary Golay code (23,12,7), which decodes
every word to the one codeword within 3 errors. A fingerprint is indexed under
the codeword of its segment and looked up under the codewords of that segment
with no or one bit turned (six on average, 12 bits each), so a pair with one
error meets under the index key of either side.

Keys with more rows than a block are a grid: an index row has one row of it, a
look-up row one column, and each cell is a run of its own, so a run holds about
two blocks at most. A key of n rows costs n / BLOCK copies of a row and no more.
Within a run only a spanning forest of its links is emitted, so a large group of
near copies never becomes all its pairs. Exact copies share one fingerprint row.

Null and empty texts, and texts without words, have the fingerprint zero and are
linked like any other. Null ids are never a component's name unless a component
has no other id. Repeated rows give repeated results; an empty table an empty
result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import connected_components, materialize

SEED, DISTANCE, SHINGLE = 42, 3, 3
#: Fingerprints (eight bytes each) of a key in a row or column of its grid.
BLOCK = 1 << 16
#: What a row of a run is for.
LOOKUP, INDEX, BOTH = range(3)

# Golay (23,12,7): generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR, CHECK_BITS, CODE_BITS = 0b110001110101, 11, 23
BITS_AT_ONCE = 1 << 16


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders by the generator polynomial."""
    rest = words.astype(np.int64).copy()
    for bit in range(CODE_BITS - 1, CHECK_BITS - 1, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - CHECK_BITS))
    return rest


def _error_table() -> np.ndarray:
    """The one error pattern of weight 3 or less for each syndrome."""
    ones = 1 << np.arange(CODE_BITS, dtype=np.int64)
    patterns = {0}
    for _ in range(3):
        patterns |= {p | int(b) for p in patterns for b in ones}
    patterns = np.array(sorted(patterns))
    table = np.zeros(1 << CHECK_BITS, np.int64)
    table[_syndromes(patterns)] = patterns
    return table


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit segment: its codeword index, and the indices near it (padded with -1)."""
    segments = np.arange(1 << 16, dtype=np.int64)
    errors = _error_table()
    decode = lambda w: (w ^ errors[_syndromes(w)]) >> CHECK_BITS
    own = decode(segments << (CODE_BITS - 16))
    near = np.sort(np.stack([own, *(own[segments ^ (1 << b)] for b in range(16))], axis=1), axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near = -np.sort(-near, axis=1)
    return own.astype(np.int64), near[:, : (near >= 0).sum(axis=1).max()]


_golay: list = []


def golay() -> tuple[np.ndarray, np.ndarray]:
    """The decoding tables, made once in a process."""
    if not _golay:
        _golay.append(_tables())
    return _golay[0]


def shingle_hashes(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's n-word shingles in order, with repeats; of all its words where they are fewer, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=False)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are 1 in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), BITS_AT_ONCE):
        ones += np.unpackbits(hashes[part : part + BITS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, n))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """(id, text_sha, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), n) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=[id_col, "text_sha", "fp"])

    return df.select(id_col, text_sha(text_col).alias("text_sha"), F.col(text_col)).mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, text_sha string, fp long")


def text_sha(text_col: str) -> Column:
    """A digest of a text; null has its own."""
    return F.coalesce(F.sha2(F.col(text_col), 256), F.lit("null"))


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row number, is index key) for all keys of unsigned fingerprints."""
    own, near = golay()
    keys, rows, index = [], [], []
    at = np.arange(len(fps))
    for i in range(4):
        exact = ((fps >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64)
        fuzzy = ((fps >> np.uint64(16 * ((i + 1) % 4))) & np.uint64(0xFFFF)).astype(np.int64)
        head = (np.int64(i) << 28) | (exact << 12)
        found = near[fuzzy]
        r, c = np.nonzero(found >= 0)
        keys.append(head[r] | found[r, c])
        rows.append(at[r])
        index.append(found[r, c] == own[fuzzy[r]])
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(index)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for part in range(0, len(fps), 8192):
            some = fps[part : part + 8192]
            key, row, index = keys_of(some.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some[row]), pa.array(index)], names=["key", "fp", "indexed"])


def forest(fps: np.ndarray, roles: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between index rows and look-up rows of a run."""
    label = np.arange(len(fps))
    asked = np.nonzero(roles != INDEX)[0]
    seen = fps[asked]
    left, right = [], []
    for i in np.nonzero(roles != LOOKUP)[0]:
        linked = asked[np.bitwise_count(seen ^ fps[i]) <= distance]
        other, first = np.unique(label[linked], return_index=True)
        apart = other != label[i]
        if apart.any():
            left += [fps[i]] * int(apart.sum())
            right += fps[linked[first[apart]]].tolist()
            label[np.isin(label, other[apart])] = label[i]
    return np.array(left, np.uint64), np.array(right, np.uint64)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of the runs of equal (key, cell) in a sorted partition; a run is carried over batch ends."""

    def runs(key, salt, fp, role, last):
        starts = np.concatenate([[0], np.nonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))[0] + 1])
        ends = np.concatenate([starts[1:], [len(key)]])
        if not last:
            rest, starts, ends = starts[-1], starts[:-1], ends[:-1]
        else:
            rest = len(key)
        left, right = [], []
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            if (role[s:e] != LOOKUP).any():
                u, v = forest(fp[s:e], role[s:e])
                left.append(u)
                right.append(v)
        pick = lambda parts: np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
        return rest, pa.RecordBatch.from_arrays([pa.array(pick(left)), pa.array(pick(right))], names=["u", "v"])

    held = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
        now[2] = now[2].view(np.uint64)
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        if len(held[0]):
            rest, out = runs(*held, last=False)
            held = [x[rest:] for x in held]
            yield out
    if held is not None and len(held[0]):
        yield runs(*held, last=True)[1]


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that join all distinct fingerprints `fp` within DISTANCE bits of one another into their components."""
    keyed = distinct.select("fp").mapInArrow(_keyed, "key long, fp long, indexed boolean")
    # At most one hot key for each BLOCK rows.
    hot = keyed.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("side"))
    salted = keyed.join(hot, "key", "left").select("key", "fp", "indexed", F.coalesce("side", F.lit(1)).alias("side"))
    home = F.pmod(F.xxhash64("fp"), F.col("side")).cast("int")
    every = F.sequence(F.lit(0), F.col("side") - 1)
    across = F.transform(every, lambda b: F.struct((home * F.col("side") + b).alias("cell"), F.when(b == home, BOTH).otherwise(INDEX).alias("role")))
    down = F.transform(every, lambda a: F.struct((a * F.col("side") + home).alias("cell"), F.lit(LOOKUP).alias("role")))
    cells = F.when(F.col("indexed"), F.concat(across, F.filter(down, lambda c: c["cell"] != home * F.col("side") + home))).otherwise(down)
    ready = salted.select("key", "fp", F.explode(cells).alias("c")).select("key", "c.cell", "fp", "c.role")
    return ready.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_linked, "u long, v long")


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints (id, text_sha, fp), and (fp, class, component) of the distinct ones."""
    prints = materialize(fingerprints(df, id_col, text_col, n), "fingerprints")
    reps = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("rep")), "fingerprint-reps")
    components = connected_components(links(reps, block))
    classes = reps.join(components.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("class"))
    named = classes.groupBy("class").agg(F.min("rep").alias("component"))
    return prints, classes.join(named, "class").select("fp", "class", "component")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(id, fp, component) of every row; component is the smallest id in the row's component."""
    prints, classes = classify(df, id_col, text_col, n, block)
    return prints.join(classes, "fp").select(id_col, "fp", "component")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, then of the smallest text digest."""
    prints, classes = classify(df, id_col, text_col, n, block)
    return first_rows(df, prints.join(classes, "fp"), id_col, text_col)


def first_rows(df: DataFrame, classed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each class of `classed` (id, text_sha, class), with all its columns."""
    firsts = classed.groupBy("class").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "text_sha")).alias("k"))
    key = lambda own, sha: F.sha2(F.concat(F.coalesce(own.cast("string"), F.lit("null")), F.lit("/"), sha), 256)
    rows = df.select(F.struct("*").alias("row"), key(F.col(id_col), text_sha(text_col)).alias("_key"))
    kept = rows.join(firsts.select(key(F.col("k.id"), F.col("k.text_sha")).alias("_key")), "_key", "left_semi")
    return kept.groupBy("_key").agg(F.first("row").alias("row")).select("row.*")  # repeated rows are one
