"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer numpy network.

Every token falls in one of BUCKETS hash buckets, each with a sparse random
index vector. A bucket's word vector is the normalised sum of the index vectors
around its tokens in the fitting texts, plus its own. A document is the weighted
mean of its tokens' vectors. The network's logits are divided by a temperature
fitted on fitting rows that the network didn't see.

The fit reads at most `max_fit` labelled ids (the smallest hashes), one label of
each (the smallest) and one text (the smallest digest), so that repeated ids add
nothing. The driver gets FIT_TASKS sums of contexts of 4 * BUCKETS * DIM bytes and
a pooled vector of DIM numbers a row; model and broadcast have a fixed size.
Scoring reads every whole text.

Null and empty texts have the zero vector and get the score that the network
gives it. Null labels are not fitted on; with no usable labels every score is
0.5, with one class only the share of that class. Repeated rows give repeated
results, an empty table an empty result. Only the text is an input of a score;
ids choose the fitting rows, and other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import discard, materialize

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 48, 6, 2
HIDDEN, EPOCHS, RATE, DECAY = 32, 300, 0.01, 1e-4
MAX_FIT, FIT_TASKS = 6000, 8
THRESHOLD = 0.7
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CACHE_WORDS = 50_000
#: Tokens whose contexts are summed at once; windows do not reach across segments.
SEGMENT = 256


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


def tokens(word: str) -> tuple[int, ...]:
    """Buckets of a word: its letters in lower case, its marks, its shape."""
    core = word.strip(MARKS)
    out = [bucket("w:" + core.lower())] if core else []
    if len(core) != len(word):
        head = word[: len(word) - len(word.lstrip(MARKS))] if core else ""
        out += [bucket("m:" + mark[:8]) for mark in (head, word[len(head) + len(core) :]) if mark]
    if core.isupper() and len(core) > 1:
        out.append(bucket("s:upper"))
    elif any(c.isdigit() for c in core):
        out.append(bucket("s:digit"))
    return tuple(out)


#: Counts words equal to the word before.
AGAIN = bucket("s:again")


class Tokens(dict):
    """Tokens by word, filled on demand and emptied when large."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        return self.setdefault(word, tokens(word.decode("utf-8", "surrogatepass")))


def index_vectors(seed: int = 7) -> np.ndarray:
    """Sparse random ternary vectors of all buckets."""
    rng = np.random.default_rng(seed)
    at = rng.random((BUCKETS, DIM)).argsort(axis=1)[:, :NONZERO]
    out = np.zeros((BUCKETS, DIM), np.int64)
    np.put_along_axis(out, at, rng.choice([-1, 1], (BUCKETS, NONZERO)), axis=1)
    return out


def add_contexts(around: np.ndarray, seq: np.ndarray, index: np.ndarray) -> None:
    """Add to each bucket the index vectors of the tokens within WINDOW of its tokens."""
    found, seq = np.unique(seq, return_inverse=True)
    pairs = sum(np.bincount(seq[k:] * len(found) + seq[:-k], minlength=len(found) ** 2) for k in range(1, WINDOW + 1) if len(seq) > k)
    if np.ndim(pairs):
        near = pairs.reshape(len(found), -1).astype(np.float64)
        around[found] += (near + near.T) @ index[found]


def pooled_counts(text: str | None, cache: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text and their counts."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    total: Counter = Counter()
    for word, n in Counter(words).items():
        for b in cache[word]:
            total[b] += n
    if again := sum(map(eq, words, words[1:])):
        total[AGAIN] = again
    return np.fromiter(total.keys(), np.int32, len(total)), np.fromiter(total.values(), np.float32, len(total))


@dataclass
class Model:
    vectors: np.ndarray
    layers: tuple[np.ndarray, ...] | None
    temperature: float
    prior: float

    def pool(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts @ self.vectors[at] / counts.sum() if len(at) else np.zeros(DIM, np.float32)

    def score(self, pooled: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(pooled), self.prior)
        return 1 / (1 + np.exp(-np.clip(_logits(pooled, self.layers)[0] / self.temperature, -60, 60)))


def _logits(x: np.ndarray, layers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale, w1, b1, w2, b2 = layers
    z = (x - mean) / scale
    hidden = np.tanh(z @ w1 + b1)
    return (hidden @ w2 + b2)[:, 0], hidden, z


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 11) -> tuple[tuple[np.ndarray, ...], float]:
    """Adam on the logistic loss; a fifth of the rows set the temperature."""
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.2
    if len(set(y[~held])) < 2 or not held.any():
        held = np.zeros(len(y), bool)
    fit_x, fit_y = x[~held], y[~held]
    params = [rng.normal(0, DIM**-0.5, (DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    mean, scale = fit_x.mean(0), fit_x.std(0) + 1e-6
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(fit_y)), max(1, len(fit_y) // 512)):
            step += 1
            logit, hidden, z = _logits(fit_x[part], (mean, scale, *params))
            error = ((1 / (1 + np.exp(-np.clip(logit, -60, 60))) - fit_y[part]) / len(part))[:, None]
            back = error @ params[2].T * (1 - hidden**2)
            grads = [z.T @ back + DECAY * params[0], back.sum(0), hidden.T @ error + DECAY * params[2], error.sum(0)]
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - RATE * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    layers = (mean, scale, *params)
    test_x, test_y = (x[held], y[held]) if held.any() else (x, y)
    logit = _logits(test_x, layers)[0]
    grid = np.geomspace(0.5, 8, 60)
    losses = [(np.logaddexp(0, logit / t) - test_y * logit / t).mean() for t in grid]
    return layers, float(grid[int(np.argmin(losses))])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_fit: int = MAX_FIT) -> Model:
    """A model from at most max_fit labelled rows outside the held-out fold."""
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where(f"_id is not null and _y in (0, 1) and not ({held_out_sql('_id')})")
    chosen = usable.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_fit)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")  # at most max_fit rows of an id and a label
    once = texts.groupBy("_id", "_y").agg(F.min(F.struct(F.sha2("_text", 256).alias("_sha"), "_text")).alias("_t"))
    rows = materialize(once.select(F.col("_id").cast("string").alias("_id"), "_t._text", "_y").repartition(FIT_TASKS, "_id"), "quality-fit")
    index = index_vectors().astype(np.float64)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, around = Tokens(), np.zeros((BUCKETS, DIM))
        for batch in batches:
            for text in batch.column(0):
                line = [b for w in (text.as_py() or "").encode("utf-8", "surrogatepass").split() for b in cache[w]]
                for start in range(0, len(line), SEGMENT):
                    add_contexts(around, np.array(line[start : start + SEGMENT]), index)
        yield pa.RecordBatch.from_arrays([pa.array([around.astype(np.int32).tobytes()], pa.binary())], names=["sums"])

    around = np.zeros((BUCKETS, DIM), np.int64)
    for r in rows.select("_text").coalesce(FIT_TASKS).mapInArrow(contexts, "sums binary").collect():
        around += np.frombuffer(r["sums"], np.int32).reshape(BUCKETS, DIM)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    model = Model((unit(around.astype(np.float64)) + unit(index)).astype(np.float32), None, 1.0, 0.5)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Tokens()
        for batch in batches:
            x = [shared.value.pool(*pooled_counts(t.as_py(), cache)).astype(np.float32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), batch.column(2)], names=["id", "x", "y"])

    fitting = sorted((r.id, bytes(r.x), r.y) for r in rows.select("_id", "_text", "_y").mapInArrow(pooled, "id string, x binary, y int").collect())
    discard(rows)
    if fitting:
        y = np.array([r[2] for r in fitting], np.float64)
        model.prior = float(y.mean())
        if 0 < model.prior < 1:
            model.layers, model.temperature = fit_network(np.array([np.frombuffer(x, np.float32) for _, x, _ in fitting], np.float64), y)
    return model


def held_out_sql(id_col: str) -> str:
    """Whether an id is in the fold that no fit reads."""
    return f"coalesce(crc32(cast({id_col} as string)) % 4 = 2, false)"


def scores(texts: Iterator[str | None], model: Model, cache: Tokens) -> np.ndarray:
    pooled = [model.pool(*pooled_counts(t, cache)) for t in texts]
    return model.score(np.array(pooled, np.float64).reshape(len(pooled), DIM))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Tokens()
        for batch in batches:
            got = scores((t.as_py() for t in batch.column(1)), shared.value, cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score at or over the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Tokens()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            yield batch.filter(pa.array(scores((t.as_py() for t in batch.column(at)), shared.value, cache) >= threshold))

    return docs.mapInArrow(run, docs.schema)
