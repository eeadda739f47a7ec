"""Mixing documents to target weights by soft domain membership, in DataFrame operations only.

A labelled table gives domains. A softmax regression over hashed words, fitted on
at most `max_fit` labelled rows and the FEATURES buckets that tell the domains
apart best, predicts every document's domain posteriors; a temperature from a
grid calibrates them on a fifth of the fitting rows. Then
nonnegative document rates are fitted by projected-gradient least squares so
that the expected token totals of the domains, sum of rate * tokens * posterior,
meet the targets. Each step reads one aggregate of a few numbers per domain; the
gradient is preconditioned by the domains' Gram matrix. A document's rate is an expression of its
posteriors and the steps' coefficients: no state per document is kept. The
Gram matrix is that of the documents whose rate is positive at the step.

Null and empty texts have no tokens and the prior as posterior. Null ids and
repeated rows are documents like others; null labels are not fitted on. Without
usable labels all posteriors are equal. An empty table gives an empty result.
Every domain has its own target, however few tokens it has. A step that doesn't
lessen the squared residual is damped towards a plain gradient step and tried
again. Targets that no nonnegative rates meet end after `max_steps` with the
least residual found: rates() returns the largest gap of a domain as a share of
all targets, and both log each domain's gap as a warning where the tolerance is
missed. Other columns are ignored by rates() and kept by resample().

The classifier is fitted on one label of an id (the smallest) and one text of it
(the smallest digest), at most `max_fit` of them, so the driver gets at most
max_fit lists of FEATURES numbers whatever repeats.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import discard, materialize

BUCKETS = 16384
MAX_FIT = 6000
FEATURES, FIT_STEPS, DECAY = 1024, 300, 1e-4
#: Share of distinct words under which a document gets the mark of repetition.
FEW_DISTINCT = 0.25
TEMPERATURES = (0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0)
TOLERANCE, MAX_STEPS = 1e-7, 60
#: First damping of a step that failed, as a share of the Gram matrix's trace, and its factor from step to step.
DAMPING, DAMPING_FACTOR = 1e-6, 10.0
#: Domains of the labels table; the first one is the reference of the log-odds.
DOMAINS = {"clean": "quality = 1 and coalesce(toxic, 0) = 0", "toxic": "quality = 1 and toxic = 1", "low": "quality = 0"}
WORD_BREAK = r"[\x20\x09-\x0D]+"


@dataclass
class Classifier:
    domains: list[str]
    prior: list[float]
    weights: list[list[float]] = field(default_factory=list)
    temperature: float = 1.0


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def _hash(column: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), column), F.lit(BUCKETS)).cast("int")


def _buckets(words: Column) -> Column:
    """Distinct hash buckets of words and of their last two characters, and a mark for few distinct words."""
    found = F.array_distinct(F.transform(words, lambda w: _hash(w, 1)))
    mark = F.when((F.size(words) > 0) & (F.size(found) < FEW_DISTINCT * F.size(words)), F.array(_hash(F.lit("few"), 3))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(found, F.transform(words, lambda w: _hash(F.right(w, F.lit(2)), 2)), mark))


def _vector(values: list[float]) -> Column:
    """A constant array that the optimizer folds to one literal."""
    return F.split(F.lit(",".join("0" if not v else repr(float(v)) for v in values)), ",").cast("array<double>")


def _evidence(buckets: Column, weights: list[float]) -> Column:
    table = _vector(weights)
    return F.aggregate(buckets, F.lit(0.0), lambda total, b: total + F.get(table, b))


def _softmax(logits: list[Column]) -> list[Column]:
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    parts = [F.exp(x - top) for x in logits]
    return [p / sum(parts[1:], parts[0]) for p in parts]


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", max_fit: int = MAX_FIT) -> Classifier:
    """Softmax regression on word buckets of at most max_fit labelled documents; its fixed-size sample is fitted by the driver."""
    domains = domains or DOMAINS
    names = list(domains)
    number = F.coalesce(*(F.when(F.expr(cond), F.lit(k)) for k, cond in enumerate(domains.values())))
    usable = labels.select(F.col(id_col).alias("_id"), number.alias("_domain")).where("_id is not null and _domain is not null")
    chosen = usable.groupBy("_id").agg(F.min("_domain").alias("_domain")).orderBy(F.xxhash64("_id"), "_id").limit(max_fit)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")  # at most max_fit rows of an id and a number
    rows = texts.groupBy("_id", "_domain").agg(F.min(F.struct(F.sha2("_text", 256).alias("_sha"), "_text")).alias("_t")).select("_domain", "_t._text")
    held = materialize(rows.select("_domain", _buckets(_words(F.col("_text"))).alias("b")), "mixing-fit")
    sizes = {r["_domain"]: r["n"] for r in held.groupBy("_domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        discard(held)
        return Classifier(names, [1 / len(names)] * len(names), [[0.0] * BUCKETS for _ in names[1:]])
    n = [sizes.get(k, 0) for k in range(len(names))]
    counts = [[0] * BUCKETS for _ in names]
    for r in held.select("_domain", F.explode("b").alias("b")).groupBy("_domain", "b").count().collect():  # BUCKETS rows a domain at most
        counts[r["_domain"]][r["b"]] = r["count"]
    columns = _telling(counts, n)
    place = {b: i for i, b in enumerate(columns)}
    kept = F.array_sort(F.array_intersect("b", F.array(*(F.lit(b) for b in columns))))
    rows = held.select("_domain", F.array_join(kept, ",").alias("b")).collect()  # max_fit texts of FEATURES numbers at most
    discard(held)
    x, y = np.zeros((len(rows), len(columns) + 1), np.float32), np.zeros(len(rows), int)
    for i, r in enumerate(sorted(map(tuple, rows))):
        y[i] = r[0]
        x[i, [place[int(b)] for b in r[1].split(",") if b]] = 1
    x[:, -1] = 1
    fitted, temperature = _softmax_regression(x, y, len(names))
    weights = [[0.0] * BUCKETS for _ in names[1:]]
    for k in range(1, len(names)):
        for b, i in place.items():
            weights[k - 1][b] = round(float(fitted[i, k] - fitted[i, 0]), 4)
    return Classifier(names, [float(v) for v in _prior(fitted[-1] - fitted[-1, 0], temperature)], weights, temperature)


def _telling(counts: list[list[int]], n: list[int]) -> list[int]:
    """The FEATURES buckets whose shares of documents differ most surely between the domains."""
    total = sum(n)
    shares = np.array([[(c + 0.5) / (size + 1) for c in row] for row, size in zip(counts, n, strict=True)])
    overall = (np.array(counts).sum(axis=0) + 0.5) / (total + 1)
    sure = (np.abs(shares - overall) / np.sqrt(overall * (1 - overall) / (np.array(n)[:, None] + 1))).max(axis=0)
    return sorted(np.argsort(-sure, kind="stable")[:FEATURES].tolist())


def _softmax_regression(x: np.ndarray, y: np.ndarray, domains: int) -> tuple[np.ndarray, float]:
    """Weights by accelerated gradient steps, and a temperature from a fifth of the rows."""
    test = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    part = test if test.any() else ~test
    seen, truth, asked, answers = x[~test], np.eye(domains, dtype=np.float32)[y[~test]], x[part], y[part]
    n = len(seen)

    def logits(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
        z = rows @ w
        return z - z.max(axis=1, keepdims=True)

    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # the largest singular value, for the step
        v = seen.T @ (seen @ v)
        v /= max(1e-9, float(np.linalg.norm(v)))
    w = ahead = np.zeros((x.shape[1], domains), np.float32)
    rate = np.float32(1.8 / max(1e-9, float(np.linalg.norm(seen @ v)) ** 2 / n))
    for step in range(FIT_STEPS):
        e = np.exp(logits(ahead, seen))
        gradient = seen.T @ (e / e.sum(axis=1, keepdims=True) - truth) / np.float32(n) + np.float32(DECAY) * ahead
        w, before = ahead - rate * gradient, w
        ahead = w + np.float32(step / (step + 3)) * (w - before)
    w = w.astype(np.float64)
    losses = [-np.mean([z[k] - np.log(np.exp(z).sum()) for z, k in zip(logits(w / t, asked), answers, strict=True)]) for t in TEMPERATURES]
    return w, TEMPERATURES[int(np.argmin(losses))]


def _prior(intercepts: np.ndarray, temperature: float) -> np.ndarray:
    """Intercepts as the posterior of a document without evidence."""
    e = np.exp(intercepts / temperature)
    return np.maximum(e / e.sum(), 1e-12)


def _posteriors(model: Classifier) -> list[Column]:
    """Posterior of each domain from the columns of evidence _e1, _e2, ..."""
    return _softmax([F.lit(math.log(model.prior[0]))] + [F.lit(math.log(q)) + F.col(f"_e{k}") / F.lit(model.temperature) for k, q in enumerate(model.prior[1:], 1)])


def _scored(docs: DataFrame, model: Classifier, text_col: str) -> DataFrame:
    """The rows with _tokens and _p0, _p1, ... for the domains; the row's own columns are in `row`."""
    words = docs.select(F.struct("*").alias("row")).select("row", _words(F.col(f"row.`{text_col}`")).alias("_w"))
    bucketed = words.select("row", F.size("_w").cast("long").alias("_tokens"), _buckets(F.col("_w")).alias("_b"))
    evidence = bucketed.select("row", "_tokens", *(_evidence(F.col("_b"), w).alias(f"_e{k}") for k, w in enumerate(model.weights, 1)))
    return evidence.select("row", "_tokens", *(p.alias(f"_p{k}") for k, p in enumerate(_posteriors(model))))


def _solve(matrix: list[list[float]], right: list[float], damping: float = 0.0) -> list[float]:
    """Gaussian elimination of a small system with a light ridge on each diagonal element, and `damping` times the trace."""
    size = len(right)
    common = damping * sum(matrix[i][i] for i in range(size))
    rows = [[matrix[i][j] + (1e-9 * matrix[i][i] + common) * (i == j) for j in range(size)] + [right[i]] for i in range(size)]
    for i in range(size):
        pivot = max(range(i, size), key=lambda r: abs(rows[r][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        for r in range(size):
            if r != i and rows[i][i]:
                ratio = rows[r][i] / rows[i][i]
                rows[r] = [a - ratio * b for a, b in zip(rows[r], rows[i], strict=True)]
    return [rows[i][size] / rows[i][i] if rows[i][i] else 0.0 for i in range(size)]


def rate_column(posterior: list[Column], steps: list[list[float]]) -> Column:
    """A document's rate after all projected steps, from rate one."""
    if not steps:
        return F.lit(1.0)
    size = len(posterior)
    flat = _vector([c for step in steps for c in step])
    p = F.array(*posterior)
    # One step takes `size` numbers of the flat list.
    move = lambda k: sum((F.get(flat, k * size + i) * F.get(p, F.lit(i)) for i in range(1, size)), F.get(flat, k * size) * F.get(p, F.lit(0)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), F.lit(1.0), lambda rate, k: F.greatest(F.lit(0.0), rate - move(k)))


@dataclass
class Fit:
    """Coefficients of the projected-gradient steps, and what each domain's total exceeds its target by, as a share of all targets."""

    steps: list[list[float]]
    gaps: list[float]

    def gap(self) -> float:
        return max(map(abs, self.gaps), default=0.0)


def fit_rates(scored: DataFrame, targets, names: list[str] | None = None, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS) -> Fit:
    """Rates that bring the domains' expected token totals to targets(totals)."""
    p = [F.col(c) for c in scored.columns if c.startswith("_p")]
    size = len(p)

    def sums(steps: list[list[float]]) -> tuple[list[list[float]], list[float]]:
        """Gram matrix of the documents with a positive rate, and the domains' totals at these rates."""
        rated = scored.withColumn("_rate", rate_column(p, steps))
        positive = F.when(F.col("_rate") > 0, F.col("_tokens"))
        row = rated.agg(*(F.coalesce(F.sum(positive * p[i] * p[j]), F.lit(0.0)) for i in range(size) for j in range(size)), *(F.coalesce(F.sum(F.col("_rate") * F.col("_tokens") * x), F.lit(0.0)) for x in p)).first()
        return [list(row[i * size : (i + 1) * size]) for i in range(size)], list(row[size * size :])

    steps: list[list[float]] = []
    gram, totals = sums(steps)
    wanted = targets(totals)
    scale = max(1.0, sum(wanted))

    def off(totals: list[float]) -> list[float]:
        """What the totals exceed the targets by."""
        return [a - b for a, b in zip(totals, wanted, strict=True)]

    residual, damping = off(totals), 0.0
    for _ in range(max_steps):
        if max(map(abs, residual)) / scale <= tolerance:
            break
        move = _solve(gram, residual, damping)
        matrix, totals = sums([*steps, move])
        after = off(totals)
        if sum(r * r for r in after) < sum(r * r for r in residual):
            steps.append(move)
            gram, residual = matrix, after
            damping = damping / DAMPING_FACTOR if damping > DAMPING else 0.0
        else:  # too far: the projection clipped more than the step foresaw
            damping = max(DAMPING, damping * DAMPING_FACTOR)
    fit = Fit(steps, [r / scale for r in residual])
    if fit.gap() > tolerance:
        logging.getLogger("strandlake").warning("mixing misses its targets by %s of all tokens", dict(zip(names or range(size), fit.gaps, strict=True)))
    return fit


def share_targets(weights: dict[str, float], names: list[str]):
    """Targets that split all tokens by domain weights."""
    whole = sum(weights[n] for n in names)
    return lambda totals: [sum(totals) * weights[n] / whole for n in names]


def factor_targets(factors: dict[str, float], names: list[str]):
    """Targets that scale each domain's own expected tokens."""
    return lambda totals: [t * factors[n] for t, n in zip(totals, names, strict=True)]


def rates(docs: DataFrame, labels: DataFrame, targets, domains: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, a posterior per domain, rate, target_gap) of every row; targets(names) gives the totals' targets."""
    model = fit_classifier(docs, labels, domains, id_col, text_col)
    p = [f"_p{k}" for k in range(len(model.domains))]
    scored = materialize(_scored(docs.select(id_col, text_col), model, text_col).select(F.col(f"row.{id_col}").alias("_id"), "_tokens", *p), "mixing")
    fit = fit_rates(scored, targets(model.domains), model.domains)
    return scored.select(F.col("_id").alias(id_col), F.col("_tokens").alias("n_tokens"), *(F.col(c).alias(f"p_{n}") for c, n in zip(p, model.domains, strict=True)), rate_column([F.col(c) for c in p], fit.steps).alias("rate"), F.lit(fit.gap()).alias("target_gap"))


def resample(docs: DataFrame, labels: DataFrame, targets, domains: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, each as often as its rate says: the whole part, and once more by a hash of id and text at the rest."""
    model = fit_classifier(docs, labels, domains, id_col, text_col)
    p = [f"_p{k}" for k in range(len(model.domains))]
    # Written with its rows: every step and the rates then read posteriors instead of scoring texts again.
    scored = materialize(_scored(docs, model, text_col), "mixing")
    fit = fit_rates(scored.select("_tokens", *p), targets(model.domains), model.domains)
    chance = F.pmod(F.xxhash64(F.lit(29), f"row.`{id_col}`", f"row.`{text_col}`"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.floor(rate_column([F.col(c) for c in p], fit.steps) + chance).cast("int")
    return scored.select("row", copies.alias("_n")).where("_n > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("_n")))).select("row.*")
