"""Secret scans with corpus-wide ownership frequency.

Base candidates are three patterns over whole texts (assignments, access keys,
hexadecimal runs). Further candidates are credential shapes: known prefixes and
random-looking strings of mixed characters. All candidates' values are hashed,
and each hash's distinct owners and repositories are counted over the corpus. A
value that more than `max_owners` owners or `max_repos` repositories hold is a
copied example; the others look live. Base spans always stay; a further
candidate becomes a span of kind `live` where its value looks live.

The counts aggregate distinct (hash, owner, repository) rows, and verdicts are
joined to the distinct sets of hashes that texts hold, so a value or a text that
a third of all rows share is one row of each join's other side.

Null texts count as empty and have no spans. A null owner or repository counts
as one owner of that name. Rows are never grouped by id: null and repeated ids
give a row each. An empty table gives an empty result; other columns are ignored
by scan() and kept by redact().
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import join_unique, materialize

KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs: a shorter run fails anyway
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16
#: Shapes of credentials beyond the base patterns.
SHAPES = re.compile(r"gh[pousr]_[A-Za-z0-9]{30,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|[A-Za-z0-9+/_=-]{24,}")
RANDOM_LENGTH, RANDOM_BITS = 24, 3.2
MAX_OWNERS, MAX_REPOS = 2, 4
#: Sets of hashes that very many texts hold are joined by broadcast where so few of their hashes are examples.
FEW_EXAMPLES = 64

CANDIDATE = "struct<start:long,kind:int,end:long,from:long,hash:string>"


def looks_random(value: str) -> bool:
    """Letters and digits in a mix that words and numbers rarely have."""
    digits = sum(c.isdigit() for c in value)
    if not 0.1 * len(value) <= digits <= 0.9 * len(value):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= RANDOM_BITS


def find(text: str | None) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of all candidates, by start and kind."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(name in low for name in NAMES):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    if max(map(len, text.split()), default=0) >= RANDOM_LENGTH:
        out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
        base = list(out)
        for m in SHAPES.finditer(text):
            if not any(s <= m.start() and m.end() <= e for s, _, e, _ in base) and (m.group()[:4] in ("AIza", "sk_l") or m.group()[:3] in ("eyJ", "xox") or looks_random(m.group())):
                out.append((m.start(), 3, m.end(), m.start()))
    return sorted(out)


def value_hash(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def candidates(text: str | None) -> list[dict]:
    return [{"start": s, "kind": k, "end": e, "from": v, "hash": value_hash(text[v:e])} for s, k, e, v in find(text)]


def _candidate_column(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("from", pa.int64()), ("hash", pa.string())]))
    return pa.array([candidates(t.as_py()) for t in texts], kind)


def _candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = _candidate_column(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("owner"), batch.column("repo"), found], names=["id", "owner", "repo", "found"])


def _owned(docs: DataFrame, id_col: str, text_col: str, owner: Column | None, repo: Column | None) -> DataFrame:
    """(id, owner, repo, found) of every row."""
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    source = docs.select(F.col(id_col).alias("id"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), F.col(text_col).alias("text"))
    return materialize(source.mapInArrow(_candidate_batches, f"id {dict(docs.dtypes)[id_col]}, owner string, repo string, found array<{CANDIDATE}>"), "secrets")


def _hashes(found: Column) -> Column:
    return F.array_sort(F.array_distinct(found["hash"]))


def _held(found: Column) -> Column:
    """A digest of the distinct hashes of candidates; null where there are none."""
    return F.when(F.size(found) > 0, F.sha2(F.array_join(_hashes(found), ","), 256))


def copied_examples(found: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """(held, examples, n): of each set of hashes that texts hold, those that too many owners or repositories have, and its texts."""
    some = found.select("owner", "repo", _hashes(F.col("found")).alias("hashes"), _held(F.col("found")).alias("held")).where("held is not null")
    owned = some.select(F.explode("hashes").alias("hash"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo")).distinct()
    copied = owned.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos")).where((F.col("owners") > max_owners) | (F.col("repos") > max_repos))
    sets = some.groupBy("held").agg(F.first("hashes").alias("hashes"), F.count("*").alias("n")).select("held", "n", F.explode("hashes").alias("hash"))
    return sets.join(copied, "hash").groupBy("held").agg(F.sort_array(F.collect_list("hash")).alias("examples"), F.first("n").alias("n"))


def _with_examples(rows: DataFrame, found: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """The rows with the examples of their set `held`; rows without candidates are not shuffled."""
    examples = materialize(copied_examples(found, max_owners, max_repos), "examples")
    weight = F.when(F.size("examples") <= FEW_EXAMPLES, F.col("n")).otherwise(0)
    joined = join_unique(rows, examples.withColumn("n", weight), "held", "n", found.where(F.size("found") > 0).count())
    return joined.withColumn("examples", F.coalesce("examples", F.array().cast("array<string>"))).drop("held")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """(id, found, examples) of every row: its candidates, and the hashes among them that are copied examples."""
    found = _owned(docs, id_col, text_col, owner, repo)
    rows = found.select("id", "found", _held(F.col("found")).alias("held"))
    return _with_examples(rows, found, max_owners, max_repos).select(F.col("id").alias(id_col), "found", "examples")


def spans_text(found: Column) -> Column:
    """kind:start:end of sorted candidates, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def of_kind(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda c: c["kind"] == kind)).cast("long")


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, spans and their digest of what scan() found."""
    found, base = F.col("found"), F.filter("found", lambda c: c["kind"] < 3)
    spans = F.filter(found, lambda c: (c["kind"] < 3) | ~F.array_contains(F.col("examples"), c["hash"]))
    return scanned.select(
        id_col,
        *(of_kind(found, k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"),
        F.size(F.filter(base, lambda c: F.array_contains(F.col("examples"), c["hash"]))).cast("long").alias("n_examples"),
    )


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """The text with the union of spans (start, end) masked; spans that overlap or touch are one."""
    out, at = [], 0
    joined: list[list[int]] = []
    for s, e in sorted(spans):
        if joined and s <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    for s, e in joined:
        out += [text[at:s], mask]
        at = e
    return "".join([*out, text[at:]])


def _masker(mask: str):
    def run(texts: pa.Array, found: pa.Array, examples: pa.Array) -> pa.Array:
        out = []
        for text, spans, copied in zip(texts, found.to_pylist(), examples.to_pylist(), strict=True):
            known, text = frozenset(copied or ()), text.as_py()
            live = [(c["from"], c["end"]) for c in spans or () if c["hash"] not in known]
            out.append(masked(text, live, mask) if live else text)
        return pa.array(out, pa.string())

    return run


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", owner: Column | None = None, repo: Column | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """The rows, with all their columns, whose live-looking secrets' values are masked; copied examples stay.

    Overlapping values are masked as one. Texts are scanned once: the rows with
    candidates are written with them, and only these take part in a join.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    find_all = F.arrow_udf(_candidate_column, f"array<{CANDIDATE}>")
    rows = docs.select(F.struct("*").alias("row"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), F.col(text_col).alias("_text"))
    found = materialize(rows.withColumn("found", find_all("_text")).drop("_text"), "secrets")
    some = F.size("found") > 0
    marked = _with_examples(found.where(some).select("row", "found", _held(F.col("found")).alias("held")), found, max_owners, max_repos)
    hide = F.arrow_udf(_masker(mask), "string")
    hidden = marked.select("row", hide(F.col(f"row.`{text_col}`"), "found", "examples").alias("_masked"))
    out = found.where(~some).select("row", F.col(f"row.`{text_col}`").alias("_masked")).unionAll(hidden)
    return out.select(*(F.col("_masked").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
