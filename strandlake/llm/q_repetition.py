"""op1: repetition rules over every document, and the same measures in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import repetition
from strandlake.session import table


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition.repetition_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _coverage(n: int) -> str:
    return f"""
g{n} as (select k, i, w{''.join(f', w{j}' for j in range(1, n))}, count(*) over (partition by k, w{''.join(f', w{j}' for j in range(1, n))}) as c
  from (select k, i, w, {', '.join(f'lead(w, {j}) over o as w{j}' for j in range(1, n))} from word window o as (partition by k order by i))
  where w{n - 1} is not null),
s{n} as (select k, count(*) as n, sum(length(w)) as chars from (select distinct word.k, word.i, word.w from (select distinct k, i + unnest(range({n})) as j from g{n} where c > 1) m join word on word.k = m.k and word.i = m.j) group by k)"""


ORACLE = (
    """
with doc as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
word as (select k, generate_subscripts(ws, 1) as i, unnest(ws) as w from (select k, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws from doc)),
total as (select k, count(*) as n_words, sum(length(w)) as word_chars from word group by k),
line as (select k, l, count(*) as c from (select k, unnest(string_split(text, chr(10))) as l from doc) where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by k, l),
lines as (select k, sum(c - 1) as n_dup_lines, sum(length(l) * c) as chars, coalesce(sum(length(l) * c) filter (c > 1), 0) as dup_chars, sum(c) as n from line group by k),"""
    + ",".join(_coverage(n) for n in sorted({repetition.BASE_N, *repetition.COVERAGE_LIMITS}))
    + """,
m as (select doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(s3.n, 0) as n_repeat_words,
  case when contains(text, chr(10)) then coalesce(lines.dup_chars / lines.chars, 0) else 0 end as line_share, """
    + ", ".join(f"coalesce(s{n}.chars / word_chars, 0) as share{n}" for n in repetition.COVERAGE_LIMITS)
    + """
  from doc left join total using (k) left join lines using (k) """
    + " ".join(f"left join s{n} using (k)" for n in repetition.COVERAGE_LIMITS)
    + f"""),
b as (select *, n_words < {repetition.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not base_failed and line_share <= {repetition.LINE_LIMIT} and """
    + " and ".join(f"share{n} <= {most}" for n, most in repetition.COVERAGE_LIMITS.items())
    + " as kept from b"
)

QUERIES = {"op1_repetition": op1_repetition}
ORACLES = {"op1_repetition": ORACLE}
