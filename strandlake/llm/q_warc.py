"""op5: every page written to a content-addressed archive and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import warc
from strandlake.session import table


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, html, sha1(html) as h, max(page_id) over (partition by html) as holder from p)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + (
    (cast('0x' || substr(h, cast(i // 4 * 5 + 1 as int), 5) as bigint) >> cast(15 - 5 * (i % 4) as bigint)) & 31) as int), 1)), '') as payload_digest,
  case when page_id = holder then 'response' else 'revisit' end as record_type,
  case when page_id <> holder then holder end as refers_to
from d
"""

QUERIES = {"op5_warc": op5_warc}
ORACLES = {"op5_warc": ORACLE}
