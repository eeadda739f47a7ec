"""op9: near-duplicate embeddings by sharded graphs, and the exact links and their components in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import hnsw
from strandlake.session import table


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))
    kept = F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept")
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), kept, F.round("audit_recall", 4).alias("audit_recall"))


#: The links of all pairs; the graphs' are the same while their recall is 1.
ORACLE = f"""
with recursive e as (select vec_id, embedding::double[] as v from embeddings where embedding is not null and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)),
u as (select vec_id, v from e where list_inner_product(v, v) > 0),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= {hnsw.THRESHOLD}),
r(vec_id, other) as (select vec_id, vec_id from embeddings union select r.vec_id, l.b from r join l on l.a = r.other),
c as (select vec_id, min(other) as component_id from r group by 1)
select vec_id, (select count(*) from l where l.a = c.vec_id) as n_links, component_id, vec_id = component_id as kept, 1.0::double as audit_recall from c
"""

QUERIES = {"op9_hnsw": op9_hnsw}
ORACLES = {"op9_hnsw": ORACLE}
