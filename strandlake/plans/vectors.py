"""Queries over stored vectors: scalar functions, neighbour search, transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import vec
from strandlake.operators import index, knn, probes
from strandlake.session import table
from strandlake.storage import fresh_path

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def neighbor_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector beside the next one by id."""
    v = vectors(spark, sf)
    return v.select("id", vec.as_double("vector").alias("a")).join(v.select((F.col("id") - 1).alias("id"), vec.as_double("vector").alias("b")), "id")


PAIRS = "with p as (select x.vec_id as id, x.embedding::double[] as a, y.embedding::double[] as b from embeddings x join embeddings y on y.vec_id = x.vec_id + 1) "
ALL = "with e as (select vec_id as id, embedding::double[] as v, label from embeddings), d as (select q.id as query_id, c.id, q.label as query_label, c.label, greatest(0, least(2, 1 - list_cosine_similarity(q.v, c.v))) as distance from e q join e c on q.id <> c.id), k as (select *, row_number() over (partition by query_id order by distance, id) as r from d) "


@query(PAIRS + "select id, round(list_distance(a, b), 6) as distance from p")
def vec_l2(spark, sf):
    return neighbor_pairs(spark, sf).select("id", F.round(vec.l2(F.col("a"), F.col("b")), 6).alias("distance"))


@query(PAIRS + "select id, round(greatest(0, least(2, 1 - list_cosine_similarity(a, b))), 6) as distance from p")
def vec_cosine(spark, sf):
    return neighbor_pairs(spark, sf).select("id", F.round(vec.cosine(F.col("a"), F.col("b")), 6).alias("distance"))


@query(PAIRS + "select id, round(-list_inner_product(a, b), 6) as distance from p")
def vec_ip(spark, sf):
    return neighbor_pairs(spark, sf).select("id", F.round(vec.inner_product(F.col("a"), F.col("b")), 6).alias("distance"))


@query("select vec_id as id, i as pos, round(v[i] / case when n = 0 then 1 else n end, 6) as value from (select vec_id, embedding::double[] as v, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n, unnest(range(1, len(embedding) + 1)) as i from embeddings)")
def vec_normalize(spark, sf):
    unit = vectors(spark, sf).select("id", F.posexplode(vec.normalize(vec.as_double("vector"))).alias("pos", "value"))
    return unit.select("id", (F.col("pos") + 1).cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("select cast(len(embedding) as bigint) as dim, count(*) as n from embeddings group by 1")
def vec_dim(spark, sf):
    return vectors(spark, sf).groupBy(vec.dimension(F.col("vector")).cast("long").alias("dim")).agg(F.count("*").alias("n"))


@query(PAIRS + "select round(list_distance(a, b), 6) as l2, round(1 - list_cosine_similarity(a, b), 6) as cosine from p where id = (select min(vec_id) from embeddings)")
def vec_pair_distance(spark, sf):
    least = vectors(spark, sf).agg(F.min("id").alias("id"))
    p = neighbor_pairs(spark, sf).join(least, "id", "left_semi")
    return p.select(F.round(vec.l2(F.col("a"), F.col("b")), 6).alias("l2"), F.round(vec.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query(PAIRS + "select id, round(list_cosine_similarity(a, b), 6) as cosine_similarity, round(list_max(g), 6) as max_abs, round(list_sum(g) / len(g), 6) as mean_abs, round(list_distance(a, b), 6) as l2 from (select *, list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i])) as g from p)")
def vec_diff(spark, sf):
    return neighbor_pairs(spark, sf).select("id", *(F.round(c, 6).alias(n) for n, c in vec.diff_metrics(F.col("a"), F.col("b")).items()))


@query()
def vec_f16(spark, sf):
    """Half rounding has no DuckDB form; tests compare with numpy."""
    return vectors(spark, sf).select("id", F.posexplode(vec.half(vec.as_double("vector"))).alias("pos", "value"))


def self_neighbors(spark, sf, k=10, metric="cosine", strict=True):
    v = vectors(spark, sf)
    own = v.select(F.col("id").alias("query_id"), "id")
    return knn.exact(v.select(F.col("id").alias("query_id"), "vector"), v, k, metric, own, strict)


def self_neighbors_each(spark, sf, *metrics):
    v = vectors(spark, sf)
    own = v.select(F.col("id").alias("query_id"), "id")
    return knn.exact_each(v.select(F.col("id").alias("query_id"), "vector"), v, 10, metrics, own)


def shaped(found):
    return found.select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(ALL + "select query_id, id, round(distance, 6) as distance, r as rank from k where r <= 10")
def knn_batch(spark, sf):
    return shaped(self_neighbors(spark, sf))


@query(ALL + "select id, round(distance, 6) as distance, r as rank from k where r <= 25 and query_id = (select min(vec_id) from embeddings)")
def knn_single(spark, sf):
    v = vectors(spark, sf)
    one = v.orderBy("id").limit(1).select(F.col("id").alias("query_id"), "vector")
    found = knn.exact(one, v, 25, "cosine", one.select("query_id", F.col("query_id").alias("id")))
    return shaped(found).drop("query_id")


@query("with e as (select vec_id as id, vec_id // 2 as s, embedding::double[] as v from embeddings), d as (select q.id as query_id, c.id, list_distance(q.v, c.v) as distance from e q join e c on q.s <> c.s) select query_id, id, round(distance, 6) as distance, r as rank from (select *, row_number() over (partition by query_id order by distance, id) as r from d) where r <= 5")
def knn_stored(spark, sf):
    v = vectors(spark, sf).withColumn("sequence_id", F.floor(F.col("id") / 2))
    return shaped(knn.stored(v, v.select("id"), 5, "l2"))


@query(ALL + "select query_id, id, round(d2, 6) as distance, row_number() over (partition by query_id order by d2, id) as rank from (select k.query_id, k.id, -list_inner_product(a.v, b.v) as d2 from k join e a on a.id = k.query_id join e b on b.id = k.id where k.r <= 20) qualify rank <= 5")
def knn_rerank(spark, sf):
    v = vectors(spark, sf)
    pool = self_neighbors(spark, sf, 20).select("query_id", "id")
    return shaped(knn.rerank(pool, v.select(F.col("id").alias("query_id"), "vector"), v, 5, "inner_product"))


@query(ALL + "select query_id, id, round(distance, 6) as distance, r as rank from k where r <= 10")
def knn_block_merge(spark, sf):
    """Partial best rows per block, ties kept, merged by (distance, id): any dealing of the corpus gives the same rows."""
    v = vectors(spark, sf)
    asked = v.select(F.col("id").alias("query_id"), "vector")
    found = knn.candidates(asked, v.repartition(7, "id"), 11).where("query_id <> id")
    return shaped(knn.rank(found, 10))


@query(ALL + "select query_id, id, round(distance, 6) as distance, r as rank from k where r <= 10")
def knn_ann_pool(spark, sf):
    """A pool of max(20 k, 200) candidates, reranked exactly."""
    v = vectors(spark, sf)
    pool = self_neighbors(spark, sf, 200, strict=False).select("query_id", "id")
    return shaped(knn.rerank(pool, v.select(F.col("id").alias("query_id"), "vector"), v, 10))


@query(ALL + "select query_id, string_agg(cast(label as varchar), ';' order by r) as labels, round(sum(distance), 5) as total from k where r <= 5 group by 1")
def knn_annotations(spark, sf):
    found = self_neighbors(spark, sf, 5).join(vectors(spark, sf).select("id", "label"), "id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col("label").cast("string").alias("label"))))
    return found.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["label"]), ";").alias("labels"), F.round(F.sum("distance"), 5).alias("total"))


@query(ALL + ", l as (select q.id as query_id, c.id, list_distance(q.v, c.v) as distance from e q join e c on q.id <> c.id), m as (select *, row_number() over (partition by query_id order by distance, id) as r from l) select k.query_id, count(*) as n_true, count(m.id) as n_shared, round(count(m.id) / count(*), 6) as recall, round(coalesce(sqrt(avg(power(m.distance - k.distance, 2))), 0), 6) as distance_rmsd from k left join m on k.query_id = m.query_id and k.id = m.id and m.r <= 10 where k.r <= 10 group by 1")
def knn_quality(spark, sf):
    out = knn.quality(*self_neighbors_each(spark, sf, "l2", "cosine"))
    return out.select("query_id", "n_true", "n_shared", F.round("recall", 6).alias("recall"), F.round("distance_rmsd", 6).alias("distance_rmsd"))


@query(ALL + ", l as (select q.id as query_id, c.id, -list_inner_product(q.v, c.v) as distance from e q join e c on q.id <> c.id), m as (select *, row_number() over (partition by query_id order by distance, id) as r from l), a as (select query_id, id, 1 / r as wa from k where r <= 10), b as (select query_id, id, 1 / r as wb from m where r <= 10) select coalesce(a.query_id, b.query_id) as query_id, round(sum(least(coalesce(wa, 0), coalesce(wb, 0))) / sum(greatest(coalesce(wa, 0), coalesce(wb, 0))), 6) as overlap from a full join b on a.query_id = b.query_id and a.id = b.id group by 1")
def knn_overlap(spark, sf):
    return knn.overlap(*self_neighbors_each(spark, sf, "cosine", "inner_product")).select("query_id", F.round("overlap", 6).alias("overlap"))


def built_index(spark, sf, **options):
    """An index of the stored vectors, built in the shared folder."""
    root = fresh_path(spark, "index")
    index.build(vectors(spark, sf), root, **options)
    return index.load(spark, root)


@query()
def knn_ivf(spark, sf):
    """Lists alone: all codes of the probed lists are in the pool; tests measure recall."""
    v = vectors(spark, sf)
    found = index.search(built_index(spark, sf, parts=8), v.select(F.col("id").alias("query_id"), "vector"), v, 10, pool=1 << 30, strict=False)
    return shaped(found)


@query()
def knn_ivfpq(spark, sf):
    """Product-quantised candidates from a written index, exact order; tests measure recall with these parameters."""
    v = vectors(spark, sf)
    return shaped(index.search(built_index(spark, sf), v.select(F.col("id").alias("query_id"), "vector"), v, 10, strict=False))


@query("select count(*) as n_short from (select e.vec_id from embeddings e where (select count(*) from embeddings) - 1 < 10)")
def knn_strict(spark, sf):
    v = vectors(spark, sf)
    found = knn.require_k(self_neighbors(spark, sf), v.select(F.col("id").alias("query_id")), 10)
    return found.groupBy("query_id").count().where("count < 10").agg(F.count("*").alias("n_short"))


@query(ALL + "select least(query_id, id) as a, greatest(query_id, id) as b, round(min(distance), 6) as distance from d where distance <= 0.75 group by 1, 2")
def join_threshold_graph(spark, sf):
    v = vectors(spark, sf)
    found = knn.within(v.select(F.col("id").alias("query_id"), "vector"), v, 0.75).where("query_id < id")
    return found.select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.round("distance", 6).alias("distance"))


@query(ALL + "select query_id, count(*) as n, round(avg(distance), 6) as mean_distance from d group by 1")
def join_theta_distance(spark, sf):
    v = vectors(spark, sf)
    found = knn.summary(v.select(F.col("id").alias("query_id"), "vector"), v, 2.0)
    return found.select("query_id", "n", F.round("mean", 6).alias("mean_distance"))


@query("select label, i as pos, round(avg(embedding[i]::double), 6) as mean from (select label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by 1, 2")
def agg_mean_vector(spark, sf):
    long = vectors(spark, sf).select("label", F.posexplode(vec.as_double("vector")).alias("pos", "x"))
    return long.groupBy("label", (F.col("pos") + 1).cast("long").alias("pos")).agg(F.round(F.avg("x"), 6).alias("mean"))


@query("with l as (select vec_id as id, i as pos, embedding[i]::double as x from (select *, unnest(range(1, len(embedding) + 1)) as i from embeddings)), s as (select pos, avg(x) as m, greatest(stddev_pop(x), 1e-6) as s from l group by 1) select id, pos, round((x - m) / s, 5) as z from l join s using (pos)")
def agg_standardize(spark, sf):
    long = vectors(spark, sf).select("id", F.posexplode(vec.as_double("vector")).alias("pos", "x"))
    stats = long.groupBy("pos").agg(F.avg("x").alias("m"), F.greatest(F.stddev_pop("x"), F.lit(1e-6)).alias("s"))
    return long.join(F.broadcast(stats), "pos").select("id", (F.col("pos") + 1).cast("long").alias("pos"), F.round((F.col("x") - F.col("m")) / F.col("s"), 5).alias("z"))


@query("select vec_id as id, round(list_sum(embedding::double[]) / len(embedding), 6) as mean, round(embedding[1]::double, 6) as first from embeddings")
def pool_mean(spark, sf):
    v = vec.as_double("vector")
    return vectors(spark, sf).select("id", F.round(vec.total(v) / F.size("vector"), 6).alias("mean"), F.round(F.get(v, F.lit(0)), 6).alias("first"))


@query("select vec_id as id, i as pos, round(embedding[i + 2]::double, 6) as value from (select *, unnest(range(1, 6)) as i from embeddings)")
def emb_slice(spark, sf):
    cut = vectors(spark, sf).select("id", F.posexplode(F.slice(vec.as_double("vector"), 3, 5)).alias("pos", "value"))
    return cut.select("id", (F.col("pos") + 1).cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("select count(*) as n, count(distinct vec_id) as n_ids, cast(sum(case when len(embedding) <> 64 then 1 else 0 end) as bigint) as wrong_dim, cast(sum(case when list_contains(list_transform(embedding, lambda x: isfinite(x)), false) then 1 else 0 end) as bigint) as not_finite from embeddings")
def emb_validate(spark, sf):
    bad = F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors(spark, sf).agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.count_if(F.size("vector") != 64).alias("wrong_dim"), F.count_if(bad).alias("not_finite"))


@query("select layer, count(*) as n from (select vec_id % 3 as layer from embeddings) where layer in (0, 2) group by 1")
def emb_layers(spark, sf):
    """Layers 0 and -1 of three; negatives count from the end."""
    wanted = resolve_layers([0, -1], 3)
    rows = vectors(spark, sf).select(F.pmod("id", F.lit(3)).alias("layer"))
    return rows.where(F.col("layer").isin(wanted)).groupBy("layer").agg(F.count("*").alias("n"))


def resolve_layers(layers: list[int] | int | None, count: int) -> list[int]:
    """Sorted distinct layers; None means all, negatives count from the end."""
    chosen = range(count) if layers is None else [layers] if isinstance(layers, int) else layers
    out = sorted({x + count if x < 0 else x for x in chosen})
    if any(not 0 <= x < count for x in out):
        raise ValueError(f"layers must lie in [{-count}, {count - 1}]")
    return out


SPLIT = ALL + ", t as (select *, row_number() over (partition by query_id order by distance, id) as tr from d where substr(sha256('probe:' || query_id), 1, 1) < '4' and substr(sha256('probe:' || id), 1, 1) >= '4') "


def transfer(spark, sf, weighting="weighted_voting"):
    """Test vectors' ten nearest training vectors with labels and weights; the split is by hash."""
    v = vectors(spark, sf).withColumn("test", F.substring(F.sha2(F.concat(F.lit("probe:"), F.col("id").cast("string")), 256), 1, 1) < "4")
    found = knn.exact(v.where("test").select(F.col("id").alias("query_id"), "vector"), v.where("not test"), 10)
    return probes.weighted(found, v.select("id", "label"), weighting)


@query(SPLIT + "select query_id, id, round(distance, 6) as distance, tr as rank from t where tr <= 10")
def trf_neighbors(spark, sf):
    v = transfer(spark, sf, "voting")
    return shaped(v)


@query(SPLIT + "select query_id, id, round(least(1, greatest(0, 1 - distance)), 6) as weight from t where tr <= 10 and 1 - distance > 0")
def trf_weights(spark, sf):
    return transfer(spark, sf).select("query_id", "id", F.round("weight", 6).alias("weight"))


@query(SPLIT + "select query_id, round(sum(label * (1 - distance)) / sum(1 - distance), 6) as prediction from t where tr <= 10 and 1 - distance > 0 group by 1")
def trf_regression(spark, sf):
    return probes.regression(transfer(spark, sf)).select("query_id", F.round("prediction", 6).alias("prediction"))


@query(SPLIT + "select query_id, round(s, 6) as score, cast(s >= 0.5 as int) as prediction from (select query_id, sum(case when label < 5 then 1 - distance else 0 end) / sum(1 - distance) as s from t where tr <= 10 and 1 - distance > 0 group by 1)")
def trf_binary(spark, sf):
    votes = transfer(spark, sf).withColumn("label", (F.col("label") < 5).cast("int"))
    return probes.binary(votes).select("query_id", F.round("score", 6).alias("score"), "prediction")


@query(SPLIT + "select query_id, label as prediction, round(votes, 6) as votes from (select query_id, label, round(sum(1 - distance), 12) as votes from t where tr <= 10 and 1 - distance > 0 group by 1, 2) qualify row_number() over (partition by query_id order by votes desc, label) = 1")
def trf_multiclass(spark, sf):
    return probes.multiclass(transfer(spark, sf)).select("query_id", "prediction", F.round("votes", 6).alias("votes"))


@query(SPLIT + ", w as (select query_id, 1 - distance as w, unnest(list_distinct(['c' || label, 'm' || label % 3])) as class from t where tr <= 10 and 1 - distance > 0), o as (select query_id, sum(1 - distance) as o from t where tr <= 10 and 1 - distance > 0 group by 1) select query_id, class, round(sum(w) / any_value(o), 6) as score, round(sum(w) / any_value(o), 9) >= 0.5 as predicted from w join o using (query_id) group by 1, 2")
def trf_multilabel(spark, sf):
    label = F.array(F.concat(F.lit("c"), F.col("label").cast("string")), F.concat(F.lit("m"), F.pmod("label", F.lit(3)).cast("string")))
    out = probes.multilabel(transfer(spark, sf).withColumn("label", label))
    return out.select("query_id", "class", F.round("score", 6).alias("score"), (F.round("score", 9) >= 0.5).alias("predicted"))


@query(SPLIT + "select query_id, string_agg(id || ':' || label, ',' order by distance, id) as neighbors from t where tr <= 10 and 1 - distance > 0 group by 1")
def trf_explain(spark, sf):
    out = probes.explain(transfer(spark, sf))
    return out.select("query_id", F.array_join(F.transform("neighbors", lambda n: F.concat_ws(":", n["id"].cast("string"), n["label"].cast("string"))), ",").alias("neighbors"))
