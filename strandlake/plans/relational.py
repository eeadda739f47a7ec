"""Queries of scans, lookups, joins, aggregates, windows, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import vec
from strandlake.operators import relational as R
from strandlake.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("select c_custkey, c_name, c_nationkey, c_acctbal from customer")
def src_scan(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


@query("select * from part where p_partkey = (select max(p_partkey) // 2 from part)")
def flt_point(spark, sf):
    part = table(spark, sf, "part")
    return part.join(part.agg(F.floor(F.max("p_partkey") / 2).alias("p_partkey")), "p_partkey", "left_semi")


@query("select c_custkey, c_name from customer where c_nationkey in (1, 3, 5, 7)")
def flt_in_list(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_nationkey").isin(1, 3, 5, 7)).select("c_custkey", "c_name")


@query("select count(*) as n, max(o_orderkey) as max_key from orders")
def agg_count(spark, sf):
    return table(spark, sf, "orders").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("max_key"))


@query("select distinct p_brand, p_type from part")
def agg_distinct(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type").distinct()


@query("select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc nulls last, o_orderkey) as rank from orders order by o_totalprice desc nulls last, o_orderkey limit 100")
def topk_global(spark, sf):
    top = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(100)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey")).cast("long"))


@query("select user_id, string_agg(event_type, ';' order by v desc nulls last, event_id) as types from (select *, case when value > 10 then value end as v from events) group by 1")
def sort_nulls_last(spark, sf):
    e = table(spark, sf, "events").withColumn("v", F.when(F.col("value") > 10, F.col("value")))
    order = F.struct(F.col("v").isNull(), -F.coalesce("v", F.lit(0.0)), "event_id")
    return e.groupBy("user_id").agg(R.ordered_list(F.col("event_type"), order).alias("types"))


@query("select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey")
def join_inner(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("select r_name, n_name, count(*) as n_lines, cast(sum(l_quantity) as double) as quantity from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey group by 1, 2")
def join_chain(spark, sf):
    t = lambda n: table(spark, sf, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").cast("double").alias("quantity"))


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_custkey in (select s_suppkey from supplier)")
def join_batch(spark, sf):
    ids = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    return R.batch_lookup(table(spark, sf, "customer"), "c_custkey", ids).join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def join_semi(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def join_anti(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("select a.c_custkey as id, b.c_custkey as alias from customer a join customer b on a.c_nationkey = b.c_nationkey")
def join_alias_self(spark, sf):
    """All ids that share a key, each with each: a row per pair, as the client's alias join returns."""
    return R.alias_pairs(table(spark, sf, "customer"), "c_nationkey", "c_custkey")


@query("select c_custkey, o_orderkey, o_totalprice, r as rank from customer left join (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) on o_custkey = c_custkey and r <= 3")
def join_lateral_topk(spark, sf):
    top = R.top_per_group(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
    return table(spark, sf, "customer").join(top, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice", "rank")


@query("select k, label, n_name from (values (1, 'a'), (4, 'b'), (99, 'c')) as v(k, label) join nation on n_nationkey = k")
def join_values(spark, sf):
    values = spark.createDataFrame([(1, "a"), (4, "b"), (99, "c")], "k int, label string")
    return table(spark, sf, "nation").join(F.broadcast(values), F.col("n_nationkey") == F.col("k")).select("k", "label", "n_name")


@query("select distinct token, p_partkey from (select p_partkey, unnest(string_split(p_name, ' ')) as token from part)")
def join_unnest(spark, sf):
    return table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("token"), "p_partkey").distinct()


@query("select a.vec_id as id_a, b.vec_id as id_b, round(list_distance(a.embedding::double[], b.embedding::double[]), 6) as l2, round(1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a, embeddings b where a.vec_id = (select min(vec_id) from embeddings) and b.vec_id = (select max(vec_id) from embeddings)")
def join_pair(spark, sf):
    """Distances of two named vectors, each found by its id."""
    e = table(spark, sf, "embeddings").select("vec_id", vec.as_double("embedding").alias("v"))
    ends = e.agg(F.min("vec_id").alias("id_a"), F.max("vec_id").alias("id_b"))
    a, b = e.select(F.col("vec_id").alias("id_a"), F.col("v").alias("a")), e.select(F.col("vec_id").alias("id_b"), F.col("v").alias("b"))
    pair = a.join(F.broadcast(ends), "id_a").join(b, "id_b")  # one row of two ids
    return pair.select("id_a", "id_b", F.round(vec.l2(F.col("a"), F.col("b")), 6).alias("l2"), F.round(vec.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("select r_name, string_agg(n_name || ':' || n, ';' order by n_name) as nations, cast(sum(n) as bigint) as customers from (select r_name, n_name, count(c_custkey) as n from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1, 2) group by 1")
def join_nested_context(spark, sf):
    t = lambda n: table(spark, sf, n)
    children = t("customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    nations = t("nation").join(children, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_regionkey", "n_name", F.coalesce("n", F.lit(0)).alias("n"))
    nested = nations.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_name", "n"))).alias("nations"))
    out = t("region").join(nested, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("r_name", F.array_join(F.transform("nations", lambda x: F.concat_ws(":", x["n_name"], x["n"].cast("string"))), ";").alias("nations"), F.aggregate("nations", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("customers"))


@query("select distinct l_orderkey, pos from (select l_orderkey, unnest(range(l_linenumber, l_linenumber + 3)) as pos from lineitem)")
def join_interval_paint(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("s"), (F.col("l_linenumber") + 2).cast("long").alias("e"))
    return R.paint_intervals(lines, ["l_orderkey"], "s", "e")


@query("select p_type, string_agg(cast(p_partkey as varchar), ';' order by p_partkey) as parts from part group by 1")
def agg_collect_list(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(R.ordered_list(F.col("p_partkey").cast("string"), F.col("p_partkey")).alias("parts"))


@query("select p_brand, string_agg(p_type, ';' order by p_type) as types from (select distinct p_brand, p_type from part) group by 1")
def agg_collect_set(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ";").alias("types"))


@query("select distinct on (o_custkey) o_custkey, o_orderkey, o_totalprice from orders order by o_custkey, o_totalprice, o_orderkey")
def agg_distinct_on(spark, sf):
    return R.first_per_group(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice"), F.col("o_orderkey")])


@query("select l_partkey, min(l_extendedprice) as least, cast(min(l_linenumber) as bigint) as first_line from lineitem group by 1")
def agg_min_dedup(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min("l_extendedprice").alias("least"), F.min("l_linenumber").cast("long").alias("first_line"))


@query("select event_type, round(avg(case when user_id % 2 = 0 then value end), 6) as mean_even, round(avg(case when user_id % 2 = 1 then value end), 6) as mean_odd, round(stddev_samp(value), 6) as std from events group by 1")
def agg_pivot_mean_std(spark, sf):
    e = table(spark, sf, "events").withColumn("side", F.when(F.pmod("user_id", F.lit(2)) == 0, "mean_even").otherwise("mean_odd"))
    means = e.groupBy("event_type").pivot("side", ["mean_even", "mean_odd"]).agg(F.round(F.avg("value"), 6))
    return means.join(e.groupBy("event_type").agg(F.round(F.stddev_samp("value"), 6).alias("std")), "event_type")


@query("select distinct l_quantity, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2 as avg_rank from lineitem")
def win_avg_rank(spark, sf):
    """Ranks of tied values, averaged: counts are aggregated before the window."""
    counts = table(spark, sf, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("l_quantity").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.select("l_quantity", (before + 1 + (F.col("n") - 1) / 2).alias("avg_rank"))


@query("select doc_id, lang, md5(doc_id || 'seed-1') as h from documents order by h, doc_id limit 200")
def smp_md5(spark, sf):
    return R.hash_sample(table(spark, sf, "documents"), "doc_id", 200, "seed-1").select("doc_id", "lang", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("seed-1"))).alias("h"))


@query()
def smp_splitmix(spark, sf):
    """Unsigned 64-bit products have no plain DuckDB form; tests compare with Python."""
    return R.splitmix_sample(table(spark, sf, "documents"), "doc_id", 200).select("doc_id", "lang")


@query("select lang, doc_id from (select *, row_number() over (partition by lang order by doc_id) as r from documents) where r <= 20")
def smp_split_limit(spark, sf):
    return R.top_per_group(table(spark, sf, "documents"), ["lang"], [F.col("doc_id")], 20).select("lang", "doc_id")


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def set_union(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("select 'customer' as kind, c_nationkey as k from customer union all select 'supplier', s_nationkey from supplier")
def set_union_all(spark, sf):
    return table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("k")).unionAll(table(spark, sf, "supplier").select(F.lit("supplier"), "s_nationkey"))


@query("select c_custkey as k from customer intersect select o_custkey from orders")
def set_intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf, "orders").select("o_custkey"))


@query("select p_partkey as k from part except select l_partkey from lineitem")
def set_except(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, sf, "lineitem").select("l_partkey"))


@query("select doc_id, upper(trim(lang)) as lang, length(regexp_replace(coalesce(text, ''), '[ \\t\\n]', '', 'g')) as packed, replace(replace(source, 's', '_'), 'c', '-') as source from documents".replace("\\\\", "\\"))
def str_clean(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.upper(F.trim("lang")).alias("lang"), F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \t\n]", "")).cast("long").alias("packed"), F.translate("source", "sc", "_-").alias("source"))


@query("select p_partkey, regexp_matches(upper(p_name), '^[A-Z ]+$') as valid, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(upper(p_name), '[^A-M]'))), ''), '') as invalid from part")
def str_validate(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.upper("p_name").rlike("^[A-Z ]+$").alias("valid"), F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper("p_name"), F.lit("([^A-M])")))), "").alias("invalid"))


@query("select p_partkey, '<s>' || array_to_string(string_split(regexp_replace(upper(replace(p_name, ' ', '')), '[UZOB]', 'X', 'g'), ''), ' ') as tokens from part")
def str_preprocess(spark, sf):
    clean = F.regexp_replace(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), "[UZOB]", "X")
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("<s>"), F.array_join(F.split(clean, ""), " ")).alias("tokens"))


@query("select p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand || '#' || p_size), '[^a-z0-9]+', '-', 'g'), '-') as slug from part")
def str_slug(spark, sf):
    name = F.lower(F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit("#"), F.col("p_size").cast("string")))
    return table(spark, sf, "part").select("p_partkey", F.btrim(F.regexp_replace(name, "[^a-z0-9]+", "-"), F.lit("-")).alias("slug"))


@query("select p_partkey, p_name from part where p_name ilike '%RED%' or p_type ilike 'standard%'")
def str_ilike(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").ilike("%RED%") | F.col("p_type").ilike("standard%")).select("p_partkey", "p_name")


@query("select o_orderkey, round(ln(o_totalprice), 6) as log, round(sqrt(o_totalprice), 6) as root, least(greatest(o_totalprice, 1000), 100000) as clipped, abs(-o_totalprice) as size from orders")
def math_basic(spark, sf):
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.log(p), 6).alias("log"), F.round(F.sqrt(p), 6).alias("root"), F.least(F.greatest(p, F.lit(1000)), F.lit(100000)).alias("clipped"), F.abs(-p).alias("size"))


@query("select p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ',') as tokens, string_split(p_name, ' ')[1] as first, cast(len(string_split(p_name, ' ')) as bigint) as n, cast(coalesce(list_position(string_split(p_name, ' '), 'red'), 0) as bigint) as red_at from part")
def arr_basic(spark, sf):
    tokens = F.split("p_name", " ")
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(tokens)), ",").alias("tokens"), F.get(tokens, F.lit(0)).alias("first"), F.size(tokens).cast("long").alias("n"), F.array_position(tokens, "red").cast("long").alias("red_at"))


@query("select p_partkey, case when p_size > 25 then p_brand else p_type end as a, coalesce(p_brand, 'none') as b from part")
def map_merge(spark, sf):
    """Defaults overlaid by a later map; the last key wins."""
    base = F.create_map(F.lit("a"), F.col("p_type"), F.lit("b"), F.lit("none"))
    over = F.map_filter(F.create_map(F.lit("a"), F.when(F.col("p_size") > 25, F.col("p_brand")), F.lit("b"), F.col("p_brand")), lambda k, v: v.isNotNull())
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)
    return table(spark, sf, "part").select("p_partkey", F.element_at(merged, "a").alias("a"), F.element_at(merged, "b").alias("b"))


@query("select event_id, props ->> '$.page' as page, coalesce(props ->> '$.missing', props ->> '$.ref', 'none') as fallback, length(props) as n from events")
def json_extract(spark, sf):
    get = lambda k: F.get_json_object("props", f"$.{k}")
    return table(spark, sf, "events").select("event_id", get("page").alias("page"), F.coalesce(get("missing"), get("ref"), F.lit("none")).alias("fallback"), F.length("props").cast("long").alias("n"))


@query("select 'count=' || count(*) || ';max_sequence_id=' || max(vec_id) as revision from embeddings")
def idx_revision(spark, sf):
    return table(spark, sf, "embeddings").agg(F.concat(F.lit("count="), F.count("*").cast("string"), F.lit(";max_sequence_id="), F.max("vec_id").cast("string")).alias("revision"))


@query("select row_number() over (order by 'P' || vec_id) - 1 as row_index, vec_id as sequence_id, 'P' || vec_id as protein_id, cast(len(embedding) as bigint) as dim from embeddings")
def idx_store(spark, sf):
    from strandlake.operators.order import row_index

    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sequence_id"), F.concat(F.lit("P"), F.col("vec_id").cast("string")).alias("protein_id"), F.size("embedding").cast("long").alias("dim"))
    return row_index(rows, "protein_id").select("row_index", "sequence_id", "protein_id", "dim")


@query("select m.name, case when m.revision is null then 'missing' when m.dim <> 64 then 'invalid' when m.revision <> r.revision then 'stale' else 'current' end as state from (values ('a', 'live', 64), ('b', 'count=1;max_sequence_id=1', 64), ('c', null, 64), ('d', 'live', 32)) as v(name, rev, dim), (select 'count=' || count(*) || ';max_sequence_id=' || max(vec_id) as revision from embeddings) as r, lateral (select v.name, case when v.rev = 'live' then r.revision else v.rev end as revision, v.dim) as m")
def idx_inspect(spark, sf):
    from strandlake.operators.store import state

    live = idx_revision(spark, sf)
    manifests = spark.createDataFrame([("a", "live", 64), ("b", "count=1;max_sequence_id=1", 64), ("c", None, 64), ("d", "live", 32)], "name string, rev string, dim int")
    joined = manifests.join(F.broadcast(live), F.lit(True)).withColumn("stored", F.when(F.col("rev") == "live", F.col("revision")).otherwise(F.col("rev")))
    return joined.select("name", state(F.col("stored"), F.col("revision"), F.col("dim") == 64).alias("state"))


@query("select name, (body ->> '$.metric') as metric, cast(body ->> '$.dim' as int) as dim, coalesce(body ->> '$.note', 'none') as note from (values ('a', '{\"metric\":\"cosine\",\"dim\":64}'), ('b', '{\"metric\":\"l2\",\"dim\":32,\"note\":\"x\"}')) as v(name, body)")
def idx_manifest(spark, sf):
    rows = spark.createDataFrame([("a", '{"metric":"cosine","dim":64}'), ("b", '{"metric":"l2","dim":32,"note":"x"}')], "name string, body string")
    parsed = rows.select("name", F.from_json("body", "metric string, dim int, note string").alias("m"))
    return parsed.select("name", "m.metric", "m.dim", F.coalesce("m.note", F.lit("none")).alias("note"))


@query("select 'P' || c_custkey as protein_id, vec_id as sequence_id, round(embedding[1]::double, 6) as first from customer join embeddings on vec_id = c_custkey % (select count(*) from embeddings)")
def idx_protein_vectors(spark, sf):
    ids = table(spark, sf, "customer").select(F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("protein_id"), "c_custkey")
    vectors = table(spark, sf, "embeddings")
    ids = ids.join(F.broadcast(vectors.agg(F.count("*").alias("n"))), F.lit(True)).select("protein_id", F.pmod("c_custkey", "n").alias("vec_id"))  # one row
    return ids.join(vectors, "vec_id").select("protein_id", F.col("vec_id").alias("sequence_id"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("select (r - 1) // 64 as batch, count(*) as n, min(vec_id) as first_id, max(vec_id) as last_id from (select vec_id, row_number() over (order by vec_id) as r from embeddings) group by 1")
def idx_batches(spark, sf):
    from strandlake.operators.order import row_index

    rows = row_index(table(spark, sf, "embeddings").select("vec_id"), "vec_id")
    return rows.groupBy(F.floor(F.col("row_index") / 64).alias("batch")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


@query("select exists (select 1 from customer where c_nationkey = 3) as has_type, exists (select 1 from customer where c_nationkey = 99) as has_layer, (select count(*) from customer where c_nationkey = 3) as n, (select string_agg(cast(k as varchar), ';' order by k) from (select distinct c_nationkey as k from customer)) as available")
def sub_exists_scalar(spark, sf):
    return table(spark, sf, "customer").agg(
        F.coalesce(F.bool_or(F.col("c_nationkey") == 3), F.lit(False)).alias("has_type"),
        F.coalesce(F.bool_or(F.col("c_nationkey") == 99), F.lit(False)).alias("has_layer"),
        F.count_if(F.col("c_nationkey") == 3).alias("n"),
        F.array_join(F.array_sort(F.collect_set("c_nationkey")), ";").alias("available"),
    )
