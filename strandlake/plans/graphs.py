"""Queries over a taxonomy (root, regions, nations, customers) and an ontology (parts under type and brand)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import dag, tree
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


def nodes(spark, sf):
    t = lambda n: table(spark, sf, n)
    root = spark.createDataFrame([("T", "T", "root", "all")], "tax_id string, parent_id string, rank string, name string")
    r = t("region").select(F.concat(F.lit("R"), "r_regionkey"), F.lit("T"), F.lit("region"), "r_name")
    n = t("nation").select(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey"), F.lit("nation"), "n_name")
    c = t("customer").select(F.concat(F.lit("C"), "c_custkey"), F.concat(F.lit("N"), "c_nationkey"), F.lit("customer"), "c_name")
    return root.unionAll(r).unionAll(n).unionAll(c)


TREE = """with recursive node(id, parent, rank, name) as (select 'T', 'T', 'root', 'all' union all select 'R' || r_regionkey, 'T', 'region', r_name from region
  union all select 'N' || n_nationkey, 'R' || n_regionkey, 'nation', n_name from nation union all select 'C' || c_custkey, 'N' || c_nationkey, 'customer', c_name from customer),
clo(id, anc, up) as (select id, id, 0 from node union all select c.id, n.parent, c.up + 1 from clo c join node n on n.id = c.anc where n.parent <> n.id),
dep as (select id, max(up) as depth from clo group by 1),
pr as (select 'C' || c_custkey as a, 'C' || (c_custkey * 7 + 3) % (select count(*) from customer) as b from customer where (c_custkey * 7 + 3) % (select count(*) from customer) in (select c_custkey from customer)),
lc as (select a, b, arg_max(anc, depth * 1000 + ord) as lca, max(depth) as lca_depth from (select pr.a, pr.b, x.anc, d.depth, 0 as ord from pr join clo x on x.id = pr.a join clo y on y.id = pr.b and y.anc = x.anc join dep d on d.id = x.anc) group by 1, 2),
l as (select lc.*, da.depth as depth_a, db.depth as depth_b from lc join dep da on da.id = a join dep db on db.id = b),
cnt as (select anc, count(distinct o_orderkey) as n from orders join clo on clo.id = 'C' || o_custkey group by 1),
ic as (select anc, abs(-ln(n / (select count(*) from orders join customer on o_custkey = c_custkey))) as ic from cnt) """


def pairs(spark, sf):
    """Each customer beside another one."""
    c = table(spark, sf, "customer").select("c_custkey")
    n = c.agg(F.count("*").alias("n"))
    p = c.join(F.broadcast(n), F.lit(True)).select("c_custkey", F.pmod(F.col("c_custkey") * 7 + 3, F.col("n")).alias("other"))
    known = c.select(F.col("c_custkey").alias("other"))
    return p.join(known, "other", "left_semi").select(F.concat(F.lit("C"), "c_custkey").alias("a"), F.concat(F.lit("C"), "other").alias("b"))


def closed_tree(spark, sf):
    return tree.closure(nodes(spark, sf))


def lcas(spark, sf):
    return tree.lca(pairs(spark, sf), closed_tree(spark, sf))


def order_ic(spark, sf):
    annotations = table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity"), F.concat(F.lit("C"), "o_custkey").alias("tax_id"))
    counts = tree.entity_counts(annotations, closed_tree(spark, sf))
    total = counts.agg(F.max("n").alias("total"))
    return tree.information(counts.join(F.broadcast(total), F.lit(True)), F.col("total"))


@query(TREE + "select n.id as tax_id, name, rank, parent as parent_id, cast(depth as bigint) as depth from node n join dep using (id)")
def tx_nodes(spark, sf):
    return nodes(spark, sf).join(tree.depths(closed_tree(spark, sf)), "tax_id").select("tax_id", "name", "rank", "parent_id", F.col("depth").cast("long").alias("depth"))


@query("select raw, id from (values (' 9606 ', '9606'), ('9606.0', '9606'), ('nan', ''), ('', ''), (null, ''), ('inf', ''), ('12.5', '12.5'), ('abc', 'abc')) as v(raw, id)")
def tx_normalize(spark, sf):
    raw = spark.createDataFrame([(" 9606 ",), ("9606.0",), ("nan",), ("",), (None,), ("inf",), ("12.5",), ("abc",)], "raw string")
    return raw.select("raw", tree.normalize_id(F.col("raw")).alias("id"))


@query(TREE + "select cast(depth as bigint) as depth, count(*) as n from dep group by 1")
def tx_depth(spark, sf):
    return tree.depths(closed_tree(spark, sf)).groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n"))


@query(TREE + "select id as tax_id, string_agg(anc, '>' order by up desc) as lineage from clo group by 1")
def tx_lineage(spark, sf):
    return tree.lineage(closed_tree(spark, sf))


@query(TREE + "select anc as ancestor, id as tax_id, cast(depth as bigint) as depth from clo join dep using (id) where up > 0")
def tx_descendants(spark, sf):
    closed = closed_tree(spark, sf)
    return closed.where("up > 0").join(tree.depths(closed), "tax_id").select("ancestor", "tax_id", F.col("depth").cast("long").alias("depth"))


@query(TREE + "select a, b, lca, cast(lca_depth as bigint) as lca_depth from l")
def tx_lca(spark, sf):
    return lcas(spark, sf).select("a", "b", "lca", F.col("lca_depth").cast("long").alias("lca_depth"))


@query(TREE + "select a, b, rank as lca_rank from l join node on node.id = lca")
def tx_lca_rank(spark, sf):
    return lcas(spark, sf).join(nodes(spark, sf).select(F.col("tax_id").alias("lca"), F.col("rank").alias("lca_rank")), "lca").select("a", "b", "lca_rank")


@query(TREE + "select a, b, x.anc = y.anc as shares from pr join (select id, anc from clo where anc like 'R%') x on x.id = a join (select id, anc from clo where anc like 'R%') y on y.id = b")
def tx_same_rank(spark, sf):
    clade = tree.nearest_at_rank(closed_tree(spark, sf), nodes(spark, sf), "region")
    p = pairs(spark, sf).join(clade.select(F.col("tax_id").alias("a"), F.col("clade").alias("ca")), "a").join(clade.select(F.col("tax_id").alias("b"), F.col("clade").alias("cb")), "b")
    return p.select("a", "b", (F.col("ca") == F.col("cb")).alias("shares"))


@query(TREE + "select a, b, cast(depth_a + depth_b - 2 * lca_depth as bigint) as length from l")
def tx_branch_len(spark, sf):
    return lcas(spark, sf).select("a", "b", tree.branch_length().cast("long").alias("length"))


@query(TREE + "select a, b, round(2 * lca_depth / (depth_a + depth_b), 6) as wu_palmer, round(lca_depth / greatest(depth_a, depth_b), 6) as normalized from l")
def tx_wu_palmer(spark, sf):
    return lcas(spark, sf).select("a", "b", F.round(tree.wu_palmer(), 6).alias("wu_palmer"), F.round(tree.normalized_depth(), 6).alias("normalized"))


@query(TREE + "select anc as tax_id, n from cnt")
def tx_counts(spark, sf):
    annotations = table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity"), F.concat(F.lit("C"), "o_custkey").alias("tax_id"))
    return tree.entity_counts(annotations, closed_tree(spark, sf)).select(F.col("ancestor").alias("tax_id"), "n")


@query(TREE + "select anc as tax_id, count(*) as n from clo group by 1")
def tx_subtree(spark, sf):
    return tree.subtree_sizes(closed_tree(spark, sf)).select(F.col("ancestor").alias("tax_id"), "n")


@query(TREE + "select anc as tax_id, round(ic, 6) as ic from ic")
def tx_ic(spark, sf):
    return order_ic(spark, sf).select(F.col("ancestor").alias("tax_id"), F.round("ic", 6).alias("ic"))


LIN = TREE + ", m as (select a, b, coalesce(x.ic, 0) as ia, coalesce(y.ic, 0) as ib, coalesce(z.ic, 0) as il from l left join ic x on x.anc = a left join ic y on y.anc = b left join ic z on z.anc = lca) "


@query(LIN + "select a, b, round(case when ia + ib = 0 then 1 else 2 * il / (ia + ib) end, 6) as lin from m")
def tx_lin(spark, sf):
    return tree.lin(lcas(spark, sf), order_ic(spark, sf)).select("a", "b", F.round("lin", 6).alias("lin"))


@query(LIN + "select a, b, round(ia, 6) as ic_a, round(ib, 6) as ic_b, round(case when ia + ib = 0 then 1 else 2 * il / (ia + ib) end, 6) as lin from m")
def tx_ic_lin_maps(spark, sf):
    return tree.lin(lcas(spark, sf), order_ic(spark, sf)).select("a", "b", *(F.round(c, 6).alias(c) for c in ("ic_a", "ic_b", "lin")))


# The ontology: a part is under its type and its brand, both under the root. Annotations: an order has its lines' parts.
NAMESPACES = ("mf", "bp", "cc")


def terms(spark, sf):
    p = table(spark, sf, "part")
    leaf = p.select(F.concat(F.lit("P"), "p_partkey").alias("term"), F.get(F.array(*(F.lit(x) for x in NAMESPACES)), F.pmod("p_partkey", F.lit(3)).cast("int")).alias("namespace"), F.col("p_name").alias("name"))
    mid = p.select(F.col("p_type").alias("term")).unionAll(p.select("p_brand")).distinct().select("term", F.lit("mf").alias("namespace"), F.col("term").alias("name"))
    return leaf.unionAll(mid).unionAll(spark.createDataFrame([("ROOT", "mf", "root")], "term string, namespace string, name string"))


def edges(spark, sf):
    p = table(spark, sf, "part")
    leaf = F.concat(F.lit("P"), "p_partkey")
    low = p.select(leaf.alias("child"), F.col("p_type").alias("parent")).unionAll(p.select(leaf, "p_brand"))
    return low.unionAll(low.select(F.col("parent").alias("child"), F.lit("ROOT").alias("parent"))).distinct()


def annotations(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entity"), F.concat(F.lit("P"), "l_partkey").alias("term"))


def closed_dag(spark, sf):
    return dag.closure(terms(spark, sf), edges(spark, sf))


DAG = """with term as (select 'P' || p_partkey as term, ['mf', 'bp', 'cc'][cast(p_partkey % 3 + 1 as int)] as namespace, p_name as name from part union all select distinct t, 'mf', t from (select p_type as t from part union all select p_brand from part) union all select 'ROOT', 'mf', 'root'),
edge as (select distinct 'P' || p_partkey as child, p_type as parent from part union select 'P' || p_partkey, p_brand from part union select p_type, 'ROOT' from part union select p_brand, 'ROOT' from part),
clo as (select term, term as anc, 0 as dist from term union all select child, parent, 1 from edge union all select 'P' || p_partkey, 'ROOT', 2 from part),
ann as (select distinct l_orderkey as entity, 'P' || l_partkey as term from lineitem),
cnt as (select anc as term, count(distinct entity) as n from ann join clo using (term) group by 1),
ic as (select term, abs(-ln(n / (select n from cnt where term = 'ROOT'))) as ic from cnt),
pr as (select 'P' || p_partkey as a, 'P' || (p_partkey * 5 + 1) % (select count(*) from part) as b from part where (p_partkey * 5 + 1) % (select count(*) from part) in (select p_partkey from part)),
res as (select pr.a, pr.b, max(ic.ic) as resnik from pr join clo x on x.term = a join clo y on y.term = b and y.anc = x.anc join ic on ic.term = x.anc group by 1, 2),
sim as (select pr.a, pr.b, coalesce(resnik, 0) as resnik, case when coalesce(i.ic, 0) + coalesce(j.ic, 0) = 0 then 0 else 2 * coalesce(resnik, 0) / (coalesce(i.ic, 0) + coalesce(j.ic, 0)) end as lin from pr left join res on res.a = pr.a and res.b = pr.b left join ic i on i.term = pr.a left join ic j on j.term = pr.b) """


def part_pairs(spark, sf):
    p = table(spark, sf, "part").select("p_partkey")
    q = p.join(F.broadcast(p.agg(F.count("*").alias("n"))), F.lit(True)).select("p_partkey", F.pmod(F.col("p_partkey") * 5 + 1, F.col("n")).alias("other"))
    return q.join(p.select(F.col("p_partkey").alias("other")), "other", "left_semi").select(F.concat(F.lit("P"), "p_partkey").alias("a"), F.concat(F.lit("P"), "other").alias("b"))


def term_ic(spark, sf, closed):
    return dag.information(dag.term_counts(annotations(spark, sf), closed), "ROOT")


def similarities(spark, sf):
    closed = closed_dag(spark, sf)
    return dag.similarity(part_pairs(spark, sf), closed, term_ic(spark, sf, closed))


@query(DAG + "select term, namespace, name from term")
def go_terms(spark, sf):
    return terms(spark, sf)


@query(DAG + "select term, anc as ancestor, cast(dist as bigint) as dist from clo where dist > 0")
def go_ancestors(spark, sf):
    return closed_dag(spark, sf).where("dist > 0").select("term", "ancestor", F.col("dist").cast("long").alias("dist"))


@query(DAG + "select anc as term, count(*) as n from clo where dist > 0 group by 1")
def go_descendants(spark, sf):
    return closed_dag(spark, sf).where("dist > 0").groupBy(F.col("ancestor").alias("term")).agg(F.count("*").alias("n"))


@query(DAG + "select parent, string_agg(child, ';' order by child) as children from edge group by 1")
def go_children(spark, sf):
    return edges(spark, sf).groupBy("parent").agg(R.ordered_list(F.col("child")).alias("children"))


RELATED = DAG + ", q as (select * from pr union all select a, a from pr union all select child, parent from edge union all select parent, child from edge), rel as (select q.a, q.b, case when q.a = q.b then 0 when u.dist = 1 then 1 when d.dist = 1 then 2 when u.dist is not null then 3 when d.dist is not null then 4 else 5 end as rank from (select distinct * from q) q left join clo u on u.term = q.b and u.anc = q.a left join clo d on d.term = q.a and d.anc = q.b) "


def related_pairs(spark, sf):
    p, e = part_pairs(spark, sf), edges(spark, sf)
    return p.unionAll(p.select("a", F.col("a").alias("b"))).unionAll(e.select(F.col("child").alias("a"), F.col("parent").alias("b"))).unionAll(e.select(F.col("parent").alias("a"), F.col("child").alias("b"))).distinct()


def related(spark, sf):
    return dag.relation(related_pairs(spark, sf), closed_dag(spark, sf))


@query(RELATED + "select a, b, ['same', 'parent', 'child', 'ancestor', 'descendant', 'non-related'][rank + 1] as relation from rel")
def go_relation(spark, sf):
    return related(spark, sf).select("a", "b", "relation")


@query(RELATED + "select a, b, rank = 1 as is_parent, rank = 2 as is_child, rank in (1, 3) as is_ancestor, rank in (2, 4) as is_descendant, rank < 5 as same_path from rel")
def go_predicates(spark, sf):
    return dag.predicates(related_pairs(spark, sf), closed_dag(spark, sf))


@query(RELATED + "select a, ['same', 'parent', 'child', 'ancestor', 'descendant', 'non-related'][rank + 1] as relation, string_agg(b, ';' order by b) as matches from rel where a <> b and rank = (select min(r2.rank) from rel r2 where r2.a = rel.a and r2.a <> r2.b) group by 1, 2")
def go_best_relation(spark, sf):
    return dag.best_relation(related(spark, sf).where("a <> b"))


@query(DAG + "select pr.a, pr.b, string_agg(x.anc, ';' order by x.anc) as common from pr join clo x on x.term = a and x.dist > 0 join clo y on y.term = b and y.anc = x.anc group by 1, 2")
def go_common_anc(spark, sf):
    c = closed_dag(spark, sf)
    both = part_pairs(spark, sf).join(c.where("dist > 0").select(F.col("term").alias("a"), "ancestor"), "a").join(c.select(F.col("term").alias("b"), "ancestor"), ["b", "ancestor"])
    return both.groupBy("a", "b").agg(R.ordered_list(F.col("ancestor")).alias("common"))


@query(DAG + "select term, n from cnt")
def go_term_counts(spark, sf):
    return dag.term_counts(annotations(spark, sf), closed_dag(spark, sf))


@query(DAG + "select term, round(ic, 6) as ic from ic")
def go_ic(spark, sf):
    return term_ic(spark, sf, closed_dag(spark, sf)).select("term", F.round("ic", 6).alias("ic"))


@query(DAG + "select a, b, round(resnik, 6) as resnik from sim")
def go_resnik(spark, sf):
    return similarities(spark, sf).select("a", "b", F.round("resnik", 6).alias("resnik"))


@query(DAG + "select a, b, round(lin, 6) as lin from sim")
def go_lin(spark, sf):
    return similarities(spark, sf).select("a", "b", F.round("lin", 6).alias("lin"))


@query(DAG + "select a, b, round(lin * (1 - exp(-resnik)), 6) as schlicker from sim")
def go_schlicker(spark, sf):
    return similarities(spark, sf).select("a", "b", F.round("schlicker", 6).alias("schlicker"))


GROUPS = DAG + ", g as (select distinct 'g' || p_partkey % 97 as g, case when p_partkey % 2 = 0 then 'a' else 'b' end as side, p_type as term from part union select distinct 'g' || p_partkey % 97, case when p_partkey % 2 = 0 then 'a' else 'b' end, p_brand from part), tp as (select distinct x.term as a, y.term as b from g x join g y on x.g = y.g and x.side = 'a' and y.side = 'b'), ts as (select tp.a, tp.b, case when coalesce(i.ic, 0) + coalesce(j.ic, 0) = 0 then 0 else 2 * coalesce((select max(ic.ic) from clo x join clo y on y.anc = x.anc and y.term = tp.b join ic on ic.term = x.anc where x.term = tp.a), 0) / (coalesce(i.ic, 0) + coalesce(j.ic, 0)) end as s from tp left join ic i on i.term = a left join ic j on j.term = b), m as (select x.g, ts.a, ts.b, s from g x join g y on x.g = y.g and x.side = 'a' and y.side = 'b' join ts on ts.a = x.term and ts.b = y.term) "


def group_scores(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("g"), F.pmod("p_partkey", F.lit(97)).cast("string")).alias("g"), F.when(F.pmod("p_partkey", F.lit(2)) == 0, "a").otherwise("b").alias("side"), F.explode(F.array("p_type", "p_brand")).alias("term")).distinct()
    pairs_ = p.where("side = 'a'").select("g", F.col("term").alias("a")).join(p.where("side = 'b'").select("g", F.col("term").alias("b")), "g").select("a", "b").distinct()
    closed = closed_dag(spark, sf)
    return p, dag.similarity(pairs_, closed, term_ic(spark, sf, closed))


@query(GROUPS + "select r.g, round((r.v + c.v) / 2, 6) as bma from (select g, avg(m) as v from (select g, a, max(s) as m from m group by 1, 2) group by 1) r join (select g, avg(m) as v from (select g, b, max(s) as m from m group by 1, 2) group by 1) c using (g)")
def go_bma(spark, sf):
    groups, scores = group_scores(spark, sf)
    return dag.best_match_average(groups, scores).select("g", F.round("bma", 6).alias("bma"))


@query(GROUPS + "select g, round(max(s), 6) as best from m group by 1")
def go_best_pair(spark, sf):
    groups, scores = group_scores(spark, sf)
    left, right = groups.where("side = 'a'").select("g", F.col("term").alias("a")), groups.where("side = 'b'").select("g", F.col("term").alias("b"))
    return left.join(right, "g").join(scores, ["a", "b"]).groupBy("g").agg(F.round(F.max("lin"), 6).alias("best"))


@query(DAG + "select entity, string_agg(distinct name, '; ' order by name) as names from ann join term using (term) group by 1")
def go_names(spark, sf):
    return annotations(spark, sf).distinct().join(terms(spark, sf), "term").groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("names"))


@query(DAG + "select namespace, entity, count(*) as n from ann join term using (term) group by 1, 2")
def go_split_category(spark, sf):
    return annotations(spark, sf).distinct().join(terms(spark, sf), "term").groupBy("namespace", "entity").agg(F.count("*").alias("n"))


@query(DAG + "select entity, term from ann join term using (term) where namespace = 'bp'")
def go_known_terms(spark, sf):
    return annotations(spark, sf).distinct().join(terms(spark, sf).where("namespace = 'bp'"), "term").select("entity", "term")


@query(DAG + "select pr.a, pr.b, cast(min(4 - 2 * d.depth) as bigint) as length from pr join clo x on x.term = a and x.dist >= 0 join clo y on y.term = b and y.anc = x.anc join (select term, case when term = 'ROOT' then 0 when regexp_matches(term, '^P[0-9]') then 2 else 1 end as depth from term) d on d.term = x.anc group by 1, 2")
def go_branch_len(spark, sf):
    """Least branch length through the deepest common ancestor; depth is the longest way to the root."""
    c = closed_dag(spark, sf)
    depth = c.where("ancestor = 'ROOT'").select("term", F.col("dist").alias("depth"))
    both = part_pairs(spark, sf).join(c.select(F.col("term").alias("a"), "ancestor"), "a").join(c.select(F.col("term").alias("b"), "ancestor"), ["b", "ancestor"])
    deep = both.join(depth.select(F.col("term").alias("ancestor"), "depth"), "ancestor").groupBy("a", "b").agg(F.max("depth").alias("deep"))
    own = lambda n: depth.select(F.col("term").alias(n), F.col("depth").alias(f"d{n}"))
    return deep.join(own("a"), "a").join(own("b"), "b").select("a", "b", (F.col("da") + F.col("db") - 2 * F.col("deep")).cast("long").alias("length"))
