"""Queries of metrics, hierarchical sweeps and splits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators import dag, metrics, splits
from strandlake.plans import graphs
from strandlake.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df, places=6):
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


REG = "with r as (select l_extendedprice as t, l_quantity * 1000.0 as p from lineitem), k as (select t, p, rank() over (order by t) + (count(*) over (partition by t) - 1) / 2 as rt, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2 as rp from r) "


@query(REG + "select round(avg(abs(t - p)), 6) as mae, round(sqrt(avg((t - p) * (t - p))), 6) as rmse, round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)), 6) as r2, round(corr(rt, rp), 6) as spearmanr from k")
def met_regression(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_extendedprice").cast("double").alias("t"), (F.col("l_quantity") * 1000.0).cast("double").alias("p"))
    return rounded(metrics.regression(rows, "t", "p"))


@query(REG + "select round(corr(rt, rp), 6) as spearmanr from k")
def met_spearman(spark, sf):
    return met_regression(spark, sf).select("spearmanr")


def labelled(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select("doc_id", "lang", F.col("quality").alias("t"), (F.least(F.floor(F.col("n_chars") / 100), F.lit(100)) / 100.0).alias("s"))


LAB = "with x as (select l.doc_id, d.lang, quality as t, least(n_chars // 100, 100) / 100.0 as s from labels l join documents d using (doc_id)) "


@query(LAB + ", c as (select count(*) filter (t = 1 and s >= 0.1) as tp, count(*) filter (t <> 1 and s < 0.1) as tn, count(*) filter (t <> 1 and s >= 0.1) as fp, count(*) filter (t = 1 and s < 0.1) as fn from x) select round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) as macro_f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as balanced_accuracy, round((tp::double * tn - fp::double * fn) / sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 6) as mcc from c")
def met_binary(spark, sf):
    rows = labelled(spark, sf).withColumn("p", (F.col("s") >= 0.1).cast("int"))
    return rounded(metrics.binary(metrics.binary_counts(rows, "t", "p")))


CURVE = LAB + ", g as (select s as threshold, count(*) filter (t = 1) as p, count(*) filter (t <> 1) as q from x group by 1), c as (select *, sum(p) over (order by threshold desc) as tp, sum(q) over (order by threshold desc) as fp from g) "


@query(CURVE + "select round(sum((tp - p) * q + p * q / 2) / (sum(p)::double * sum(q)), 6) as auroc, round(sum(p * tp / (tp + fp)) / sum(p), 6) as auprc from c")
def met_auroc_auprc(spark, sf):
    return rounded(metrics.auroc_auprc(labelled(spark, sf), "t", "s"))


@query(CURVE + "select threshold::double as threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp from c")
def met_roc_pr_curve(spark, sf):
    return metrics.curve(labelled(spark, sf), "t", "s").select(F.col("threshold").cast("double").alias("threshold"), "tp", "fp")


@query("with x as (select p_type as t, first_value(p_type) over (partition by p_brand order by p_partkey) as p from part), k as (select distinct t as c from x), f as (select c, (select count(*) from x where t = c and p = c) as tp, (select count(*) from x where t = c) as s, (select count(*) from x where p = c) as n from k) select round(sum(tp) / sum(s), 6) as accuracy, round(avg(case when s + n = 0 then 0 else 2 * tp / (s + n) end), 6) as macro_f1, round(sum(s * case when s + n = 0 then 0 else 2 * tp / (s + n) end) / sum(s), 6) as weighted_f1 from f")
def met_multiclass(spark, sf):
    """Part types predicted by the type of the brand's first part."""
    p = table(spark, sf, "part")
    first = p.groupBy("p_brand").agg(F.min_by("p_type", "p_partkey").alias("p"))
    rows = p.join(first, "p_brand").select(F.col("p_type").alias("t"), "p")
    return rounded(metrics.multiclass(rows, "t", "p", rows.select(F.col("t").alias("class")).distinct()))


ML = "with t as (select distinct p_partkey as e, unnest(string_split(p_name, ' ')) as k from part), p as (select distinct p_partkey as e, unnest(string_split(p_name || ' red', ' ')) as k from part where p_size > 10), m as (select coalesce(t.k, p.k) as k, (t.e is not null)::int as t, (p.e is not null)::int as p from t full join p on t.e = p.e and t.k = p.k), f as (select k, sum(t * p) as tp, sum(t) as s, sum(p) as n from m group by 1) "


@query(ML + "select round(sum(tp) / sum(n), 6) as micro_precision, round(sum(tp) / sum(s), 6) as micro_recall, round(2 * sum(tp) / (sum(s) + sum(n)), 6) as micro_f1, round(avg(2 * tp / (s + n)), 6) as macro_f1, round(sum(s * 2 * tp / (s + n)) / sum(s), 6) as weighted_f1 from f")
def met_multilabel(spark, sf):
    p = table(spark, sf, "part")
    truth = p.select(F.col("p_partkey").alias("entity"), F.explode(F.split("p_name", " ")).alias("term"))
    predicted = p.where("p_size > 10").select(F.col("p_partkey").alias("entity"), F.explode(F.split(F.concat("p_name", F.lit(" red")), " ")).alias("term"))
    return rounded(metrics.multilabel(truth, predicted))


@query("with t as (select distinct p_partkey as e, unnest(string_split(p_name, ' ')) as k from part), p as (select distinct p_partkey as e, unnest(string_split(case when p_size > 10 then p_name else 'red' end, ' ')) as k from part), w as (select distinct coalesce(t.e, p.e) as e from t full join p on t.e = p.e and t.k = p.k where t.e is null or p.e is null) select round(1 - (select count(*) from w) / (select count(*) from part), 6) as exact_match")
def met_exact_match(spark, sf):
    p = table(spark, sf, "part")
    truth = p.select(F.col("p_partkey").alias("entity"), F.explode(F.split("p_name", " ")).alias("term"))
    predicted = p.select(F.col("p_partkey").alias("entity"), F.explode(F.split(F.when(F.col("p_size") > 10, F.col("p_name")).otherwise("red"), " ")).alias("term"))
    return rounded(metrics.exact_match(truth, predicted, p.select(F.col("p_partkey").alias("entity"))))


@query("with t as (select distinct p_partkey as e, unnest(string_split(p_name, ' ')) as k from part), s as (select p_partkey as e, k, (p_partkey * 13 + length(k) * 7 + p_size) % 50 / 50.0 as s from part, (select distinct k from t) c), j as (select s.k, s.s, (t.e is not null)::int as y from s left join t on t.e = s.e and t.k = s.k), g as (select k, s, sum(y) as p, count(*) as n from j group by 1, 2), c as (select *, sum(p) over (partition by k order by s desc) as tp, sum(n) over (partition by k order by s desc) as cn from g) select round(avg(a), 6) as average_precision from (select k, sum(p * tp / cn) / sum(p) as a from c group by 1)")
def met_average_precision(spark, sf):
    """Macro average precision over name words; every part has a score for every word."""
    p = table(spark, sf, "part")
    truth = p.select(F.col("p_partkey").alias("entity"), F.explode(F.split("p_name", " ")).alias("term")).distinct()
    words = truth.select("term").distinct()
    every = p.select("p_partkey", "p_size").join(F.broadcast(words), F.lit(True))  # a few dozen words of a fixed vocabulary
    score = F.pmod(F.col("p_partkey") * 13 + F.length("term") * 7 + F.col("p_size"), F.lit(50)) / 50.0
    return rounded(metrics.average_precision(truth, every.select(F.col("p_partkey").alias("entity"), "term", score.cast("double").alias("score")), words))


@query("select user_id, count(*) as n, round(count(*) filter ((value > 10) = (event_type = 'view')) / count(*), 6) as accuracy from events group by 1")
def met_per_entity(spark, sf):
    right = (F.col("value") > 10) == (F.col("event_type") == "view")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.count_if(right) / F.count("*"), 6).alias("accuracy"))


# Scores of parts for orders: every order's parts, and the next part by key, with numbers from a hash.
GO = graphs.DAG + """, sc as (select distinct entity, term, (entity * 31 + cast(substr(term, 2) as bigint) * 17) % 1009 / 1008.0 as score from (select entity, term from ann union select entity, 'P' || (cast(substr(term, 2) as bigint) + 1) from ann) where term in (select 'P' || p_partkey from part)),
tr as (select distinct entity, anc as term from ann join clo using (term) where anc <> 'ROOT'), ps as (select entity, anc as term, max(score) as score from sc join clo using (term) where anc <> 'ROOT' group by 1, 2),
wt as (select term, ic as weight from ic), th as (select i / 100.0 as t, i from (select unnest(range(0, 101)) as i)) """


def scored(spark, sf):
    """Scores (entity, term, score) of an order's parts and the next ones; a pair that comes twice has one score."""
    number = F.substring("term", 2, 20).try_cast("long")
    near = graphs.annotations(spark, sf).select("entity", F.explode(F.array(number, number + 1)).alias("number"))
    known = table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("term"))
    scores = near.select("entity", F.concat(F.lit("P"), F.col("number").cast("string")).alias("term"), (F.pmod(F.col("entity") * 31 + F.col("number") * 17, F.lit(1009)) / 1008.0).alias("score"))
    return scores, known


def go_tables(spark, sf):
    closed = graphs.closed_dag(spark, sf)
    scores, known = scored(spark, sf)
    # Only parts have scores, so the ancestors of other terms are left out.
    return dag.propagate_labels(graphs.annotations(spark, sf), closed, ["ROOT"]), dag.propagate_scores(scores, closed.join(known, "term", "left_semi"), ["ROOT"]), closed


@query(GO + "select entity, string_agg(term, ';' order by term) as terms from (select entity, term from tr except select entity, anc from ann join clo using (term) where anc <> 'ROOT' and try_cast(substr(ann.term, 2) as bigint) % 5 = 0) group by 1")
def go_context(spark, sf):
    """Propagated truth without what is already known, known terms propagated too."""
    truth, _, closed = go_tables(spark, sf)
    known = graphs.annotations(spark, sf).where(F.pmod(F.substring("term", 2, 20).try_cast("long"), F.lit(5)) == 0)
    left = truth.join(dag.propagate_labels(known, closed, ["ROOT"]), ["entity", "term"], "left_anti")
    return left.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list("term")), ";").alias("terms"))


@query(GO + "select entity, term, round(score, 6) as score from ps")
def go_score_prop(spark, sf):
    return rounded(go_tables(spark, sf)[1])


SWEEP = GO + """, en as (select entity, sum(1.0) as tw, sum(coalesce(weight, 0)) as ww from tr left join wt using (term) group by 1),
hit as (select ps.entity, ps.term, score, coalesce(weight, 0) as w, (tr.term is not null)::int as h from ps left join tr on tr.entity = ps.entity and tr.term = ps.term left join wt on wt.term = ps.term),
pe as (select th.t, hit.entity, sum(h) as tp, count(*) as n, sum(h * w) as wtp, sum(w) as wn from th join hit on score >= th.t group by 1, 2),
sw as (select t, sum(pe.tp / n) as ps, count(*) as np, sum(pe.tp / tw) as rs, sum(pe.tp) as tp, sum(n) as n, sum(case when wn > 0 and ww > 0 then wtp / wn else 0 end) as wps, count(*) filter (wn > 0 and ww > 0) as wnp, sum(case when ww > 0 then wtp / ww else 0 end) as wrs, sum(case when ww > 0 then wtp else 0 end) as wtp, sum(case when ww > 0 then wn else 0 end) as wn from pe join en using (entity) group by 1),
tot as (select count(*) as c, sum(tw) as tw, count(*) filter (ww > 0) as wc, sum(ww) as ww from en),
m as (select t, ps / np as p, rs / c as r, tp / n as mp, sw.tp / tot.tw as mr, wps / wnp as wp, wrs / wc as wr, (tot.ww - wtp) / wc as ru, (wn - wtp) / wc as mi from sw, tot) """


def swept(spark, sf, *kinds):
    closed = graphs.closed_dag(spark, sf)
    scores, known = scored(spark, sf)
    weights = graphs.term_ic(spark, sf, closed).withColumnRenamed("ic", "weight") if "weighted" in kinds else None
    marked = dag.propagate_marks(graphs.annotations(spark, sf), scores.join(known, "term", "left_semi"), closed, ["ROOT"], weights)
    return metrics.sweep(marked, 101, kinds)


@query(SWEEP + "select round(t, 6)::double as threshold, round(2 * p * r / (p + r), 6) as f from m order by round(2 * p * r / (p + r), 12) desc, t limit 1")
def go_fmax(spark, sf):
    return rounded(metrics.best(swept(spark, sf, "plain"), "f"))


@query(SWEEP + "select round(t, 6)::double as threshold, round(2 * mp * mr / (mp + mr), 6) as micro_f from m order by round(2 * mp * mr / (mp + mr), 12) desc, t limit 1")
def go_fmax_micro(spark, sf):
    return rounded(metrics.best(swept(spark, sf, "plain"), "micro_f"))


@query(SWEEP + "select round(t, 6)::double as threshold, round(2 * wp * wr / (wp + wr), 6) as f from m order by round(2 * wp * wr / (wp + wr), 12) desc, t limit 1")
def go_weighted_fmax(spark, sf):
    return rounded(metrics.best(swept(spark, sf, "weighted"), "f"))


@query(SWEEP + "select round(min(sqrt(ru * ru + mi * mi)), 5) as smin from m")
def go_smin(spark, sf):
    return swept(spark, sf, "weighted").agg(F.round(F.min(F.sqrt(F.pow("ru", F.lit(2)) + F.pow("mi", F.lit(2)))), 5).alias("smin"))


@query(SWEEP + "select round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / (p + r), 6) as f from m where abs(t - 0.5) < 1e-9")
def go_fixed(spark, sf):
    return rounded(swept(spark, sf, "plain").where(F.abs(F.col("threshold") - 0.5) < 1e-9).select("precision", "recall", "f"))


@query(SWEEP + "select round(avg(f), 6) as mean_f from (select max(2 * p * r / (p + r)) as f from m union all select max(2 * mp * mr / (mp + mr)) from m union all select max(2 * wp * wr / (wp + wr)) from m)")
def go_cafa_mean(spark, sf):
    """Mean of three best values, as the mean over three ontologies is taken."""
    both = swept(spark, sf, "plain", "weighted")
    plain = both.where("kind = 'plain'")
    each = plain.agg(F.max("f").alias("f")).unionAll(plain.agg(F.max("micro_f"))).unionAll(both.where("kind = 'weighted'").agg(F.max("f")))
    return each.agg(F.round(F.avg("f"), 6).alias("mean_f"))


@query("with x as (select p_partkey as e, (p_partkey * 37 % 101) / 100.0 as s, (p_size > 25)::int as t from part), th as (select i / 100.0 as t, i from (select unnest(range(0, 101)) as i)), m as (select th.t, sum(x.t) as tp, count(*) as n, (select sum(t) from x) as pos from th join x on s >= th.t group by 1) select t::double as threshold, round(2 * tp / (n + pos), 6) as f from m order by round(2 * tp / (n + pos), 12) desc, t limit 1")
def met_fmax(spark, sf):
    """Best pooled F over the grid of 101 thresholds."""
    p = table(spark, sf, "part").select((F.pmod(F.col("p_partkey") * 37, F.lit(101)) / 100.0).alias("s"), (F.col("p_size") > 25).cast("int").alias("t"))
    g = p.groupBy(metrics.bucket(F.col("s")).alias("b")).agg(F.sum("t").alias("p"), F.count("*").alias("n"))
    grid = spark.range(101).select(F.col("id").cast("int").alias("b"))
    down = W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, 0)
    at = grid.join(g, "b", "left").na.fill(0).select("b", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("n"), F.sum("p").over(W.partitionBy()).alias("pos"))
    f = metrics.safe(2 * F.col("tp"), F.col("n") + F.col("pos"))
    return rounded(metrics.best(at.select((F.col("b") / 100).alias("threshold"), f.alias("f")), "f"))


SPL = "with h as (select *, sha256('split:' || doc_id) as h from documents), n as (select count(*) as n from documents) "
SIZES = "case when {n} >= 2 and round_even({n} * 0.1, 0) < 1 then 1 else round_even({n} * 0.1, 0) end as nt, case when {n} >= 10 and round_even({n} * 0.1, 0) < 1 then 1 else round_even({n} * 0.1, 0) end as nv"


@query(SPL + ", s as (select n, " + SIZES.format(n="n") + " from n) select doc_id, case when r <= nt then 'test' when r <= nt + nv then 'val' else 'train' end as split from (select doc_id, row_number() over (order by h) as r from h), s")
def spl_hash(spark, sf):
    return splits.hash_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


STRATA = "with d as (select doc_id, source || '/' || lang as a, lang as b, sha256('split:' || doc_id) as h from documents), x as (select *, count(*) over (partition by a) as na from d), y as (select *, count(*) over (partition by na < 10, b) as nb from x), g as (select *, case when na >= 10 then 'a:' || a when nb >= 10 then 'b:' || b else 'pool' end as g from y), k as (select *, count(*) over (partition by g) as n, row_number() over (partition by g order by h) as r from g), s as (select *, least(case when n >= 2 and round_even(n * 0.1, 0) < 1 then 1 else round_even(n * 0.1, 0) end, greatest(n - 1, 0)) as nt, case when n >= 10 and round_even(n * 0.1, 0) < 1 then 1 else round_even(n * 0.1, 0) end as v from k) "


@query(STRATA + "select doc_id, case when r <= nt then 'test' when r <= nt + least(v, greatest(n - 1 - nt, 0)) then 'val' else 'train' end as split from s")
def spl_stratified(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang").alias("stratum"), "lang")
    return splits.stratified_split(d, "doc_id", "stratum", "lang").select("doc_id", "split")


HOLD = "with c as (select source as class, count(*) as n, sha256('split:holdout:' || source) as h from documents group by 1), o as (select class, coalesce(sum(n) over (order by h rows between unbounded preceding and 1 preceding), 0) as b, sum(n) over () as w from c), held as (select class from o where b < greatest(1, round_even(w * 0.1, 0))) "


@query(HOLD + ", r as (select doc_id, row_number() over (order by sha256('split:' || doc_id)) as r, count(*) over () as n from documents where source not in (select class from held)), s as (select *, round_even(n * (0.1 / (0.8 + 0.1 + 0.0)), 0) as nv from r) select doc_id, case when r <= nv then 'val' else 'train' end as split from s union all select doc_id, 'test' from documents where source in (select class from held)")
def spl_holdout(spark, sf):
    return splits.holdout_split(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", "source").select("doc_id", "split")


@query("select split, count(*) as n from (" + ORACLES["spl_hash"] + ") group by 1")
def ds_split_counts(spark, sf):
    """Counts of the three splits, empty ones included."""
    every = spark.createDataFrame([("train",), ("val",), ("test",)], "split string")
    return every.join(spl_hash(spark, sf).groupBy("split").agg(F.count("*").alias("n")), "split", "left").na.fill(0)


@query("select count(*) as n, count(*) filter (doc_id is null) as null_ids, count(*) filter (coalesce(length(text), 0) = 0) as empty_texts, cast(0 as bigint) as bad_splits, (select count(*) from (select doc_id from documents group by 1 having count(*) > 1)) as repeated_ids from documents")
def ds_validate(spark, sf):
    return splits.validate(table(spark, sf, "documents").withColumn("split", F.lit("train")), "doc_id", "text")


@query("select lang as majority, n from (select lang, count(*) as n from documents group by 1) order by n desc, lang limit 1")
def base_majority(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("majority")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "majority").limit(1)


@query("select token, count(*) as n, round(count(*) / (select count(*) from part), 6) as frequency from (select distinct p_partkey, unnest(string_split(p_name, ' ')) as token from part) group by 1")
def base_frequency(spark, sf):
    p = table(spark, sf, "part")
    n = p.agg(F.count("*").alias("whole"))
    tokens = p.select("p_partkey", F.explode(F.split("p_name", " ")).alias("token")).distinct().groupBy("token").agg(F.count("*").alias("n"))
    return tokens.join(F.broadcast(n), F.lit(True)).select("token", "n", F.round(F.col("n") / F.col("whole"), 6).alias("frequency"))


@query("select p_type, cast(dense_rank() over (order by p_type) - 1 as bigint) as code, count(*) as n from part group by 1")
def enc_labels(spark, sf):
    counts = table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return counts.select("p_type", (F.dense_rank().over(W.orderBy("p_type")) - 1).cast("long").alias("code"), "n")
