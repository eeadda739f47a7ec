"""Queries of dataset adapters, catalog search, batching, alignment and redundancy."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import align, batching
from strandlake.operators import metrics as M
from strandlake.operators import relational as R
from strandlake.operators.order import average_ranks, group_index
from strandlake.plans import vectors
from strandlake.session import table
from strandlake.sources import datasets as D
from strandlake.sources import embeddings as E
from strandlake.sources import text as S
from strandlake.storage import fresh_path, write_bytes

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def put(spark, name, body):
    """A small file in the shared folder."""
    return write_bytes(spark, f"{fresh_path(spark, 'files')}/{name}", body.encode() if isinstance(body, str) else body)


def digits(df):
    """Labels as one text."""
    return df.withColumn("labels", F.array_join(F.col("labels").cast("array<string>"), ""))


def lines(spark, *values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, _position int")


@query("select * from (values ('P1', 'GO:1'), ('P1', 'GO:2'), ('P2', 'GO:1')) as v(entity, term)")
def ann_tsv(spark, sf):
    return S.annotations_tsv(lines(spark, "# head", "P1\tGO:1", "", "P1\tGO:1", "P1\t GO:2 \tx", "short", "P2\tGO:1"))


@query("select * from (values ('1', '1', 'no rank', 'root'), ('2', '1', 'superkingdom', 'Bacteria'), ('9606', '2', 'species', 'Homo sapiens')) as v(tax_id, parent_id, rank, name)")
def src_taxdump(spark, sf):
    nodes = S.taxdump_nodes(lines(spark, "1\t|\t1\t|\tno rank\t|", "2\t|\t1\t|\tsuperkingdom\t|", "9606\t|\t2\t|\tspecies\t|"))
    names = S.taxdump_names(lines(spark, "1\t|\troot\t|\t\t|\tscientific name\t|", "2\t|\teubacteria\t|\t\t|\tgenbank common name\t|", "2\t|\tBacteria\t|\t\t|\tscientific name\t|", "9606\t|\tHomo sapiens\t|\t\t|\tscientific name\t|", "9606\t|\thuman\t|\t\t|\tcommon name\t|"))
    return nodes.join(names, "tax_id").select("tax_id", "parent_id", "rank", "name")


@query("select * from (values ('GO:1', 'root', 'mf', false, null), ('GO:2', 'leaf', 'mf', false, 'GO:1'), ('GO:3', 'old', 'mf', true, null)) as v(term, name, namespace, is_obsolete, parent)")
def src_obo(spark, sf):
    terms, edges = S.obo_terms(lines(spark, "format: 1.2", "\nid: GO:1\nname: root\nnamespace: mf\n", "\nid: GO:2\nname: leaf\nnamespace: mf\nis_a: GO:1 ! root\n", "\nid: GO:3\nname: old\nnamespace: mf\nis_a: GO:1\nis_obsolete: true\n"))
    return terms.join(edges, F.col("term") == F.col("child"), "left").select("term", "name", "namespace", "is_obsolete", "parent")


@query("select * from (values ('sp|P1|A', 'MKVLA'), ('P1', 'MKVLA'), ('x', 'GG')) as v(alias, sequence)")
def src_fasta_alias(spark, sf):
    return S.fasta_aliases(S.fasta_records(lines(spark, "", "sp|P1|A some protein\nMKV\nLA\n", "x\nG G\n")))


@query("with e as (select 'doc' || doc_id as id, doc_id % 7 || '.' || doc_id % 5 || '.' || case when doc_id % 3 = 0 then '-' else cast(doc_id % 3 as varchar) end as ec from documents) select id, string_agg(distinct l, ';' order by l) as level2 from (select id, string_split(ec, '.')[1] || '.' || string_split(ec, '.')[2] as l, string_split(ec, '.')[3] as third from e) where third <> '-' group by 1")
def ec_levels(spark, sf):
    """Level-two prefixes of codes whose first three levels are known."""
    d = F.col("doc_id")
    third = F.when(F.pmod(d, F.lit(3)) == 0, "-").otherwise(F.pmod(d, F.lit(3)).cast("string"))
    codes = table(spark, sf, "documents").select(F.concat(F.lit("doc"), d.cast("string")).alias("id"), F.concat_ws(".", F.pmod(d, F.lit(7)).cast("string"), F.pmod(d, F.lit(5)).cast("string"), third).alias("ec"))
    return ec_level(codes, "id", "ec", 2, 3).select("id", "level2")


def ec_level(df, key, column, level, known):
    """(key, level<N>): distinct prefixes of ';'-joined codes with `known` full levels."""
    codes = df.select(key, F.explode(F.split(column, ";")).alias("c")).select(key, F.split(F.trim("c"), r"\.").alias("p"))
    full = codes.where((F.size("p") >= known) & ~F.exists(F.slice("p", 1, known), lambda x: x.isin("", "-")))
    return full.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.array_join(F.slice("p", 1, level), "."))), ";").alias(f"level{level}"))


@query("select l_orderkey as query, arg_max(l_partkey, l_quantity * 1e12 + l_extendedprice * 1e4 - l_linenumber) as target from lineitem group by 1")
def red_best_hit(spark, sf):
    hits = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("target"), F.col("l_quantity").alias("bits"), F.col("l_extendedprice").alias("pident"), F.col("l_linenumber").alias("position"))
    return align.best_hits(hits).select("query", "target")


@query("select doc_id as id from documents where doc_id % 10 <> 0 and doc_id % 4 = 1 and (doc_id // 10 * 10) in (select doc_id from documents)")
def red_filter(spark, sf):
    """Documents outside the test split with a close hit in it."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.pmod("doc_id", F.lit(10)) == 0, "test").otherwise("train").alias("split"))
    hits = d.select(F.col("id").alias("query"), (F.floor(F.col("id") / 10) * 10).alias("target"), F.when(F.pmod("id", F.lit(4)) == 1, 45.0).otherwise(20.0).alias("pident"), F.lit(0.9).alias("qcov"), F.lit(0.85).alias("tcov"))
    return align.redundant(d, hits)


@query("select l_partkey, count(*) filter (l_quantity < 10) as htp, count(*) filter (l_quantity between 10 and 30) as ltp, count(*) filter (l_quantity > 30) as other from lineitem group by 1")
def ds_evidence_counts(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_if(q < 10).alias("htp"), F.count_if(q.between(10, 30)).alias("ltp"), F.count_if(q > 30).alias("other"))


@query("select o_orderkey as id, string_agg(case when pos in (select l_linenumber from lineitem where l_orderkey = o_orderkey) then '1' else '0' end, '' order by pos) as labels from orders, (select unnest(range(1, 8)) as pos) group by 1")
def ds_interval_labels(spark, sf):
    """Seven positions per order, 1 where a line covers them."""
    painted = R.paint_intervals(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("s")), ["id"], "s", "s").groupBy("id").agg(F.collect_set("pos").alias("on"))
    every = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).join(painted, "id", "left")
    return every.select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.when(F.array_contains("on", i), "1").otherwise("0")), "").alias("labels"))


@query("select * from (values ('a', '1;0;1'), ('b', '1;0'), ('c', '1;1;0'), ('d', '0;1')) as v(id, labels)")
def ds_label_parse(spark, sf):
    raw = rows(spark, "id string, raw string", ("a", "[1, 0, 1]"), ("b", "1,0"), ("c", "110"), ("d", " 0 1 "))
    return raw.select("id", F.array_join(D.parse_labels(F.col("raw")), ";").alias("labels"))


@query("select lang || case when r = 1 then '' else '__dup' || (r - 1) end as id, doc_id from (select doc_id, lang, row_number() over (partition by lang order by doc_id) as r from documents)")
def ds_dup_ids(spark, sf):
    d = group_index(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", name="_at").withColumn("r", F.col("_at") + 1)
    return d.select(F.concat("lang", F.when(F.col("r") == 1, "").otherwise(F.concat(F.lit("__dup"), (F.col("r") - 1).cast("string")))).alias("id"), "doc_id")


@query("select * from (values ('train', 'AC', 1.5), ('val', 'CC', null), ('test', 'DD', -2.0)) as v(split, sequence, target)")
def ds_flip(spark, sf):
    """A file of the format's shape, read from the shared folder; so are those of the next queries."""
    path = put(spark, "flip.csv", "sequence,target,set,validation\nAC,1.5,train,False\nCC,nan,train,True\nDD,-2,test,\n")
    return D.read_flip(spark, path).select("split", "sequence", "target")


@query("select * from (values ('a', 'MSTY', '0100'), ('b', 'KK', '01')) as v(id, sequence, labels)")
def ds_marked(spark, sf):
    """'#' marks the residue before it."""
    return digits(D.read_marked(spark, put(spark, "marked.fasta", ">a\nMS#TY\n>b\nKK#\n"))).select("id", "sequence", "labels")


@query("select * from (values ('1abA', '2;5'), ('2cdB', '11')) as v(id, sites)")
def ds_biolip(spark, sf):
    """Binding positions of ligands that are no nucleic acids or peptides."""
    line = lambda pdb, chain, ligand, at, seq: "\t".join([pdb, chain, "x", "x", ligand, "x", "x", "x", at, *["x"] * 11, seq])
    body = "\n".join([line("1ab", "A", "ZN", "A2 C5", "MAKVC"), line("2cd", "B", "CA", "K11", "MKVLAMKVLAK"), line("3ef", "A", "dna", "K3", "MMK")])
    found = D.read_biolip(spark, put(spark, "biolip.txt", body + "\n"), "other")
    at = F.filter(F.transform("labels", lambda x, i: F.when(x == 1, i + 1)), lambda x: x.isNotNull())
    return found.select("id", F.array_join(at.cast("array<string>"), ";").alias("sites"))


@query("select * from (values ('a', 3, 0.3, '30-60%'), ('b', 8, 0.8, '60-100%'), ('c', 1, 0.05, '0-10%')) as v(id, n, frac, bin)")
def ds_disprot(spark, sf):
    entry = lambda name, n, *spans: '{"disprot_id":"%s","sequence":"%s","regions":[%s]}' % (name, "M" * n, ",".join('{"start":%d,"end":%d}' % x for x in spans))  # noqa: E731, UP031
    body = '{"entries":[' + ",".join([entry("a", 10, (1, 2), (2, 3)), entry("b", 10, (3, 10)), entry("c", 20, (7, 7))]) + "]}"
    found = D.read_disprot_json(spark, put(spark, "disprot.json", body))
    return found.select("id", F.aggregate("labels", F.lit(0), lambda a, x: a + x).alias("n"), F.round("disorder_fraction", 6).alias("frac"), F.col("disorder_bin").alias("bin"))


@query("select * from (values ('Q1', 'S+T', '0110', 1), ('Q2', 'Y', '01', 0)) as v(id, strata, labels, htp)")
def ds_phospho(spark, sf):
    head = "acc\tsequence\tposition\tcode\tsource\n"
    path = put(spark, "phospho.tsv", head + "Q1\tMSTY\t2\tS\tHTP\nQ1\tMSTY\t3\tT\tLTP\nQ2\tAY\t2\tY\tother\n")
    return digits(D.read_phospho(spark, path)).select("id", F.col("stratum").alias("strata"), "labels", F.col("htp").cast("int").alias("htp"))


@query("select * from (values ('A', 'MK', 'GO:1;GO:2')) as v(id, sequence, terms)")
def ds_cafa(spark, sf):
    fasta = put(spark, "train.fasta", ">A\nMK\n>B\nGG\n")
    terms = put(spark, "terms.tsv", "EntryID\tterm\taspect\nA\tGO:2\tF\nA\tGO:1\tMFO\nA\tGO:9\tP\nC\tGO:1\tF\n")
    return D.read_cafa(spark, fasta, terms, "mf").select("id", "sequence", F.array_join("terms", ";").alias("terms"))


@query("select doc_id as id, case when doc_id % 9 = 0 then 'test' else 'train' end as split from documents where doc_id % 9 = 0 or doc_id not in (select doc_id from documents where doc_id % 9 = 0)")
def ds_cafa_subset(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return D.released_subset(d, d.where(F.pmod("id", F.lit(9)) == 0))


@query("select * from (values ('x', '1.1.1.1', '1.1')) as v(id, label, level2)")
def ds_ec(spark, sf):
    body = '{"id":"x","labels_exact":["1.1.1.1"],"metadata":{"ec_level2":"1.1"}}\n{"id":"y","labels_exact":["1.1.1.1","2.1.1.1"]}\n'
    r = D.read_term_jsonl(spark, put(spark, "ec.jsonl", body), "labels_exact", single=True)
    return r.select("id", F.get("labels", F.lit(0)).alias("label"), F.element_at("metadata", "ec_level2").alias("level2"))


@query("select * from (values ('x', 'GO:1;GO:2')) as v(id, labels)")
def ds_go(spark, sf):
    body = '{"id":"x","labels_asserted":["GO:2"," GO:1","GO:2"]}\n\n'
    return D.read_term_jsonl(spark, put(spark, "go.jsonl", body)).select("id", F.array_join("labels", ";").alias("labels"))


@query("select o_orderkey as id, string_agg(case when pos in (select l_linenumber from lineitem where l_orderkey = o_orderkey) then '1' else '0' end, '' order by pos) as labels from orders, (select unnest(range(1, 8)) as pos) where o_orderkey in (select l_orderkey from lineitem) group by 1")
def ds_intervals(spark, sf):
    """Labels of whole tables' intervals: a sequence of seven positions per order, one interval per line."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("MKVLAMK").alias("sequence"), F.col("l_linenumber").alias("start"), F.col("l_linenumber").alias("end"))
    return digits(D.interval_labels(lines)).select("id", "labels")


@query("select * from (values ('Site_neg:x', 'AAKAA', '00000'), ('Site_pos:x', 'AASAA', '00100'), ('Site_pos:x__dup2', 'CCSCC', '00100')) as v(id, sequence, labels)")
def ds_windows(spark, sf):
    """Site windows of an archive's members."""
    import io
    import tarfile

    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as archive:
        for name, body in (("Site_pos.fasta", b">x\nAASAA\n>x\nCCSCC\n"), ("Site_neg.fasta", b">x\nAAKAA\n")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            archive.addfile(info, io.BytesIO(body))
    return digits(D.read_site_windows(spark, put(spark, "windows.tar.gz", raw.getvalue()))).select("id", "sequence", "labels")


@query("select * from (values ('GO:1', 0.75), ('GO:2', 1.25)) as v(term, weight)")
def ds_weights(spark, sf):
    return D.read_weights(spark, put(spark, "weights.tsv", "# head\nGO:1\t0.5\n\nGO:2,1.25\nGO:1 0.75\n"))


@query("select 'F' || c_custkey as id, upper(regexp_replace(c_name, '[^A-Za-z]', '', 'g')) as sequence from customer")
def src_fasta(spark, sf):
    """A FASTA file of all customers, written by Spark and read again."""
    c = table(spark, sf, "customer").select(F.concat(F.lit(">F"), F.col("c_custkey").cast("string"), F.lit(" -> x\n"), F.upper(F.regexp_replace("c_name", "[^A-Za-z]", ""))).alias("value"))
    path = fresh_path(spark, "fasta")
    c.write.text(path)
    return S.read_fasta(spark, path).select("id", "sequence")


@query("select c_custkey as id, c_name as name from customer")
def src_csv(spark, sf):
    """A table of all customers with a header, written by Spark and read again."""
    path = fresh_path(spark, "csv")
    table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).write.option("header", True).option("sep", "\t").csv(path)
    return S.read_table(spark, path, "id long, name string", ["id", "name"])


@query("select event_id, event_type, user_id from events")
def src_jsonl(spark, sf):
    """JSON lines of all events, written by Spark and read again."""
    path = fresh_path(spark, "jsonl")
    table(spark, sf, "events").select("event_id", "event_type", "user_id").write.json(path)
    return S.read_jsonl(spark, path, "event_id long, event_type string, user_id long")


@query("select vec_id as id, round(embedding[1]::double, 6) as first, len(embedding) as dim from embeddings")
def src_arrays(spark, sf):
    """All stored vectors as npz shards and read again."""
    path = fresh_path(spark, "shards")
    E.write_shards(vectors.vectors(spark, sf).select("id", "vector"), path, 5000)
    return E.read_arrays(spark, path).select(F.col("id").cast("long").alias("id"), F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"), F.size("vector").cast("long").alias("dim"))


CATALOG = (("flip_gb1", "Protein GB1 fitness", "protein", "regression", "fitness flip", True), ("go_mf", "Gene ontology molecular function", "protein", "multilabel", "function go", True), ("disorder", "Residue disorder", "residue", "binary", "disorder", False))
CATALOG_SQL = "(values " + ", ".join(f"('{a}', '{b}', '{c}', '{d}', '{e}', {str(f).lower()})" for a, b, c, d, e, f in CATALOG) + ") as v(id, title, level, objective, tags, has_loader)"


def catalog(spark):
    return rows(spark, "id string, title string, level string, objective string, tags string, has_loader boolean", *CATALOG)


@query(f"select id, title from {CATALOG_SQL} where lower(level) = 'protein' and has_loader and list_contains(string_split(tags, ' '), 'go')")
def cat_filter(spark, sf):
    return catalog(spark).where((F.lower("level") == "protein") & F.col("has_loader") & F.array_contains(F.split("tags", " "), "go")).select("id", "title")


@query(f"select id, cast(sum(case when id = t then 20 when contains(id, t) then 8 else 0 end + case when contains(lower(title), t) then 4 else 0 end + case when contains(tags, t) then 2 else 0 end) as bigint) as score from {CATALOG_SQL}, (values ('go_mf'), ('function')) as q(t) group by 1 having score > 0")
def cat_search(spark, sf):
    tokens = F.explode(F.split(F.lower(F.replace(F.lit("GO-mf function"), F.lit("-"), F.lit("_"))), r"\s+")).alias("t")
    has = lambda c: F.lower(c).contains(F.col("t"))
    score = F.when(F.col("id") == F.col("t"), 20).when(has("id"), 8).otherwise(0) + F.when(has("title"), 4).otherwise(0) + F.when(has("tags"), 2).otherwise(0)
    return catalog(spark).select("*", tokens).groupBy("id").agg(F.sum(score).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(20)


@query("select name, name in ('customer', 'part') as present from (values ('customer'), ('part'), ('missing')) as v(name)")
def cat_health(spark, sf):
    """Which required tables are there."""
    for name in ("customer", "part"):
        table(spark, sf, name).createOrReplaceTempView(name)
    have = {t.name for t in spark.catalog.listTables()}
    return rows(spark, "name string, present boolean", *((n, n in have) for n in ("customer", "part", "missing")))


@query("select doc_id, w as \"window\", row_number() over (partition by w order by length(text) desc, doc_id) - 1 as position from (select doc_id, coalesce(text, '') as text, (row_number() over (order by doc_id) - 1) // 64 as w from documents)")
def bat_length_window(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return batching.length_windows(d, "doc_id", "text", 64).select("doc_id", "window", "position")


@query("select doc_id as id, length(text) as length, 'length>4096' as reason from documents where length(text) > 4096")
def bat_skipped(spark, sf):
    _, skipped = batching.split_by_length(table(spark, sf, "documents"), "text", 4096)
    return skipped.select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("length"), "reason")


@query()
def bat_token_budget(spark, sf):
    """Sequential packing; tests compare with a plain loop."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return batching.token_budget(batching.length_windows(d, "doc_id", "text", 64), "text", 16384, 16).select("doc_id", "window", "position", "batch")


def name_pairs(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.upper(F.regexp_replace("p_name", "[^A-Za-z]", "")).alias("s"))
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("s").alias("b")), "p_partkey").select(F.col("p_partkey").alias("id"), F.col("s").alias("a"), "b")


@query()
def aln_pairs(spark, sf):
    """Local alignments of neighbouring part names; tests hold the scores against a plain recursion."""
    return align.align_pairs(name_pairs(spark, sf))


@query()
def aln_stats(spark, sf):
    """Statistics of global alignments; co-optimal tracebacks have no SQL form."""
    a = align.align_pairs(name_pairs(spark, sf), mode="global")
    return a.agg(F.count("*").alias("n"), F.round(F.avg("identity"), 6).alias("identity"), F.round(F.avg("positives"), 6).alias("positives"), F.sum("gaps").alias("gaps"))


@query(vectors.ALL + ", x as (select distance, abs(query_label - label) as g from d), r as (select rank() over (order by distance) + (count(*) over (partition by distance) - 1) / 2 as a, rank() over (order by g) + (count(*) over (partition by g) - 1) / 2 as b from (select round(distance, 9) as distance, g from x)) select round(corr(a, b), 5) as spearman from r")
def cmp_audit(spark, sf):
    """Do near vectors have near labels: Spearman's rho of distance and label gap over all pairs."""
    from strandlake.operators import correlate, knn

    v = vectors.vectors(spark, sf)
    if correlate.regular(v):
        return rows(spark, "spearman double", (correlate.label_gap_rho(v),))
    # Rows without a label, or with the id of others: every pair is ranked.
    d = knn.within(v.select(F.col("id").alias("query_id"), "vector"), v, 2.0).where("query_id <> id")
    joined = d.join(v.select(F.col("id").alias("query_id"), F.col("label").alias("q")), "query_id").join(v.select("id", "label"), "id")
    pairs = joined.select(F.round("distance", 9).alias("distance"), F.abs(F.col("q") - F.col("label")).alias("g"))
    return average_ranks(average_ranks(pairs, "distance", "a"), "g", "b").agg(F.round(F.corr("a", "b"), 5).alias("spearman"))


@query("with c as (select label, i, avg(embedding[i]::double) as m from (select label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by 1, 2), v as (select label, list(m order by i) as m from c group by 1) select a.label as a, b.label as b, round(1 - list_cosine_similarity(a.m, b.m), 6) as distance from v a join v b on a.label < b.label")
def cmp_centroids(spark, sf):
    """Distances between the labels' mean vectors."""
    from strandlake.functions import vec

    long = vectors.vectors(spark, sf).select("label", F.posexplode(vec.as_double("vector")).alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m"))
    means = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("m"))
    a, b = means.select(F.col("label").alias("a"), F.col("m").alias("x")), means.select(F.col("label").alias("b"), F.col("m").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(vec.cosine(F.col("x"), F.col("y")), 6).alias("distance"))


@query()
def spl_subclass(spark, sf):
    """Held-out subclasses: a greedy choice over the small table of (parent, child) counts; tests hold its invariants."""
    from strandlake.operators import splits

    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("parent"), F.concat_ws("/", "p_brand", "p_type").alias("child"))
    return splits.subclass_holdout(p)


@query()
def prb_linear(spark, sf):
    """Logistic probe on standardised vectors; an iterative fit, held against accuracy in tests."""
    from strandlake.operators import linear

    return linear.classify(split_vectors(spark, sf), "logistic").select("id", "label", "prediction")


@query()
def prb_mlp(spark, sf):
    """One hidden layer on standardised vectors; an iterative fit."""
    from strandlake.operators import linear

    return linear.classify(split_vectors(spark, sf), "mlp", hidden=32).select("id", "label", "prediction")


@query()
def prb_regression(spark, sf):
    """Least squares on standardised vectors; an iterative fit."""
    from strandlake.operators import linear

    return linear.regress(split_vectors(spark, sf)).select("id", "label", "prediction")


@query()
def prb_residue(spark, sf):
    """Per-position labels flattened to rows id:position before the fit; masked positions drop out."""
    from strandlake.operators import linear

    v = vectors.vectors(spark, sf).select("id", F.array(*(F.slice("vector", 1 + 8 * i, 8) for i in range(8))).alias("matrix"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.get("vector", i * 8) > 0).cast("int")).alias("labels"))
    flat = linear.flatten(v.withColumn("mask", F.transform("labels", lambda _, i: i < 6)))
    with_split = flat.withColumn("split", F.when(F.substring(F.sha2("id", 256), 1, 1) < "4", "test").otherwise("train"))
    return linear.classify(with_split, "logistic").select("id", "label", "prediction")


@query()
def tsk_run(spark, sf):
    """A task end to end: split, probe, metrics."""
    done = prb_linear(spark, sf)
    return M.multiclass(done, "label", "prediction", done.select(F.col("label").alias("class")).distinct())


def split_vectors(spark, sf):
    v = vectors.vectors(spark, sf)
    return v.select("id", "vector", "label", F.when(F.substring(F.sha2(F.concat(F.lit("probe:"), F.col("id").cast("string")), 256), 1, 1) < "4", "test").otherwise("train").alias("split"))
