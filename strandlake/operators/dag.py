"""Ontology DAGs: terms(term, namespace) and edges(child, parent)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.storage import materialize

#: Rows of a task before the ancestors of its entities are unfolded.
ENTITY_ROWS = 400_000
RELATIONS = ("same", "parent", "child", "ancestor", "descendant", "non-related")


def closure(terms: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(term, ancestor, dist) of all ancestors and the term itself, with the least number of edges.

    Breadth first: a round extends only the pairs that the last round found, by
    one edge, and drops those known before, so a pair is made once per way up to
    its least distance and a DAG's many paths never multiply. Pairs whose ancestor
    has no parents, the root's above all, take no part in the next join. Each
    round's pairs are written. A cycle, which no ontology has, raises.
    """
    up = materialize(edges.select("child", "parent").where("child is not null and parent is not null").distinct(), "dag-edges")
    inner = up.select(F.col("child").alias("parent")).distinct().withColumn("more", F.lit(True))
    step = materialize(up.join(inner, "parent", "left").select("child", "parent", F.coalesce("more", F.lit(False)).alias("more")), "dag-steps")
    known = terms.select("term").unionAll(up.select("child")).unionAll(up.select("parent")).distinct()
    rounds = [materialize(known.select("term", F.col("term").alias("ancestor"), F.lit(0).alias("dist")), "dag-closure")]
    fresh = step.select(F.col("child").alias("term"), F.col("parent").alias("ancestor"), "more")
    for dist in range(1, max_rounds + 1):
        fresh = materialize(fresh, "dag-closure")
        state = fresh.agg(F.count("*"), F.count_if(F.col("term") == F.col("ancestor"))).first()
        if state[1]:
            raise RuntimeError("the closure does not settle: the edges are cyclic")
        if not state[0]:
            break
        rounds.append(fresh.select("term", "ancestor", F.lit(dist).alias("dist")))
        wider = fresh.where("more").select("term", F.col("ancestor").alias("child")).join(step, "child").select("term", F.col("parent").alias("ancestor"), "more").distinct()
        before = rounds[0]
        for earlier in rounds[1:]:
            before = before.unionAll(earlier)
        # A pair stays at its least distance; one that ends where it began has found a cycle.
        fresh = wider.join(before.where("dist > 0").select("term", "ancestor"), ["term", "ancestor"], "left_anti")
    else:
        raise RuntimeError("the closure did not settle; are the edges cyclic?")
    out = rounds[0]
    for part in rounds[1:]:
        out = out.unionAll(part)
    return out


def relation(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """Pairs (a, b) with the closest relation of a to b and its rank; "parent" means that a is a parent of b."""
    up = closed.select(F.col("term").alias("b"), F.col("ancestor").alias("a"), F.col("dist").alias("above"))
    down = closed.select(F.col("term").alias("a"), F.col("ancestor").alias("b"), F.col("dist").alias("below"))
    joined = pairs.join(up, ["a", "b"], "left").join(down, ["a", "b"], "left")
    rank = F.when(F.col("a") == F.col("b"), 0).when(F.col("above") == 1, 1).when(F.col("below") == 1, 2).when(F.col("above").isNotNull(), 3).when(F.col("below").isNotNull(), 4).otherwise(5)
    ranked = joined.withColumn("rank", rank)
    return ranked.withColumn("relation", F.get(F.array(*(F.lit(r) for r in RELATIONS)), F.col("rank"))).drop("above", "below")


def predicates(pairs: DataFrame, closed: DataFrame, include_self: bool = False) -> DataFrame:
    """Pairs (a, b) with is_parent, is_child, is_ancestor and is_descendant, whether a is that of b, and same_path, whether one is on the other's path.

    A term is its own ancestor and descendant only with include_self, and always
    on its own path. Terms that the ontology lacks raise when rows are computed.
    """
    known = lambda end: closed.where("dist = 0").select(F.col("term").alias(end), F.lit(True).alias(f"_{end}"))
    told = relation(pairs, closed).join(known("a"), "a", "left").join(known("b"), "b", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown term in the pair "), F.coalesce("a", F.lit("null")), F.lit(", "), F.coalesce("b", F.lit("null"))))
    rank = F.when(F.col("_a").isNull() | F.col("_b").isNull(), unknown.cast("int")).otherwise(F.col("rank"))
    own = (F.col("rank") == 0) & F.lit(include_self)
    flags = {"is_parent": F.col("rank") == 1, "is_child": F.col("rank") == 2, "is_ancestor": F.col("rank").isin(1, 3) | own, "is_descendant": F.col("rank").isin(2, 4) | own, "same_path": F.col("rank") < 5}
    return told.withColumn("rank", rank).select("a", "b", *(flag.alias(name) for name, flag in flags.items()))


def best_relation(related: DataFrame) -> DataFrame:
    """Per term a: its closest relation to a group of terms b, and all b at it, sorted."""
    least = related.groupBy("a").agg(F.min("rank").alias("rank"))
    return related.join(least, ["a", "rank"]).groupBy("a", "relation").agg(F.array_join(F.array_sort(F.collect_set("b")), ";").alias("matches"))


def ancestry(closed: DataFrame, roots: list[str] = (), weights: DataFrame | None = None) -> DataFrame:
    """(term, up): each term's ancestors and itself without roots, as structs (term, w); w is the weight (term, weight), 0 for terms without, 1 if there are none."""
    up = closed.where(~F.col("ancestor").isin(list(roots))) if roots else closed
    if weights is None:
        return up.groupBy("term").agg(F.collect_list(F.struct(F.col("ancestor").alias("term"))).alias("up"))
    rated = up.join(weights.select(F.col("term").alias("ancestor"), "weight"), "ancestor", "left")
    return rated.groupBy("term").agg(F.collect_list(F.struct(F.col("ancestor").alias("term"), F.coalesce("weight", F.lit(0.0)).alias("w"))).alias("up"))


def _by_entity(rows: DataFrame, n: int) -> DataFrame:
    """Rows (entity, up, ...) dealt by entity before their ancestors are unfolded: these never pass a shuffle, and tasks stay of one size as rows grow."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(min(max(least, -(-n // ENTITY_ROWS)), 1 << 15), "entity")
    return dealt.withColumn("_up", F.explode("up")).drop("up").select("*", "_up.*").drop("_up")


def term_counts(annotations: DataFrame, closed: DataFrame) -> DataFrame:
    """(term, n): entities annotated with a term or its descendants; annotations: (entity, term), unknown terms drop out."""
    held = annotations.join(ancestry(closed), "term").select("entity", "up")
    return _by_entity(held, annotations.count()).distinct().groupBy("term").agg(F.count("*").alias("n"))


def information(counts: DataFrame, root: str) -> DataFrame:
    """(term, ic): -ln of a term's share of the root's count; counts that lack the root raise, no counts give no rows."""
    absent = F.raise_error(F.lit(f"no count of the root {root}")).cast("long")
    top = counts.agg(F.count("*").alias("terms"), F.max(F.when(F.col("term") == root, F.col("n"))).alias("n"))
    top = top.select(F.when(F.col("terms") > 0, F.coalesce("n", absent)).alias("top"))
    return counts.join(F.broadcast(top), F.lit(True)).select("term", F.abs(-F.log(F.col("n") / F.col("top"))).alias("ic"))  # one row


def similarity(pairs: DataFrame, closed: DataFrame, ic: DataFrame) -> DataFrame:
    """Pairs (a, b) with resnik, lin and schlicker by the most informative common ancestor; 0 where none is."""
    rated = closed.join(ic.withColumnRenamed("term", "ancestor"), "ancestor").select("term", "ancestor", "ic")
    both = pairs.join(rated.select(F.col("term").alias("a"), "ancestor", "ic"), "a").join(rated.select(F.col("term").alias("b"), "ancestor"), ["b", "ancestor"])
    best = both.groupBy("a", "b").agg(F.max("ic").alias("resnik"))
    own = lambda name: ic.select(F.col("term").alias(name), F.col("ic").alias(f"ic_{name}"))
    joined = pairs.join(best, ["a", "b"], "left").join(own("a"), "a", "left").join(own("b"), "b", "left").na.fill(0.0, ["resnik", "ic_a", "ic_b"])
    whole = F.col("ic_a") + F.col("ic_b")
    lin = F.when(whole == 0, 0.0).otherwise(2 * F.col("resnik") / whole)
    return joined.select("a", "b", "resnik", lin.alias("lin"), (lin * (1 - F.exp(-F.col("resnik")))).alias("schlicker"))


def best_match_average(groups: DataFrame, scores: DataFrame, name: str = "lin") -> DataFrame:
    """Per pair of groups: the mean of row maxima and of column maxima, averaged. groups: (g, side a or b, term)."""
    left, right = groups.where("side = 'a'").select("g", F.col("term").alias("a")), groups.where("side = 'b'").select("g", F.col("term").alias("b"))
    s = left.join(right, "g").join(scores, ["a", "b"]).select("g", "a", "b", F.col(name).alias("s"))
    rows = s.groupBy("g", "a").agg(F.max("s").alias("m")).groupBy("g").agg(F.avg("m").alias("rows"))
    columns = s.groupBy("g", "b").agg(F.max("s").alias("m")).groupBy("g").agg(F.avg("m").alias("columns"))
    return rows.join(columns, "g").select("g", ((F.col("rows") + F.col("columns")) / 2).alias("bma"))


def propagate_labels(labels: DataFrame, closed: DataFrame, roots: list[str]) -> DataFrame:
    """(entity, term): labels and their ancestors without roots."""
    return _by_entity(labels.join(ancestry(closed, roots), "term").select("entity", "up"), labels.count()).distinct()


def propagate_scores(scores: DataFrame, closed: DataFrame, roots: list[str]) -> DataFrame:
    """(entity, term, score): an ancestor's score is the largest of its descendants'."""
    held = scores.join(ancestry(closed, roots), "term").select("entity", "score", "up")
    return _by_entity(held, scores.count()).groupBy("entity", "term").agg(F.max("score").alias("score"))


def propagate_marks(labels: DataFrame, scores: DataFrame, closed: DataFrame, roots: list[str], weights: DataFrame | None = None) -> DataFrame:
    """(entity, term, t, score, w) as metrics.marks() gives for propagated labels and scores, from one shuffle of the rows as they were before."""
    up = ancestry(closed, roots, weights)
    rows = labels.select("entity", "term", F.lit(1).alias("t"), F.lit(None).cast("double").alias("score")).unionAll(scores.select("entity", "term", F.lit(0), "score"))
    held = rows.join(up, "term").select("entity", "t", "score", "up")
    unfolded = _by_entity(held, labels.count() + scores.count())
    w = F.lit(1.0) if weights is None else F.first("w")
    return unfolded.groupBy("entity", "term").agg(F.max("t").alias("t"), F.max("score").alias("score"), w.alias("w"))
