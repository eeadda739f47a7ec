"""Evaluation metrics as aggregate plans: regression, binary, multiclass, multilabel, hierarchical sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators.order import average_ranks, running_sum
from strandlake.storage import materialize


def safe(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or nothing is there."""
    return F.when(F.coalesce(b, F.lit(0)) == 0, F.lit(0.0)).otherwise(a / b)


def regression(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """mae, rmse, r2 (0 without variance) and Spearman's rho (0 for constants)."""
    e = F.col(truth) - F.col(prediction)
    r = average_ranks(average_ranks(df.select(truth, prediction), truth, "_rt"), prediction, "_rp")
    spread = F.var_pop(truth) * F.count("*")
    constant = (F.coalesce(F.var_pop("_rt"), F.lit(0.0)) == 0) | (F.coalesce(F.var_pop("_rp"), F.lit(0.0)) == 0)
    return r.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(spread == 0, 0.0).otherwise(1 - F.sum(e * e) / spread).alias("r2"), F.when(constant, 0.0).otherwise(F.corr("_rt", "_rp")).alias("spearmanr"))


def binary_counts(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """tp, tn, fp, fn; other values than 1 are negative."""
    t, p = F.col(truth) == 1, F.col(prediction) == 1
    return df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))


def binary(counts: DataFrame) -> DataFrame:
    """Metrics of a confusion; empty denominators give 0."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    f1 = safe(2 * tp, 2 * tp + fp + fn)
    g1 = safe(2 * tn, 2 * tn + fp + fn)
    root = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.select(
        safe(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        safe(tp, tp + fp).alias("precision"),
        safe(tp, tp + fn).alias("recall"),
        f1.alias("f1"),
        ((f1 + g1) / 2).alias("macro_f1"),
        ((safe(tp, tp + fn) + safe(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        safe(tp.cast("double") * tn - fp.cast("double") * fn, root).alias("mcc"),
    )


def curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Per distinct score, the highest first: cumulative tp and fp. Scores are grouped before the window."""
    g = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) != 1).alias("q"))
    tp = running_sum(g, "p", -F.col("threshold"), name="tp")
    both = running_sum(tp, "q", -F.col("threshold"), name="fp")
    return both.select("threshold", "p", "q", (F.col("tp") + F.col("p")).alias("tp"), (F.col("fp") + F.col("q")).alias("fp"))


def auroc_auprc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Rank-sum AUROC with tied ranks averaged (0 for one class) and step average precision by tied score (0 without positives)."""
    c = curve(df, truth, score)
    pairs = F.sum((F.col("tp") - F.col("p")) * F.col("q") + F.col("p") * F.col("q") / 2)
    steps = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return c.agg(safe(pairs, F.sum("p").cast("double") * F.sum("q")).alias("auroc"), safe(steps, F.sum("p")).alias("auprc"))


def multiclass(df: DataFrame, truth: str, prediction: str, classes: DataFrame) -> DataFrame:
    """accuracy, macro F1 over all classes, F1 weighted by support. classes: (class)."""
    rows = df.select(F.col(truth).alias("t"), F.col(prediction).alias("p"))
    cells = rows.groupBy("t", "p").count()
    long = cells.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.col("count").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("t") == F.col("p"), F.col("count")).otherwise(0).alias("tp")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("count").alias("predicted"), F.lit(0).cast("long").alias("tp")))).alias("x")).select("x.*")
    per = classes.join(long.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("support", "predicted", "tp"))), "class", "left").na.fill(0)
    f1 = safe(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    return per.agg(safe(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg(f1).alias("macro_f1"), safe(F.sum(f1 * F.col("support")), F.sum("support")).alias("weighted_f1"))


def multilabel(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Micro and macro F1, precision and recall of (entity, term) sets; classes are those of either side."""
    marked = truth.distinct().withColumn("t", F.lit(1)).join(predicted.distinct().withColumn("p", F.lit(1)), ["entity", "term"], "full_outer").na.fill(0, ["t", "p"])
    per = marked.groupBy("term").agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum("t").alias("support"), F.sum("p").alias("predicted"))
    f1 = safe(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    return per.agg(
        safe(F.sum("tp"), F.sum("predicted")).alias("micro_precision"),
        safe(F.sum("tp"), F.sum("support")).alias("micro_recall"),
        safe(2 * F.sum("tp"), F.sum("support") + F.sum("predicted")).alias("micro_f1"),
        F.avg(f1).alias("macro_f1"),
        safe(F.sum(f1 * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def exact_match(truth: DataFrame, predicted: DataFrame, entities: DataFrame) -> DataFrame:
    """(exact_match): the share of entities (entity) whose predicted terms are exactly the true ones."""
    marked = truth.distinct().withColumn("t", F.lit(1)).join(predicted.distinct().withColumn("p", F.lit(1)), ["entity", "term"], "full_outer")
    wrong = marked.where("t is null or p is null").select("entity").distinct().withColumn("wrong", F.lit(1))
    return entities.distinct().join(wrong, "entity", "left").agg(safe(F.count_if(F.col("wrong").isNull()), F.count("*")).alias("exact_match"))


def average_precision(truth: DataFrame, scores: DataFrame, classes: DataFrame) -> DataFrame:
    """(average_precision): the mean over classes (term) of the step average precision; a class without positives counts 0.

    scores (entity, term, score); pairs without a score have 0. Tied scores are one
    step. Scores are counted per class before the running sums, which run over
    ranges of (class, score).
    """
    joined = scores.join(truth.distinct().withColumn("t", F.lit(1)), ["entity", "term"], "full_outer").select("term", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("t", F.lit(0)).alias("t"))
    steps = joined.groupBy("term", "score").agg(F.sum("t").alias("p"), F.count("*").alias("n"))
    summed = running_sum(running_sum(steps, "p", "term", -F.col("score"), name="bp"), "n", "term", -F.col("score"), name="bn")
    firsts = summed.groupBy("term").agg(F.min("bp").alias("fp"), F.min("bn").alias("fn"), F.sum("p").alias("whole"))
    tp, n = F.col("bp") - F.col("fp") + F.col("p"), F.col("bn") - F.col("fn") + F.col("n")
    per = summed.join(firsts, "term").groupBy("term").agg(F.sum(F.col("p") * tp / n).alias("s"), F.first("whole").alias("whole"))
    return classes.distinct().join(per, "term", "left").agg(F.avg(safe(F.col("s"), F.col("whole"))).alias("average_precision"))


def bucket(score: Column, points: int = 101) -> Column:
    """The number of grid points i/(points-1) at or under a score, less one: the last threshold that predicts it."""
    guess = F.floor(score * (points - 1)).cast("int")
    up = F.when((guess + 1).cast("double") / (points - 1) <= score, guess + 1).otherwise(guess)
    down = F.when(up.cast("double") / (points - 1) > score, up - 1).otherwise(up)
    return F.least(down, F.lit(points - 1))


def marks(truth: DataFrame, scores: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(entity, term, t, score, w): a row per pair that is true (t = 1) or has a score, with the term's weight (term, weight), 0 for terms without, 1 if there are none."""
    rows = truth.select("entity", "term", F.lit(1).alias("t"), F.lit(None).cast("double").alias("score")).unionAll(scores.select("entity", "term", F.lit(0), "score"))
    marked = rows.groupBy("entity", "term").agg(F.max("t").alias("t"), F.max("score").alias("score"))
    if weights is None:
        return marked.withColumn("w", F.lit(1.0))
    return marked.join(weights.select("term", F.col("weight").alias("w")), "term", "left").na.fill(0.0, ["w"]).select("entity", "term", "t", "score", "w")


def sweep(marked: DataFrame, points: int = 101, kinds: tuple[str, ...] = ("plain",)) -> DataFrame:
    """Per kind of weight and threshold: protein-centric precision, recall and F, pooled ones, remaining uncertainty and misinformation.

    marked: see marks(). A kind is "plain" (every term weighs 1) or "weighted" (w);
    only entities with truth of that weight count. All kinds come from one pass. An
    entity's state changes only at the buckets that its scores hit, and is added up
    by (next lower bucket, bucket), of which there are points * points / 2 at most;
    thresholds are unfolded from these sums, which are written.
    """
    one = {"plain": F.lit(1.0), "weighted": F.col("w")}
    b = F.when(F.col("score").isNull(), -1).otherwise(F.greatest(bucket(F.col("score"), points), F.lit(-1)))
    true, scored = F.col("t") == 1, F.col("b") >= 0
    sums = [x for k in kinds for x in (F.sum(F.when(true, one[k]).otherwise(0.0)).alias(f"t_{k}"), F.sum(F.when(scored, one[k]).otherwise(0.0)).alias(f"p_{k}"))]
    per = marked.withColumn("b", b).groupBy("entity", "b").agg(*sums)
    down, whole = W.partitionBy("entity").orderBy(F.desc("b")), W.partitionBy("entity")
    so_far = down.rowsBetween(W.unboundedPreceding, 0)
    state = per.select("b", F.coalesce(F.lead("b").over(down), F.lit(-1)).alias("low"), F.lag("b").over(down).isNull().alias("top"), *(x for k in kinds for x in (F.sum(f"t_{k}").over(so_far).alias(f"tp_{k}"), F.sum(f"p_{k}").over(so_far).alias(f"predicted_{k}"), F.sum(f"t_{k}").over(whole).alias(f"truth_{k}"))))

    def added(k: str) -> list[Column]:
        truth, tp, predicted = F.col(f"truth_{k}"), F.col(f"tp_{k}"), F.col(f"predicted_{k}")
        told = {"n": F.when(F.col("top"), 1), "whole": F.when(F.col("top"), truth), "ps": safe(tp, predicted), "np": F.when(predicted > 0, 1), "rs": safe(tp, truth), "tp": tp, "predicted": predicted}
        return [F.sum(F.when(truth > 0, x).otherwise(0)).alias(f"{name}_{k}") for name, x in told.items()]

    spans = materialize(state.groupBy("low", "b").agg(*(x for k in kinds for x in added(k))), "sweep")
    names = ("n", "whole", "ps", "np", "rs", "tp", "predicted")
    long = spans.select("low", "b", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), *(F.col(f"{x}_{k}").alias(x) for x in names)) for k in kinds))).alias("x")).select("low", "b", "x.*")
    all_ = long.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole"))
    parts = long.where("b >= 0").select("kind", *names[2:], F.explode(F.sequence(F.col("low") + 1, F.col("b"))).alias("i"))
    at = parts.groupBy("kind", "i").agg(*(F.sum(x).alias(x) for x in names[2:])).join(F.broadcast(all_), "kind")  # a row per kind
    precision, recall = safe(F.col("ps"), F.col("np")), safe(F.col("rs"), F.col("n"))
    mp, mr = safe(F.col("tp"), F.col("predicted")), safe(F.col("tp"), F.col("whole"))
    return at.where("n > 0").select(
        "kind",
        (F.col("i") / (points - 1)).alias("threshold"),
        precision.alias("precision"),
        recall.alias("recall"),
        safe(2 * precision * recall, precision + recall).alias("f"),
        safe(2 * mp * mr, mp + mr).alias("micro_f"),
        ((F.col("whole") - F.col("tp")) / F.col("n")).alias("ru"),
        ((F.col("predicted") - F.col("tp")) / F.col("n")).alias("mi"),
    )


def best(swept: DataFrame, value: str) -> DataFrame:
    """The largest value and the first threshold that has it."""
    return swept.orderBy(F.desc(F.round(value, 12)), "threshold").limit(1).select("threshold", value)
