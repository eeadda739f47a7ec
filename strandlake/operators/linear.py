"""Linear and one-hidden-layer probes on standardised vectors, fitted on the train split and applied to test."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import vec


def standardize(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Vectors less the train mean, over the population deviation (1e-6 at least), as `features`."""
    long = df.where("split = 'train'").select(F.posexplode(vec.as_double(vector)).alias("pos", "x"))
    stats = long.groupBy("pos").agg(F.avg("x").alias("m"), F.greatest(F.stddev_pop("x"), F.lit(1e-6)).alias("s"))
    row = stats.agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("stats"))  # one row of one entry per dimension
    z = F.zip_with(vec.as_double(vector), F.col("stats"), lambda x, t: (x - t["m"]) / t["s"])
    return df.join(F.broadcast(row), F.lit(True)).withColumn("features", array_to_vector(z)).drop("stats")


def classify(df: DataFrame, kind: str = "logistic", hidden: int = 64, epochs: int = 100, seed: int = 7) -> DataFrame:
    """Test rows with `prediction`; two classes at least, in sorted order."""
    indexed = StringIndexer(inputCol="text_label", outputCol="number", stringOrderType="alphabetAsc").fit(source := df.withColumn("text_label", F.col("label").cast("string")))
    if len(indexed.labels) < 2:
        raise ValueError("a classifier needs two classes")
    data = standardize(indexed.transform(source))
    train, test = data.where("split = 'train'"), data.where("split = 'test'")
    if kind == "logistic":
        model = LogisticRegression(featuresCol="features", labelCol="number", maxIter=epochs, standardization=False, predictionCol="_p").fit(train)
    elif kind == "mlp":
        width = train.select(F.size("vector")).first()[0]
        model = MultilayerPerceptronClassifier(featuresCol="features", labelCol="number", layers=[width, hidden, len(indexed.labels)], maxIter=epochs, seed=seed, predictionCol="_p").fit(train)
    else:
        raise ValueError(f"unknown probe {kind!r}")
    names = F.array(*(F.lit(x) for x in indexed.labels))
    kind_of_label = dict(df.dtypes)["label"]
    return model.transform(test).withColumn("prediction", F.get(names, F.col("_p").cast("int")).cast(kind_of_label))


def regress(df: DataFrame, epochs: int = 100) -> DataFrame:
    data = standardize(df).withColumn("number", F.col("label").cast("double"))
    model = LinearRegression(featuresCol="features", labelCol="number", maxIter=epochs, standardization=False, predictionCol="prediction").fit(data.where("split = 'train'"))
    return model.transform(data.where("split = 'test'"))


def flatten(df: DataFrame) -> DataFrame:
    """(id:position, vector, label) of per-position matrices and labels where the mask allows; positions count from 1."""
    rows = df.select("id", F.posexplode(F.arrays_zip("matrix", "labels", "mask")).alias("pos", "r"))
    return rows.where("r.mask").select(F.concat_ws(":", F.col("id").cast("string"), (F.col("pos") + 1).cast("string")).alias("id"), F.col("r.matrix").alias("vector"), F.col("r.labels").alias("label"))
