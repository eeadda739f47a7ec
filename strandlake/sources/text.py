"""Readers of sequence, ontology, taxonomy and annotation files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME_PRIORITY = ("scientific name", "genbank common name", "common name", "synonym")


def fasta_records(records: DataFrame, id_from: str = "record_id", keep: list[str] | None = None) -> DataFrame:
    """(id, description, sequence) of one column `value`, a record's text after '>', and columns to keep."""
    if id_from not in ("record_id", "description"):
        raise ValueError("id_from must be record_id or description")
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    header = F.trim(F.get(lines, F.lit(0)))
    sequence = F.regexp_replace(F.array_join(F.slice(lines, F.lit(2), F.size(lines)), ""), r"\s+", "")
    name = F.get(F.split(header, r"\s+"), F.lit(0)) if id_from == "record_id" else header
    return records.where(F.length(F.trim("value")) > 0).select(name.alias("id"), header.alias("description"), sequence.alias("sequence"), *(keep or []))


def read_fasta(spark: SparkSession, path: str, id_from: str = "record_id") -> DataFrame:
    """FASTA files, compressed ones included; a record starts at a line that starts with '>'."""
    # Records are cut at line ends that '>' follows; what a file begins with has no line end before it.
    lines = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value"))
    return fasta_records(lines, id_from)


def fasta_aliases(records: DataFrame) -> DataFrame:
    """(alias, sequence): the header's first token, and the second part of a|b|c tokens among the first two; conflicts are an error."""
    tokens = F.slice(F.split("description", r"\s+"), 1, 2)
    parts = F.filter(F.transform(tokens, lambda t: F.get(F.split(t, r"\|"), F.lit(1))), lambda p: p.isNotNull() & (p != ""))
    aliases = F.array_distinct(F.concat(F.array("id"), parts))
    out = records.select(F.explode(aliases).alias("alias"), "sequence").distinct()
    counts = out.groupBy("alias").agg(F.count("*").alias("n"), F.min("sequence").alias("sequence"))
    return counts.select("alias", F.when(F.col("n") == 1, F.col("sequence")).otherwise(F.raise_error(F.concat(F.lit("several sequences of "), "alias"))).alias("sequence"))


def read_table(spark: SparkSession, path: str, schema: str, required: list[str], sep: str = "\t") -> DataFrame:
    """A delimited file with a header; a missing required column is an error."""
    header = spark.read.option("sep", sep).option("header", True).csv(path).columns
    if lacking := [c for c in required if c not in header]:
        raise ValueError(f"{path} lacks the columns {', '.join(lacking)}")
    return spark.read.option("sep", sep).option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped and malformed ones are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def obo_terms(stanzas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, name, namespace, is_obsolete) and edges (child, parent) of one column `value`, a stanza's text."""
    pick = lambda key: F.nullif(F.regexp_extract("value", rf"(?m)^{key}: (.*)$", 1), F.lit(""))
    own = stanzas.where(F.col("value").rlike(r"(?m)^id: ")).select(pick("id").alias("term"), pick("name").alias("name"), pick("namespace").alias("namespace"), F.coalesce(pick("is_obsolete") == "true", F.lit(False)).alias("is_obsolete"), F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)")).alias("parents"))
    return own.drop("parents"), own.where("not is_obsolete").select(F.col("term").alias("child"), F.explode("parents").alias("parent")).distinct()


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return obo_terms(spark.read.option("lineSep", "[Term]").text(path).select(F.regexp_replace("value", r"(?s)\n\[Typedef\].*", "").alias("value")))


def _fields(lines: DataFrame) -> DataFrame:
    return lines.where(F.length(F.trim("value")) > 0).select(F.transform(F.split("value", r"\|"), lambda x: F.btrim(x, F.lit(" \t\r"))).alias("f"), F.col("_position") if "_position" in lines.columns else F.lit(0).alias("_position"))


def taxdump_nodes(lines: DataFrame) -> DataFrame:
    """(tax_id, parent_id, rank): '|'-separated fields; a missing parent makes a root."""
    f = _fields(lines)
    at = lambda i: F.get("f", F.lit(i))
    return f.select(at(0).alias("tax_id"), F.coalesce(F.nullif(at(1), F.lit("")), at(0)).alias("parent_id"), F.coalesce(at(2), F.lit("")).alias("rank"))


def taxdump_names(lines: DataFrame) -> DataFrame:
    """(tax_id, name): the name of the best class, then the first in order."""
    at = lambda i: F.get("f", F.lit(i))
    place = F.array_position(F.array(*(F.lit(x) for x in NAME_PRIORITY)), F.col("kind"))
    rows = _fields(lines).select(at(0).alias("tax_id"), at(1).alias("name"), at(3).alias("kind"), "_position").withColumn("p", F.when(place == 0, 99).otherwise(place))
    return rows.groupBy("tax_id").agg(F.min_by("name", F.struct("p", "_position", "name")).alias("name"))


def annotations_tsv(lines: DataFrame) -> DataFrame:
    """Distinct (entity, term) of two tab-separated columns; blank, short and '#' lines are skipped."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 2)).select(F.trim(F.get(f, F.lit(0))).alias("entity"), F.trim(F.get(f, F.lit(1))).alias("term"))
    return rows.where("entity <> '' and term <> ''").distinct()
