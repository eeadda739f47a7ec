"""Readers of labelled sequence datasets, from paths to typed rows.

Residue readers return (id, sequence, labels array<int>, ...) with a label per
position; protein readers return a row per protein. Rows that break a format's
rules raise when the result is computed, with the id in the message. Paths may be
any that Spark's readers open.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.order import group_index
from strandlake.sources.text import fasta_records, read_fasta

#: Codes of the three ontologies in term files.
ASPECTS = {"F": "mf", "MF": "mf", "MFO": "mf", "MOLECULAR_FUNCTION": "mf", "P": "bp", "BP": "bp", "BPO": "bp", "BIOLOGICAL_PROCESS": "bp", "C": "cc", "CC": "cc", "CCO": "cc", "CELLULAR_COMPONENT": "cc"}


def _text(column: str | Column) -> Column:
    return F.trim(F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit("")))


def _unless(bad: Column, value: Column, *message: str | Column) -> Column:
    """The value, or an error where `bad` holds."""
    told = F.concat(*(F.lit(m) if isinstance(m, str) else m.cast("string") for m in message))
    return F.when(~F.coalesce(bad, F.lit(False)), value).otherwise(F.raise_error(told))


def read_delimited(spark: SparkSession, path: str, sep: str, required: list[str]) -> DataFrame:
    """All columns of a file with a header as text; a byte-order mark and blanks around names are dropped, a missing column is an error."""
    rows = spark.read.option("sep", sep).option("header", True).option("multiLine", sep == ",").option("escape", '"').csv(path)
    rows = rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))
    if lacking := [c for c in required if c not in rows.columns]:
        raise ValueError(f"{path} lacks the columns {', '.join(lacking)}")
    return rows


def interval_labels(rows: DataFrame, *kept: Column) -> DataFrame:
    """(id, sequence, labels, ...) of intervals (id, sequence, start, end), counted from 1 and inclusive; a null start adds none.

    Conflicting sequences of an id, empty ids and sequences, and positions outside
    of the sequence are errors. `kept` are further aggregates.
    """
    where = F.struct(F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e"))
    grouped = rows.groupBy("id").agg(F.min("sequence").alias("sequence"), F.max("sequence").alias("_other"), F.collect_list(F.when(F.col("start").isNotNull(), where)).alias("_spans"), *kept)
    n = F.length("sequence")
    bad = F.exists("_spans", lambda x: x["s"].isNull() | x["e"].isNull() | (x["s"] < 1) | (x["e"] < x["s"]) | (x["e"] > n))
    labels = F.transform(F.sequence(F.lit(1), n), lambda i: F.exists("_spans", lambda x: (x["s"] <= i) & (i <= x["e"])).cast("int"))
    checked = _unless((_text("id") == "") | (_text("sequence") == ""), F.col("sequence"), "an interval row has no id or sequence: ", F.coalesce("id", F.lit("")))
    checked = _unless(F.col("sequence") != F.col("_other"), checked, "conflicting sequences of ", F.col("id"))
    return grouped.select("id", checked.alias("sequence"), _unless(bad, labels, "a position is outside of the sequence of ", F.col("id")).alias("labels"), *(c for c in grouped.columns if c not in ("id", "sequence", "_other", "_spans")))


def read_intervals(spark: SparkSession, path: str, sep: str = "\t", one_based: bool = True) -> DataFrame:
    """(id, sequence, labels, split) of a table id, sequence, start, end and perhaps split (train where it is blank)."""
    rows = read_delimited(spark, path, sep, ["id", "sequence", "start"])
    split = F.coalesce(F.nullif(_text("split"), F.lit("")), F.lit("train")) if "split" in rows.columns else F.lit("train")
    end = F.coalesce(F.nullif(_text("end"), F.lit("")), _text("start")) if "end" in rows.columns else _text("start")
    at = 0 if one_based else 1
    return interval_labels(rows.select(_text("id").alias("id"), _text("sequence").alias("sequence"), (_text("start").cast("int") + at).alias("start"), (end.cast("int") + at).alias("end"), split.alias("split")), F.min("split").alias("split"))


def parse_labels(raw: Column) -> Column:
    """Labels from JSON, comma, blank or letter by letter."""
    t = F.trim(raw)
    return F.when(t.startswith("["), F.from_json(t, "array<string>")).when(t.contains(","), F.split(t, r"\s*,\s*")).when(t.rlike(r"\s"), F.split(t, r"\s+")).otherwise(F.filter(F.split(t, ""), lambda x: x != ""))


def read_residue_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(id, sequence, labels array<string>, mask array<boolean>, split) of a table with one label per position; other lengths are errors."""
    rows = read_delimited(spark, path, sep, ["id", "sequence", "labels"])
    n = F.length(_text("sequence"))
    mask = F.transform(parse_labels(F.col("mask")), lambda x: F.lower(x).isin("1", "true", "yes")) if "mask" in rows.columns else F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(True))
    labels = parse_labels(F.col("labels"))
    same = lambda column, what: _unless(F.size(column) != n, column, f"{what} of another length than the sequence of ", F.col("id"))
    split = F.coalesce(F.nullif(_text("split"), F.lit("")), F.lit("train")) if "split" in rows.columns else F.lit("train")
    return rows.select(_text("id").alias("id"), _text("sequence").alias("sequence"), same(labels, "labels").alias("labels"), same(mask, "a mask").alias("mask"), split.alias("split"))


def read_flip(spark: SparkSession, path: str, target: str = "target", sequence: str = "sequence", region: tuple[int, int] | None = None) -> DataFrame:
    """(id, sequence, target double, split) of a CSV with set and validation; rows without a set are left out.

    validation true makes a train row val. region (start, end) cuts sequences from 0, end excluded.
    """
    rows = read_delimited(spark, path, ",", [sequence, target, "set"])
    part, validation = F.lower(_text("set")), F.lower(_text("validation")) if "validation" in rows.columns else F.lit("")
    cut = _text(sequence) if region is None else F.substring(_text(sequence), region[0] + 1, region[1] - region[0])
    value = F.lower(_text(target))
    number = F.when(value.isin("true", "false"), (value == "true").cast("double")).otherwise(F.col(target).try_cast("double"))
    name = F.col("id") if "id" in rows.columns else F.col("name") if "name" in rows.columns else F.monotonically_increasing_id()
    split = F.when(part == "test", "test").when(validation.isin("true", "1", "1.0"), "val").otherwise("train")
    return rows.where(part.isin("train", "test", "val", "validation")).select(name.cast("string").alias("id"), cut.alias("sequence"), F.when(~F.isnan(number), number).alias("target"), F.when(part.isin("val", "validation"), "val").otherwise(split).alias("split"))


def read_biolip(spark: SparkSession, path: str, ligand: str = "all", fasta: str | None = None) -> DataFrame:
    """(id, sequence, labels) of receptors' binding positions, of ligands all, dna, rna, pep or other; sequences of a FASTA file come first."""
    ligand = {"peptide": "pep"}.get(ligand.strip().lower(), ligand.strip().lower())
    if ligand not in ("all", "dna", "rna", "pep", "other"):
        raise ValueError("ligand must be one of all, dna, rna, pep, other")
    lines = spark.read.text(path).where(F.trim("value") != "")
    f = F.when(F.col("value").contains("\t"), F.split("value", "\t")).otherwise(F.split(F.trim("value"), r"\s+"))
    at = lambda i: F.get("f", F.lit(i))
    kind = F.lower(F.trim(at(4)))
    wanted = {"all": F.lit(True), "pep": kind == "peptide", "other": ~kind.isin("dna", "rna", "peptide")}.get(ligand, kind == ligand)
    rows = lines.select(f.alias("f")).select(_unless(F.size("f") < 21, F.col("f"), "a row has too few columns: ", F.size("f")).alias("f")).where(wanted)
    rows = rows.select(F.concat(at(0), at(1)).alias("id"), at(20).alias("sequence"), F.explode_outer(F.regexp_extract_all(F.replace(at(8), F.lit(";"), F.lit(" ")), F.lit(r"(-?\d+)(?=\s|$)"))).alias("start"))
    if fasta:
        rows = rows.join(read_fasta(spark, fasta).select("id", F.col("sequence").alias("_given")), "id", "left").withColumn("sequence", F.coalesce("_given", "sequence"))
    return interval_labels(rows.withColumn("end", F.col("start")))


def content_bin(fraction: Column) -> Column:
    """Names of shares under a tenth, three tenths, six tenths and beyond."""
    return F.when(fraction < 0.1, "0-10%").when(fraction < 0.3, "10-30%").when(fraction < 0.6, "30-60%").otherwise("60-100%")


def _disordered(labelled: DataFrame) -> DataFrame:
    inside = F.aggregate("labels", F.lit(0), lambda a, x: a + x)
    return labelled.withColumn("disorder_fraction", inside / F.size("labels")).withColumn("disorder_bin", content_bin(F.col("disorder_fraction")))


def read_disprot_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, sequence, labels, stratum, disorder_fraction, disorder_bin) of disorder regions.

    Entries are a list, or stand under data, entries or results. A region that is
    one object with terms counts where it is a structural state of disorder; lists
    of regions count as they are.
    """
    entry = "acc string, disprot_id string, id string, sequence string, protein_sequence string, seq string, dataset array<string>, regions string, disorder_regions string, annotations string"
    nested = f"array<struct<{entry.replace(' string', ':string').replace(' array', ':array')}>>"
    read = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(f"{entry}, data {nested}, entries {nested}, results {nested}").json(path)
    names = [c.split()[0] for c in entry.split(", ")]
    own = F.array(F.struct(*names))
    rows = read.select(F.explode(F.coalesce("data", "entries", "results", own)).alias("x")).select("x.*")
    text = F.coalesce("sequence", "protein_sequence", "seq")
    text = F.when(text.startswith("{"), F.coalesce(*(F.get_json_object(text, f"$.{k}") for k in ("value", "sequence", "content")))).otherwise(text)
    regions = F.coalesce("regions", "disorder_regions", "annotations")
    kind = "struct<start:int,start_position:int,begin:int,end:int,end_position:int,stop:int,term_namespace:string,term_name:string>"
    listed = F.when(regions.startswith("{"), F.array(F.from_json(regions, kind))).otherwise(F.from_json(regions, f"array<{kind}>"))
    name = F.coalesce(*(F.nullif(_text(c), F.lit("")) for c in ("acc", "disprot_id", "id")))
    spans = rows.select(name.alias("id"), F.trim(text).alias("sequence"), "dataset", F.explode(listed).alias("r"))
    state = F.lower(_text("r.term_namespace"))
    spans = spans.where(((state == "") & (_text("r.term_name") == "")) | ((state == "structural state") & (F.lower(_text("r.term_name")) == "disorder")))
    start = F.coalesce("r.start", "r.start_position", "r.begin")
    tags = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(F.coalesce("dataset", F.array().cast("array<string>")), lambda x: F.trim(x)))))), "+")
    labelled = interval_labels(spans.select("id", "sequence", "dataset", start.alias("start"), F.coalesce("r.end", "r.end_position", "r.stop", start).alias("end")), tags.alias("stratum"))
    return _disordered(labelled.withColumn("stratum", F.when(F.col("stratum") == "", "none").otherwise(F.col("stratum"))))


def read_disprot_tsv(spark: SparkSession, path: str, sequences: DataFrame | None = None, term_names: tuple[str, ...] = ("disorder",), term_ids: tuple[str, ...] = ()) -> DataFrame:
    """Residue labels of the rows with a wanted term.

    With sequences (id, sequence) a row per protein; without, each region is a row
    of its own sequence, all ones.
    """
    rows = read_delimited(spark, path, "\t", ["UniProt ACC", "DisProt ID", "Start", "End", "Region sequence", "Term ID", "Term name"])
    wanted = F.lower(_text("Term name")).isin([t.lower() for t in term_names]) | F.lower(_text("Term ID")).isin([t.lower() for t in term_ids])
    rows = rows.where(wanted)
    if sequences is None:
        region = _text("Region sequence")
        name = F.concat_ws(":", _text("UniProt ACC"), _text("Start"), _text("End"))
        return rows.select(name.alias("id"), region.alias("sequence"), F.transform(F.sequence(F.lit(1), F.length(region)), lambda _: F.lit(1)).alias("labels"))
    spans = rows.select(_text("UniProt ACC").alias("id"), F.col("Start").alias("start"), F.col("End").alias("end")).join(sequences.select("id", "sequence"), "id", "left")
    return _disordered(interval_labels(spans))


def read_phospho(spark: SparkSession, path: str, codes: tuple[str, ...] = ("S", "T", "Y"), evidence: str = "all") -> DataFrame:
    """(id, sequence, labels, mask, stratum, htp, ltp, other) of phosphorylation sites; mask marks residues of the codes."""
    if not codes or set(codes) - {"S", "T", "Y"}:
        raise ValueError("codes must be drawn from S, T, Y")
    if evidence not in ("all", "LTP", "HTP"):
        raise ValueError("evidence must be one of all, LTP, HTP")
    rows = read_delimited(spark, path, "\t", ["acc", "sequence", "position", "code", "source"])
    source, code = F.upper(_text("source")), F.upper(_text("code"))
    rows = rows.select(_text("acc").alias("id"), _text("sequence").alias("sequence"), _text("position").try_cast("int").alias("start"), code.alias("code"), F.when(source.isin("HTP", "LTP"), source).otherwise("other").alias("source"))
    rows = rows.where(F.col("code").isin(*codes) & (F.lit(evidence == "all") | (F.col("source") == evidence)))
    seen = F.upper(F.substring("sequence", F.col("start"), F.lit(1)))
    checked = _unless(F.col("start").isNull() | (seen != F.col("code")), F.col("start"), "no such residue at the position of a row of ", F.col("id"))
    kinds = [F.count_if(F.col("source") == k).alias(k.lower()) for k in ("HTP", "LTP", "other")]
    out = interval_labels(rows.withColumn("start", checked).withColumn("end", F.col("start")), F.array_join(F.array_sort(F.collect_set("code")), "+").alias("stratum"), *kinds)
    letters = F.split("sequence", "")
    return out.withColumn("mask", F.transform(F.sequence(F.lit(0), F.length("sequence") - 1), lambda i: F.upper(F.get(letters, i)).isin(*codes)))


def marked_residues(records: DataFrame, mark: str = "#") -> DataFrame:
    """(id, sequence, labels) of (id, sequence) whose mark follows positive residues; a mark that follows none is an error."""
    each = F.regexp_extract_all("sequence", F.lit(f"([^{mark}]{mark}?)"))
    bad = F.col("sequence").startswith(mark) | F.col("sequence").contains(mark * 2)
    return records.select("id", _unless(bad, F.array_join(F.transform(each, lambda x: F.substring(x, 1, 1)), ""), "a mark without a residue in ", F.col("id")).alias("sequence"), F.transform(each, lambda x: x.endswith(mark).cast("int")).alias("labels"))


def read_marked(spark: SparkSession, path: str) -> DataFrame:
    return marked_residues(read_fasta(spark, path))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw, out = body.as_py(), []
            low = path.lower()
            if low.endswith((".tar.gz", ".tgz", ".tar")):
                with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as archive:
                    out = [(m.name, archive.extractfile(m).read()) for m in archive if m.isfile()]
            elif low.endswith(".zip"):
                with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                    out = [(n, archive.read(n)) for n in archive.namelist() if not n.endswith("/")]
            elif low.endswith(".gz"):
                out = [(path.rsplit("/", 1)[-1][:-3], gzip.decompress(raw))]
            else:
                out = [(path.rsplit("/", 1)[-1], raw)]
            for name, data in out:  # a member at a time
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([data], pa.binary())], names=["path", "member", "body"])


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, body) of the files in tar, tar.gz, tgz, zip and gz archives; an archive is read by one task and must fit in it."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_members, "path string, member string, body binary")


def read_site_windows(spark: SparkSession, path: str) -> DataFrame:
    """(id, sequence, labels, site_label) of an archive of FASTA windows: *_pos members are positive at the centre, *_neg ones negative.

    Ids are member:record, repeated ones with __dup2, __dup3, ...
    """
    files = read_members(spark, path).where(F.lower("member").rlike(r"\.(fa|fasta|faa)$")).withColumn("stem", F.regexp_replace(F.regexp_extract("member", r"([^/]*)$", 1), r"\.[^.]*$", ""))
    low = F.lower("stem")
    positive = F.when(low.endswith("_pos") | low.contains("positive"), 1).when(low.endswith("_neg") | low.contains("negative"), 0)
    texts = files.select("stem", _unless(positive.isNull(), positive, "neither positive nor negative: ", F.col("member")).alias("site_label"), F.posexplode(F.split(F.concat(F.lit("\n"), F.decode("body", "utf-8")), "\n>")).alias("at", "value"))
    records = texts.where("at > 0")
    parsed = records.select("stem", "site_label", "at", F.struct("value").alias("v"))
    one = fasta_records(parsed.select("v.value", "stem", "site_label", "at"), keep=["stem", "site_label", "at"])
    based = one.withColumn("base", F.concat_ws(":", "stem", "id"))
    numbered = group_index(based, "base", "at", name="again")
    name = F.when(F.col("again") == 0, F.col("base")).otherwise(F.concat("base", F.lit("__dup"), (F.col("again") + 1).cast("string")))
    centre = F.floor(F.length("sequence") / 2)
    labels = F.transform(F.sequence(F.lit(0), F.length("sequence") - 1), lambda i: ((i == centre) & (F.col("site_label") == 1)).cast("int"))
    return numbered.select(name.alias("id"), "sequence", _unless(F.length("sequence") == 0, labels, "an empty window: ", F.col("base")).alias("labels"), "site_label")


def read_terms(spark: SparkSession, path: str, aspect: str) -> DataFrame:
    """(id, terms) of a table EntryID, term, aspect: sorted terms of one ontology; an unknown aspect is an error."""
    rows = read_delimited(spark, path, "\t", [])
    named = {c.lower().replace("_", ""): c for c in rows.columns}
    if lacking := [c for c in ("entryid", "term", "aspect") if c not in named]:
        raise ValueError(f"{path} lacks the columns {', '.join(lacking)}")
    code = F.regexp_replace(F.upper(_text(named["aspect"])), "[ -]", "_")
    known = F.create_map(*(F.lit(x) for pair in ASPECTS.items() for x in pair))
    kind = _unless(~F.map_contains_key(known, code), F.element_at(known, code), "unknown aspect ", code)
    out = rows.select(_text(named["entryid"]).alias("id"), _text(named["term"]).alias("term"), kind.alias("aspect"))
    out = out.select(_unless((F.col("id") == "") | (F.col("term") == ""), F.col("id"), "an empty id or term").alias("id"), "term", "aspect")
    return out.where(F.col("aspect") == aspect).groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def read_cafa(spark: SparkSession, fasta: str, terms: str, aspect: str) -> DataFrame:
    """(id, sequence, terms) of the proteins that have terms of an ontology."""
    return read_fasta(spark, fasta).select("id", "sequence").join(read_terms(spark, terms, aspect), "id")


def released_subset(train: DataFrame, test: DataFrame) -> DataFrame:
    """Rows with a `split`: released targets are test, the others without their ids train."""
    return test.withColumn("split", F.lit("test")).unionByName(train.join(test.select("id").distinct(), "id", "left_anti").withColumn("split", F.lit("train")))


def read_term_jsonl(spark: SparkSession, path: str, labels: str = "labels_asserted", single: bool = False) -> DataFrame:
    """(id, sequence, labels, metadata, cluster_id) of JSON lines; `single` keeps records with exactly one label."""
    rows = spark.read.schema(f"id string, sequence string, {labels} array<string>, metadata map<string,string>, cluster_id string").option("mode", "FAILFAST").json(path)
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: x != "")))
    out = rows.where("id is not null").select("id", "sequence", clean.alias("labels"), "metadata", "cluster_id")
    return out.where(F.size("labels") == 1) if single else out


def read_enzyme_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(id, sequence, codes) of a table whose columns go by several names; codes are ';'- or ','-joined."""
    rows = read_delimited(spark, path, sep, [])
    named = {c.lower().replace("_", " "): c for c in rows.columns}
    pick = lambda *names: next((named[n] for n in names if n in named), None)
    found = {"id": pick("entry", "id"), "sequence": pick("sequence", "sequences", "seq"), "codes": pick("ec number", "ec", "ec numbers")}
    if lacking := [k for k, v in found.items() if v is None]:
        raise ValueError(f"{path} lacks columns for {', '.join(lacking)}")
    codes = F.filter(F.transform(F.split(F.col(found["codes"]), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(_text(found["id"]).alias("id"), _text(found["sequence"]).alias("sequence"), F.array_sort(F.array_distinct(codes)).alias("codes"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(term, weight) of lines of a term and a number; blank and '#' lines are skipped, the last of a term's lines counts, others are errors."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).select("at", F.trim("line").alias("line"))
    f = F.split(F.replace("line", F.lit(","), F.lit(" ")), r"\s+")
    rows = lines.where("line <> '' and not startswith(line, '#')").select("at", F.get(f, F.lit(0)).alias("term"), F.get(f, F.lit(1)).try_cast("double").alias("weight"))
    if rows.isEmpty():
        raise ValueError(f"{path} contains no weights")
    checked = rows.select("at", "term", _unless((F.col("term") == "") | F.col("weight").isNull(), F.col("weight"), "no weight of ", F.col("term")).alias("weight"))
    return checked.groupBy("term").agg(F.max_by("weight", "at").alias("weight"))


def read_json_document(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """The entries, of the schema `entry`, of a JSON document that is a list or holds one under data, entries or results."""
    kind = f"array<struct<{entry}>>"
    flat = ", ".join(x.replace(":", " ", 1) for x in entry.split(","))
    read = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(f"{flat}, data {kind}, entries {kind}, results {kind}").json(path)
    own = F.array(F.struct(*(x.split(":", 1)[0].strip() for x in entry.split(","))))
    return read.select(F.explode(F.coalesce("data", "entries", "results", own)).alias("x")).select("x.*")
