"""Report sinks read back by other parsers."""

import csv
import json
from xml.etree import ElementTree

from pyspark.sql import functions as F

from strandlake.operators import store, tree
from strandlake.sources import reports as R

NS = {"g": "http://graphml.graphdrawing.org/xmlns"}


def test_graphml(spark, tmp_path):
    nodes = spark.createDataFrame([("a<&\"", "x > y\x01", 1), ("b", None, 2), (None, "z", 3)], "id string, title string, n long")
    edges = spark.createDataFrame([("a<&\"", "b", 0.25), (None, "b", 0.5)], "source string, target string, distance double")
    path = tmp_path / "g.graphml"
    R.write_graphml(nodes, edges, f"file://{path}")
    root = ElementTree.parse(path).getroot()
    names = {k.get("id"): (k.get("attr.name"), k.get("attr.type")) for k in root.findall("g:key", NS)}
    assert names == {"n0": ("title", "string"), "n1": ("n", "long"), "e0": ("distance", "double")}
    found = {n.get("id"): {names[d.get("key")][0]: d.text for d in n.findall("g:data", NS)} for n in root.iter(f"{{{NS['g']}}}node")}
    assert found == {"a<&\"": {"title": "x > y", "n": "1"}, "b": {"n": "2"}}
    assert [(e.get("source"), e.get("target")) for e in root.iter(f"{{{NS['g']}}}edge")] == [("a<&\"", "b")]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a\tb", 'say "x"', 1), (None, "two\nlines | bar", None)], "k string, `v.w` string, n int").coalesce(1)
    for sep, name in (("\t", "t.tsv"), (",", "t.csv")):
        R.write_delimited(df, f"file://{tmp_path / name}", sep)
        assert list(csv.reader((tmp_path / name).open(newline=""), delimiter=sep)) == [["k", "v.w", "n"], ["a\tb", 'say "x"', "1"], ["", "two\nlines | bar", ""]]
    R.write_markdown(df, f"file://{tmp_path / 't.md'}")
    assert (tmp_path / "t.md").read_text().splitlines()[3] == "|  | two lines \\| bar |  |"
    R.write_json_lines(df, f"file://{tmp_path / 't.jsonl'}")
    assert [json.loads(x) for x in (tmp_path / "t.jsonl").read_text().splitlines()][1] == {"v.w": "two\nlines | bar"}
    R.write_delimited(df.where("false"), f"file://{tmp_path / 'e.tsv'}")
    assert (tmp_path / "e.tsv").read_text() == "k\tv.w\tn\n"


def test_formats(spark):
    df = spark.createDataFrame([(1, 8), (1, 0)], "a int, b int").select(R.percent(F.col("a"), F.col("b")).alias("p"), R.utc_stamp(F.timestamp_seconds(F.lit(0))).alias("t"))
    assert [tuple(r) for r in df.collect()] == [("12.5%", "1970-01-01T00:00:00+00:00"), ("0.0%", "1970-01-01T00:00:00+00:00")]


def test_names(spark):
    names = spark.createDataFrame([("1", "root"), ("2", "b"), ("3", "a")], "id string, name string")
    groups = spark.createDataFrame([("x", ["3", "2", "9"]), ("y", None)], "key string, ids array<string>")
    assert {r["key"]: (r["names"], r["joined"]) for r in tree.names(groups, names).collect()} == {"x": (["a", "b"], "a; b"), "y": ([], "")}


def test_key_path():
    assert store.key_path("/root", "bio-1.0", 3, 0, "cosine", 1024) == "/root/bio-1.0/type_3/layer_0/cosine_1024"
    for bad in (("a/b", 1, 0, "cosine", 4), ("", 1, 0, "cosine", 4), ("a", -1, 0, "cosine", 4), ("a", 1, -1, "cosine", 4), ("a", 1, 0, "other", 4), ("a", 1, 0, "cosine", 0)):
        try:
            store.key_path("/root", *bad)
        except ValueError:
            continue
        raise AssertionError(bad)
