"""Sinks for one file that people or other tools open: GraphML, delimited text, Markdown, JSON lines.

Rows stream through the driver one partition at a time into one file of any file
system that Spark knows, so these are for reports; large results belong in
`df.write`. Lines are made by expressions. Nulls are empty cells, absent GraphML
data and absent JSON fields.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.storage import file_system

GRAPHML_TYPES = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "float": "float", "double": "double", "boolean": "boolean"}
#: Characters of lines that are written at once.
FLUSH = 1 << 20


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Text like 12.5%; 0 where the whole is 0."""
    value = F.when(whole == 0, F.lit(0.0)).otherwise(F.try_divide(part * 100.0, whole))
    return F.format_string(f"%.{digits}f%%", value.cast("double"))


def utc_stamp(moment: Column | None = None) -> Column:
    """ISO-8601 text in UTC of a timestamp, of now by default."""
    moment = F.current_timestamp() if moment is None else moment
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def write_lines(spark: SparkSession, path: str, head: Iterable[str], *bodies: DataFrame, tail: Iterable[str] = ()) -> str:
    """One file of lines: the head, each one-column table in its order, the tail."""

    def lines():
        yield from head
        for body in bodies:
            for row in body.toLocalIterator():
                yield row[0]
        yield from tail

    fs, hadoop = file_system(spark, path)
    out = fs.create(hadoop, True)
    try:
        waiting, size = [], 0
        for line in lines():
            waiting.append(line)
            size += len(line)
            if size >= FLUSH:
                out.write(bytearray(("\n".join(waiting) + "\n").encode()))
                waiting, size = [], 0
        if waiting:
            out.write(bytearray(("\n".join(waiting) + "\n").encode()))
    finally:
        out.close()
    return path


def _cell(column: Column, sep: str) -> Column:
    text = F.coalesce(column.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.contains('"') | text.contains(sep) | text.rlike("[\r\n]"), quoted).otherwise(text)


def _name(name: str, sep: str) -> str:
    return '"' + name.replace('"', '""') + '"' if any(c in name for c in ('"', sep, "\r", "\n")) else name


def write_delimited(df: DataFrame, path: str, sep: str = "\t") -> str:
    """One delimited file with a header; cells are quoted where they must be."""
    head = sep.join(_name(c, sep) for c in df.columns)
    return write_lines(df.sparkSession, path, [head], df.select(F.concat_ws(sep, *(_cell(F.col(f"`{c}`"), sep) for c in df.columns))))


def write_markdown(df: DataFrame, path: str) -> str:
    """One Markdown table; line breaks in cells are blanks and bars are escaped."""
    escape = lambda c: F.replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[\r\n]+", " "), F.lit("|"), F.lit("\\|"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(escape(F.col(f"`{c}`")) for c in df.columns)), F.lit(" |"))
    head = ["| " + " | ".join(c.replace("|", "\\|") for c in df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return write_lines(df.sparkSession, path, head, df.select(row))


def write_json_lines(df: DataFrame, path: str) -> str:
    """One file with a JSON object a row."""
    return write_lines(df.sparkSession, path, [], df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))


def _escaped(column: Column) -> Column:
    text = F.regexp_replace(column.cast("string"), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")  # XML has no such characters
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, directed: bool = False) -> str:
    """GraphML of nodes (id, attributes...) and edges (source, target, attributes...)."""

    def keys(df: DataFrame, kind: str, skip: tuple[str, ...]) -> dict[str, tuple[str, str]]:
        return {c: (f"{kind}{i}", GRAPHML_TYPES.get(t, "string")) for i, (c, t) in enumerate((c, t) for c, t in df.dtypes if c not in skip)}

    def data(names: dict[str, tuple[str, str]]) -> Column:
        cells = [F.concat(F.lit(f'<data key="{key}">'), _escaped(F.col(f"`{c}`")), F.lit("</data>")) for c, (key, _) in names.items()]
        return F.concat_ws("", *cells) if cells else F.lit("")

    of_nodes, of_edges = keys(nodes, "n", ("id",)), keys(edges, "e", ("source", "target"))
    quote = lambda s: s.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")
    declared = [f'<key id="{key}" for="{kind}" attr.name="{quote(c)}" attr.type="{t}"/>' for kind, names in (("node", of_nodes), ("edge", of_edges)) for c, (key, t) in names.items()]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *declared, f'<graph edgedefault="{"directed" if directed else "undirected"}">']
    node = F.concat(F.lit('<node id="'), _escaped(F.col("id")), F.lit('">'), data(of_nodes), F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), _escaped(F.col("source")), F.lit('" target="'), _escaped(F.col("target")), F.lit('">'), data(of_edges), F.lit("</edge>"))
    return write_lines(nodes.sparkSession, path, head, nodes.where("id is not null").select(node), edges.where("source is not null and target is not null").select(edge), tail=["</graph>", "</graphml>"])
