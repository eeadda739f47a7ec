"""Content-addressed WARC archive.

write_archive() makes one record per page. Payload bytes are stored once per
strong digest (SHA-256), as gzip members; the exact header bytes of every record
are stored separately, beside the payload's digest. A revisit's block is empty. Of records with equal
payloads of at least `least_bytes` bytes the one with the largest page id is the
response and the others revisit it. read_archive() joins headers with payloads,
verifies both digests and parses the rebuilt bytes of each record;
record_bytes() gives a record as it stands in a .warc file.

Null html is an empty payload. A null url becomes an empty target. Pages with a
null id are written as responses without an id that no record revisits. Repeated
rows: equal ids and payloads give equal records (all of them responses where the
id is the largest). An empty table gives an empty archive; other columns are
ignored. A payload that very many records share is one row that is joined by
broadcast of its holder, and by copies of its bytes for parts of its records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import fresh_path, join_spread, join_unique, materialize

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_LEVEL = 4
#: Digests that a task remembers to drop copies before a shuffle.
REMEMBERED = 100_000


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_bytes(page_id: int | None, url: str | None, kind: str, refers_to: int | None, length: int, digest: str) -> bytes:
    """A record's exact header block; line ends in a url are percent-encoded. A revisit has no block of its own."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        VERSION,
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html", f"Content-Length: {0 if kind == 'revisit' else length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record_bytes(header: bytes, payload: bytes) -> bytes:
    return header + payload + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; lengths and end are checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != VERSION:
        raise ValueError(f"not a {VERSION} record")
    headers = dict(line.split(": ", 1) for line in lines)
    length = int(headers["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:length]


def _page_number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """Write the tables `headers` and `payloads` of an archive under a shared path."""
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "utf-8").alias("payload"))
    digests = materialize(source.select("page_id", "url", F.sha2("payload", 256).alias("strong"), F.sha1("payload").alias("weak"), F.octet_length("payload").cast("long").alias("size")), "warc-digests")
    holders = materialize(digests.groupBy("strong").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")), "warc-holders")
    held = join_unique(digests, holders, "strong", "n", digests.count())
    held.mapInArrow(_headers(least_bytes), "page_id long, strong string, header binary").write.parquet(f"{path}/headers")
    members = source.select("payload").mapInArrow(_members, "strong string, payload binary")
    members.repartition("strong").sortWithinPartitions("strong").mapInArrow(_first_of_each, "strong string, payload binary").write.parquet(f"{path}/payloads")


def _headers(least_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["page_id", "url", "weak", "size", "holder"]).to_pydict()
            out = []
            for page_id, url, weak, size, holder in zip(*rows.values(), strict=True):
                revisit = page_id is not None and page_id != holder and size >= least_bytes
                out.append(header_bytes(page_id, url, "revisit" if revisit else "response", holder if revisit else None, size, base64.b32encode(bytes.fromhex(weak)).decode()))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("strong"), pa.array(out, pa.binary())], names=["page_id", "strong", "header"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A gzip member of each payload; most copies are dropped before the shuffle."""
    seen: set[bytes] = set()
    for batch in batches:
        strong, members = [], []
        for payload in batch.column(0):
            payload = payload.as_py()
            digest = hashlib.sha256(payload).digest()
            if digest not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(digest)
                strong.append(digest.hex())
                members.append(gzip.compress(payload, GZIP_LEVEL, mtime=0))
        yield pa.RecordBatch.from_arrays([pa.array(strong, pa.string()), pa.array(members, pa.binary())], names=["strong", "payload"])


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each digest in a sorted partition that holds all its rows."""
    last = None
    for batch in batches:
        keep = []
        for strong in batch.column(0).to_pylist():
            keep.append(strong != last)
            last = strong
        yield batch.filter(pa.array(keep, pa.bool_()))


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]) of every record, from its rebuilt bytes."""
    headers, stored = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    joined = join_spread(headers.select("strong", "header"), stored, "strong").select("strong", "header", "payload")
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if payloads else [])]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, body, digest = None, b"", ""
        for batch in batches:
            out = []
            for strong, header, member in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if strong != last:
                    last, body = strong, gzip.decompress(member.as_py())
                    if hashlib.sha256(body).hexdigest() != strong:
                        raise ValueError(f"the payload stored as {strong} has another digest")
                    digest = base32_sha1(body)
                fields, _ = parse_record(record_bytes(header, b"" if b"\r\nWARC-Type: revisit\r\n" in header else body))
                if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
                    raise ValueError(f"a record's payload digest is not {digest}")
                out.append((_page_number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], len(body), digest, _page_number(fields.get("WARC-Refers-To")), body)[: len(names)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(names), types, strict=False)], names=names)

    return joined.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads)


def archive_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write an archive of the pages in the shared folder and read it back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archive(pages, path, **columns)
    return read_archive(pages.sparkSession, path)
