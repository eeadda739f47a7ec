import base64
import hashlib

from strandlake.llm import warc

ROWS = [(1, "u1", "same"), (5, "u5", "same"), (9, None, "same"), (2, "u\r\n2", None), (3, "u3", ""), (4, "é", "Ünï" * 40_000), (None, "n", "same"), (None, "m", "alone"), (7, "x", "rep"), (7, "x", "rep"), (6, "y", "rep")]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'h' as header", "1 as payload", "2 as strong").repartition(4)
    path = warc.fresh_path(spark, "warc-test")
    warc.write_archive(pages, path)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == stored.select("strong").distinct().count() == 5
    largest = {}
    for page, _, html in ROWS:
        if page is not None:
            largest[html or ""] = max(page, largest.get(html or "", page))
    want = []
    for page, url, html in ROWS:
        body, revisit = (html or "").encode(), page is not None and page != largest[html or ""]
        want.append((page, (url or "").replace("\r\n", "%0D%0A"), "revisit" if revisit else "response", len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), largest[html or ""] if revisit else None, body))
    got = [(*tuple(r)[:6], bytes(r.payload)) for r in warc.read_archive(spark, path, payloads=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted((tuple(r) for r in warc.read_archive(spark, path).collect()), key=str) == sorted((w[:6] for w in want), key=str)


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    path = warc.fresh_path(spark, "warc-test")
    warc.write_archive(pages, path, least_bytes=4)
    kinds = {(r.page_id, r.record_type) for r in warc.read_archive(spark, path).collect()}
    assert {(1, "revisit"), (9, "response"), (6, "response"), (2, "response"), (3, "response")} <= kinds


def test_empty(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_records_of_a_serial_file():
    header = warc.header_bytes(3, "http://a", "revisit", 8, 2, "AB")
    fields, block = warc.parse_record(warc.record_bytes(header, b""))
    assert block == b"" and fields["WARC-Refers-To"] == "<urn:page:8>" and fields["Content-Length"] == "0"
    fields, block = warc.parse_record(warc.record_bytes(warc.header_bytes(8, "http://a", "response", None, 2, "AB"), b"xy"))
    assert block == b"xy" and "WARC-Refers-To" not in fields


def test_hot_payload_and_repeated_ids(spark):
    """A third of 6,000 rows share a payload and a third one id and payload."""
    rows = [(i, None, "hot") if i % 3 == 0 else (7, "u", "same") if i % 3 == 1 else (i, "u", f"own {i}") for i in range(6000)]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)).collect()
    kinds = {}
    for r in got:
        kinds[r.record_type] = kinds.get(r.record_type, 0) + 1
    assert len(got) == 6000 and kinds == {"response": 4001, "revisit": 1999} and {r.refers_to for r in got} == {None, 5997}
