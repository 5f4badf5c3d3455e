import hashlib

import pytest

from flowloom.llm import warc
from flowloom.llm.warc import assemble, op7_warc, parse, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, `row` string, digest string"


@pytest.fixture
def pages(spark, tmp_path):
    big, other = "<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 1000, "y" * 999
    rows = [(1, "http://a/ b\r\n", big), (2, None, big), (3, "u", big), (4, "u", other), (5, "u", other), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "\r\n\r\n"), (9, "u", "z\r\n\r"), (10, "u", "k" * 1000)]
    rows += [(3, "u", big), (100, "u", "\n" * 300_000)]
    path = str(tmp_path / "pages")
    spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3).write.parquet(path)
    return rows, spark.read.parquet(path)


def test_round_trip(spark, pages, monkeypatch, tmp_path):
    rows, table = pages
    monkeypatch.setattr(warc, "FILE_RECORDS", 5)
    write_warc(table, str(tmp_path / "w"))
    got = assemble(read_warc(spark, str(tmp_path / "w"))).collect()
    assert len(got) == len(rows)
    stored = sorted((str(r.metadata.page_id), r.response.payload.decode()) for r in got if r.response.type == "response")
    big = rows[0][2]
    assert stored == sorted((str(i), h or "") for i, _, h in rows if h != big or i == 3)
    stores = {r.record_id: r.metadata.page_id for r in got if r.response.type == "response"}
    assert {stores[r.response.refers_to] for r in got if r.response.type == "revisit"} == {"3"}
    assert all(r.response.refers_to is None for r in got if r.response.type == "response")
    assert all(r.request.http_head.startswith("GET ") and r.response.http_head.startswith("HTTP/1.1 200") for r in got)
    assert {r.request.url for r in got if r.metadata.page_id == "1"} == {"http://a/%20b%20%20"}


def test_digests_only_route(spark, pages, monkeypatch, tmp_path):
    """Payloads that share a digest are told apart by their bytes."""
    monkeypatch.setattr(warc.F, "sha1", lambda c: warc.F.lit("d"))
    rows = [(1, "u", "a" * 2000, "x", "y"), (2, "u", "a" * 2000, "x", "y"), (9, "u", "b" * 2000, "x", "y")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "p"))
    got = warc.decide(spark.read.parquet(str(tmp_path / "p"))).collect()
    assert [(r.digest, r.keeper) for r in got] == [("d", 2)]


def test_query(spark, pages, monkeypatch):
    rows, table = pages
    monkeypatch.setattr(warc, "table", lambda *_: table)
    big, want = rows[0][2], []
    for i, _, h in rows:
        b = (h or "").encode()
        again = h == big and i != 3
        want.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 3 if again else None))
    got = op7_warc(spark, "").collect()
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)


def test_empty_and_broken(spark, monkeypatch):
    monkeypatch.setattr(warc, "table", lambda *_: spark.createDataFrame([], SCHEMA))
    assert op7_warc(spark, "").count() == 0
    with pytest.raises(ValueError):
        list(parse([b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 10", b"short"]))
    with pytest.raises(ValueError):
        list(parse([b"HTTP/1.1 200 OK"]))
