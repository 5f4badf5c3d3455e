"""WARC archives: writing captures, reading them back and assembling transactions.

A capture is three records: the response (or, where an equal payload is stored already, a revisit),
the request, and metadata; request and metadata name the response in ``WARC-Concurrent-To``. The
archives are gzip files written by Spark's text writer with the record separator as line
separator, and read the same way, so any store Spark reaches will do; a file is read by one task as
a stream, record by record, whatever its size. Assembly joins the records on the concurrent-to
identifiers and emits one nested row for each capture.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, shared_dir, stored, table, text_or_empty, with_row
from .kernels import tidy

#: Smaller payloads are always stored in full.
REVISIT_BYTES = 1000
#: Records of an archive file; larger partitions make several files.
FILE_RECORDS = 30_000
BROADCAST_GROUPS = 500_000
VERSION = "WARC/1.1"
SEPARATOR = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RESPONSE_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def decide(pages: DataFrame) -> DataFrame:
    """``digest, strong, keeper, keeper_id`` of each payload of ``REVISIT_BYTES`` or more that several
    pages share: the largest page_id stores it (a null id only if no other is there).

    Digests only route: what shares one is grouped by its bytes, and ``strong``, another digest,
    tells the payloads of one ``digest`` apart.
    """
    rows = with_row(pages.select("page_id", text_or_empty("html").alias("html")), "row").filter(F.octet_length("html") >= REVISIT_BYTES)
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    shared = stored(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "warc-digests")
    same = rows.join(broadcast_if(shared, BROADCAST_GROUPS), "digest").groupBy("digest", "html")
    kept = same.agg(F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "row")).alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    keeper = kept.select("digest", F.sha2("html", 256).alias("strong"), F.col("kept.page_id").alias("page_id"), F.col("kept.row").alias("row"))
    return keeper.select("digest", "strong", F.col("page_id").alias("keeper"), _urn("response", "row", "page_id").alias("keeper_id"))


def _urn(role: str, *parts: str) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(role), *parts))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))))


def _record(kind: Column | str, record_id: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its last separator, which the writer puts. Null fields are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit(f"{VERSION}\r\nWARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(SEPARATOR), block)


def records(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """``value``: three WARC records for each row of ``pages`` (``page_id, url, html``)."""
    rows = with_row(pages.select("page_id", F.regexp_replace(text_or_empty("url"), "[\\x00-\\x20]", "%20").alias("url"), text_or_empty("html").alias("html")), "row")
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    rows = rows.withColumn("strong", F.when(F.col("size") >= REVISIT_BYTES, F.sha2("html", 256)))
    rows = rows.join(broadcast_if(repeated, BROADCAST_GROUPS), ["digest", "strong"], "left")
    revisit = F.coalesce(F.col("keeper_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.lit(False))
    rows = rows.withColumn("revisit", revisit).withColumn("id", _urn("response", "row", "page_id"))
    url, digest = ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))
    page = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.concat(F.lit(RESPONSE_HEAD), F.col("size").cast("string"), F.lit(SEPARATOR))
    block = F.when(F.col("revisit"), head).otherwise(F.concat(head, "html"))
    profile = ("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    refers = ("WARC-Refers-To", F.when(F.col("revisit"), F.col("keeper_id")))
    response = _record(F.when(F.col("revisit"), "revisit").otherwise(F.lit("response")), F.col("id"), [url, digest, profile, refers, ("Content-Type", F.lit("application/http;msgtype=response"))], block)
    concurrent = ("WARC-Concurrent-To", F.col("id"))
    get = F.concat(F.lit("GET "), "url", F.lit(" HTTP/1.1" + SEPARATOR))
    request = _record("request", _urn("request", "row", "page_id"), [url, concurrent, ("Content-Type", F.lit("application/http;msgtype=request"))], get)
    notes = F.concat(F.lit("page-id: "), page("page_id"), F.lit("\r\nrefers-to-page-id: "), F.when(F.col("revisit"), page("keeper")).otherwise(F.lit("")), F.lit("\r\n"))
    metadata = _record("metadata", _urn("metadata", "row", "page_id"), [url, concurrent, ("Content-Type", F.lit("application/warc-fields"))], notes)
    return rows.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_warc(pages: DataFrame, path: str) -> None:
    """Archive every row of ``pages`` below ``path``.

    Payloads of at least ``REVISIT_BYTES`` with equal bytes are stored once, with the largest page_id;
    rows that repeat that id with that payload are stored in full again. A null html is an empty
    payload; null urls are empty; a null page_id stores a payload only where no other id has it.
    """
    repeated = stored(decide(pages), "warc-repeated")
    records(pages, repeated).write.option("compression", "gzip").option("lineSep", SEPARATOR).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(pieces, with_payload: bool = True):
    """Records from the ordered pieces of one file between separators."""
    buffer, need, header = bytearray(), 0, None
    for piece in pieces:
        buffer += piece
        buffer += SEPARATOR.encode()
        while True:
            if header is None:
                while buffer[:2] == b"\r\n":  # the reader takes the last separator of a file away
                    del buffer[:2]
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                lines = bytes(buffer[:end]).decode("utf-8", "surrogateescape").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
                header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                del buffer[: end + 4]
                need = int(header["content-length"]) + 4
            if len(buffer) < need:
                break
            block = bytes(buffer[: need - 4])
            del buffer[:need]
            payload = None
            if header["warc-type"] in ("response", "revisit", "request"):
                head, _, payload = block.partition(b"\r\n\r\n")
                header["http-head"] = head.decode("latin-1")
                block = b""
            yield header, block, payload
            header = None
    if header is not None or buffer.strip(b"\r\n"):
        raise ValueError("a WARC file ends inside a record")


def _http_length(head: str) -> int | None:
    for line in head.split("\r\n")[1:]:
        name, _, value = line.partition(":")
        if name.lower() == "content-length":
            return int(value)
    return None


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record of the archives below ``path``.

    Payloads of responses are checked against their digests (a mismatch raises) and, unless
    ``with_payload``, dropped where they are read.
    """
    names = ["record_id", "type", "concurrent_to", "refers_to", "url", "date", "digest", "payload_bytes", "notes", "http_head", "payload"]

    def run(batches):
        def files():
            """(path, iterator over its pieces): pieces come in order, one file after the other."""
            state = {"it": ((p, v) for b in batches for p, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))}
            item = next(state["it"], None)
            while item is not None:
                current, held = item[0], [item]

                def pieces():
                    held_ = held.pop() if held else None
                    while held_ is not None and held_[0] == current:
                        yield held_[1]
                        held_ = next(state["it"], None)
                    state["next"] = held_

                yield pieces()
                item = state.get("next")

        out, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), kinds)], names=names)

        kinds = [pa.string()] * 7 + [pa.int64()] + [pa.string()] * 2 + [pa.binary()]
        for pieces in files():
            for h, block, payload in parse(pieces):
                kind, digest = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                length = None
                if kind == "response":
                    length = len(payload)
                    if digest and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {h['warc-record-id']} does not have its digest")
                elif kind == "revisit":
                    length, payload = _http_length(h["http-head"]), None
                notes = block.decode("utf-8") if kind == "metadata" else None
                keep = payload if with_payload and kind == "response" else None
                out.append((h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), digest, length, notes, h.get("http-head"), keep))
                size += len(keep or b"")
                if len(out) >= 2000 or size > 1 << 24:
                    yield batch()
                    out, size = [], 0
        if out:
            yield batch()

    lines = spark.read.option("lineSep", SEPARATOR).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(tidy(run), "record_id string, type string, concurrent_to string, refers_to string, url string, date string, digest string, payload_bytes long, notes string, http_head string, payload binary")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: ``record_id, response, request, metadata``.

    Requests and metadata join their response or revisit on concurrent-to identifiers; a capture
    without request or metadata has null there, and records that name no capture are left out.
    """
    response = records.filter(F.col("type").isin("response", "revisit")).select(
        "record_id", F.struct("type", "refers_to", "url", "date", "digest", "payload_bytes", "http_head", "payload").alias("response")
    )
    request = records.filter("type = 'request'").select(F.col("concurrent_to").alias("record_id"), F.struct("record_id", "url", "http_head").alias("request"))
    field = lambda name: F.nullif(F.regexp_extract("notes", f"(?m)^{name}: ([^\\r\\n]*)", 1), F.lit(""))
    metadata = records.filter("type = 'metadata'").select(
        F.col("concurrent_to").alias("record_id"), F.struct("record_id", field("page-id").alias("page_id"), field("refers-to-page-id").alias("refers_to")).alias("metadata")
    )
    return response.join(request, "record_id", "left").join(metadata, "record_id", "left")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back. A null html is an empty payload; null page_ids
    come back as null and store a payload only where no other id has it; rows that repeat an id each
    make a capture; an empty table gives no rows."""
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/flowloom/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    captures = assemble(stored(read_warc(spark, path, with_payload=False), "warc-records"))
    kind = pages.schema["page_id"].dataType
    return captures.select(
        F.col("metadata.page_id").cast(kind).alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("metadata.refers_to").cast(kind).alias("refers_to"),
    )


QUERIES = {"op7_warc": op7_warc}
ORACLES = {
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest,
             max(page_id) OVER (PARTITION BY html) AS largest FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN largest END AS refers_to
FROM q"""
}
