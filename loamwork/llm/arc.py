"""Legacy archives: ARC records become WARC records, with revisits for repeated payloads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions.joins import sized_join
from loamwork.functions.storage import new_path, stage

#: The field names of a record's header line in the two versions of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "uri string, ip string, date string, content_type string, warc_type string, record_id string, http binary, payload binary, payload_bytes long, payload_sha1 string, truncated boolean"
BACK = "warc_type string, record_id string, uri string, date string, http string, payload_bytes long, payload_sha1 string, refers_to string, intact boolean"


def arc_file(records: list[tuple[str, str, str, str, bytes]], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file: a version block, then (url, ip, date, type, content) records."""
    text = f"{version} 0 loamwork\n{FIELDS[version]}\n\n".encode()
    out = [_arc_line(version, f"filedesc://{name}", "0.0.0.0", "20240101000000", "text/plain", len(text), name), text, b"\n"]
    for url, ip, date, kind, content in records:
        out += [_arc_line(version, url, ip, date, kind, len(content), name), content, b"\n"]
    return b"".join(out)


def _arc_line(version: int, url: str, ip: str, date: str, kind: str, length: int, name: str) -> bytes:
    middle = [kind] if version == 1 else [kind, "200", "-", "-", "0", name]
    return (" ".join([url, ip, date, *middle, str(length)]) + "\n").encode()


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(header fields, content, truncated) of each record after the version block of an ARC file (gzipped or not).

    The first digit of the version block says how many fields a header line has. A URL may hold blanks: the other
    fields are taken from the right. The content is as long as the header declares, whatever bytes it holds; a record
    that the file's end cuts is truncated, and a line that is no header ends the file.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, names = 0, FIELDS[1].split()
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            return
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        at = end + 1
        if not line:
            continue
        parts = line.rsplit(" ", len(names) - 1 if not line.startswith("filedesc:") else line.count(" "))
        if not parts[-1].isdigit():
            return
        length = int(parts[-1])
        content = data[at : at + length]
        at += length
        if line.startswith("filedesc:"):
            if content[:1] in (b"1", b"2"):
                names = FIELDS[int(content[:1])].split()
            continue
        if len(parts) == len(names):
            yield dict(zip(names, parts, strict=True)), content, len(content) < length


def warc_date(stamp: str) -> str:
    """YYYYMMDDhhmmss as 2024-01-31T12:00:00Z; missing parts are taken as the earliest."""
    s = (stamp if stamp.isdigit() else "")[:14]
    s += "19700101000000"[len(s) :]
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


def arc_records(blobs: DataFrame) -> DataFrame:
    """What WARC needs of each record of ARC files: RECORDS. blobs: a column content (binary), as binaryFile gives it.

    HTTP records are split at the end of their header block and become responses; all else becomes a resource. The
    record's identifier is a UUID made from the SHA-1 of its header and content, so conversion can be repeated.
    """

    def convert(batches):
        for batch in batches:
            for blob in batch.column(0):
                rows = []
                for head, content, cut in parse_arc(blob.as_py() or b""):
                    web = head["URL"].startswith(("http://", "https://")) or content[:5] == b"HTTP/"
                    split = content.find(b"\r\n\r\n") if content[:5] == b"HTTP/" else -1
                    http, payload = (content[: split + 4], content[split + 4 :]) if split >= 0 else (b"", content)
                    whole = hashlib.sha1(" ".join(head.values()).encode() + content).digest()
                    rows.append((head["URL"], head["IP-address"], warc_date(head["Archive-date"]), head["Content-type"], "response" if web else "resource", f"urn:uuid:{uuid.UUID(bytes=whole[:16], version=5)}", http, payload, len(payload), hashlib.sha1(payload).hexdigest(), cut))
                    if sum(len(r[7]) for r in rows[-64:]) > 8_000_000 or len(rows) >= 2000:
                        yield _batch(rows, RECORDS)
                        rows = []
                if rows:
                    yield _batch(rows, RECORDS)

    return blobs.select("content").mapInArrow(convert, RECORDS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def with_revisits(records: DataFrame, order: Column, least: int = 1000) -> DataFrame:
    """records with first_id, first_uri, first_date: null, or the record that a revisit refers to.

    Of records with equal payloads of `least` bytes or more, the one of the largest `order` stays (all that share it);
    the others revisit it. records is read twice. Digests that repeat are counted before rows meet them, so a payload
    that a third of all records share is one row there.
    """
    rows = records.withColumn("_order", order)
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("payload_sha1")
    top = F.max(F.struct("_order", "record_id", "uri", "date"))
    firsts = groups.agg(F.count(F.lit(1)).alias("n"), top.alias("t")).where("n > 1 AND t._order IS NOT NULL")
    firsts = stage(firsts.select("payload_sha1", F.col("t._order").alias("_top"), F.col("t.record_id").alias("first_id"), F.col("t.uri").alias("first_uri"), F.col("t.date").alias("first_date")), "firsts")
    joined = sized_join(rows, firsts, ["payload_sha1"], "left", 200_000)
    own = F.coalesce(F.col("_order") == F.col("_top"), F.lit(False))
    gone = lambda c: F.when(~own, F.col(c)).alias(c)
    return joined.select(*records.columns, gone("first_id"), gone("first_uri"), gone("first_date"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write records (RECORDS with first_id, first_uri, first_date) as gzipped WARC/1.1 files, one for each partition.

    Spark's writer puts the files where Spark can reach, and commits them: a lost task leaves none behind. It ends each
    value with a line feed, which is the record's own last byte.
    """

    def render(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                revisit = r["first_id"] is not None
                block = r["http"] if revisit else r["http"] + r["payload"]
                digest = "sha1:" + base64.b32encode(bytes.fromhex(r["payload_sha1"])).decode()
                kind = "revisit" if revisit else r["warc_type"]
                head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["uri"]), ("WARC-IP-Address", r["ip"])]
                head += [("WARC-Payload-Digest", digest), ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())]
                if revisit:
                    head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{r['first_id']}>"), ("WARC-Refers-To-Target-URI", r["first_uri"]), ("WARC-Refers-To-Date", r["first_date"])]
                if r["truncated"]:
                    head.append(("WARC-Truncated", "length"))
                head += [("Content-Type", "application/http; msgtype=response" if r["http"] else r["content_type"]), ("Content-Length", str(len(block)))]
                out.append("".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + b"\r\n\r")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    lines = records.mapInArrow(render, "value binary").select(F.col("value").cast("string"))
    lines.write.option("compression", "gzip").option("lineSep", "\n").text(path)


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a WARC stream, by declared lengths."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, stream.read(int(head.get("content-length", "0")))
        stream.readline()
        stream.readline()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """BACK for each record of the WARC files (gzipped or not) in a folder, unpacked as a stream.

    payload_bytes and payload_sha1 are those of the payload at hand; for a revisit, those that its HTTP header and its
    digest declare. intact: the digests found are those declared.
    """

    def read(batches):
        for batch in batches:
            for blob in batch.column(0):
                data = blob.as_py()
                stream = io.BytesIO(data)
                rows = []
                for head, block in parse_warc(io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20) if data[:2] == b"\x1f\x8b" else stream):
                    web = head.get("content-type", "").startswith("application/http")
                    split = block.find(b"\r\n\r\n") if web else -4
                    http, payload = block[: split + 4], block[split + 4 :]
                    said = base64.b32decode(head.get("warc-payload-digest", "sha1:").partition(":")[2]).hex()
                    found, n = hashlib.sha1(payload).hexdigest(), len(payload)
                    intact = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() == head.get("warc-block-digest")
                    if head["warc-type"] == "revisit":
                        found, fields = said, dict(x.lower().split(": ", 1) for x in http.decode("utf-8", "replace").split("\r\n") if ": " in x)
                        n = int(fields.get("content-length", "0"))
                    rows.append((head["warc-type"], head["warc-record-id"].strip("<>"), head.get("warc-target-uri"), head.get("warc-date"), http.decode("utf-8", "replace"), n, found, head.get("warc-refers-to", "").strip("<>") or None, intact and said == found))
                    if len(rows) >= 5000:
                        yield _batch(rows, BACK)
                        rows = []
                if rows:
                    yield _batch(rows, BACK)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, BACK)


def page_arcs(pages: DataFrame, most: int = 2_000_000) -> DataFrame:
    """pages (page_id, url, html) as ARC files of about `most` bytes in a column content, in both versions by turns.

    The page's number travels in its HTTP header. A null or empty URL becomes `-`, blanks in it %20; a null html is an
    empty payload.
    """

    def build(batches):
        version = 1
        for batch in batches:
            rows, size = [], 0
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                body = (html.as_py() or "").encode()
                mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(body)}\r\n\r\n".encode()
                rows.append(("%20".join((url or "-").split()) or "-", "192.0.2.1", "20240101000000", "text/html", http + body))
                size += len(body)
                if size > most:
                    yield pa.RecordBatch.from_arrays([pa.array([arc_file(rows, version)], pa.binary())], ["content"])
                    rows, size, version = [], 0, 3 - version
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([arc_file(rows, version)], pa.binary())], ["content"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(build, "content binary")


def archive_pages(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from WARC files.

    The pages are held as ARC files, converted, written to the shared folder as WARC files and read again. Repeated
    rows of the largest page_id are all responses; a page without an id is a response only if no copy has one.
    """
    spark = pages.sparkSession
    number = lambda c: F.regexp_extract(c, r"\r\nX-Page-Id: (-?[0-9]+)\r\n", 1).try_cast("long")
    records = with_revisits(arc_records(page_arcs(pages)), number(F.col("http").cast("string")), least)
    path = new_path(spark, "warc")
    write_warc(records, path)
    back = stage(read_warc(spark, path).withColumn("page_id", number(F.col("http"))).drop("http", "uri"), "warc-read")
    spoilt = back.where("NOT intact").count()
    if spoilt:
        raise ValueError(f"{spoilt} records differ from their digests")
    told = back.where("refers_to IS NOT NULL").select(F.col("refers_to").alias("record_id")).distinct()
    named = back.select("record_id", "page_id").join(told, "record_id", "left_semi").groupBy("record_id").agg(F.max("page_id").alias("first"))
    out = back.alias("l").join(named.withColumnRenamed("record_id", "refers_to").alias("r"), "refers_to", "left")
    return out.select("page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.col("first").alias("refers_to"))
