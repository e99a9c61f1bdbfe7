"""WARC archives: writing captures and assembling them again.

A capture is three records: a response (an HTTP response with the page's HTML in
UTF-8) or, where another page has the same payload, a revisit; a request; and
metadata. The last two name the first by WARC-Concurrent-To. Of pages with
equal payloads of `least` bytes or more the largest page_id is the response.
Spark's text sink writes the archives with gzip, with the two line ends that close
a record as its line separator, so a file appears whole or not at all. Its text
source reads them, and records are put together as they stream by: a file may be
of any size, and a task holds one record at a time.

A null html is an empty payload, a null url an empty target. A page without an
id keeps a null id and is a response. Repeated rows are captures of their own. Payloads may hold any text, also
WARC headers: records are read by their Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keep, new_path, with_mark

_SPACE = uuid.UUID("6f1c9f60-8f64-4b8e-9b8e-0d2a4c5b7e11")
_DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"
_NEXT = "\r\n\r\nWARC/1.1\r\n"  # where the text source cuts; a payload may hold it too
_RECORD = "record_type string, record_id string, concurrent_to string, target string, page_id bigint, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, record_id: str, target: str, block: str, content_type: str, more: dict[str, str]) -> str:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": _DATE, "WARC-Target-URI": target, **more, "Content-Type": content_type, "Content-Length": str(len(block.encode()))}
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n" + block


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def capture_records(name: str, page_id: int | None, url: str | None, html: str | None, n_bytes: int, digest: str, refers_to: int | None, refers_url: str | None) -> list[str]:
    """Texts of the three records of a capture, without the two line ends that close each. A revisit needs no html."""
    target = _one_line(url)
    ids = {k: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{k}/{name}')}>" for k in ("response", "request", "metadata")}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n"
    more = {"WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to is None:
        first = _record("response", ids["response"], target, http + (html or ""), "application/http;msgtype=response", more)
    else:
        more |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Target-URI": _one_line(refers_url), "WARC-Refers-To-Date": _DATE}
        first = _record("revisit", ids["response"], target, http, "application/http;msgtype=response", more)
    request = f"GET {target} HTTP/1.1\r\n\r\n"
    fields = "".join(f"{k}: {v}\r\n" for k, v in (("page-id", page_id), ("refers-to-page", refers_to)) if v is not None)
    with_first = {"WARC-Concurrent-To": ids["response"]}
    return [first, _record("request", ids["request"], target, request, "application/http;msgtype=request", with_first), _record("metadata", ids["metadata"], target, fields, "application/warc-fields", with_first)]


def _write(run_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                out = []
                for r in batch.slice(start, 500).to_pylist():
                    digest = base64.b32encode(bytes.fromhex(r["print"])).decode()
                    out += capture_records(f"{run_id}/{part}/{n}", r["page_id"], r["url"], r["html"], r["n_bytes"], digest, r["refers_to"], r["refers_url"])
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return run


def write_archives(pages: DataFrame, path: str, least: int = 0, records_per_file: int = 30_000) -> None:
    """Write the captures of all pages.

    Revisits are written from their prints alone. Responses stay where they are read:
    only pages that a bit map of the revisits' ids shows as possible ones are shuffled.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("print", F.sha1(F.encode("html", "UTF-8"))).withColumn("n_bytes", F.octet_length("html").cast("bigint"))
    prints = keep(rows.where((F.col("n_bytes") >= least) & F.col("page_id").isNotNull()).drop("html"), "prints")
    groups = prints.groupBy("print").agg(F.max(F.struct("page_id", "url")).alias("last"), F.min("page_id").alias("least")).where("last.page_id <> least").drop("least")
    revisits = prints.join(groups, "print").where("page_id <> last.page_id").select("page_id", "url", "print", "n_bytes", F.col("last.page_id").alias("refers_to"), F.col("last.url").alias("refers_url"))
    revisits = keep(revisits, "revisits")
    split = with_mark(rows, "page_id", revisits.select("page_id"), "_may")
    doubtful = split.where("_may").join(revisits.select("page_id", "print").distinct(), ["page_id", "print"], "left_anti")
    responses = split.where("not _may").unionByName(doubtful).drop("_may").withColumns({"refers_to": F.lit(None).cast("bigint"), "refers_url": F.lit(None).cast("string")})
    every = responses.unionByName(revisits.withColumn("html", F.lit(None).cast("string")))
    every.mapInArrow(_write(path.rsplit("/", 1)[1]), "value string").write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _fields(raw: bytes) -> dict[str, str]:
    lines = (line.partition(":") for line in raw.decode().split("\r\n"))
    return {k.strip().lower(): v.strip() for k, colon, v in lines if colon}


def parse_record(raw: bytes, payload: bool) -> tuple[tuple, int] | None:
    """The record that bytes begin with and where it ends, or None if they hold less than a record."""
    block_at = raw.find(b"\r\n\r\n") + 4
    if block_at < 4:
        return None
    head = _fields(raw[:block_at])
    stop = block_at + int(head["content-length"])
    if stop > len(raw):
        return None
    kind, page, refers, n_bytes, digest, body = head["warc-type"], None, None, None, None, None
    if kind == "metadata":
        fields = _fields(raw[block_at:stop])
        page, refers = (int(fields[k]) if k in fields else None for k in ("page-id", "refers-to-page"))
    elif kind in ("response", "revisit"):
        http_end = raw.index(b"\r\n\r\n", block_at) + 4
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response":
            body = raw[http_end:stop]
            n_bytes, real = len(body), base32_sha1(body)
            if real != digest:
                raise ValueError(f"payload of {head['warc-record-id']} has digest {real}, not {digest}")
        else:
            n_bytes = int(_fields(raw[block_at:http_end])["content-length"])
    return (kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-target-uri"), page, refers, n_bytes, digest, body if payload else None), stop


def _whole(raw: bytes) -> int:
    """Length of the record that bytes begin with, 0 if its head isn't whole yet."""
    block_at = raw.find(b"\r\n\r\n") + 4
    return block_at + int(_fields(raw[:block_at])["content-length"]) if block_at >= 4 else 0


class RecordStream:
    """Records of archives whose pieces, cut at _NEXT, arrive in order.

    Once a record's head is there, its pieces are joined when they are as long as it says, however many times a payload holds _NEXT.
    """

    def __init__(self, payload: bool):
        self.payload, self.name, self.held, self.size, self.need = payload, None, [], 0, 0

    def add(self, name: str, piece: bytes) -> Iterator[tuple]:
        if name != self.name:
            yield from self.end()
            self.name, self.held, self.size = name, [piece], len(piece)
            return
        # a record ends where a piece does, if the piece is whole
        if self.size >= self.need:
            yield from self._records(False)
        self.held.append(_NEXT.encode() + piece)
        self.size += len(self.held[-1])

    def _records(self, last: bool) -> Iterator[tuple]:
        raw, self.need = b"".join(self.held), 0
        while raw:
            raw = raw[4:] if raw.startswith(b"\r\n\r\n") else raw
            found = parse_record(raw, self.payload) if raw else None
            if found is None:
                if last and raw.strip():
                    raise ValueError(f"{self.name} ends within a record")
                self.need = _whole(raw)
                break
            yield found[0]
            raw = raw[found[1] :]
        self.held, self.size = [raw] if raw else [], len(raw)

    def end(self) -> Iterator[tuple]:
        yield from self._records(True)
        self.held = []


def _read(payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.string()] * 4, *[pa.int64()] * 3, pa.string(), pa.binary()]
        names = [c.split()[0] for c in _RECORD.split(", ")]
        stream = RecordStream(payload)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

        for batch in batches:
            out: list[tuple] = []
            for name, piece in zip(batch.column("name"), batch.column("value"), strict=True):
                out += stream.add(name.as_py(), piece.as_buffer().to_pybytes())
                if len(out) >= 1000:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)
        yield batch_of(list(stream.end()))

    return run


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row for each record of the archives in a folder. Gzip files are read whole and in order, each by one task."""
    pieces = spark.read.option("lineSep", _NEXT).text(path).select(F.col("_metadata.file_path").alias("name"), "value")
    return pieces.mapInArrow(_read(payload), _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, page_id, response (or revisit), request, metadata.

    Requests and metadata join the record they name as concurrent; one without is left null.
    """
    main = records.where("record_type in ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), F.struct("record_type", "target", "payload_bytes", "payload_digest", "payload").alias("response"))
    request = records.where("record_type = 'request'").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "target").alias("request"))
    metadata = records.where("record_type = 'metadata'").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "page_id", "refers_to").alias("metadata"))
    return main.join(request, "capture_id", "left").join(metadata, "capture_id", "left")


def archived_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to new archives and report what these hold: page_id, payload_bytes, payload_digest, record_type, refers_to, request_target."""
    spark = pages.sparkSession
    path = new_path(spark, "archives")
    write_archives(pages, path, least)
    captures = assemble(keep(read_records(spark, path, payload=False), "records"))
    return captures.select("metadata.page_id", "response.payload_bytes", "response.payload_digest", "response.record_type", "metadata.refers_to", F.col("request.target").alias("request_target"), "capture_id")
