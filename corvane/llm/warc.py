"""WARC archives: writing, reading, and revisit resolution.

A record is one row of bytes; Spark's text writer joins the rows by the two line ends that close a record, so archives
are committed like any other output and land in any store Spark reaches. A file is closed after as many records as have
about ``FILE_BYTES`` on the average. Archives are read as whole files, unpacked a piece at a time and cut by the length
each record states; a record is known by its file and its place there, as ids may repeat.

Resolution shuffles headers alone: they are grouped by payload digest (an aggregate with map-side combine, so a payload
that a third of all records share is no hot group), and every other record of a digest is joined to the original. The
decisions about a file are a list beside it when it is written anew: what stays is passed on byte by byte, and what
repeats an original gets a fresh header. Payloads are not shuffled where the decisions are few enough to broadcast, and
their packed archives once where they are not.

Cases: a null payload is empty, a null URL is an empty target; line ends in a URL are percent-encoded; of records with
equal payloads the smallest id is the original (null ids come last, then record id, URL, date, file and place decide);
pages that repeat, and archives that hold the same records, are records of their own, of which one stays a response; a
repeat under its original's record id gets an id of its own; a revisit record whose original is not in the archives stays
as it is; page ids are whole numbers, others raise an error; a record of any length stands in memory as a whole; an empty
table makes an empty archive; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import parts_of, stored

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
FILE_BYTES = 1 << 26  # of records in a file, before they are packed
BROADCAST_DECISIONS = 1_000_000  # about 150 bytes each; more of them are joined by a shuffle
HEADERS = (
    "record_id string, page_id bigint, url string, date string, record_type string, payload_bytes bigint, "
    "payload_digest string, refers_to bigint, refers_to_id string, refers_to_url string, refers_to_date string"
)
NAMES = [x.split()[0] for x in HEADERS.split(", ")]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(head: dict, payload: bytes | None) -> bytes:
    """The bytes of a record without the closing line ends. ``payload`` is None for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {head['payload_bytes']}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = [
        VERSION,
        f"WARC-Type: {head['record_type']}",
        f"WARC-Record-ID: <urn:uuid:{head['record_id']}>",
        f"WARC-Target-URI: {_one_line(head['url'])}",
        f"WARC-Date: {head['date']}",
        f"WARC-Payload-Digest: sha1:{head['payload_digest']}",
    ]
    if head["page_id"] is not None:
        lines.append(f"X-Page-Id: {head['page_id']}")
    if head["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
        lines.append(f"WARC-Refers-To: <urn:uuid:{head['refers_to_id']}>")
        lines.append(f"WARC-Refers-To-Target-URI: {_one_line(head['refers_to_url'])}")
        lines.append(f"WARC-Refers-To-Date: {head['refers_to_date']}")
        if head["refers_to"] is not None:
            lines.append(f"X-Refers-To-Page-Id: {head['refers_to']}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + block


def _one_line(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def parse_records(chunks: Iterator[bytes]) -> Iterator[tuple[int, dict, bytes, bytes]]:
    """(place, header, block, whole record) of each record of an archive that comes in pieces."""
    buffer, at, passed = b"", 0, 0  # what lies before the cursor ``at`` is dropped when more is read

    def more(n: int) -> bool:
        nonlocal buffer, at, passed
        have = len(buffer) - at
        if have < n:
            parts = [buffer[at:]]
            while have < n and (piece := next(chunks, None)) is not None:
                parts.append(piece)
                have += len(piece)
            passed += at
            buffer, at = b"".join(parts), 0
        return have >= n

    while more(1):
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more(len(buffer) - at + 1):
                if buffer[at:].strip():
                    raise ValueError("an archive ends within a header")
                return
        first, *fields = buffer[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("a record does not start with a version line")
        head = {k.lower(): v for k, _, v in (f.partition(": ") for f in fields)}
        size, length = int(head["content-length"]), end + 4 - at
        if not more(length + size):
            raise ValueError("an archive ends within a block")
        yield passed + at, head, buffer[at + length : at + length + size], buffer[at : at + length + size]
        at += length + size
        more(4)
        if buffer.startswith(b"\r\n\r\n", at):
            at += 4


def _pieces(content: bytes, size: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of an archive, gzip members unpacked, a piece at a time."""
    view = memoryview(content)
    if content[:2] != b"\x1f\x8b":
        yield from (bytes(view[i : i + size]) for i in range(0, len(view), size))
        return
    unpack, at = zlib.decompressobj(31), 0
    while at < len(view):
        yield unpack.decompress(view[at : at + size])
        at += size
        if unpack.eof:
            at = min(at, len(view)) - len(unpack.unused_data)
            unpack = zlib.decompressobj(31)


def _urn(value: str | None) -> str | None:
    return value.removeprefix("<urn:uuid:").removesuffix(">") if value else None


def _row(head: dict, block: bytes) -> tuple[tuple, bytes | None]:
    """The values of HEADERS, and the payload of what is not a revisit."""
    cut = block.find(b"\r\n\r\n") + 4
    payload = block[cut:] if head["warc-type"] != "revisit" else None
    if payload is None:
        stated = next((int(x[16:]) for x in block[:cut].split(b"\r\n") if x.lower().startswith(b"content-length: ")), 0)
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    else:
        stated, digest = len(payload), digest_of(payload)
    page, origin = head.get("x-page-id"), head.get("x-refers-to-page-id")
    return (
        _urn(head["warc-record-id"]), int(page) if page else None, head.get("warc-target-uri", ""), head.get("warc-date"),
        head["warc-type"], stated, digest, int(origin) if origin else None, _urn(head.get("warc-refers-to")),
        head.get("warc-refers-to-target-uri"), head.get("warc-refers-to-date"),
    ), payload


def _save(records: DataFrame, path: str, per_file: int) -> None:
    values = records.select(F.col("record").cast("string").alias("value"))
    packed = values.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    packed.option("maxRecordsPerFile", per_file).text(path)


def _per_file(total: int | None, records: int) -> int:
    """Records that fill a file, at their average size and about 600 bytes of headers."""
    return max(1, FILE_BYTES * records // ((total or 0) + 600 * records)) if records else 1


def write_archive(df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = DATE) -> None:
    """Every row as a response record."""
    rows = df.select(F.col(page_id).cast("bigint"), F.col(url).cast("string"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")))
    size = df.agg(F.sum(F.octet_length(payload)), F.count(F.lit(1))).first()

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        for batch in parts_of(batches):
            out = []
            for page, target, body in zip(*(c.to_pylist() for c in batch.columns)):
                number += 1
                head = {"record_type": "response", "page_id": page, "url": target, "date": date, "payload_bytes": len(body)}
                head["payload_digest"] = digest_of(body)
                head["record_id"] = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{task}/{number}/{page}/{target}"))
                out.append(build_record(head, body))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    _save(rows.mapInArrow(run, "record binary"), path, _per_file(*size))


def read_archive(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The headers of all records (lengths and digests taken anew from the payloads that are there) with their ``file`` and
    place ``at``, payloads if asked."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    target = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to", "at") else pa.string()) for n in [*NAMES, "file", "at"]])
    if payload:
        target = target.append(pa.field("payload", pa.binary()))

    def sheet(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)] if rows else [pa.array([], f.type) for f in target], schema=target)

    def run(batches):
        for batch in batches:
            for name, content in zip(*batch.columns):
                rows, held, name = [], 0, name.as_py()
                for at, head, block, _ in parse_records(_pieces(content.as_py())):
                    row, body = _row(head, block)
                    rows.append((*row, name, at, body) if payload else (*row, name, at))
                    held += len(body or b"") if payload else 500
                    if held > 1 << 23:
                        yield sheet(rows)
                        rows, held = [], 0
                yield sheet(rows)

    return files.mapInArrow(run, HEADERS + ", file string, at bigint" + ", payload binary" * payload)


def resolve(headers: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """(file, at, and the original's id, page, URL and date) of each record that repeats an original's payload."""
    rank = F.struct(F.col("page_id").isNull(), "page_id", "record_id", "url", "date", "file", "at")
    first = F.min(F.when(F.col("record_type") == "response", rank)).alias("first")
    large = headers.where(F.col("payload_bytes") >= min_bytes)
    originals = large.groupBy("payload_digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    named = originals.select("payload_digest", "first.*").toDF("payload_digest", "no_page", *ORIGINAL, "new_file", "new_at")
    originals = stored(named.drop("no_page"), f"{folder}/originals")
    joined = large.select("file", "at", "payload_digest").join(originals, "payload_digest")
    return joined.where("file <> new_file OR at <> new_at").select("file", "at", *ORIGINAL)


ORIGINAL = ("new_page", "new_id", "new_url", "new_date")


def deduplicate(spark: SparkSession, path: str, out: str, folder: str, min_bytes: int = 0) -> None:
    """Read archives at ``path`` and write them to ``out`` with every repeated payload as a revisit record."""
    headers = stored(read_archive(spark, path), f"{folder}/headers")
    decisions = stored(resolve(headers, folder, min_bytes), f"{folder}/decisions")
    size = headers.agg(F.sum("payload_bytes"), F.count(F.lit(1))).first()
    # As many decisions for a file as it has records, which is bounded when it is written.
    lists = decisions.groupBy("file").agg(F.collect_list(F.struct("at", *ORIGINAL)).alias("repeats"))
    lists = F.broadcast(lists) if decisions.count() <= BROADCAST_DECISIONS else lists
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content").join(lists, "file", "left")

    def run(batches):
        for batch in batches:
            for name, content, repeats in zip(*batch.columns):
                told = {r["at"]: r for r in repeats.as_py() or ()}
                records, held, name = [], 0, name.as_py()
                for at, head, block, whole in parse_records(_pieces(content.as_py())):
                    records.append(whole if at not in told else _revisit(head, block, told[at], f"{name}/{at}"))
                    held += len(records[-1])
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])
                        records, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    _save(files.select("file", "content", "repeats").mapInArrow(run, "record binary"), out, _per_file(*size))


def _revisit(head: dict, block: bytes, original: dict, place: str) -> bytes:
    """A fresh record that refers to the original in place of the payload."""
    row = dict(zip(NAMES, _row(head, block)[0]))
    row |= {"record_type": "revisit", "refers_to": original["new_page"], "refers_to_id": original["new_id"]}
    row |= {"refers_to_url": original["new_url"], "refers_to_date": original["new_date"]}
    if row["record_id"] == original["new_id"]:
        row["record_id"] = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{place}/{row['record_id']}"))
    return build_record(row, None)
