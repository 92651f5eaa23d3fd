"""WARC records in ZIP-packaged archives: a writer, and a reader that takes single records by range.

An archive holds two stored members, ``archive/data.warc.gz`` (a gzip member for each record) and
``indexes/index.cdxj`` (a JSON line for each record with its place in the former). The reader parses the end record,
its ZIP64 form and the central directory, finds where members begin, reads the index and then only the byte ranges it
needs; nothing is extracted. Equal payloads are stored once; later ones are revisit records that refer to it.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_in_python, shared_path, written
from .files import new_file, opened, read_range

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


@dataclass
class Member:
    name: str
    method: int
    start: int
    size: int


def members_of(source, size: int) -> dict[str, Member]:
    """The members of a ZIP file by name, from its central directory; ``source`` can seek and read."""
    tail_at = max(0, size - 65_557)
    tail = read_range(source, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HLL", tail[end + 10 : end + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        where = tail_at + end - 20
        signature, _, end64, _ = struct.unpack("<4sLQL", read_range(source, where, 20))
        if signature != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = read_range(source, end64, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", record[32:56])
    directory, at, out = read_range(source, start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("no central directory entry")
        flags, method = struct.unpack("<HH", directory[at + 8 : at + 12])
        packed, full, n, m, k = struct.unpack("<LLHHH", directory[at + 20 : at + 34])
        (local,) = struct.unpack("<L", directory[at + 42 : at + 46])
        name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = directory[at + 46 + n : at + 46 + n + m], 0
        while e + 4 <= len(extra):
            kind, size_ = struct.unpack("<HH", extra[e : e + 4])
            if kind == 1:  # ZIP64: only the fields that didn't fit, in this order
                field = e + 4
                if full == 0xFFFFFFFF:
                    (full,), field = struct.unpack("<Q", extra[field : field + 8]), field + 8
                if packed == 0xFFFFFFFF:
                    (packed,), field = struct.unpack("<Q", extra[field : field + 8]), field + 8
                if local == 0xFFFFFFFF:
                    (local,) = struct.unpack("<Q", extra[field : field + 8])
            e += 4 + size_
        header = read_range(source, local, 30)
        if header[:4] != b"PK\x03\x04":
            raise ValueError("no local header")
        skip_name, skip_extra = struct.unpack("<HH", header[26:30])
        out[name] = Member(name, method, local + 30 + skip_name + skip_extra, packed)
        at += 46 + n + m + k
    return out


def record_bytes(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A whole WARC record. A revisit keeps the payload's digest and length but not the payload."""
    target = "".join(c for c in url or "" if c > " ") or "about:blank"
    revisit = refers_to is not None
    body = b"" if revisit else payload
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", target),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")] if revisit else []),
        ("Content-Length", str(len(http) + len(body))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http + body + b"\r\n\r\n"


def parsed_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    warc = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(warc["Content-Length"])]
    http_head, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http_head.decode().split("\r\n")[1:]), payload


def number_in(urn: str) -> int | None:
    digits = urn.strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, archive_bytes: int = 256 << 20, level: int = 1, hot_part: int = 5000) -> DataFrame:
    """Writes a record for each row into archives in ``folder``; (path, records, bytes) of the archives.

    Of rows with equal payloads of ``least_bytes`` or more, those with the largest id are responses and the others
    revisit it. Null html is an empty payload. A null id is never referred to; if only such rows share a payload, all
    are responses. Repeated rows are written each; other columns are ignored; an empty table gives no archive.

    Payloads that more than one row in ``hot_part`` shares are at most ``hot_part`` and are looked up in a broadcast
    table; of the rest, no payload's rows are more than that share of all. Rows that look up nothing are dealt out evenly.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    digest = F.sha1(F.encode("html", "UTF-8"))
    large = rows.where(F.octet_length("html") >= least_bytes).select(digest.alias("sha"), "page_id")
    first = written(large.groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "payloads")
    hot_rows = max(1000, rows.count() // hot_part)
    hot = first.where(F.col("n") > hot_rows).select(F.col("sha").alias("digest"), F.col("first").alias("hot"))  # hot_part rows at most
    keyed = rows.withColumn("digest", digest).withColumn("large", F.octet_length("html") >= least_bytes).join(F.broadcast(hot), "digest", "left")
    apart = F.concat(F.lit("-"), F.floor(F.rand(7) * 1_000_000).cast("string"))  # no digest begins so
    keyed = keyed.withColumn("sha", F.when(F.col("large") & F.col("hot").isNull(), F.col("digest")).otherwise(apart))
    joined = keyed.join(first.where(F.col("n") <= hot_rows).select("sha", F.col("first").alias("cold")), "sha", "left")
    newest = F.when(F.col("large"), F.coalesce("hot", "cold"))
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < newest), newest)
    ready = joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, records = None, 0
        stream = archive = member = None
        index: list[str] = []
        at = 0

        def close() -> None:
            member.close()
            archive.writestr(INDEX, "".join(index))
            archive.close()
            stream.close()

        def manifest_row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([at], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for row in zip(*(batch.column(c) for c in range(5)), strict=True):
                page, url, html, sha, refers_to = (v.as_py() for v in row)
                if archive is None:
                    name, records, at, index = new_file(folder, ".wacz"), 0, 0, []
                    fs, path = opened(name)
                    stream = fs.open_output_stream(path)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
                    member = archive.open(DATA, "w", force_zip64=True)
                data = gzip.compress(record_bytes(page, url, html.encode("utf-8", "replace"), sha, refers_to), level, mtime=0)
                member.write(data)
                index.append(json.dumps({"id": page, "offset": at, "length": len(data)}) + "\n")
                at, records = at + len(data), records + 1
                if at >= archive_bytes:
                    close()
                    yield manifest_row()
                    archive = None
        if archive is not None:
            close()
            yield manifest_row()

    return map_in_python(ready, write, "path string, records long, bytes long")


def read_archives(archives: DataFrame, run_records: int = 512, run_bytes: int = 4 << 20, task_bytes: int = 32 << 20) -> DataFrame:
    """A row for each record in the archives that ``archives.path`` names.

    (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload): payload is null for a revisit. The
    index of each archive is dealt out in runs of neighbouring records, of ``run_bytes`` or one record, and each run is
    one ranged read. ``archives.bytes`` says how much there is to read, hence how many tasks share it: about
    ``task_bytes`` each. Null paths and other columns are ignored; without archives there are no rows.
    """

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = opened(name)
                with fs.open_input_file(path) as f:
                    members = members_of(f, f.size())
                    data, index = members[DATA], members[INDEX]
                    if data.method or index.method:
                        raise ValueError(f"{name}: a member isn't stored")
                    entries = [json.loads(x) for x in read_range(f, index.start, index.size).splitlines()]
                runs: list[list[dict]] = []
                for e in entries:
                    if not runs or len(runs[-1]) == run_records or e["offset"] + e["length"] - runs[-1][0]["offset"] > run_bytes:
                        runs.append([])
                    runs[-1].append(e)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(runs), pa.string()), pa.array([data.start + r[0]["offset"] for r in runs], pa.int64()), pa.array([[e["length"] for e in r] for r in runs], pa.list_(pa.int64()))], names=["path", "start", "lengths"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for name, start, lengths in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                fs, path = opened(name)
                with fs.open_input_file(path) as f:
                    data = memoryview(read_range(f, start, sum(lengths)))
                rows, at = [], 0
                for length in lengths:
                    warc, http, payload = parsed_record(zlib.decompress(data[at : at + length], 31))
                    at += length
                    kind, digest = warc["WARC-Type"], warc["WARC-Payload-Digest"].partition(":")[2]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{name}: {warc['WARC-Record-ID']} doesn't have its digest")
                    refers = number_in(warc["WARC-Refers-To"]) if "WARC-Refers-To" in warc else None
                    rows.append((number_in(warc["WARC-Record-ID"]), warc["WARC-Target-URI"], int(http["Content-Length"]), digest, kind, refers, payload if kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    whole = archives.agg(F.count("path").alias("n"), F.sum("bytes").alias("bytes")).first()
    tasks = max(1, min(100_000, -(-(whole.bytes or 0) // task_bytes)))
    named = archives.where("path is not null").select("path").repartition(max(1, min(whole.n, tasks)), "path")
    runs = written(named.mapInArrow(locate, "path string, start long, lengths array<long>"), "runs")
    return runs.repartition(tasks, F.col("path"), F.col("start")).mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archived(pages: DataFrame, **settings) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and returns what reading them gives, without the payloads.

    A row for each row of ``pages``, those with a null id included; an empty table gives an empty table.
    """
    folder = shared_path(pages.sparkSession, "archives")
    manifest = written(write_archives(pages, folder, **settings), "manifest")
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
