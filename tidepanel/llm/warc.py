"""Web archives in ZIP packages: writing with revisit records, and reading by byte ranges.

A package holds stored (uncompressed) members: ``archive/data.warc.gz``, in which every record
is a gzip member of its own, and ``indexes/index.cdx``, one line per record with its place in
the archive. The reader finds the central directory from the end of the file, also where its
sizes are in ZIP64 fields, and reads single records without unpacking anything else.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.session import fresh_path, written

ARCHIVE, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdx", "datapackage.json"
PACKAGE_BYTES = 32_000_000  # a package is closed at the first record beyond this size
BLOCK_RECORDS = 256  # records of a package that one task reads at least
BROADCAST_ROWS = 500_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # records carry a fixed date, so that reruns write the same bytes


# --- file access -----------------------------------------------------------------------

def _file_system(path: str):
    """(file system, path in it); a URI names any store that Arrow reaches, a plain path is a shared folder."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# --- ZIP directories -------------------------------------------------------------------

@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int  # bytes in the package
    header: int  # place of the local header


def _zip64(extra: bytes, wanted: list[bool]) -> list[int]:
    """Values of the ZIP64 field, in order, for those fixed fields that are full."""
    at = 0
    while at + 4 <= len(extra):
        tag, length = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            return list(struct.unpack_from(f"<{sum(wanted)}Q", extra, at + 4))
        at += 4 + length
    return []


def directory(read_at, size: int) -> list[Member]:
    """Members of a package; ``read_at(offset, length)`` gives bytes of the file of ``size`` bytes."""
    tail_at = max(0, size - 22 - 65535 - 20)
    tail = read_at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    entries, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20:end - 16] == b"PK\x06\x07" and (
            entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF):
        (place,) = struct.unpack_from("<Q", tail, end - 12)
        record = read_at(place, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end of central directory")
        entries, length, start = struct.unpack_from("<QQQ", record, 32)
    data, at, found = read_at(start, length), 0, []
    for _ in range(entries):
        if data[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, plain, names, extras, notes = struct.unpack_from("<IIHHH", data, at + 20)
        (header,) = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46:at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        full = [plain == 0xFFFFFFFF, packed == 0xFFFFFFFF, header == 0xFFFFFFFF]
        if any(full):
            values = iter(_zip64(data[at + 46 + names:at + 46 + names + extras], full))
            plain, packed, header = (next(values) if f else v for f, v in zip(full, (plain, packed, header)))
        found.append(Member(name, method, packed, header))
        at += 46 + names + extras + notes
    return found


def stored_at(read_at, member: Member) -> int:
    """Place of the first byte of a stored member."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed in the package")
    header = read_at(member.header, 30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    names, extras = struct.unpack_from("<HH", header, 26)
    return member.header + 30 + names + extras


# --- records ---------------------------------------------------------------------------

def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id, url: str | None, payload: bytes, response_of) -> bytes:
    """One record: a response, or a revisit of the page ``response_of`` without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = response_of is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{response_of}>"]
    head += [f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}",
             f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record; its length and block digest are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(fields["content-length"])]
    if base32(hashlib.sha1(block).digest()) != fields["warc-block-digest"].removeprefix("sha1:"):
        raise ValueError(f"broken block of {fields['warc-record-id']}")
    return fields, block


def page(data: bytes) -> tuple:
    """page_id (text), payload_bytes, payload_digest, record_type, refers_to (text), payload, url of a record."""
    fields, block = parsed(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != length or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"broken payload of {fields['warc-record-id']}")

    def number(name):
        value = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return None if value in ("", "None") else value

    return (number("warc-record-id"), length, digest, kind, number("warc-refers-to"),
            payload if kind == "response" else None, fields.get("warc-target-uri"))


class Package:
    """One package while it is filled: bounded by PACKAGE_BYTES and a record."""

    def __init__(self):
        self.data, self.lines = io.BytesIO(), []

    def add(self, page_id, raw: bytes, kind: str) -> None:
        packed = gzip.compress(raw, 6, mtime=0)
        self.lines.append(json.dumps({"page": None if page_id is None else str(page_id), "type": kind,
                                      "offset": self.data.tell(), "length": len(packed)}))
        self.data.write(packed)

    def write(self, path: str) -> tuple[str, int, int]:
        store, place = _file_system(path)
        whole = io.BytesIO()
        with zipfile.ZipFile(whole, "w", zipfile.ZIP_STORED) as package:
            for name, data in ((ARCHIVE, self.data.getbuffer()), (INDEX, "\n".join(self.lines).encode()),
                               (ABOUT, json.dumps({"records": len(self.lines), "profile": "data-package"}).encode())):
                with package.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                    member.write(data)
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(place) as out:
            out.write(whole.getbuffer())
        return path, whole.tell(), len(self.lines)


# --- jobs ------------------------------------------------------------------------------

def write_archives(pages: DataFrame, folder: str, *, least: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) below ``folder``; returns path, bytes, records.

    Of payloads that are equal and have ``least`` bytes or more, the one with the smallest page_id
    is a response and the others revisit it; all others are responses. A null html is an empty
    payload, a null url is left out. Rows that repeat the smallest page_id are all responses; rows
    with a null page_id revisit a page that has one. Files of a task that is run again have other
    names; only those in the returned table count.
    """
    rows = pages.select("page_id", F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    shared = (rows.where(F.octet_length("html") >= least).select("page_id", digest.alias("digest"))
              .groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").drop("n"))
    shared = written(shared, "payloads")
    if shared.count() <= BROADCAST_ROWS:  # rows of a digest and a number
        shared = F.broadcast(shared)
    rows = rows.withColumn("digest", digest).join(shared, "digest", "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("response_of"))

    def run(batches):
        task = TaskContext.get()
        stem = f"{folder}/part-{task.partitionId():06d}-{uuid.uuid4().hex}"
        done, package = 0, Package()

        def row(result):
            return pa.RecordBatch.from_pydict(dict(zip(("path", "bytes", "records"), ([x] for x in result))))

        for batch in batches:
            for page_id, url, html, response_of in zip(*(batch.column(i) for i in range(4))):
                page_id, response_of = page_id.as_py(), response_of.as_py()
                raw = record(page_id, url.as_py(), html.as_py().encode(), response_of)
                package.add(page_id, raw, "response" if response_of is None else "revisit")
                if package.data.tell() >= package_bytes:
                    yield row(package.write(f"{stem}-{done:05d}.wacz"))
                    done, package = done + 1, Package()
        if package.lines:
            yield row(package.write(f"{stem}-{done:05d}.wacz"))

    return written(rows.mapInArrow(run, "path string, bytes bigint, records bigint"), "packages")


def read_archives(packages: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Records of the packages in ``packages`` (path): page_id, payload_bytes, payload_digest,
    record_type, refers_to as text, and with ``payloads`` url and payload (null for revisits).

    First the index of every package is read, then its records are dealt out in blocks and each
    is read as one byte range. Lengths and digests are checked; a broken package is an error.
    """

    def places(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = _file_system(path)
                with store.open_input_file(place) as file:
                    def read_at(offset, length, file=file):
                        return file.read_at(length, offset)

                    members = {m.name: m for m in directory(read_at, file.size())}
                    archive = stored_at(read_at, members[ARCHIVE])
                    lines = read_at(stored_at(read_at, members[INDEX]), members[INDEX].size).decode().split("\n")
                entries = [json.loads(x) for x in lines if x]
                for start in range(0, len(entries), 10_000):
                    part = entries[start:start + 10_000]
                    yield pa.RecordBatch.from_pydict({
                        "path": [path] * len(part),
                        "block": pa.array([(start + i) // BLOCK_RECORDS for i in range(len(part))], pa.int64()),
                        "offset": pa.array([archive + x["offset"] for x in part], pa.int64()),
                        "length": pa.array([x["length"] for x in part], pa.int64())})

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload", "url"] * payloads
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def records(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500).to_pydict()
                rows, path, file = [], None, None
                for where, offset, length in zip(part["path"], part["offset"], part["length"]):
                    if where != path:
                        if file:
                            file.close()
                        store, place = _file_system(where)
                        path, file = where, store.open_input_file(place)
                    rows.append(page(gzip.decompress(file.read_at(length, offset))))
                if file:
                    file.close()
                columns = list(zip(*rows))[:len(names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    found = packages.select("path").repartition("path").mapInArrow(
        places, "path string, block bigint, offset bigint, length bigint")
    schema = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + (
        ", payload binary, url string" if payloads else "")
    # a row stands for the bytes behind it: with a stated number, few small rows are not put into one task
    tasks = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(tasks, "path", "block").sortWithinPartitions("path", "offset").mapInArrow(records, schema)


def round_trip(pages: DataFrame, *, least: int = 0) -> DataFrame:
    """Write ``pages`` to packages in the shared folder and read their records back."""
    folder = fresh_path(pages.sparkSession, "archives")
    return read_archives(write_archives(pages, folder, least=least), payloads=False)
