"""WARC records in ZIP-packaged archives.

An archive is a ZIP file with stored members: ``archive/data.warc.gz`` (each record
its own gzip member) and ``indexes/index.cdx`` (a line for each record: page id,
offset and length within that member). The reader parses the end of the ZIP file,
its ZIP64 records and the central directory, finds where the stored members lie and
reads the records' byte ranges from the archive itself; nothing is extracted.
Each attempt of a task writes archives under names of its own, and a manifest, which
Spark commits once for each task, names those that count: of a task that runs twice
the other attempt's archives are never read. Files are reached through Arrow's file
systems by URI. The index member is checked by its CRC, records by gzip's, payloads by
their digest.

Of records with equal payloads the one with the smallest page_id is a ``response``;
the others are ``revisit`` records, whose block is the HTTP head alone.

Defined results: a null html is an empty payload; a null url is an empty target; of
several rows with the same page_id and payload all are of the same type; a null
page_id never is the smallest, unless all page_ids of that payload are null, and then
all those rows are responses; no rows make no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import folder, joined_by, marked, picked, stored
from .text import tidy

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: An archive is closed at so many bytes of records.
ARCHIVE_BYTES = 32 << 20
#: Records of one archive that a task reads, and the bytes that it asks for at once.
CHUNK_RECORDS, READ_BYTES = 2000, 4 << 20
#: Where the archives that count are named, below their folder.
MANIFEST = "manifest"
#: Stands for a null page_id where rows are joined.
NO_ID = -(1 << 63)
WARC_DATE = "2024-01-01T00:00:00Z"


# --- ZIP -----------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int
    crc: int = 0


def directory(source) -> dict[str, Member]:
    """The members of a ZIP file by name, from its central directory. ``source`` has
    seek, read and size."""
    size = source.size()
    tail_at = max(0, size - 65_557 - 20)
    source.seek(tail_at)
    tail = source.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    entries, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        (at,) = struct.unpack_from("<Q", tail, locator + 8)
        source.seek(at)
        record = source.read(56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end of central directory is missing")
        entries, length, start = struct.unpack_from("<QQQ", record, 32)
    source.seek(start)
    block, at, found = source.read(length), 0, {}
    for _ in range(entries):
        if block[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        (method,) = struct.unpack_from("<H", block, at + 10)
        (crc,) = struct.unpack_from("<I", block, at + 16)
        packed, plain, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", block, at + 20)
        (header,) = struct.unpack_from("<I", block, at + 42)
        name = block[at + 46 : at + 46 + name_n].decode("utf-8", "replace")
        extra, e = block[at + 46 + name_n : at + 46 + name_n + extra_n], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # only the fields that overflowed, in this order
                wide = [x[0] for x in struct.iter_unpack("<Q", extra[e + 4 : e + 4 + n - n % 8])]
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            e += 4 + n
        found[name] = Member(name, method, packed, header, crc)
        at += 46 + name_n + extra_n + comment_n
    return found


def data_start(source, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    source.seek(member.header)
    local = source.read(30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name} has no local header")
    name_n, extra_n = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + name_n + extra_n


def read_index(source, members: dict[str, Member]) -> list[str]:
    """The lines of an archive's index."""
    member = members[INDEX]
    source.seek(data_start(source, member))
    body = source.read(member.size)
    if len(body) != member.size or zlib.crc32(body) != member.crc:
        raise ValueError("the index is damaged")
    return body.decode().splitlines()


# --- WARC ----------------------------------------------------------------------


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    number = record[len("<urn:x-page:") : -1]
    return int(number) if number else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, refers_to: int | None, size: int, sha1: str, date: str = WARC_DATE) -> bytes:
    """One WARC record as a gzip member; without a payload, of which size and SHA-1 (hexadecimal) are given, a revisit."""
    revisit = payload is None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = "".join(c for c in url or "" if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 1, mtime=0)


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse_record(member: bytes) -> dict:
    """A record from its gzip member; digests and lengths of responses come from the payload itself."""
    whole = zlib.decompress(member, 31)
    cut = whole.index(b"\r\n\r\n")
    head = _headers(whole[:cut])
    block = whole[cut + 4 : cut + 4 + int(head["content-length"])]
    cut = block.index(b"\r\n\r\n")
    http, payload = _headers(block[:cut]), block[cut + 4 :]
    revisit = head["warc-type"] == "revisit"
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and sha1_base32(payload) != digest:
        raise ValueError(f"{head['warc-record-id']}: the payload's digest is not {digest}")
    return {
        "page_id": page_of(head["warc-record-id"]), "url": head["warc-target-uri"], "payload": None if revisit else payload,
        "payload_bytes": int(http["content-length"]) if revisit else len(payload), "payload_digest": digest,
        "record_type": head["warc-type"], "refers_to": page_of(head["warc-refers-to"]) if revisit else None,
    }


# --- writing -------------------------------------------------------------------


def _put(fs, path: str, body: bytes) -> None:
    """The whole file or none: written beside and moved."""
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(beside) as out:
        out.write(body)
    fs.move(beside, path)


def pack(records: list[tuple[int | None, bytes]]) -> bytes:
    """A ZIP archive of records (page id, gzip member)."""
    lines, at = [], 0
    for page_id, body in records:
        lines.append(f"{'-' if page_id is None else page_id} {at} {len(body)}\n")
        at += len(body)
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, body in ((DATA, b"".join(b for _, b in records)), (INDEX, "".join(lines).encode())):
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), body)
    return whole.getvalue()


def write_archives(pages: DataFrame, to: str, revisit_from_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) below the URI
    ``to``; returns a row for each archive: uri, n_records, n_bytes. Payloads of at
    least ``revisit_from_bytes`` bytes are written once and revisited. Html is shuffled of
    one row of each repeated payload only; of the others their digests are."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumns({"digest": F.sha1("html"), "size": F.octet_length("html").cast("long"), "place": F.coalesce("page_id", F.lit(NO_ID))})
    first = rows.where(F.col("size") >= revisit_from_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    repeated = stored(first.where("n > 1 and first_id is not null").select("digest", "first_id", "n"), "repeated-payloads")
    known = marked(rows, repeated, "digest")
    near = stored(known.where("maybe").select("page_id", "place", "url", "digest", "size"), "near-payloads")
    judged = joined_by(near, repeated, ["digest"], "n", "left").withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False)))
    first = stored(judged.where("not revisit").select("place", "digest").distinct(), "first-payloads")
    columns = ["page_id", "url", "html", "first_id", "size", "digest"]
    none = lambda kind: F.lit(None).cast(kind)
    whole = known.where("not maybe").unionByName(picked(known.where("maybe"), first, "place", "digest"), allowMissingColumns=True).withColumn("first_id", none("long"))
    rows = whole.select(*columns).unionByName(judged.where("revisit").withColumn("html", none("string")).select(*columns))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(to)
        task, made, records, total = TaskContext.get(), [], [], 0

        def close() -> None:
            name = f"part-{task.partitionId():06d}-{len(made):04d}-{uuid.uuid4().hex}.zip"
            body = pack(records)
            _put(fs, f"{base}/{name}", body)
            made.append((f"{to}/{name}", len(records), len(body)))

        for batch in batches:
            for page_id, url, html, first_id, size, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = record_bytes(page_id, url, None if html is None else html.encode(), first_id, size, digest)
                records.append((page_id, body))
                total += len(body)
                if total >= archive_bytes:
                    close()
                    records, total = [], 0
        if records:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["uri", "n_records", "n_bytes"])

    rows.mapInArrow(run, "uri string, n_records long, n_bytes long").write.mode("overwrite").parquet(f"{to}/{MANIFEST}")
    return archives_in(pages.sparkSession, to)


# --- reading -------------------------------------------------------------------


def read_records(uri: str, first: int, count: int) -> Iterator[dict]:
    """Records ``first`` to ``first + count`` of an archive's index, by range."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as source:
        members = directory(source)
        lines = read_index(source, members)[first : first + count]
        base = data_start(source, members[DATA])
        spans = [(int(a), int(n)) for _, a, n in (x.split() for x in lines)]
        i = 0
        while i < len(spans):
            j = i + 1
            while j < len(spans) and spans[j][0] + spans[j][1] - spans[i][0] <= READ_BYTES:
                j += 1
            at = spans[i][0]
            source.seek(base + at)
            block = source.read(spans[j - 1][0] + spans[j - 1][1] - at)
            for a, n in spans[i:j]:
                yield parse_record(block[a - at : a - at + n])
            i = j


def archives_in(spark: SparkSession, uri: str) -> DataFrame:
    """The archives below a folder, as write_archives returns them: those of its manifest, or
    all that Spark's file listing finds where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{uri}/{MANIFEST}")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema("uri string, n_records long, n_bytes long").parquet(f"{uri}/{MANIFEST}")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(uri).select(F.col("path").alias("uri"), F.col("length").alias("n_bytes"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for uri in batch.column("uri").to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as source:
                    n.append(len(read_index(source, directory(source))))
            yield pa.RecordBatch.from_arrays([batch.column("uri"), pa.array(n, pa.int64()), batch.column("n_bytes")], ["uri", "n_records", "n_bytes"])

    return found.mapInArrow(count, "uri string, n_records long, n_bytes long")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives (uri, n_records): page_id, url, payload
    (null for revisits; left out if not wanted), payload_bytes, payload_digest,
    record_type and refers_to."""
    chunks = archives.where("n_records > 0").select("uri", F.explode(F.expr(f"sequence(0L, n_records - 1, {CHUNK_RECORDS}L)")).alias("first"))
    n = max(1, archives.agg(F.sum(F.expr(f"ceil(n_records / {CHUNK_RECORDS})"))).first()[0] or 1)
    names = ["page_id", "url", *["payload"] * payloads, "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in names], names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column("uri").to_pylist(), batch.column("first").to_pylist(), strict=True):
                rows, size = [], 0
                for record in read_records(uri, first, CHUNK_RECORDS):
                    rows.append(record)
                    size += len(record["payload"] or b"") if payloads else 0
                    if size > READ_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    schema = "page_id long, url string" + ", payload binary" * payloads + ", payload_bytes long, payload_digest string, record_type string, refers_to long"
    return chunks.repartition(min(n, 2000)).mapInArrow(run, schema)


def round_trip(pages: DataFrame, to: str | None = None, revisit_from_bytes: int = 0) -> DataFrame:
    """Writes archives of ``pages`` and reads them back; a row for each page."""
    to = to or folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, to, revisit_from_bytes), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
