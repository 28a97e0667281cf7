"""WARC archives with a Zstandard dictionary: a leading skippable frame holds it, and each record is a frame of its own.

Layout of an archive: a skippable frame (magic 0x184D2A5D) whose content is the dictionary, then one frame for each
WARC/1.1 record, the first of them a warcinfo, compressed with that dictionary. The dictionary is built from whole
records of the archive, at even steps; where they are too few or too alike to train on, it is their last bytes as they
are, and the warcinfo says so.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, tune

SKIPPABLE = 0x184D2A5D
#: Bytes of records in one archive; size of a dictionary; bytes of records that it is built from, spread evenly.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 32 << 20, 64 << 10, 4 << 20
LEVEL = 3


def _record(kind: str, name: str, uri: str, payload: bytes, digest: str, refers_to: str | None, length: int, page: str = "", date: str = "1970-01-01T00:00:00Z", target: str = "") -> bytes:
    """One record; name is unique to it, page and refers_to are keys of pages, target is the uri of the page referred to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page: {page}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To-Target-URI: {target}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(name: str, date: str, dictionary: str) -> bytes:
    block = f"software: lexloom\r\nformat: WARC File Format 1.1\r\ndictionary: {dictionary}\r\n".encode()
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers by lower-case name, the HTTP header and the payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def build_dictionary(records: list[bytes]) -> tuple[bytes, str]:
    """A dictionary of whole records taken at even steps, about SAMPLE_BYTES in all, and how it was made: trained or raw."""
    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    samples = records[::step]
    size = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 4), samples, k=200, d=8).as_bytes(), "trained"
    except (zstandard.ZstdError, ValueError):  # too few samples, or too little that they share
        return b"".join(samples)[-DICTIONARY_BYTES:], "raw"


def encode_archive(records: list[bytes], name: str = "", date: str = "1970-01-01T00:00:00Z") -> Iterator[bytes]:
    dictionary, how = build_dictionary(records)
    yield struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary
    compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary))
    yield compressor.compress(_info(str(uuid.uuid5(uuid.NAMESPACE_URL, name)), date, how))
    for r in records:
        yield compressor.compress(r)


def decode_archive(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, read a chunk at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive has no leading dictionary frame")
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    data = stream.read(chunk)
    while data:
        frame, out = plain.decompressobj(), []
        while True:
            out.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data or stream.read(chunk)
                break
            data = stream.read(chunk)
            if not data:
                raise ValueError("the archive ends within a record")
        yield b"".join(out)


def _open(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(root)


def _base32(digest_hex: Column) -> Column:
    """Bare upper-case base32 of a 160-bit digest given as 40 hex digits: 8 groups of 20 bits, 4 digits each."""
    base, zeros = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.translate(F.lpad(F.conv(F.substring(digest_hex, 5 * i + 1, 5), 16, 32), 4, "0"), base, zeros) for i in range(8)]
    return F.concat(*groups)


def plan_records(pages: DataFrame, key: str, uri: str, payload: str, minimum: int) -> DataFrame:
    """(k, uri, body, digest, record_type, refers_to, target): which records are responses and which revisit another.

    Which pages share a payload is found from keys and digests alone; a payload is joined with what was found for its
    page only where it is not alone, so payloads that very many pages share do not meet in one task.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).alias("k"), F.coalesce(F.col(uri).cast("string"), F.lit("")).alias("uri"), body.alias("body"), _base32(F.sha1(body.cast("binary"))).alias("digest"))
    names = rows.filter(F.octet_length("body") >= minimum).select("k", "uri", "digest")
    groups = names.groupBy("digest").agg(F.max(F.struct("k", "uri")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    scratch = Scratch(pages.sparkSession, "warc-plan")
    shared = names.select("k", "digest").join(scratch.save(groups, "groups"), "digest").select(F.col("k").alias("sk"), F.col("digest").alias("d"), "first").distinct()
    marked = rows.join(scratch.save(shared, "shared"), F.col("k").eqNullSafe(F.col("sk")) & (F.col("digest") == F.col("d")), "left")
    leads = F.col("d").isNull() | F.col("k").eqNullSafe(F.col("first.k"))
    return marked.select("k", "uri", "body", "digest", F.when(leads, "response").otherwise("revisit").alias("record_type"), F.when(~leads, F.col("first.k")).alias("refers_to"), F.when(~leads, F.col("first.uri")).alias("target"))


def write_archives(records: DataFrame, root: str, date: str) -> DataFrame:
    """Write planned records to archives under ``root``; (path, n_records, n_bytes) of each.

    A task names its archives by its partition and renames them into place when they are whole, so a task that runs
    again replaces what it wrote. Archives are closed at ARCHIVE_BYTES of records, which with the longest record bounds
    memory; records of any length are kept whole. Ids of records are made of archive and place, so none is given twice.
    """
    tune(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        fs.create_dir(base, recursive=True)
        held, size, made = [], 0, 0
        where = TaskContext.get().partitionId()

        def label() -> str:
            return f"part-{where:06d}-{made:05d}.warc.zst"

        def close() -> pa.RecordBatch:
            nonlocal held, size, made
            name = f"{base}/{label()}"
            temporary, total = f"{base}/.{uuid.uuid4().hex}", 0
            with fs.open_output_stream(temporary, compression=None) as out:
                for piece in encode_archive(held, label(), date):
                    out.write(piece)
                    total += len(piece)
            fs.move(temporary, name)
            n, held, size, made = len(held), [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["path", "n_records", "n_bytes"])

        for b in batches:
            for k, u, body, digest, kind, refers, target in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = body.encode()
                unique = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{label()}/{len(held)}"))
                held.append(_record(kind, unique, " ".join(u.split()), payload, digest, refers, len(payload), "" if k is None else str(k), date, " ".join((target or "").split())))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
        if held:
            yield close()

    return records.mapInArrow(run, "path string, n_records long, n_bytes long")


def read_archives(manifest: DataFrame, root: str) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, uri, payload) of each record in the archives listed.

    A response's digest and length are those of the payload read, and must agree with its headers; those of a revisit
    come from its headers, and its payload is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(root)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for record in decode_archive(stream):
                        fields, http, payload = parse_record(record)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                        length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length:"))[15:])
                        if kind == "response" and (length != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{path}: a payload differs from its digest")
                        page, refers = fields["x-page"], fields.get("x-refers-to-page")
                        rows.append((page or None, length, digest, kind, refers or None, fields["warc-target-uri"], payload if kind == "response" else None))
                        size += len(record)
                        if size >= 8 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return manifest.select("path").mapInArrow(run, READ_SCHEMA)


READ_SCHEMA = "id string, payload_bytes long, payload_digest string, record_type string, refers_to string, uri string, payload binary"
_READ_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ_TYPES, strict=True)], names=[x.split()[0] for x in READ_SCHEMA.split(", ")])


def archive(spark: SparkSession, pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", minimum: int = 0, root: str | None = None, date: str | None = None) -> DataFrame:
    """Write a WARC record for each row of ``pages`` and read the archives back: see ``read_archives``.

    Of records with equal payloads of at least ``minimum`` bytes, that with the largest key is the response and others
    revisit it; smaller ones are all responses. A null payload is empty, a null uri an empty one. Repeated rows with the
    largest key are all responses; a row with a null key revisits if any equal payload has a key. Equal payloads are
    found by their SHA-1. Texts of any length are kept whole. ``date`` is that of all records, by default the time of the
    call. An empty table makes no archive and gives no rows. Other columns are not read.
    """
    scratch = Scratch(spark, "warc")
    root = root or scratch.path("archives")
    manifest = scratch.save(write_archives(plan_records(pages, key, uri, payload, minimum), root, date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")), "manifest")
    return read_archives(manifest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path"), root)
