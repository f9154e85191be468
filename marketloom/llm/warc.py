"""WARC archives of pages, compressed record by record with a dictionary of their own.

An archive begins with a skippable frame that holds its dictionary, trained on
its first records; each record follows as a frame of its own. Payloads of at
least ``REVISIT_BYTES`` that occur again are written once, as the response of
the least page id; other pages become revisit records that refer to it.

Defined cases: a null html is an empty payload; a null url has no target field;
rows with the page id of the response are responses too; a null page id is
never referred to, and pages whose copies all have null ids are responses; an
empty table writes no archive; other columns are not read.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.storage import materialise, shared_path

REVISIT_BYTES = 100
#: The frame that holds a dictionary, and the URI of the revisit profile.
DICTIONARY_FRAME = (0x184D2A5D).to_bytes(4, "little")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 1 << 20
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
_URN = "urn:page:"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: int | None) -> bytes:
    """One WARC record with its HTTP header; a revisit carries no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits is not None else http + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if revisits is None else 'revisit'}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        fields.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m.group()):02X}", url))
    if revisits is not None:
        fields += [f"WARC-Refers-To: <{_URN}{revisits}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on records; of too few to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _roles(pages: DataFrame, ident: str, url: str, html: str) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest`` and ``first`` (null for responses)."""
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{ident}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long_enough = rows.where(F.octet_length("payload") >= REVISIT_BYTES)
    copies = long_enough.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    joined = rows.join(materialise(copies.select("digest", "first")), "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.expr("if(page_id <=> first, null, first)").alias("first"))


def write_archives(pages: DataFrame, folder: str, ident: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write every page of ``pages`` below ``folder`` (a URI that all executors see); gives ``path`` and ``records``.

    A task writes its archives under their final names only when they are
    whole, so one that is run again leaves the same files and no half ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get().partitionId()
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        paths, counts = [], []
        row = next(rows, None)
        while row is not None:
            name = f"part-{task:05d}-{len(paths):03d}.warc.zst"
            draft = f"{base}/.{name}.{uuid.uuid4().hex}"
            first, size = [], 0
            while row is not None and size < SAMPLE_BYTES:
                first.append(record(*row))
                size += len(first[-1])
                row = next(rows, None)
            trained = dictionary(first)
            pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained).compress
            with store.open_output_stream(draft, compression=None) as out:
                held = trained.as_bytes()
                out.write(DICTIONARY_FRAME + len(held).to_bytes(4, "little") + held)
                n = len(first)
                for x in first:
                    out.write(pack(x))
                first.clear()
                while row is not None and size < ARCHIVE_BYTES:
                    x = record(*row)
                    out.write(pack(x))
                    n, size, row = n + 1, size + len(x), next(rows, None)
            store.move(draft, f"{base}/{name}")
            paths.append(f"{folder}/{name}")
            counts.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    rows = _roles(pages, ident, url, html)
    # A page is a record: its fields in the order that record() takes.
    return rows.select("page_id", "url", "payload", "digest", "first").mapInArrow(run, "path string, records long")


def records_of(source: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of one archive, read as a stream."""
    head = source.read(8)
    if head[:4] != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with its dictionary")
    known = zstandard.ZstdCompressionDict(source.read(int.from_bytes(head[4:], "little")))
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=known).stream_reader(source, read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
        block = stream.read(int(fields["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where it says")
        yield fields, block


def read_archives(manifest: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (null for revisits), ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` of each record."""
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def number(urn: str | None) -> int | None:
        text = (urn or "").strip("<>").removeprefix(_URN)
        return int(text) if text else None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for path in b.column("path").to_pylist():
                store, name = pafs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as source:
                    for fields, block in records_of(source):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        kind = fields["WARC-Type"]
                        length = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
                        if kind == "response" and (len(payload) != length or sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{path}: payload of {fields['WARC-Record-ID']} is damaged")
                        held = payload if kind == "response" else None
                        rows.append((number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), held, length, digest, kind, number(fields.get("WARC-Refers-To"))))
                        size += len(payload)
                        if size > 16 << 20 or len(rows) >= 5000:
                            yield batch(rows)
                            rows, size = [], 0
        if rows:
            yield batch(rows)

    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.select("path").mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str | None = None, ident: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all of ``pages``, then read the archives back (a new shared folder unless ``folder`` is given)."""
    manifest = materialise(write_archives(pages, folder or shared_path(pages.sparkSession, "warc"), ident, url, html))
    # Archives are few and large: one to a task.
    return read_archives(manifest.repartition(max(1, manifest.count()), "path"))
