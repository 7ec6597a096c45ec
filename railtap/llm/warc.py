"""WARC archives as a Python data source, and the write of pages with revisits.

Writing: a task turns its rows into gzip members, one per record, and rolls to a
new file at ``max_bytes``.  Files carry the task attempt in their names, and the
commit writes a list of those that count, so a task that is run again leaves
nothing behind in the archive.  Each member states its own length in the ``sl``
field of the gzip header.

Reading: one partition per file.  The head of a record is parsed before anything
else; predicates on record type and head fields are pushed down, and a record
that fails them, or whose payload is not asked for, is skipped over by its
length without being decoded.  Archives without stated lengths, and plain .warc
files, are read too.

Files are opened through pyarrow's file systems: a local or mounted folder,
object stores, HDFS.

Edge cases: a null payload is empty.  A null page id is an empty one and comes
back as null; it never is the one that others revisit while another id has the
same payload.  Rows that repeat the id and payload of a response are responses.
An empty table gives an archive without page records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage)

from railtap.llm.common import need, stored
from railtap.session import fresh_path

WRITE_SCHEMA = "record_id string, record_type string, uri string, refers_to string, sha1 string, payload_bytes long, payload binary"
READ_SCHEMA = "record_id string, record_type string, uri string, refers_to string, digest string, payload_bytes long, payload binary"

_LIST = "_files.json"
_END = b"\r\n\r\n"
_CHUNK = 1 << 16


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    fs, inside = pafs.FileSystem.from_uri(path)
    return fs, inside.rstrip("/")


def _line(name: str, value) -> bytes:
    clean = str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    return f"{name}: {clean}\r\n".encode()


def _clean(value: str | None) -> str | None:
    return None if value is None else value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(kind: str, record_id: str, fields: dict, block: bytes) -> bytes:
    head = b"WARC/1.1\r\n" + _line("WARC-Type", kind) + _line("WARC-Record-ID", f"<{record_id}>")
    head += b"".join(_line(k, v) for k, v in fields.items() if v is not None)
    return head + _line("Content-Length", len(block)) + b"\r\n" + block + _END


def member(raw: bytes, level: int = 1) -> bytes:
    """A gzip member that states its own and its content's length, if both fit their fields."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush() + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    total = 10 + 2 + 12 + len(body)
    if max(total, len(raw)) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + body
    return b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(raw)) + body


def page_record(row: dict) -> bytes:
    """A response holds the payload; a revisit keeps only the HTTP head, which states the full length."""
    n, payload = row["payload_bytes"], row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    fields = {"WARC-Target-URI": row["uri"], "WARC-Payload-Digest": f"sha1:{digest}",
              "Content-Type": "application/http; msgtype=response"}
    if row["record_type"] == "revisit":
        fields |= {"WARC-Refers-To": f"<{row['refers_to']}>",
                   "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        payload = b""
    return record(row["record_type"], row["record_id"], fields, http + payload)


class _Files(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.max_bytes = options["path"], int(options.get("max_bytes", 1 << 28))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        fs, folder = _folder(self.path)
        fs.create_dir(folder, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                    out.write(member(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", {"Content-Type": "application/warc-fields"},
                                            b"software: railtap\r\n")))
                own = member(page_record(row))
                out.write(own)
                size += len(own)
                if size >= self.max_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Files(names)

    def commit(self, messages: list) -> None:
        fs, folder = _folder(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{_LIST}") as out:
            out.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages: list) -> None:
        """Files of an aborted write are on no list and are never read."""


class _File(InputPartition):
    def __init__(self, name: str):
        self.value = name


class _Plain:
    """The bytes of a record in a plain file, read as far as they are asked for."""

    def __init__(self, file, at: int, size: int, first: bytes):
        self.file, self.at, self.size, self.raw = file, at, size, bytearray(first)

    def more(self) -> bool:
        self.file.seek(self.at + len(self.raw))
        got = self.file.read(1 << 20)
        self.raw += got
        return bool(got)

    def end(self, length: int) -> int:
        return self.at + length


class _Member:
    """The content of a gzip member, inflated as far as it is asked for."""

    def __init__(self, file, at: int, size: int, first: bytes):
        self.file, self.at, self.size, self.stated = file, at, size, None
        body = 10
        if first[3] & 4:
            i, body = 12, 12 + struct.unpack_from("<H", first, 10)[0]
            while i + 4 <= body:
                name, n = struct.unpack_from("<2sH", first, i)
                if name == b"sl" and n == 8:
                    self.stated = struct.unpack_from("<I", first, i + 4)[0]
                i += 4 + n
        for bit in (8, 16):  # file name and comment, each ended by a zero byte
            if first[3] & bit:
                body = first.index(b"\0", body) + 1
        body += 2 * bool(first[3] & 2)
        self.inflate, self.pos = zlib.decompressobj(-15), at + len(first)
        self.raw = bytearray(self.inflate.decompress(first[body:], 1 << 12))

    def more(self) -> bool:
        if self.inflate.eof:
            return False
        rest = self.inflate.unconsumed_tail
        if not rest:
            self.file.seek(self.pos)
            rest = self.file.read(1 << 20)
            self.pos += len(rest)
            if not rest:
                raise ValueError("a gzip member is cut off")
        self.raw += self.inflate.decompress(rest, 1 << 22)
        return True

    def end(self, length: int) -> int:
        if self.stated:
            return self.at + self.stated
        while not self.inflate.eof:  # no stated length: inflate to the end, keeping nothing
            self.more()
            self.raw.clear()
        return self.pos - len(self.inflate.unused_data) + 8


def _head(raw: bytes) -> tuple[dict, int]:
    """Fields of a record's head by the names of the read schema, and the length of its block."""
    if not raw.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    digest, refers = fields.get("warc-payload-digest"), fields.get("warc-refers-to")
    return {"record_id": _clean(fields.get("warc-record-id", "")[1:-1]), "record_type": fields.get("warc-type"),
            "uri": _clean(fields.get("warc-target-uri")), "refers_to": _clean(refers[1:-1]) if refers else None,
            "digest": digest.rpartition(":")[2] if digest else None,
            "http": fields.get("content-type", "").startswith("application/http")}, int(fields["content-length"])


def records(file, size: int, wanted, payload: bool) -> Iterator[dict]:
    """The wanted records of an open file; ``payload`` decides whether payloads are decoded."""
    at = 0
    while at < size:
        file.seek(at)
        first = file.read(min(_CHUNK, size - at))
        source = (_Member if first[:2] == b"\x1f\x8b" else _Plain)(file, at, size, first)
        while (start := source.raw.find(_END)) < 0 and source.more():
            pass
        found, length = _head(bytes(source.raw[:max(start, 0)]))
        start += len(_END)
        if wanted(found):
            if found["http"]:
                while (cut := source.raw.find(_END, start)) < 0 and len(source.raw) < start + length and source.more():
                    pass
                http = bytes(source.raw[start:cut]).decode("utf-8", "replace").lower()
                stated = [x.partition(":")[2] for x in http.split("\r\n") if x.startswith("content-length:")]
                found["payload_bytes"] = int(stated[0]) if stated else None
                start, length = cut + len(_END), length - (cut + len(_END) - start)
            if payload and found["record_type"] != "revisit":
                while len(source.raw) < start + length and source.more():
                    pass
                found["payload"] = bytes(source.raw[start:start + length])
                if found["digest"] and found["http"] and base64.b32encode(hashlib.sha1(found["payload"]).digest()).decode() != found["digest"]:
                    raise ValueError(f"{found['record_id']}: the payload does not have its digest")
            yield found
        at = source.end(start + length + len(_END))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.names, self.filters = options["path"], schema.fieldNames(), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute in (
                    ("record_type",), ("record_id",), ("uri",), ("refers_to",), ("digest",)):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, found: dict) -> bool:
        for f in self.filters:
            value = found[f.attribute[0]]
            ok = value is not None and (value == f.value if isinstance(f, EqualTo) else value in f.value if isinstance(f, In)
                                        else value.startswith(f.value))
            if not ok:
                return False
        return True

    def partitions(self) -> list[_File]:
        fs, folder = _folder(self.path)
        if fs.get_file_info(f"{folder}/{_LIST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{folder}/{_LIST}") as f:
                return [_File(f"{folder}/{n}") for n in json.loads(f.read())]
        here = fs.get_file_info(pafs.FileSelector(folder, recursive=True))
        return [_File(i.path) for i in here if i.path.endswith((".warc", ".warc.gz"))]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition is None:  # what an archive without files is given
            return
        fs, _ = _folder(self.path)
        with fs.open_input_file(partition.value) as file:
            for found in records(file, file.size(), self._wanted, "payload" in self.names):
                yield tuple(found.get(n) for n in self.names)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; leave ``payload`` out of the schema to read heads only."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Records of ``pages`` (page_id, url, html): of equal payloads, the smallest page id keeps the payload."""
    body = need(pages, "page_id", "url", "html").withColumn("payload", F.coalesce(F.col("html").cast("binary"), F.lit(b"")))
    body = body.select("page_id", "url", "payload", F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("payload_bytes"))
    same = stored(body.filter(F.col("payload_bytes") >= least_bytes).groupBy("sha1").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n"), "warc-same")
    rows = body.join(same, "sha1", "left")
    again = F.col("first").isNotNull() & (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    return rows.select(name.alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
                       F.col("url").alias("uri"), F.when(again, F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to"),
                       "sha1", "payload_bytes", F.when(~again, F.col("payload")).alias("payload"))


def write_pages(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> str:
    """Write an archive folder and return its path."""
    spark = pages.sparkSession
    register(spark)
    path = path or fresh_path(spark, "warc")
    page_records(pages, least_bytes).write.format("warc").mode("append").save(path)
    return path


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the page records of an archive."""
    register(spark)

    def page(name: str):
        return F.nullif(F.substring(name, len("urn:page:") + 1, 32), F.lit("")).cast("long")

    records = spark.read.format("warc").load(path).filter(F.col("record_type").isin("response", "revisit"))
    return records.select(page("record_id").alias("page_id"), F.coalesce(F.length("payload").cast("long"), F.col("payload_bytes")).alias("payload_bytes"),
                          F.col("digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
