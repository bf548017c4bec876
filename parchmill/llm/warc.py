"""WARC archives as a data source, and pages written to them without repeated payloads.

Reading: a task gets whole files, up to `partition_bytes` of them. It parses a record's
headers first and gives the record up there if a predicate that Spark handed down does
not hold; where no column needs the block it is skipped as well. A skipped block is not
decoded: in files of this writer every gzip member says its length (the `sl` field of
the WARC standard's annex on compression), so the reader seeks over it; elsewhere it is
inflated up to its end without being kept.

    spark.dataSource.register(WarcDataSource)
    spark.read.format("warc").load(path)
    df.write.format("warc").mode("append").save(path)
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from parchmill.formats.storage import resolve

PARTITION_BYTES = 64 << 20
FILE_BYTES = 128 << 20
_CHUNK = 1 << 16
_HTTP = "application/http;msgtype=response"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Columns from headers of a record, as the standard names them.
_HEADERS = {
    "warc_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
}
SCHEMA = (
    "warc_type string, record_id string, target_uri string, warc_date string, "
    "payload_digest string, refers_to string, content_type string, content_length long, "
    "headers map<string,string>, http_headers map<string,string>, payload binary, path string"
)
_NEEDS_BLOCK = {"http_headers", "payload"}


@dataclass
class Files(InputPartition):
    files: tuple[tuple[str, int], ...]


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...]


class WarcDataSource(DataSource):
    """Options: partition_bytes (reading); file_bytes, level (writing); verify (reading:
    fail where a payload that is read does not have the digest its header gives).

    Give a schema with some of the columns to read only these."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to: use the mode append")
        return WarcWriter(dict(self.options))


def _listed(path: str) -> list[tuple[str, int]]:
    """Archives below a path, but for those still being written."""
    fs, inside = resolve(path)
    info = fs.get_file_info(inside)
    if info.type == pafs.FileType.File:
        return [(inside, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(inside, recursive=True))
    return sorted(
        (f.path, f.size)
        for f in found
        if f.type == pafs.FileType.File
        and f.base_name.endswith((".warc", ".warc.gz"))
        and not f.base_name.startswith(("_", "."))
    )


def _test(f: Filter):
    """(column, test of its value) for a predicate that headers decide, else None."""
    column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
    if column not in _HEADERS:
        return None
    if isinstance(f, EqualTo):
        return column, lambda v: v is not None and v == f.value
    if isinstance(f, In):
        return column, lambda v: v is not None and v in f.value
    if isinstance(f, IsNotNull):
        return column, lambda v: v is not None
    if isinstance(f, IsNull):
        return column, lambda v: v is None
    if isinstance(f, StringStartsWith):
        return column, lambda v: v is not None and v.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return column, lambda v: v is not None and v.endswith(f.value)
    if isinstance(f, StringContains):
        return column, lambda v: v is not None and f.value in v
    return None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.options, self.columns = options, columns
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _test(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        limit = int(self.options.get("partition_bytes", PARTITION_BYTES))
        out, now, size = [], [], 0
        for file in _listed(self.options["path"]):
            if now and size + file[1] > limit:
                out.append(Files(tuple(now)))
                now, size = [], 0
            now.append(file)
            size += file[1]
        return [*out, Files(tuple(now))]

    def read(self, partition: Files) -> Iterator[tuple]:
        tests = [_test(f) for f in self.filters]
        verify = str(self.options.get("verify", "false")).lower() == "true"
        needs_block = verify or bool(_NEEDS_BLOCK & set(self.columns))
        fs, _ = resolve(self.options["path"])

        def wanted(headers: dict[str, str]) -> bool:
            return all(test(headers.get(_HEADERS[column])) for column, test in tests)

        for path, _ in partition.files:
            with fs.open_input_file(path) as file:
                for headers, block in records(file, wanted, needs_block):
                    row = {c: headers.get(h) for c, h in _HEADERS.items()}
                    row |= {"headers": headers, "path": path}
                    row["content_length"] = int(headers.get("content-length", 0))
                    if needs_block:
                        row["http_headers"], row["payload"] = _http(headers, block)
                        if verify and headers.get("warc-type") == "response":
                            _verify(headers, row["payload"])
                    yield tuple(row.get(c) for c in self.columns)


def _verify(headers: dict[str, str], payload: bytes) -> None:
    said = headers.get("warc-payload-digest", "")
    if said.startswith("sha1:") and said != f"sha1:{payload_digest(payload)}":
        raise ValueError(f"{headers.get('warc-record-id')}: the payload is not the one written")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a blank goes on."""
    out: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.decode("utf-8", "replace").strip()
        else:
            key, _, value = line.decode("utf-8", "replace").partition(":")
            name = key.strip().lower()
            out[name] = value.strip()
    return out


def _http(headers: dict[str, str], block: bytes) -> tuple[dict[str, str] | None, bytes]:
    """The HTTP header of a block, if its type has one, and the payload after it."""
    if not headers.get("content-type", "").startswith("application/http"):
        return None, block
    head, _, payload = block.partition(b"\r\n\r\n")
    return _fields(head.split(b"\r\n")[1:]), payload


class _Plain:
    """Bytes of an uncompressed file; skipping is seeking."""

    def __init__(self, file):
        self.file, self.held = file, b""

    def more(self) -> bool:
        data = self.file.read(_CHUNK)
        self.held += data
        return bool(data)

    def take(self, n: int) -> bytes:
        parts, size = [self.held[:n]], min(n, len(self.held))
        self.held = self.held[n:]
        while size < n:
            data = self.file.read(min(n - size, 1 << 22))
            if not data:
                raise EOFError("an archive ends within a record")
            parts.append(data)
            size += len(data)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        held = min(n, len(self.held))
        self.held = self.held[held:]
        if n > held:
            self.file.seek(self.file.tell() + n - held)

    def end_record(self) -> None:
        pass


class _Gzip:
    """The same for a file of gzip members, one a record."""

    def __init__(self, file):
        self.file, self.held, self.raw = file, b"", b""
        self.inflate, self.next = None, None

    def _begin(self) -> bool:
        """Start the member at the file's place, if there is one."""
        begins = self.file.tell() - len(self.raw)
        while len(self.raw) < 24:
            data = self.file.read(_CHUNK)
            if not data:
                break
            self.raw += data
        if not self.raw:
            return False
        self.inflate, self.next = zlib.decompressobj(31), None
        flags = self.raw[3] if len(self.raw) > 3 else 0
        if flags & 4 and self.raw[12:14] == b"sl" and len(self.raw) >= 24:
            self.next = begins + struct.unpack("<I", self.raw[16:20])[0]
        return True

    def more(self) -> bool:
        if self.inflate is None and not self._begin():
            return False
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.raw or self.file.read(_CHUNK)
            if not self.inflate.unconsumed_tail:
                self.raw = b""
            if not data:
                raise EOFError("an archive ends within a record")
            out = self.inflate.decompress(data, _CHUNK)
            self.held += out
            if out:
                return True
        return False

    def take(self, n: int) -> bytes:
        parts, size = [], 0
        while True:
            part = self.held[: n - size]
            parts.append(part)
            size += len(part)
            self.held = self.held[len(part) :]
            if size == n:
                return b"".join(parts)
            if not self.more():
                raise EOFError("an archive ends within a record")

    def skip(self, n: int) -> None:
        if self.next is None:  # nothing says where the member ends
            while n > len(self.held):
                n -= len(self.held)
                self.held = b""
                if not self.more():
                    raise EOFError("an archive ends within a record")
            self.held = self.held[n:]

    def end_record(self) -> None:
        """Go to the next member, over what is left of this one."""
        if self.next is not None:
            self.file.seek(self.next)
            self.raw = b""
        else:
            self.held = b""
            while self.more():
                self.held = b""
            self.raw = self.inflate.unused_data if self.inflate else b""
        self.held, self.inflate = b"", None


def records(file, wanted, needs_block: bool) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open file for whose headers `wanted`
    holds; the block is empty unless it is needed."""
    magic = file.read(2)
    file.seek(0)
    source = _Gzip(file) if magic == b"\x1f\x8b" else _Plain(file)
    while True:
        source.held = source.held.lstrip(b"\r\n")
        while b"\r\n\r\n" not in source.held:
            if not source.more():
                if source.held.strip():
                    raise EOFError("an archive ends within a record")
                return
            source.held = source.held.lstrip(b"\r\n")
        head, _, source.held = source.held.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        headers = _fields(lines[1:])
        length = int(headers.get("content-length", 0))
        if not wanted(headers):
            source.skip(length)
        elif needs_block:
            yield headers, source.take(length)
        else:
            source.skip(length)
            yield headers, b""
        source.end_record()


def gzip_member(data: bytes, level: int) -> bytes:
    """One gzip member that says how long it is."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def warc_record(row: dict) -> bytes:
    """A response or revisit record with an HTTP header before the payload."""
    length = row["payload_bytes"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
    block = http.encode() + (row["payload"] or b"")
    fields = [
        ("WARC-Type", row["warc_type"]),
        ("WARC-Record-ID", row["record_id"]),
        ("WARC-Date", row["warc_date"]),
        ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Payload-Digest", row["payload_digest"]),
        ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Profile", REVISIT_PROFILE if row["warc_type"] == "revisit" else None),
        ("Content-Type", _HTTP),
        ("Content-Length", str(len(block))),
    ]
    said = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{said}\r\n".encode() + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    """Rows of warc_type, record_id, target_uri, warc_date, payload_digest, refers_to,
    payload and payload_bytes to .warc.gz files, a gzip member a record.

    A task writes under names that readers pass over; a committed job renames them, a
    failed one removes them. So a task that ran twice leaves nothing twice."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.level = int(options.get("level", 1))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = resolve(self.path)
        fs.create_dir(folder, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for k in range(len(batch)):
                    if out is None or size >= self.file_bytes:
                        if out is not None:
                            out.close()
                        names.append(f"_{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                    member = gzip_member(warc_record(batch.slice(k, 1).to_pylist()[0]), self.level)
                    out.write(member)
                    size += len(member)
        finally:
            if out is not None:
                out.close()
        return Written(tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = resolve(self.path)
        fs.create_dir(folder, recursive=True)
        for message in messages:
            for name in message.files if message else ():
                fs.move(f"{folder}/{name}", f"{folder}/{name[1:]}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = resolve(self.path)
        for message in messages:
            for name in message.files if message else ():
                if fs.get_file_info(f"{folder}/{name}").type == pafs.FileType.File:
                    fs.delete_file(f"{folder}/{name}")


_RECORD = "urn:page:"


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{_RECORD}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_pages(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """A record for each row, added to the archives in `path`.

    The payload is the page in UTF-8, empty for null. Of rows with equal payloads of at
    least `min_bytes` bytes the one with the largest id is written as a response, the
    others as revisits that refer to it and hold no payload; smaller ones are all
    responses. Rows of that payload that repeat the largest id are responses too, and so
    are all rows of a payload none of which has an id. Other columns are not read. An
    empty table writes nothing but the folder.

    The largest ids are gathered with partial aggregation and joined back, so a payload
    may have any number of rows; Spark splits the join where one is frequent.
    """
    payload = F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{url_col}`").cast("string").alias("target_uri"),
        payload.alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    narrow = pages.select(F.col(f"`{id_col}`").alias("id"), payload.alias("payload"))
    kept = (
        narrow.where(F.octet_length("payload") >= min_bytes)
        .groupBy(F.sha1("payload").alias("sha1"))
        .agg(F.max("id").alias("keeper"))
    )
    rows = rows.join(kept, "sha1", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    spark = pages.sparkSession
    spark.dataSource.register(WarcDataSource)
    rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        _record_id(F.col("id")).alias("record_id"),
        "target_uri",
        F.lit(date).alias("warc_date"),
        F.concat(F.lit("sha1:"), base32(F.col("sha1"))).alias("payload_digest"),
        F.when(revisit, _record_id(F.col("keeper"))).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
    ).write.format("warc").mode("append").save(path)


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of a hexadecimal string of a multiple of five digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = F.sequence(F.lit(0), (F.length(hexadecimal) / 5).cast("int") - 1)

    def four(k: Column) -> Column:
        bits = F.conv(F.substring(hexadecimal, (k * 5 + 1).cast("int"), F.lit(5)), 16, 10).cast("int")
        at = [F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1 for s in (15, 10, 5, 0)]
        return F.concat(*[F.substring(letters, a, F.lit(1)) for a in at])

    return F.array_join(F.transform(groups, four), "")


def read_pages(spark, path: str, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record
    that write_pages has written.

    Responses are read with their payloads, which are held against their digests;
    revisits by their headers, the payloads of other records unread."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def page(record: str) -> Column:
        number = F.regexp_extract(record, f"<{_RECORD}(.*)>", 1)
        return F.when(number != "", number).cast(id_type)

    def some(kind: str, columns: str) -> DataFrame:
        named = "warc_type string, record_id string, payload_digest string, refers_to string"
        reader = spark.read.format("warc").option("verify", "true").schema(f"{named}, {columns}")
        return reader.load(path).where(F.col("warc_type") == kind)

    responses = some("response", "payload binary")
    responses = responses.withColumn("n", F.octet_length("payload").cast("long")).drop("payload")
    revisits = some("revisit", "http_headers map<string,string>")
    revisits = revisits.withColumn("n", F.col("http_headers")["content-length"].cast("long"))
    both = responses.unionByName(revisits.drop("http_headers"))
    return both.select(
        page("record_id").alias("page_id"),
        F.col("n").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )
