"""WARC archives as a Spark data source, and captures written with revisit records for equal payloads.

Writing: each task writes its records, one gzip member each, into files of its own. The member's header holds the
`sl` field, the member's compressed and plain length. A job's files count once the driver has written their names
into a `_committed-` list, so what failed or repeated tasks leave behind is never read.

Reading: partitions are whole files, small ones packed together. Filters on record type and headers are pushed into
the source. A record's header is parsed first; where it fails the filters, or where no column asks for the body,
the body is not decoded: `sl` (or Content-Length in plain files) leads to the next record, else it is inflated
piece by piece and thrown away.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
    WriterCommitMessage,
)

# Bytes of files that one read task takes, and bytes after which a writer begins its next file.
PARTITION_BYTES = 128 << 20
FILE_BYTES = 1 << 30
# Rows and bytes of payload in an Arrow batch of the reader.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
READ = 1 << 18

SCHEMA = ("file string, offset long, record_type string, record_id string, refers_to string, target_uri string, "
          "date string, content_type string, content_length long, declared_digest string, headers map<string,string>, "
          "http_headers map<string,string>, payload binary, payload_length long, digest_ok boolean")
# Columns that are plain header fields, and those that need the body.
FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to",
          "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type",
          "content_length": "content-length", "declared_digest": "warc-payload-digest"}
BODY = {"http_headers", "payload", "payload_length", "digest_ok"}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Archive:
    """The decoded bytes of a plain or gzipped file, record by record."""

    def __init__(self, file, gzipped: bool):
        self.file, self.gzipped = file, gzipped
        self.place, self.raw = 0, b""  # file position of what is read next, bytes read but not decoded
        self.data, self.at = b"", 0  # decoded bytes, and how many of them are used up
        self.inflater = None
        self.inflated = 0  # bytes decoded so far
        self.start, self.after = 0, None  # of the member at hand: its begin, and its end if its header names it
        self.alone = False  # whether the record at hand begins with its member

    def _read_raw(self) -> None:
        got = self.file.read(READ)
        self.place += len(got)
        self.raw += got

    def _open_member(self) -> bool:
        while len(self.raw) < 12 and (held := len(self.raw), self._read_raw()) and len(self.raw) > held:
            pass
        if not self.raw:
            return False
        self.start, self.after = self.place - len(self.raw), None
        if len(self.raw) >= 12 and self.raw[3] & 4:
            end = 12 + struct.unpack("<H", self.raw[10:12])[0]
            if len(self.raw) < end:
                self._read_raw()
            extra = self.raw[12:end]
            while len(extra) >= 4:
                size = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and size == 8:
                    self.after = self.start + struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + size:]
        self.inflater = zlib.decompressobj(31)
        return True

    def _more(self) -> bool:
        """Decodes some more bytes; False at the end of the file."""
        if not self.gzipped:
            self._read_raw()
            new, self.raw = self.raw, b""
            if not new:
                return False
        else:
            if self.inflater is None and not self._open_member():
                return False
            if not self.raw:
                self._read_raw()
            new = self.inflater.decompress(self.raw, READ)
            if not new and not self.raw and not self.inflater.eof:
                raise ValueError(f"archive ends inside the member at {self.start}")
            self.raw = self.inflater.unconsumed_tail
            if self.inflater.eof:
                self.raw, self.inflater = self.inflater.unused_data, None
        self.inflated += len(new)
        self.data, self.at = self.data[self.at:] + new, 0
        return True

    def head(self) -> bytes | None:
        """The next record's header; None at the end of the file."""
        self.alone = False
        while True:
            while self.data[self.at:self.at + 1] in (b"\r", b"\n"):  # blank lines between records
                self.at += 1
            if self.at < len(self.data):
                break
            begins = self.gzipped and self.inflater is None
            if not self._more():
                return None
            self.alone = begins
        if not self.gzipped:
            self.start = self.place - (len(self.data) - self.at)
        while (end := self.data.find(b"\r\n\r\n", self.at)) < 0:
            if not self._more():
                raise ValueError(f"archive ends inside the header at {self.start}")
        header, self.at = self.data[self.at:end], end + 4
        return header

    def read(self, n: int) -> bytes:
        parts, missing = [], n
        while True:
            parts.append(self.data[self.at:self.at + missing])
            self.at += len(parts[-1])
            missing -= len(parts[-1])
            if not missing:
                return b"".join(parts)
            if not self._more():
                raise ValueError(f"archive ends inside the record at {self.start}")

    def skip(self, n: int) -> None:
        """Passes over n bytes of body, by a jump where the file says how far."""
        target = self.place - (len(self.data) - self.at) + n if not self.gzipped else self.after if self.alone else None
        if target is not None and (self.gzipped or target > self.place):
            held = self.place - len(self.raw)
            if target > self.place:
                self.file.seek(target)
                self.place, self.raw = target, b""
            else:
                self.raw = self.raw[target - held:]
            self.data, self.at, self.inflater = b"", 0, None
            return
        while n > len(self.data) - self.at:
            n, self.at = n - (len(self.data) - self.at), len(self.data)
            if not self._more():
                raise ValueError(f"archive ends inside the record at {self.start}")
        self.at += n


def parse_fields(lines: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a blank goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def header_value(fields: dict[str, str], column: str):
    value = fields.get(FIELDS[column])
    if value is None:
        return None
    if column == "content_length":
        return int(value)
    return value[1:-1] if column in ("record_id", "refers_to") and value[:1] == "<" and value[-1:] == ">" else value


_TESTS = {
    EqualTo: lambda x, y: x == y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y,
    LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y, StringStartsWith: lambda x, y: x.startswith(y),
    StringEndsWith: lambda x, y: x.endswith(y), StringContains: lambda x, y: y in x,
}


def _bytewise(value):
    """Strings compare by their UTF-8 bytes, as in Spark."""
    return value.encode() if isinstance(value, str) else value


def test_for(condition):
    """(column, value -> True, False or None) of a pushed filter on a header column, or None for another filter."""
    if isinstance(condition, Not):
        inner = test_for(condition.child)
        return inner and (inner[0], lambda v, f=inner[1]: None if (r := f(v)) is None else not r)
    column = condition.attribute[0] if len(condition.attribute) == 1 else None
    if column not in FIELDS:
        return None
    kind = type(condition)
    if kind in (IsNull, IsNotNull):
        return column, (lambda v: v is None) if kind is IsNull else (lambda v: v is not None)
    if kind is EqualNullSafe:
        return column, lambda v, y=condition.value: v == y
    if kind is In:
        wanted, unsure = {x for x in condition.value if x is not None}, any(x is None for x in condition.value)
        return column, lambda v: None if v is None else True if v in wanted else None if unsure else False
    if kind in _TESTS:
        test, right = _TESTS[kind], _bytewise(condition.value)
        return column, lambda v: None if v is None or right is None else test(_bytewise(v), right)
    return None


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        self.paths = paths


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.columns, self.arrow = [field.name for field in schema.fields], to_arrow_schema(schema)
        known = {c.split()[0] for c in SCHEMA.split(", ")}
        if unknown := [c for c in self.columns if c not in known]:
            raise ValueError(f"no such column of WARC records: {', '.join(unknown)}")
        self.path, self.conditions = options["path"], []
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))

    def pushFilters(self, filters):
        for condition in filters:
            if test_for(condition):
                self.conditions.append(condition)
            else:
                yield condition

    def partitions(self):
        parts, size = [[]], 0
        for path, length in archive_files(self.path):
            if parts[-1] and size + length > self.partition_bytes:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += length
        return [Files(p) for p in parts]

    def read(self, partition):
        rows, size = [], 0
        for row, weight in self._records(partition.paths):
            rows.append(row)
            size += weight
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield _batch(rows, self.arrow)
                rows, size = [], 0
        if rows:
            yield _batch(rows, self.arrow)

    def _records(self, paths: list[str]) -> Iterator[tuple[list, int]]:
        tests = [test_for(c) for c in self.conditions]
        body = BODY & set(self.columns)
        for path in paths:
            system, place = filesystem(path)
            with system.open_input_file(place) as file:
                archive = Archive(file, path.endswith(".gz"))
                while (header := archive.head()) is not None:
                    if not header.startswith(b"WARC/"):
                        raise ValueError(f"{path}: no WARC record at {archive.start}")
                    fields, start = parse_fields(header), archive.start
                    length = int(fields.get("content-length", 0))
                    if not all(test(header_value(fields, column)) for column, test in tests):
                        archive.skip(length)
                        continue
                    values = {"file": path, "offset": start, "headers": fields} | {
                        c: header_value(fields, c) for c in FIELDS if c in self.columns}
                    if body:
                        values |= parse_body(fields, archive.read(length))
                    else:
                        archive.skip(length)
                    yield [values[c] for c in self.columns], len(values.get("payload") or b"")


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([list(v.items()) if isinstance(v, dict) else v for v in column], field.type)
        for column, field in zip(zip(*rows), schema)], schema=schema)


def parse_body(fields: dict[str, str], block: bytes) -> dict:
    """HTTP header, payload, its length and whether the digest holds.

    A revisit has no payload: its length is the one that its HTTP header gives.
    """
    http, payload = None, block
    if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        header, _, payload = block.partition(b"\r\n\r\n")
        http = parse_fields(header)
    if fields.get("warc-type") == "revisit":
        length = (http or {}).get("content-length")
        return {"http_headers": http, "payload": None, "payload_length": int(length) if length else None, "digest_ok": None}
    kind, _, digest = fields.get("warc-payload-digest", "").partition(":")
    return {"http_headers": http, "payload": payload, "payload_length": len(payload),
            "digest_ok": base32_sha1(payload) == digest if kind.lower() == "sha1" else None}


def archive_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the archives of a folder, or of one file. With `_committed-` lists only what they name."""
    system, place = filesystem(path)
    info = system.get_file_info(place)
    prefix = path[:len(path) - len(place)] if path.endswith(place) else ""
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = sorted(system.get_file_info(fs.FileSelector(place)), key=lambda f: f.path)
    lists = [f.path for f in found if f.base_name.startswith("_committed-")]
    named: set[str] = set()
    for name in lists:
        with system.open_input_stream(name) as file:
            named.update(file.read().decode().split("\n"))
    return [(prefix + f.path, f.size) for f in found if f.type == fs.FileType.File
            and f.base_name.endswith((".warc", ".warc.gz")) and (not lists or f.base_name in named)]


def clean(value: str) -> str:
    """A value for one header line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(kind: str, record_id: str, block: bytes, content_type: str, **fields: str | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {clean(kind)}", f"WARC-Record-ID: <{clean(record_id)}>"]
    lines += [f"WARC-{name.replace('_', '-')}: {clean(value)}" for name, value in fields.items() if value is not None]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member that names its compressed and plain length in an `sl` field."""
    squeezer = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = squeezer.compress(data) + squeezer.flush()
    return b"".join([b"\x1f\x8b\x08\x04", bytes(5), b"\xff", struct.pack("<H2sHII", 12, b"sl", 8, len(packed) + 32, len(data)),
                     packed, struct.pack("<II", zlib.crc32(data), len(data))])


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.level = int(options.get("level", 6))
        self.suffix = ".warc.gz" if options.get("compression", "gzip") == "gzip" else ".warc"
        system, place = filesystem(self.path)
        system.create_dir(place, recursive=True)
        self.old = [f.path for f in system.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File]

    def _record(self, row: dict) -> bytes:
        payload, kind = row.get("payload"), row["record_type"]
        digest = row.get("declared_digest") or (None if payload is None else "sha1:" + base32_sha1(payload))
        length = row.get("payload_length")
        block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                 f"Content-Length: {length if length is not None else len(payload or b'')}\r\n\r\n").encode()
        refers = row.get("refers_to")
        return record(
            kind, row["record_id"], block if kind == "revisit" else block + (payload or b""),
            "application/http;msgtype=response", Date=row.get("date") or "1970-01-01T00:00:00Z",
            Target_URI=row.get("target_uri"), Refers_To=None if refers is None else f"<{refers}>",
            Profile=SAME_PAYLOAD if kind == "revisit" else None, Payload_Digest=digest)

    def write(self, iterator):
        system, place = filesystem(self.path)
        names, file, size, attempt = [], None, 0, uuid.uuid4().hex
        for batch in iterator:
            # row by row, so that a batch of large payloads is never held twice
            for n in range(batch.num_rows):
                if file is None or size >= self.file_bytes:
                    if file is not None:
                        file.close()
                    names.append(f"part-{attempt}-{len(names):05d}{self.suffix}")
                    file, size = system.open_output_stream(f"{place}/{names[-1]}", compression=None), 0
                    size += self._put(file, record(
                        "warcinfo", f"urn:uuid:{uuid.uuid4()}", b"format: WARC File Format 1.1\r\n",
                        "application/warc-fields", Date="1970-01-01T00:00:00Z", Filename=names[-1]))
                row = {c: batch.column(i)[n].as_py() for i, c in enumerate(batch.schema.names)}
                size += self._put(file, self._record(row))
        if file is not None:
            file.close()
        return Written(names)

    def _put(self, file, data: bytes) -> int:
        data = member(data, self.level) if self.suffix.endswith(".gz") else data
        file.write(data)
        return len(data)

    def commit(self, messages):
        system, place = filesystem(self.path)
        with system.open_output_stream(f"{place}/_committed-{self.job}") as file:
            file.write("\n".join(n for m in messages if m for n in m.paths).encode())
        if self.overwrite:
            for old in sorted(self.old, key=lambda p: "/_committed-" not in p):  # lists first
                system.delete_file(old)

    def abort(self, messages):
        system, place = filesystem(self.path)
        for name in [n for m in messages if m for n in m.paths]:
            system.delete_file(f"{place}/{name}")


class WarcSource(DataSource):
    """`spark.read.format("warc").load(folder)` and `df.write.format("warc").save(folder)`.

    Read options: partition_bytes. A schema with fewer columns reads less. Write options: file_bytes, level,
    compression (gzip or none). Columns written: record_type and record_id, and where they are there payload,
    payload_length, declared_digest, target_uri, refers_to, date; others are ignored.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        names = {field.name for field in schema.fields}
        if missing := {"record_type", "record_id"} - names:
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the source known to the session and lets Spark push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def captures(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
             min_bytes: int = 0) -> DataFrame:
    """Rows for the writer: of equal payloads of `min_bytes` and more the largest id is the response, the others
    revisit it; smaller ones are all responses.

    A null payload is empty. Payloads count as equal if SHA-1, length and a second hash agree. Rows that repeat
    the largest id are responses each; rows without id are the smallest, and responses where no id is there.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(uri_col).alias("target_uri"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_length"), F.sha1(payload).alias("sha1"),
        F.xxhash64(payload).alias("second"))
    holders = rows.groupBy("sha1", "second", "payload_length").agg(F.max("id").alias("holder"))
    revisit = (F.col("payload_length") >= min_bytes) & F.col("holder").isNotNull() & ~F.col("id").eqNullSafe(F.col("holder"))
    return rows.join(holders, ["sha1", "second", "payload_length"]).select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none"))).alias("record_id"),
        F.when(revisit, F.concat(F.lit("urn:page:"), "holder")).alias("refers_to"), "target_uri",
        F.when(~revisit, F.col("payload")).alias("payload"), "payload_length",
        F.concat(F.lit("sha1:"), base32("sha1")).alias("declared_digest"))


def base32(hex_digits: str):
    """Base 32 of 40 hexadecimal digits, by five binary digits a letter."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(hex_digits, at, 10), 16, 2), 40, "0") for at in (1, 11, 21, 31)])
    number = lambda n: F.conv(F.substring(bits, 5 * n + 1, 5), 2, 10).cast("int")
    return F.concat(*[F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), number(n) + 1, F.lit(1)) for n in range(32)])


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from the archives written to `folder`.

    A payload that does not agree with its digest is an error. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    register(spark)
    captures(pages).write.format("warc").mode("append").save(folder)
    records = spark.read.format("warc").schema(
        "record_type string, record_id string, refers_to string, declared_digest string, payload_length long, "
        "digest_ok boolean").load(folder).filter(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    return records.select(
        page("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.when(F.col("digest_ok").isNull() | F.col("digest_ok"), F.substring("declared_digest", 6, 32)).otherwise(
            F.raise_error(F.concat(F.lit("payload differs from its digest: "), "record_id"))).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"))
