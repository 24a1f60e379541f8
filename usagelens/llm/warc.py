"""Web archives as a Spark data source: WARC files of gzip members, read by record type and header."""

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith,
    WriterCommitMessage)

from usagelens.runtime import work_folder

SCHEMA = ("record_id string, record_type string, target_uri string, date string, payload_digest string, "
          "refers_to string, payload_bytes long, payload binary")
MANIFEST = re.compile(r"_files-[0-9a-f]{32}\.json")  # one for each write
FILE_BYTES = 1 << 30  # a task goes on to a new file beyond this size
PARTITION_BYTES = 32 << 20  # small files read together
BATCH_BYTES = 8 << 20
HEAD = 4096  # bytes unpacked at a time while a header is looked for
# Field names of the format. Fixed values.
FIELDS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BRACKETED = ("record_id", "refers_to")


def _file_system(path: str):
    from pyarrow import fs

    if ":" not in path.split("/")[0]:
        path = f"file://{path}"
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


def qualified(spark, path: str) -> str:
    """The path with the scheme that Spark gives it, so that tasks mean the same place as the driver."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def _manifests(system, root: str) -> list[str]:
    from pyarrow import fs

    listed = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(found.path for found in listed if MANIFEST.fullmatch(found.base_name))


def _field(value: str) -> str:
    """A header value on one line: blanks and control characters become percent signs with their code."""
    return re.sub(r"[\x00-\x20\x7f-\x9f]", lambda found: quote(found[0]), value)


def _header(first: str, fields) -> bytes:
    return "\r\n".join([first, *(f"{name}: {value}" for name, value in fields if value is not None), "", ""]).encode()


def record(row: dict) -> bytes:
    """One record with its WARC and HTTP headers; a revisit keeps the HTTP header, not the payload."""
    payload, kind = row["payload"] or b"", row["record_type"]
    size = len(payload) if row["payload_bytes"] is None else row["payload_bytes"]
    http = _header("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)])
    block = http if kind == "revisit" else http + payload
    fields = []
    for column, name in FIELDS.items():
        value = row[column]
        if value is not None:
            value = _field(value)
            value = f"<{value}>" if column in BRACKETED else f"sha1:{value}" if column == "payload_digest" else value
        fields.append((name, value))
    head = _header("WARC/1.1", [*fields, ("WARC-Profile", PROFILE if kind == "revisit" else None),
                                ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))])
    return head + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` tells its packed and plain length, so that readers can skip it."""
    packer = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


class Member:
    """One record of an open file, unpacked as far as it is asked for."""

    def __init__(self, source, start: int):
        self.source, self.start, self.size = source, start, None
        source.seek(start)
        head = source.read(12)
        self.packed = head[:2] == b"\x1f\x8b"
        self.plain, self.ended, self.rest = bytearray(), False, b""
        if self.packed:
            flags, at = head[3], 10
            if flags & 4:
                extra = source.read(struct.unpack("<H", head[10:12])[0])
                at = 12 + len(extra)
                while len(extra) >= 4:
                    length = struct.unpack("<H", extra[2:4])[0]
                    # The length has 32 bits; a longer record is read through.
                    if extra[:2] == b"sl" and length == 8 and struct.unpack("<I", extra[8:12])[0] < 1 << 31:
                        self.size = struct.unpack("<I", extra[4:8])[0]
                    extra = extra[4 + length:]
            source.seek(start + at)
            for flag in (8, 16):  # file name and comment end with a zero byte
                while flags & flag and source.read(1) not in (b"\x00", b""):
                    pass
            if flags & 2:
                source.read(2)
            self.unpacker = zlib.decompressobj(-15)
        else:
            source.seek(start)

    def more(self, number: int) -> bool:
        """Unpack up to ``number`` further bytes; False at the end."""
        if self.ended:
            return False
        if not self.packed:
            data = self.source.read(number)
            self.plain += data
            self.ended = not data
            return bool(data)
        while True:
            given = self.rest or self.source.read(1 << 16)
            if not given:
                self.ended = True
                raise ValueError(f"archive ends inside the record at {self.start}")
            data = self.unpacker.decompress(given, number)
            self.rest = self.unpacker.unconsumed_tail
            self.plain += data
            if self.unpacker.eof:
                self.ended = True
                if self.size is None:
                    self.size = self.source.tell() - len(self.unpacker.unused_data) + 8 - self.start
            if data or self.ended:
                return bool(data)

    def until(self, mark: bytes, start: int) -> int:
        """Place behind the next ``mark``, unpacking as needed; -1 if there is none."""
        seen = start
        while (at := self.plain.find(mark, max(start, seen - len(mark)))) < 0:
            seen = len(self.plain)
            if not self.more(HEAD):
                return -1
        return at + len(mark)

    def fill(self, length: int) -> None:
        while len(self.plain) < length and self.more(max(HEAD, length - len(self.plain))):
            pass

    def end(self, plain_length: int) -> int:
        """Where the next record begins; only a member that does not tell its size is unpacked to its end."""
        if not self.packed:
            return self.start + plain_length
        while self.size is None:
            self.plain = bytearray()
            self.more(1 << 20)
        return self.start + self.size


def parse_header(head: bytes) -> dict[str, str]:
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return fields


def read_file(source, length: int, wanted, with_payload: bool, verify: bool):
    """Rows of one file. Headers come first: payloads of records that ``wanted`` refuses stay packed."""
    start = 0
    while start < length:
        part = Member(source, start)
        body = part.until(b"\r\n\r\n", 0)
        if body < 0:
            if not part.plain.strip():
                return
            raise ValueError(f"no header in the record at {start}")
        fields = parse_header(bytes(part.plain[:body]))
        block = int(fields.get("content-length", 0))
        row = {column: fields.get(name.lower()) for column, name in FIELDS.items()}
        for column in BRACKETED:
            if row[column]:
                row[column] = row[column].strip("<>")
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
        if wanted(row):
            row |= {"payload_bytes": None, "payload": None}
            if "http" in fields.get("content-type", "") and block:
                http = part.until(b"\r\n\r\n", body)
                if 0 <= http <= body + block:
                    told = parse_header(bytes(part.plain[body:http])).get("content-length")
                    row["payload_bytes"] = int(told) if told else None
                    if row["record_type"] != "revisit" and (with_payload or verify):
                        part.fill(body + block)
                        payload = bytes(part.plain[http:body + block])
                        if verify and (len(payload) != row["payload_bytes"] or row["payload_digest"] != base64.b32encode(
                                hashlib.sha1(payload).digest()).decode()):
                            raise ValueError(f"payload of {row['record_id']} differs from its digest")
                        row["payload"] = payload if with_payload else None
            yield row
        start = part.end(body + block + 4)


@dataclass
class Files(InputPartition):
    names: list


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns, self.options, self.tests = schema.names, dict(options), []

    def pushFilters(self, filters):
        """Record type and header fields are tested on the header; other filters stay with Spark."""
        for given in filters:
            column = given.attribute[0] if len(getattr(given, "attribute", ())) == 1 else None
            if column in FIELDS and isinstance(given, (EqualTo, In, IsNotNull, StringStartsWith)):
                value = getattr(given, "value", None)
                kind = type(given).__name__
                self.tests.append((kind, column, tuple(value) if kind == "In" else value))
            else:
                yield given

    def partitions(self):
        """Files of about PARTITION_BYTES together; names and sizes come from the folder's manifests or listing."""
        from pyarrow import fs

        system, root = _file_system(self.options["path"])
        found = system.get_file_info(root)
        manifests = _manifests(system, root) if found.type == fs.FileType.Directory else []
        files = []
        for path in manifests:
            with system.open_input_stream(path) as listed:
                files += [(f"{root}/{name}", size) for name, size in json.loads(listed.read())]
        if not manifests:
            found = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root))
            files = [(f.path, f.size) for f in found if f.path.endswith((".warc", ".warc.gz"))]
        parts, size = [], PARTITION_BYTES
        for name, length in sorted(files):
            if size + length > PARTITION_BYTES:
                parts.append([])
                size = 0
            parts[-1].append((name, length))
            size += length
        return [Files(part) for part in parts] or [Files([])]

    def read(self, partition):
        system, _ = _file_system(self.options["path"])
        tests = self.tests

        def wanted(row):
            for kind, column, value in tests:
                have = row[column]
                if have is None or kind == "EqualTo" and have != value or kind == "In" and have not in value \
                        or kind == "StringStartsWith" and not have.startswith(value):
                    return False
            return True

        types = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array([row[c] for row in rows], types.get(c, pa.string())) for c in self.columns], self.columns)

        verify = self.options.get("verify", "false").lower() == "true"
        for name, length in partition.names:
            with system.open_input_file(name) as source:
                for row in read_file(source, length, wanted, "payload" in self.columns, verify):
                    rows.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size > BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite=False):
        self.options, self.overwrite = dict(options), overwrite

    def write(self, iterator):
        """Files of one task. Names carry a random part, so that a repeated task never meets its predecessor's files."""
        from pyspark import TaskContext

        system, root = _file_system(self.options["path"])
        system.create_dir(root, recursive=True)
        limit, files, out = int(self.options.get("file_bytes", FILE_BYTES)), [], None
        part = TaskContext.get().partitionId()
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
                    out, size = system.open_output_stream(f"{root}/{name}", compression=None), 0
                data = member(record(row))
                out.write(data)
                size += len(data)
                if size > limit:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages):
        """Readers see the files that manifests name, so those of failed attempts do not count. Each write adds a manifest;
        one that overwrites removes those before it."""
        system, root = _file_system(self.options["path"])
        system.create_dir(root, recursive=True)
        before = _manifests(system, root) if self.overwrite else []
        with system.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([file for message in messages if message for file in message.files]).encode())
        for path in before:
            system.delete_file(path)

    def abort(self, messages):
        system, root = _file_system(self.options["path"])
        for message in messages:
            for name, _ in message.files if message else ():
                system.delete_file(f"{root}/{name}")


class Warc(DataSource):
    """Format ``warc``. A schema without ``payload`` leaves payloads packed; ``verify`` checks them all the same."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html",
                 date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0) -> DataFrame:
    """Records of pages: of equal payloads the page of the smallest id is the response, the others revisit it.

    Payloads below ``min_bytes`` are all responses. Null html counts as empty. Rows that repeat the smallest id of
    their payload are all responses; so are rows with a null id if no equal payload has one. Equality is that of
    SHA-1 digest and length; only those, not the pages, are grouped.
    """
    known = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{uri_col}`").cast("string").alias("target_uri"),
        F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    known = known.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    first = known.groupBy("sha1", "payload_bytes").agg(F.min("id").alias("first"))
    both = known.join(first, ["sha1", "payload_bytes"])
    again = (F.col("payload_bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return both.select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("date"),
        base32(F.unhex("sha1")).alias("payload_digest"),
        F.when(again, F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to"), "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"))


def base32(binary):
    """Base-32 text of 20 bytes: 32 groups of five bits."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(F.hex(binary), 10 * k + 1, 10), 16, 2), 40, "0") for k in range(4)])
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return F.concat(*[F.substring(F.lit(letters), F.conv(F.substring(bits, 5 * k + 1, 5), 2, 10).cast("int") + 1,
                                  F.lit(1)) for k in range(32)])


def write_archive(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write records as archives below ``path``; the columns are those of SCHEMA, missing ones are null."""
    register(records.sparkSession)
    full = [column.split()[0] for column in SCHEMA.split(", ")]
    kinds = dict(column.split() for column in SCHEMA.split(", "))
    have = {name.lower() for name in records.columns}
    rows = records.select(*[(F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in full])
    rows.write.format("warc").mode("append").option("file_bytes", file_bytes).save(
        qualified(records.sparkSession, path))


def read_archive(spark, path: str, columns=None, verify: bool = False) -> DataFrame:
    """Records below ``path`` with the given columns of SCHEMA, all by default."""
    register(spark)
    schema = ", ".join(c for c in SCHEMA.split(", ") if columns is None or c.split()[0] in columns)
    return spark.read.format("warc").schema(schema).option("verify", str(verify)).load(
        qualified(spark, path))


def archived_pages(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the pages as archives, read them back with their payloads verified, and tell what each page became.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to. An empty table gives none.
    """
    spark = pages.sparkSession
    path = path or work_folder(spark, "warc")
    write_archive(page_records(pages, **options), path)
    found = read_archive(spark, path, ["record_id", "record_type", "payload_digest", "refers_to", "payload_bytes"],
                         verify=True).filter(F.col("record_type").isin("response", "revisit"))
    page = F.regexp_extract("record_id", "^urn:page:(-?[0-9]+)$", 1)
    target = F.regexp_extract("refers_to", "^urn:page:(-?[0-9]+)$", 1)
    return found.select(F.when(page != "", page).cast("long").alias("page_id"), "payload_bytes", "payload_digest",
                        "record_type", F.when(target != "", target).cast("long").alias("refers_to"))
