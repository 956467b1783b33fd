"""Web archives as a Spark data source (operator 13).

``spark.read.format("warc")`` plans neighbouring files into partitions, takes over predicates on the record type and other
headers, and reads each record's headers first: of a record that a predicate rejects neither HTTP headers nor
payload are decoded.  In plain files its block is skipped by its length.  In compressed ones every record is a gzip member;
those written here name their compressed length in the gzip header, so the rest of the member is
skipped as well (members of other writers are inflated in pieces and thrown away).  A file is read by one task, as record ends
inside a file can't be told from payload bytes; the writer starts a new file after ``file_bytes``.

``df.write.format("warc")`` takes the columns ``warc_type, record_id, target_uri, date, refers_to, payload_digest,
payload_length, content_type, payload`` (any may be missing).  Responses and revisits hold an HTTP head; a
revisit has no payload, its HTTP head keeps the payload's length.

Spark 4.1 keeps the predicates handed over with the loaded table, not with the query: a DataFrame that ``load`` returned, used in
two queries, would read the second with the first's predicates.  So every query takes a fresh :func:`records`.

Options for reading: ``payload`` (false: the column is NULL), ``verify`` (true: payloads are read, also if not returned, and
compared with their digest), ``partition_bytes``, ``mode``: a record that can't be read raises an error (``failfast``) or is a row
with ``file, offset, error`` alone (``permissive``), after which reading goes on at the next record of a plain file and ends in a compressed one.
Options for writing: ``compression`` (gzip or none), ``file_bytes``.

Defined results for pages: NULL html is an empty payload; a NULL url leaves the header out; a NULL page_id is NULL again.  Repeated rows are
records of their own.  An empty table gives archives without records.  Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from ..operators.sizing import MAX_BROADCAST_ROWS, maybe_broadcast
from ..session import materialize, scratch_path
from ..sources import storage

SCHEMA = ("file string, offset long, warc_type string, record_id string, date string, target_uri string, refers_to string, payload_digest string, "
          "content_type string, content_length long, headers map<string,string>, http_status int, http_headers map<string,string>, "
          "payload_length long, payload binary, error string")
ARROW = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("date", pa.string()),
    ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()),
    ("headers", pa.map_(pa.string(), pa.string())), ("http_status", pa.int32()), ("http_headers", pa.map_(pa.string(), pa.string())),
    ("payload_length", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
#: Columns that are WARC headers of their own.
NAMED = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To",
         "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type"}
#: Columns known before the block of a record is read, with the file's name.
EARLY = (*NAMED, "content_length", "file", "offset")
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
END = b"\r\n\r\n"
#: Subfield of the gzip header that holds a member's compressed length.
LENGTH_FIELD = b"QL"
CHUNK = 1 << 16
#: Most bytes of a record's headers; more is no record.
MOST_HEADERS = 1 << 20
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


class Malformed(ValueError):
    pass


# --- records as bytes ----------------------------------------------------------------

def sha1(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(value: str) -> str:
    """A header's value on one line: line ends and other control characters as percent codes."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def head_of(named: dict[str, str | None], length: int) -> bytes:
    lines = [f"{k}: {header_value(v)}\r\n" for k, v in named.items() if v is not None]
    return VERSION + "".join(lines).encode() + f"Content-Length: {length}\r\n\r\n".encode()


def record_bytes(row: dict) -> bytes:
    """One record of a row's columns."""
    kind = row.get("warc_type") or "response"
    payload = row.get("payload") or b""
    digest = row.get("payload_digest") or (sha1(payload) if kind == "response" else None)
    block, content = payload, row.get("content_type") or "application/octet-stream"
    named = {"WARC-Type": kind, "WARC-Record-ID": row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": row.get("date") or "1970-01-01T00:00:00Z",
             "WARC-Target-URI": row.get("target_uri"), "WARC-Refers-To": row.get("refers_to"), "WARC-Payload-Digest": digest}
    if kind in ("response", "revisit"):
        length = len(payload) if kind == "response" else row.get("payload_length")
        lines = ["HTTP/1.1 200 OK", f"Content-Type: {header_value(content)}", *([] if length is None else [f"Content-Length: {length}"])]
        block = "\r\n".join(lines).encode() + END + (payload if kind == "response" else b"")
        content = HTTP_TYPE
    if kind == "revisit":
        named["WARC-Profile"] = REVISIT_PROFILE
    return head_of({**named, "Content-Type": content}, len(block)) + block + END


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose header says how long it is."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra = LENGTH_FIELD + struct.pack("<HQ", 8, 10 + 2 + 12 + len(body) + 8)
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(raw: bytes) -> list[tuple[str, str]]:
    """Names and values; a line that begins with white space continues the one before."""
    out: list[tuple[str, str]] = []
    for line in raw.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


# --- reading --------------------------------------------------------------------------

@dataclass
class Record:
    """A record's headers, and how to get at the block or past it."""

    offset: int
    headers: list[tuple[str, str]]
    length: int
    read: Callable[[], bytes]

    def early(self, file: str) -> dict:
        by_name = {k.lower(): v for k, v in self.headers}
        return {**{c: by_name.get(h.lower()) for c, h in NAMED.items()}, "content_length": self.length, "file": file, "offset": self.offset}


def _headers(raw: bytes, offset: int) -> tuple[list[tuple[str, str]], int]:
    first, _, rest = raw.partition(b"\n")
    if not first.startswith(b"WARC/"):
        raise Malformed(f"no record at byte {offset}")
    headers = parse_headers(rest)
    length = next((v for k, v in headers if k.lower() == "content-length"), "")
    if not length.isdecimal():
        raise Malformed(f"no length in the record at byte {offset}")
    return headers, int(length)


class PlainFile:
    """Records of an uncompressed file, one after another."""

    def __init__(self, source: io.BufferedReader):
        self.source, self.next = source, 0

    def record(self) -> Record | None:
        at = self.next
        self.source.seek(at)
        lines, size = [], 0
        while True:
            line = self.source.readline(MOST_HEADERS)
            if not line.strip():
                if lines or not line:
                    break
                at += len(line)  # empty lines before a record
                continue
            lines.append(line)
            size += len(line)
            if size > MOST_HEADERS:
                raise Malformed(f"headers of more than {MOST_HEADERS} bytes at byte {at}")
        if not lines:
            return None
        headers, length = _headers(b"".join(lines), at)
        begin = self.source.tell()
        self.next = begin + length

        def read() -> bytes:
            self.source.seek(begin)
            block = self.source.read(length)
            if len(block) < length:
                raise Malformed(f"the file ends inside the record at byte {at}")
            return block

        return Record(at, headers, length, read)

    def recover(self) -> bool:
        """Go on at the next place that looks like a record."""
        at, tail = self.next + 1, b""
        self.source.seek(at)
        while chunk := self.source.read(CHUNK):
            found = (tail + chunk).find(b"\nWARC/1.")
            if found >= 0:
                self.next = at - len(tail) + found + 1
                return True
            at += len(chunk)
            tail = (tail + chunk)[-7:]
        return False


class GzipFile:
    """Records of a file of gzip members, a record each."""

    def __init__(self, source: io.BufferedReader):
        self.source, self.next = source, 0

    def _known_length(self, head: bytes) -> int | None:
        if len(head) >= 24 and head[3] & 4 and head[12:14] == LENGTH_FIELD:
            return struct.unpack("<Q", head[16:24])[0]
        return None

    def record(self) -> Record | None:
        at = self.next
        self.source.seek(at)
        head = self.source.read(CHUNK)
        if not head:
            return None
        known = self._known_length(head)
        state = {"in": head, "done": False, "at": at + len(head), "size": 0}
        unpacker = zlib.decompressobj(31)

        def more(most: int) -> bytes:
            try:
                piece = unpacker.decompress(state["in"], most)
            except zlib.error as e:
                raise Malformed(f"{e} at byte {at}") from e
            state["in"] = unpacker.unconsumed_tail
            state["size"] += len(piece)
            if unpacker.eof:
                state["done"] = True
            elif not state["in"]:
                self.source.seek(state["at"])
                state["in"] = self.source.read(CHUNK)
                state["at"] += len(state["in"])
                if not state["in"] and not piece:
                    raise Malformed(f"the file ends inside the record at byte {at}")
            return piece

        raw = b""
        while not state["done"] and (cut := re.search(rb"\r?\n\r?\n", raw)) is None:
            raw += more(4096)
            if len(raw) > MOST_HEADERS:
                raise Malformed(f"headers of more than {MOST_HEADERS} bytes at byte {at}")
        cut = re.search(rb"\r?\n\r?\n", raw)
        if cut is None:
            raise Malformed(f"no record at byte {at}")
        headers, length = _headers(raw[:cut.start()], at)
        begun = raw[cut.end():]

        def end() -> None:
            while not state["done"]:
                more(CHUNK)
            self.next = state["at"] - len(unpacker.unused_data)
            if state["size"] > cut.end() + length + len(END):
                raise Malformed(f"more than one record in the gzip member at byte {at}")

        if known is not None:
            self.next = at + known
        else:
            self.next = -1  # only known after inflating

        def read() -> bytes:
            parts, size = [begun], len(begun)
            while size < length and not state["done"]:
                parts.append(more(CHUNK))
                size += len(parts[-1])
            if size < length:
                raise Malformed(f"the record at byte {at} is shorter than it says")
            return b"".join(parts)[:length]

        self.finish = end
        return Record(at, headers, length, read)

    def past(self) -> None:
        if self.next < 0:
            self.finish()

    def recover(self) -> bool:
        return False


def open_records(file: str, source: io.BufferedReader) -> PlainFile | GzipFile:
    magic = source.peek(2)[:2]
    return GzipFile(source) if magic == b"\x1f\x8b" else PlainFile(source)


def split_http(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """Status, headers and payload of an HTTP response."""
    head, found, payload = block.partition(END)
    if not found:
        head, _, payload = block.partition(b"\n\n")
    first, _, rest = head.partition(b"\n")
    status = re.match(rb"HTTP/\S+\s+(\d{3})", first)
    return (int(status.group(1)) if status else None), parse_headers(rest), payload


def decode(record: Record, early: dict, payload: bool, verify: bool) -> dict:
    """The whole row of a record whose headers no predicate rejects."""
    row = {**early, "headers": [(k, v) for k, v in dict(record.headers).items() if k not in NAMED.values() and k != "Content-Length"],
           "http_status": None, "http_headers": None, "payload_length": None, "payload": None, "error": None}
    http = (early["content_type"] or "").replace(" ", "").lower().startswith("application/http")
    if early["warc_type"] == "revisit" or payload or verify:
        body = record.read()
        if http:
            row["http_status"], headers, body = split_http(body)
            row["http_headers"] = list(dict(headers).items())
            told = next((v for k, v in headers if k.lower() == "content-length"), "")
            if early["warc_type"] == "revisit":
                row["payload_length"] = int(told) if told.isdecimal() else None
        if early["warc_type"] != "revisit":
            row["payload_length"] = len(body)
            row["payload"] = body if payload else None
            digest = early["payload_digest"]
            if verify and digest and digest.startswith("sha1:") and sha1(body) != digest:
                raise Malformed(f"payload and digest differ in the record at byte {record.offset}")
    return row


def read_file(path: str, source: io.BufferedReader, wanted: Callable[[dict], bool], payload: bool, verify: bool, strict: bool) -> Iterator[dict]:
    records = open_records(path, source)
    while True:
        began = max(records.next, 0)
        try:
            record = records.record()
            if record is None:
                return
            early = record.early(path)
            if wanted(early):
                yield decode(record, early, payload, verify)
            if isinstance(records, GzipFile):
                records.past()
        except Malformed as e:
            if strict:
                raise Malformed(f"{path}: {e}") from e
            row = {**{c: None for c in ARROW.names}, "file": path, "offset": began, "error": str(e)}
            if wanted(row):
                yield row
            if records.next <= began and not records.recover() or records.next < 0:
                return


# --- predicates ------------------------------------------------------------------------

def as_test(f: ds.Filter) -> Callable[[dict], bool | None] | None:
    """A test of early columns with SQL's three values, or None for a predicate that Spark has to evaluate."""
    if isinstance(f, ds.Not):
        inner = as_test(f.child)
        return None if inner is None else lambda row: None if (x := inner(row)) is None else not x
    if len(f.attribute) != 1 or f.attribute[0] not in EARLY:
        return None
    name = f.attribute[0]
    if isinstance(f, (ds.IsNull, ds.IsNotNull)):
        null = isinstance(f, ds.IsNull)
        return lambda row: (row[name] is None) == null
    value = getattr(f, "value", None)
    if isinstance(f, ds.EqualNullSafe):
        return lambda row: row[name] == value
    compare: dict[type, Callable] = {
        ds.EqualTo: lambda x: x == value, ds.GreaterThan: lambda x: x > value, ds.GreaterThanOrEqual: lambda x: x >= value, ds.LessThan: lambda x: x < value,
        ds.LessThanOrEqual: lambda x: x <= value, ds.In: lambda x: True if x in value else None if None in value else False,
        ds.StringStartsWith: lambda x: x.startswith(value), ds.StringEndsWith: lambda x: x.endswith(value), ds.StringContains: lambda x: value in x}
    test = compare.get(type(f))
    if test is None or (value is None and not isinstance(f, ds.In)):
        return None
    if isinstance(value, str) and type(f) in (ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual):
        return None  # Spark compares bytes
    return lambda row: None if row[name] is None else test(row[name])


def _names(f: ds.Filter) -> str:
    return _names(f.child) if isinstance(f, ds.Not) else ".".join(f.attribute)


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.strict = options.get("mode", "failfast").lower() == "failfast"
        self.partition_bytes = int(options.get("partition_bytes", 32 << 20))
        self.pushed: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]):
        for f in filters:
            if as_test(f) is None:
                yield f
            else:
                self.pushed.append(f)

    def partitions(self) -> list[storage.Files]:
        tests = [as_test(f) for f in self.pushed if _names(f) == "file"]
        files = [f for f in storage.list_files(self.path, (".warc", ".warc.gz")) if all(t({"file": f[0]}) is True for t in tests)]
        return storage.plan(files, self.partition_bytes)

    def read(self, partition: storage.Files) -> Iterator[pa.RecordBatch]:
        tests = [as_test(f) for f in self.pushed]
        wanted = lambda early: all(t(early) is True for t in tests)
        rows, size = [], 0
        system, _ = storage.file_system(self.path)
        for path, _ in partition.value if partition is not None else ():
            with system.open_input_file(path) as raw, io.BufferedReader(raw, CHUNK) as source:
                for row in read_file(path, source, wanted, self.payload, self.verify, self.strict):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.packed = options.get("compression", "gzip").lower() == "gzip"
        self.file_bytes = int(options.get("file_bytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> storage.Written:
        system, root = storage.file_system(self.path)
        system.create_dir(root, recursive=True)
        files, out, size, rows = [], None, 0, 0
        pack = gzip_member if self.packed else bytes
        for batch in iterator:
            for i in range(batch.num_rows):
                data = pack(record_bytes({c: batch.column(c)[i].as_py() for c in batch.schema.names}))
                if out is None or size >= self.file_bytes:
                    if out is not None:
                        out.close()
                        files[-1] = (files[-1][0], size)
                    name = storage.new_name(".warc.gz" if self.packed else ".warc")
                    out, size = system.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None, buffer_size=1 << 20), 0
                    files.append((name, 0))
                    info = f"software: quadrant\r\nformat: WARC File Format 1.1\r\nfile: {name}\r\n".encode()
                    first = pack(record_bytes({"warc_type": "warcinfo", "content_type": "application/warc-fields", "payload": info}))
                    out.write(first)
                    size += len(first)
                out.write(data)
                size += len(data)
                rows += 1
        if out is not None:
            out.close()
            files[-1] = (files[-1][0], size)
        return storage.Written(files, rows)

    def commit(self, messages: list) -> None:
        storage.commit(self.path, messages, self.overwrite)

    def abort(self, messages: list) -> None:
        storage.abort(self.path, messages)


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format ``warc`` known to the session, with predicates handed to Python data sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(spark: SparkSession, path: str, where: Column | str | None = None, **options) -> DataFrame:
    """The records of the archives at ``path`` that satisfy ``where``, loaded for this one query."""
    register(spark)
    loaded = spark.read.format("warc").options(**options).load(path)
    return loaded if where is None else loaded.where(where)


# --- pages -----------------------------------------------------------------------------

def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


#: Tasks over which the rows of one payload are dealt where the groups of equal payloads are not broadcast.
SALTS = 64


def _id(page_id: str, row: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(F.col(page_id).cast("string")), F.lit("")), F.lit(":"), F.col(row).cast("string"), F.lit(">"))


def page_records(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A record per page: of equal payloads of ``min_bytes`` or more, the one with the smallest page_id is the response.

    A NULL page_id comes after all others; among equal ones the row that was stored first.  Pages are stored once with their
    row number, digest and length.  Groups of equal payloads are found on digests (SHA-256) by an aggregation that
    combines before its shuffle; only groups of two or more meet the pages again: broadcast if measured small,
    else by a shuffle that deals each group over ``SALTS`` tasks.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    stored = materialize(pages.select(
        F.col("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("row"),
        base32_sha1(payload).alias("digest"), F.unhex(F.sha2(payload, 256)).alias("key"), F.octet_length(payload).cast("long").alias("bytes")), "warc-pages")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id"), F.col("row")))
    groups = (stored.where(F.col("bytes") >= min_bytes).groupBy("key").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
              .select(F.col("key").alias("k"), F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row")))
    groups, small = maybe_broadcast(materialize(groups, "warc-groups"), max_broadcast_rows)
    met = stored["key"] == groups["k"]
    if not small:
        stored = stored.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)))
        groups = groups.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = (stored["key"] == groups["k"]) & (stored["salt"] == groups["s"])
    again = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    return stored.join(groups, met, "left").select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"), _id("page_id", "row").alias("record_id"), F.lit(date).alias("date"),
        F.col("url").alias("target_uri"), F.when(again, _id("first_id", "first_row")).alias("refers_to"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"), F.col("bytes").alias("payload_length"),
        F.lit("text/html; charset=utf-8").alias("content_type"), F.when(~again, F.col("payload")).alias("payload"))


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, **options) -> None:
    register(pages.sparkSession)
    page_records(pages, min_bytes).write.format("warc").options(**options).mode("append").save(path)


def read_pages(spark: SparkSession, path: str, page_id: str = "long") -> DataFrame:
    """One row per archived page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Of responses every payload is read and compared with its digest; of revisits only the heads are read, and
    the responses' payloads between them are skipped.
    """
    own = lambda c: F.url_decode(F.nullif(F.regexp_extract(c, "^<urn:page:([^:]*):", 1), F.lit(""))).cast(page_id)
    responses = records(spark, path, F.col("warc_type") == "response", payload="false", verify="true")
    revisits = records(spark, path, F.col("warc_type") == "revisit", payload="false")
    return responses.unionByName(revisits).select(
        own("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.substring("payload_digest", 6, 32).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), own("refers_to").alias("refers_to"))


def archived_pages(pages: DataFrame, path: str | None = None, min_bytes: int = 0, **options) -> DataFrame:
    """Write ``pages`` as archives (under the shared scratch folder if no place is given) and read them back."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_pages(pages, path, min_bytes, **options)
    return read_pages(pages.sparkSession, path, pages.schema["page_id"].dataType.simpleString())
