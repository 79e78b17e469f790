"""WARC files as a Spark data source: one record per row, headers first, payloads only where they are wanted.

Method. A Python data source. Its writer turns batches into WARC/1.1 records, each a gzip member of its own whose
extra field tells the member's length, and rolls files at `max_file_bytes`; files of failed attempts never enter the
manifest that the commit writes. Its reader plans one partition per file of the manifest, takes over predicates on
the record type and on headers (`pushFilters`), inflates a record's headers first, and skips to the next member where
a predicate fails or the schema asks for no payload. read() hands predicates over itself (`where`).

Archives of other makers are folders (or single files) without a manifest: all .warc.gz and .warc files below them are
read. Members without a length field, several records in a member and plain text are read as one stream, in which an
unwanted block is inflated piece by piece and dropped.

Files hold what their task wrote, and a task holds one batch, or one record; nothing but file names goes through the
driver.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull,
    WriterCommitMessage,
)

from quire.llm.store import written
from quire.session import work_path

#: Payloads of fewer bytes are written in full each time.
LEAST_BYTES = 0
FILE_BYTES = 128 << 20
SCHEMA = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string,"
    " payload binary, record_id string, refers_to_id string, content_type string"
)
MANIFEST = "_manifest.json"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_KINDS = {
    "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
    "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(), "record_id": pa.string(),
    "refers_to_id": pa.string(), "content_type": pa.string(),
}
_HEAD = struct.Struct("<4BI2BH2sHII")  # gzip head with one extra field: length of the member and of its content
_SIZED = re.compile(rb"\x1f\x8b\x08\x04.{6}\x0c\x00sl\x08\x00", re.DOTALL)
_END = re.compile(rb"\r?\n\r?\n")  # of headers
_OWN = re.compile(r"<urn:page:(-?\d*)>")  # record ids of this writer
_PIECE = 1 << 18


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record (without the payload) if refers_to is given."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:  # a header is one line; what would break it is escaped
        lines.append("WARC-Target-URI: " + json.dumps(url, ensure_ascii=False)[1:-1])
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    body = http + (payload if refers_to is None else b"")
    lines += [
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(content: bytes) -> bytes:
    """A gzip member that tells its own length, as the WARC standard's annex on compression suggests."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    packed = packer.compress(content) + packer.flush()
    total = _HEAD.size + len(packed) + 8
    head = _HEAD.pack(0x1F, 0x8B, 8, 4, 0, 4, 255, 12, b"sl", 8, total, len(content) & 0xFFFFFFFF)
    return head + packed + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


def _headers(text: bytes) -> dict[str, str]:
    """Values by lower-case name, without the one space that the writer puts; folded lines are joined."""
    out: dict[str, str] = {}
    name = ""
    for line in re.split("\r?\n", text.decode("utf-8", "replace"))[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        out[name] = value.removeprefix(" ")
    return out


def _page(urn: str | None) -> int | None:
    own = _OWN.fullmatch(urn or "")
    return int(own[1]) if own and own[1] else None


def _row(own: dict[str, str], length: int, http: bytes | None) -> dict:
    """The header columns; length: bytes of the block; http: its HTTP headers with the empty line, if it has any."""
    record_id, refers_to, url = own.get("warc-record-id"), own.get("warc-refers-to"), own.get("warc-target-uri")
    if url is not None:
        if _OWN.fullmatch(record_id or ""):
            url = json.loads(f'"{url}"')
        else:
            url = url.strip()
            url = url[1:-1] if url.startswith("<") and url.endswith(">") else url
    kind, size = own.get("warc-type"), length - len(http or b"")
    if kind == "revisit":  # its block has no payload, but the HTTP headers may tell the payload's length
        told = _headers(http).get("content-length", "").strip() if http else ""
        size = int(told) if told.isascii() and told.isdigit() else None
    found = own.get("warc-payload-digest")
    return {
        "page_id": _page(record_id), "url": url, "record_type": kind, "refers_to": _page(refers_to), "payload_bytes": size,
        "payload_digest": None if found is None else found.strip().removeprefix("sha1:"), "record_id": record_id,
        "refers_to_id": refers_to, "content_type": own.get("content-type"),
    }


def _has_http(own: dict[str, str]) -> bool:
    return own.get("content-type", "").strip().lower().startswith("application/http")


class _Stream:
    """The rest of a file as one text: gzip members one after the other, or plain. It holds what was read ahead."""

    def __init__(self, file, plain: bool):
        self.file, self.plain = file, plain
        self.raw, self.held = b"", bytearray()
        self.unpacker = None

    def more(self) -> bool:
        """Reads on by about a piece; false at the end of the file."""
        self.raw = self.raw or self.file.read(_PIECE)
        if self.unpacker is None and not self.plain:
            self.raw = self.raw.lstrip(b"\0") or self.file.read(_PIECE).lstrip(b"\0")  # padding between members
        if not self.raw:
            if self.unpacker is not None:
                raise EOFError("the file ends within a gzip member")
            return False
        if self.plain:
            self.held += self.raw
            self.raw = b""
            return True
        if self.unpacker is None:
            self.unpacker = zlib.decompressobj(31)
        self.held += self.unpacker.decompress(self.raw, _PIECE)
        self.raw = self.unpacker.unconsumed_tail
        if self.unpacker.eof:
            self.raw, self.unpacker = self.unpacker.unused_data, None
        return True

    def end_of_headers(self, most: int | None = None) -> int | None:
        """Where the text after the next empty line begins; None if there is none within `most` bytes."""
        at = 0
        while True:
            found = _END.search(self.held, at, len(self.held) if most is None else min(most, len(self.held)))
            if found:
                return found.end()
            if most is not None and len(self.held) >= most:
                return None
            at = max(0, len(self.held) - 3)
            if not self.more():
                return None

    def headers(self) -> dict[str, str] | None:
        """The next record's headers; None at the end of the file."""
        while True:
            blank = len(self.held) - len(self.held.lstrip(b"\r\n"))
            del self.held[:blank]
            if self.held:
                break
            if not self.more():
                return None
        end = self.end_of_headers()
        if end is None or not self.held.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {bytes(self.held[:20])!r}")
        own = _headers(bytes(self.held[:end]).rstrip(b"\r\n"))
        del self.held[:end]
        return own

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise EOFError("the file ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip(self, n: int) -> None:
        while n > len(self.held):
            n -= len(self.held)
            self.held.clear()
            if not self.more():
                raise EOFError("the file ends within a record")
        del self.held[:n]


def _folder(path: str):
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class WarcPart(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path = options["path"]
        self.columns = columns
        given = json.loads(options.get("where", "{}"))
        #: header columns and the values allowed in them (None: all but null)
        self.wanted: list[tuple[str, frozenset | None]] = [(name, frozenset(values)) for name, values in given.items()]

    def partitions(self) -> list[WarcPart]:
        files, root = _folder(self.path)
        if files.get_file_info(root).type == pafs.FileType.File:
            return [WarcPart(root)]
        try:
            with files.open_input_file(f"{root}/{MANIFEST}") as f:
                return [WarcPart(f"{root}/{n}") for n in sorted(json.loads(f.read()))]
        except FileNotFoundError:
            found = files.get_file_info(pafs.FileSelector(root, recursive=True))
            return [WarcPart(n) for n in sorted(x.path for x in found if x.path.endswith((".warc.gz", ".warc")))]

    def _kept(self, row: dict) -> bool:
        return all(row[n] is not None if v is None else row[n] in v for n, v in self.wanted)

    def read(self, partition: WarcPart | None) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, _KINDS[c]) for c in self.columns])
        if partition is None:  # an archive without files
            return
        files, _ = _folder(self.path)
        rows, held = [], 0
        with files.open_input_file(partition.path) as f:
            for row in self._records(f):
                held += len(row.get("payload") or b"")
                rows.append(row)
                if len(rows) >= 2000 or held > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _records(self, f) -> Iterator[dict]:
        """The rows that the predicates keep: members that tell their length are jumped over, the rest is a stream."""
        payload = "payload" in self.columns
        while _SIZED.match(head := f.read(_HEAD.size)):
            *_, total, _length = _HEAD.unpack(head)
            row, start, rest = self._record(f.read(total - _HEAD.size))
            if self._kept(row):
                if payload:
                    row["payload"] = None if row["record_type"] == "revisit" else rest()[start:-4]
                yield row
        f.seek(f.tell() - len(head))
        stream = _Stream(f, plain=not head.startswith(b"\x1f\x8b"))
        while (own := stream.headers()) is not None:
            length = int(own["content-length"])
            start = stream.end_of_headers(length) if _has_http(own) else None
            row = _row(own, length, bytes(stream.held[:start]) if start else None)
            if not self._kept(row):
                stream.skip(length)
                continue
            if payload and row["record_type"] != "revisit":
                row["payload"] = stream.take(length)[start or 0 :]
            else:
                stream.skip(length)
            yield row

    @staticmethod
    def _record(raw: bytes):
        """Header columns, where the payload begins, and a function that inflates the whole record."""
        size = 1024
        while True:
            text = zlib.decompressobj(-15).decompress(raw, size)
            warc = _END.search(text)
            own = _headers(text[: warc.start()]) if warc else {}
            http = _END.search(text, warc.end()) if warc and _has_http(own) else None
            if http or len(text) < size or (warc and not _has_http(own)):
                break
            size *= 4
        block, length = warc.end(), int(own["content-length"])
        if http and http.end() > block + length:  # the empty line belongs to the record's end
            http = None
        start = http.end() if http else block
        row = _row(own, length, text[block:start] if http else None)
        return row, start, lambda: zlib.decompress(raw, -15) if len(text) == size else text


class FilteringReader(WarcReader):
    """Takes predicates over from Spark's plan.

    Spark 4.1 keeps the reader of the last plan with the relation, so two plans over one frame would see each other's
    predicates. Hence this reader needs the option push_filters, and its frame must serve one plan only.
    """

    def pushFilters(self, filters: list[Filter]):
        """Takes equality and null tests on header columns; the others stay with Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else "payload"
            if name == "payload":
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.append((name, frozenset([f.value])))
            elif isinstance(f, In):
                self.wanted.append((name, frozenset(f.value)))
            elif isinstance(f, IsNotNull):
                self.wanted.append((name, None))
            elif isinstance(f, IsNull):
                self.wanted.append((name, frozenset([None])))
            else:
                yield f


class WarcFiles(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("max_file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WarcFiles:
        files, root = _folder(self.path)
        files.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for k in range(0, batch.num_rows, 200):
                    for row in batch.slice(k, 200).to_pylist():
                        if out is None:
                            names.append(f"{uuid.uuid4().hex}.warc.gz")
                            out, size = files.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                        data = member(record(row["page_id"], row["url"], row["payload"] or b"", row["refers_to"]))
                        out.write(data)
                        size += len(data)
                        if size >= self.most:
                            out.close()
                            out = None
        finally:
            if out is not None:
                out.close()
        return WarcFiles(names)

    def commit(self, messages: list[WarcFiles | None]) -> None:
        files, root = _folder(self.path)
        files.create_dir(root, recursive=True)
        names = sorted(n for m in messages if m for n in m.names)
        with files.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages: list[WarcFiles | None]) -> None:
        files, root = _folder(self.path)
        for m in messages:
            for n in m.names if m else ():
                files.delete_file(f"{root}/{n}")


class WarcDataSource(DataSource):
    """spark.read.format("warc").schema(some columns of SCHEMA).load(path); df.write.format("warc").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        options = dict(self.options)
        kind = FilteringReader if options.get("push_filters", "").lower() == "true" else WarcReader
        return kind(options, schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known; filter pushdown is enabled for sources that take predicates over (push_filters)."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, refers_to: of rows with equal payloads the one with the largest page_id is full.

    Only digests go through the shuffle that finds equal payloads, and only those that occur more than once are
    joined back.
    """
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"),
    )
    twice = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(
        F.max("page_id").alias("full"), F.count("*").alias("n")
    ).filter("n > 1 AND full IS NOT NULL").select("digest", "full")
    joined = rows.join(written(twice, "payloads"), "digest", "left")
    again = (F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("full"))
    return joined.select("page_id", "url", "payload", F.when(again, F.col("full")).alias("refers_to"))


def archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, max_file_bytes: int = FILE_BYTES) -> None:
    """Writes a record per row of pages: page_id, url, html (null: an empty payload); other columns are ignored.

    Rows that repeat the largest page_id of their payload are all full records; rows without page_id are full only
    if no row of the payload has one. An empty table gives an archive without records.
    """
    register(pages.sparkSession)
    out = with_revisits(pages, least_bytes)
    out.write.format("warc").mode("append").option("max_file_bytes", str(max_file_bytes)).save(path)


def read(spark: SparkSession, path: str, columns: str = SCHEMA, where: dict[str, list] | None = None) -> DataFrame:
    """The records of an archive; without `payload` among the columns no payload is decoded.

    where: the values allowed in header columns (None allows null), which need not be among `columns`; the reader
    tests them on a record's headers and skips the rest of a record that fails. Filters on the frame are Spark's, so
    it may be used in several plans.
    path: a folder that archive() wrote, or a file or folder of .warc.gz and .warc files of any maker. Of records that
    archive() didn't write, page_id and refers_to are null (record_id and refers_to_id hold the ids as they stand),
    and what a header doesn't tell is null. A payload is the block after its HTTP headers, or the whole block of
    records without any (warcinfo, metadata, resource); it is not decoded further, and null for revisits, whose
    payload_bytes are those that the HTTP headers tell. Digests other than SHA-1 keep their label. Repeated records all come out;
    an empty file has none; a file that ends within a record or holds something else is an error.
    """
    register(spark)
    unknown = set(where or ()) - (_KINDS.keys() - {"payload"})
    if unknown:
        raise ValueError(f"no header columns: {sorted(unknown)}")
    return spark.read.format("warc").schema(columns).option("where", json.dumps(where or {})).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of pages, written to an archive and read back."""
    path = work_path(pages.sparkSession, "warc")
    archive(pages, path)
    return read(
        pages.sparkSession, path,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )
