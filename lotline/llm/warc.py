"""WARC archives as a Spark data source, read back as a chunked record table.

Writing takes one row per record and streams payloads into gzip members, one member per
record. Reading streams every archive and gives ``CHUNKS``: rows of record identifier and
chunk number with at most ``chunk_bytes`` of the payload each, the payload's length and
SHA-256 so far, and the record's header on each row. No more than one chunk of a payload is in
memory in the reader, however long the record is.

A task writes archives of about ``archive_bytes`` under names of its own; the driver moves
them into place only when all tasks are done, so lost executors and repeated tasks leave no
record twice. Repeated payloads are recorded as revisits (see ``with_revisits``).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader,
                                    InputPartition, WriterCommitMessage)

from lotline.llm.common import cut_lineage, join_small, text_of

VERSION = b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_BYTES = 100
SUFFIX = ".warc.gz"
RECORDS = ("record_type string, page_id bigint, refers_to bigint, url string, "
           "payload_bytes bigint, payload_digest string, payload string")
CHUNKS = ("archive string, record_no bigint, chunk_no bigint, is_last boolean, record_type string, "
          "page_id bigint, refers_to bigint, url string, date string, stated_bytes bigint, "
          "stated_digest string, bytes_so_far bigint, digest_so_far string, chunk binary")
CHUNKS_ARROW = pa.schema([
    ("archive", pa.string()), ("record_no", pa.int64()), ("chunk_no", pa.int64()),
    ("is_last", pa.bool_()), ("record_type", pa.string()), ("page_id", pa.int64()),
    ("refers_to", pa.int64()), ("url", pa.string()), ("date", pa.string()),
    ("stated_bytes", pa.int64()), ("stated_digest", pa.string()), ("bytes_so_far", pa.int64()),
    ("digest_so_far", pa.string()), ("chunk", pa.binary())])


def _store(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/")
                                  else path.replace("file:", "file://", 1))


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(urn: str | None):
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


def _line(text) -> str:
    """A header value may hold no line ends."""
    return str(text).replace("\r", "%0D").replace("\n", "%0A")


def _header(row: dict, length: int) -> bytes:
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", _urn(row["page_id"])),
              ("WARC-Date", DATE), ("Content-Type", "text/html; charset=utf-8"),
              ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
              ("X-Payload-Length", row["payload_bytes"])]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", _line(row["url"])))
    if row["record_type"] == "revisit":
        fields += [("WARC-Refers-To", _urn(row["refers_to"])),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Length", length))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex
        self.archive_bytes = int(options.get("archive_bytes", 1 << 30))
        self.piece = int(options.get("chunk_bytes", 1 << 20))

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext
        store, root = _store(self.path)
        task = TaskContext.get()
        stem = f"{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}"
        store.create_dir(f"{root}/_open-{self.job}", recursive=True)
        names, out = [], None
        for batch in batches:
            payloads = batch.column(batch.schema.get_field_index("payload"))
            heads = batch.drop_columns(["payload"]).to_pylist()
            for head, payload in zip(heads, payloads):
                if out is None or out.tell() >= self.archive_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"{stem}-{len(names):04d}{SUFFIX}")
                    out = store.open_output_stream(f"{root}/_open-{self.job}/{names[-1]}", compression=None)
                body = (memoryview(payload.as_buffer())
                        if payload.is_valid and head["record_type"] == "response" else memoryview(b""))
                member = zlib.compressobj(4, zlib.DEFLATED, 31)
                out.write(member.compress(_header(head, len(body))))
                for at in range(0, len(body), self.piece):
                    out.write(member.compress(body[at:at + self.piece]))
                out.write(member.compress(b"\r\n\r\n") + member.flush())
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        for message in messages:
            for name in message.names if message else ():
                store.move(f"{root}/_open-{self.job}/{name}", f"{root}/{name}")

    def abort(self, messages) -> None:
        """What was open stays under its own name, which readers pass over."""


@dataclass
class _Archive(InputPartition):
    name: str


class _Stream:
    """Bytes of a file of gzip members, decompressed piece by piece."""

    def __init__(self, raw, piece: int):
        self.raw, self.piece = raw, piece
        self.member, self.held, self.tail = None, b"", b""

    def _more(self) -> bool:
        """Some more decompressed bytes in ``held``, at most about a piece."""
        while True:
            source = self.tail or self.raw.read(self.piece)
            self.tail = b""
            if not source:
                return False
            if self.member is None:
                self.member = zlib.decompressobj(31)
            got = self.member.decompress(source, self.piece)
            self.tail = self.member.unconsumed_tail
            if self.member.eof:
                self.tail, self.member = self.member.unused_data, None
            if got:
                self.held += got
                return True

    def read(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out, self.held = self.held[:n], self.held[n:]
        if len(out) < n:
            raise ValueError("the archive ends inside a record")
        return out

    def line(self) -> bytes:
        """Up to the next line feed, or nothing at the end."""
        seen = 0
        while (end := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held)
            if not self._more():
                if self.held:
                    raise ValueError("the archive ends inside a header")
                return b""
        out, self.held = self.held[:end + 1], self.held[end + 1:]
        return out


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.chunk_bytes = int(options.get("chunk_bytes", 1 << 20))
        self.payload = str(options.get("payload", "true")).lower() == "true"

    def partitions(self):
        from pyarrow import fs
        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root))
        return [_Archive(f.base_name) for f in found if f.base_name.endswith(SUFFIX)]

    def read(self, archive: _Archive | None) -> Iterator[pa.RecordBatch]:
        if archive is None:  # Spark asks for one partition where there are no archives
            return
        store, root = _store(self.path)
        rows, held = [], 0
        with store.open_input_stream(f"{root}/{archive.name}", compression=None) as raw:
            for row in self._chunks(_Stream(raw, 1 << 18), archive.name):
                rows.append(row)
                held += len(row["chunk"] or b"") + 512
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=CHUNKS_ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=CHUNKS_ARROW)

    def _chunks(self, stream: _Stream, name: str):
        record_no = 0
        while line := stream.line():
            if line != VERSION:
                raise ValueError(f"{name}: no record starts here: {line[:60]!r}")
            head = {}
            while (line := stream.line().rstrip(b"\r\n")):
                key, _, value = line.decode().partition(": ")
                head[key] = value
            left, so_far, total, chunk_no = int(head["Content-Length"]), hashlib.sha256(), 0, 0
            shared = {
                "archive": name, "record_no": record_no, "record_type": head["WARC-Type"],
                "page_id": _page_of(head["WARC-Record-ID"]), "refers_to": _page_of(head.get("WARC-Refers-To")),
                "url": head.get("WARC-Target-URI"), "date": head["WARC-Date"],
                "stated_bytes": int(head["X-Payload-Length"]),
                "stated_digest": head["WARC-Payload-Digest"].partition(":")[2]}
            while True:
                chunk = stream.read(min(left, self.chunk_bytes))
                left -= len(chunk)
                total += len(chunk)
                so_far.update(chunk)
                yield {**shared, "chunk_no": chunk_no, "is_last": left == 0, "bytes_so_far": total,
                       "digest_so_far": so_far.hexdigest(), "chunk": chunk if self.payload else None}
                chunk_no += 1
                if not left:
                    break
            if stream.read(4) != b"\r\n\r\n":
                raise ValueError(f"{name}: record {record_no} is longer than it says")
            record_no += 1


class WarcSource(DataSource):
    """``format("warc")``: writes ``RECORDS``, reads ``CHUNKS``.

    Options: path, archive_bytes, chunk_bytes, payload (false leaves the chunks' bytes out).
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def with_revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) as ``RECORDS``.

    Of equal payloads of at least ``least_bytes`` bytes the one with the smallest page_id is
    the response and the others revisit it. Null html is an empty payload. Rows that share the
    smallest page_id are all responses; a null page_id is larger than any other, and if all
    ids of a payload are null, all are responses. Shorter payloads are always responses. Only
    digests that occur more than once are joined back; they are few next to the pages, are
    broadcast if counted to be, and a hot payload is split by AQE if not.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        text_of("html").alias("payload")).withColumns({
            "payload_bytes": F.octet_length("payload").cast("bigint"),
            "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})
    repeated = (rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
                .agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))
                .where("n > 1 and first_page is not null").drop("n"))
    joined = join_small(rows, cut_lineage(repeated), ["payload_digest"])
    again = F.col("first_page").isNotNull() & ~F.col("first_page").eqNullSafe(F.col("page_id"))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), "page_id",
        F.when(again, F.col("first_page")).alias("refers_to"), "url", "payload_bytes",
        "payload_digest", "payload")


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Writes a record per page to archives under ``path``."""
    pages.sparkSession.dataSource.register(WarcSource)
    with_revisits(pages).write.format("warc").mode("append").options(**options).save(path)


def read_chunks(spark: SparkSession, path: str, **options) -> DataFrame:
    """The chunked record table of the archives under ``path``."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(path)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk: no shuffle, no whole payload.

    A response's length and digest are those of the bytes read; if they are not what its
    header states, ``intact`` is false. A revisit stores no payload and has what it states.
    """
    response = F.col("record_type") == "response"
    return chunks.where("is_last").select(
        "page_id", "url",
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type", "refers_to",
        (~response | ((F.col("stated_bytes") == F.col("bytes_so_far"))
                      & (F.col("stated_digest") == F.col("digest_so_far")))).alias("intact"))
