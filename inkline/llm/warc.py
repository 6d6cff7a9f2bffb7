"""Web archives as a table of chunks: WARC records cut into rows of record number, chunk number and bytes.

The bytes of all chunks, in order of record and chunk, are a WARC file. A chunk carries the CRC-32 of the
record's bytes up to its end; reading goes on from chunk to chunk with running digests, so that no record
is put together in memory. Records of one chunk, nearly all, are read where they lie; only the chunks
of larger ones are shuffled and sorted.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, written

#: Bytes of a chunk, and bytes of chunks that are sent on together.
CHUNK, TOGETHER = 1 << 20, 8 << 20
#: Payloads of at least so many bytes are recorded once.
REVISIT_FROM = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE = "record long, chunk int, last boolean, data binary, crc long"
FOUND = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
CONTROL = re.compile(r"[\x00-\x20\x7f]")


def header(page: str | None, url: str | None, date: str, n: int, sha1: bytes, refers: str | None) -> bytes:
    """A record's head, blank line included; a revisit has no block of its own."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", f"X-Payload-Length: {n}"]
    if page is not None:
        lines += [f"WARC-Record-ID: <urn:page:{quote(page, safe='')}>"]
    if url is not None:
        lines += [f"WARC-Target-URI: {CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url)}"]
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{quote(refers, safe='')}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {n if refers is None else 0}", "", ""]).encode()


def with_targets(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """``pages`` with ``sha1``, and ``refers``: the largest id among equal payloads of ``REVISIT_FROM`` bytes or more, where it isn't the row's own.

    Digests alone are grouped, combined before the shuffle; those that stand for several rows (``held``) go
    back to the pages as a broadcast if they are few. If not, those of the largest groups do, whose number is
    bounded, and only pages whose payload is long enough meet the others in a join.
    """
    known = pages.withColumn("sha1", F.sha1(payload_col)).withColumn("n", F.octet_length(payload_col).cast("long"))
    long, short = known.where(F.col("n") >= REVISIT_FROM), known.where(F.col("n") < REVISIT_FROM)
    held = written(long.groupBy("sha1", "n").agg(F.max(id_col).alias("target"), F.count("*").alias("rows")).where("rows > 1"), "warc-repeated")
    keys = ["sha1", "n"]
    groups, total = held.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if groups <= BROADCAST_ROWS:
        joined = known.join(F.broadcast(held.drop("rows")), keys, "left")
    else:
        many = F.col("rows") > max(1000, total // BROADCAST_ROWS)
        hot, cold = held.where(many).drop("rows"), held.where(~many).drop("rows")
        rest = long.join(F.broadcast(hot), keys, "left_anti").join(cold, keys, "left")
        joined = long.join(F.broadcast(hot), keys).unionByName(rest).unionByName(short, allowMissingColumns=True)
    refers = F.when(F.col("target").eqNullSafe(F.col(id_col)), F.lit(None)).otherwise(F.col("target"))
    return joined.withColumn("refers", refers)


def to_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", date: str = "2024-01-01T00:00:00Z", chunk: int = CHUNK) -> DataFrame:
    """The archive table (``record``, ``chunk``, ``last``, ``data``, ``crc``) of one record per row of ``pages``.

    A null payload is empty, a null URL or id leaves its header out. Rows that repeat the largest id of
    equal payloads are responses all. Other columns are ignored. Record numbers are unique in one
    computation of the table: write it before it is read more than once.
    """
    wanted = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("payload"))
    ready = with_targets(wanted, "page", "payload").select(F.col("page").cast("string"), "url", "payload", "sha1", F.col("refers").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, rows, size = TaskContext.get().partitionId() << 33, [], 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64()), strict=True)], names=["record", "chunk", "last", "data", "crc"])

        for batch in batches:
            for k in range(batch.num_rows):
                page, url, payload, sha1, refers = (c[k] for c in batch.columns)
                payload = memoryview(payload.as_buffer())
                head = header(page.as_py(), url.as_py(), date, len(payload), bytes.fromhex(sha1.as_py()), refers.as_py())
                block = payload if refers.as_py() is None else payload[:0]
                crc, n = 0, max(1, -(-len(block) // chunk))
                for j in range(n):
                    data = b"".join([head if j == 0 else b"", block[j * chunk : (j + 1) * chunk], b"\r\n\r\n" if j == n - 1 else b""])
                    crc = zlib.crc32(data, crc)
                    rows.append((record, j, j == n - 1, data, crc))
                    size += len(data)
                    if size > TOGETHER:
                        yield flush()
                        rows, size = [], 0
                record += 1
        yield flush()

    return ready.mapInArrow(run, ARCHIVE)


class Reader:
    """One record at a time, chunk by chunk; ``feed`` gives the finished record's row at its last chunk."""

    def __init__(self):
        self.fields: dict[str, str] | None = None

    def feed(self, chunk: int, last: bool, data: bytes, crc: int) -> tuple | None:
        if chunk == 0:
            head, _, data_ = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError("a record does not begin with its version")
            self.fields = dict(line.split(": ", 1) for line in lines[1:])
            self.left, self.seen, self.sha1, self.crc, self.next = int(self.fields["Content-Length"]), 0, hashlib.sha1(), 0, 0
        else:
            data_ = data
        if self.fields is None or chunk != self.next:
            raise ValueError("a record's chunks are not whole")
        self.next += 1
        self.crc = zlib.crc32(data, self.crc)
        if self.crc != crc:
            raise ValueError("a chunk's running digest differs")
        block = memoryview(data_)[: self.left]
        self.left -= len(block)
        self.seen += len(block)
        self.sha1.update(block)
        if not last:
            return None
        fields, self.fields = self.fields, None
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        if self.left or bytes(data_[len(block) :]) != b"\r\n\r\n" or fields["WARC-Type"] == "response" and self.sha1.hexdigest() != digest:
            raise ValueError("a record's block differs from its head")
        page, refers = (unquote(fields[k][10:-1]) if k in fields else None for k in ("WARC-Record-ID", "WARC-Refers-To"))
        return page, int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], refers


def read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of record and chunk, whole records within the task; the reader carries its digests across batches."""
    reader = Reader()
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            chunk, last, data, crc = (batch.column(c)[k].as_py() for c in ("chunk", "last", "data", "crc"))
            if row := reader.feed(chunk, last, data, crc):
                rows.append(row)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archive(archive: DataFrame) -> DataFrame:
    """One row a record: ``page_id``, ``payload_bytes``, ``payload_digest`` (SHA-1, hex), ``record_type``, ``refers_to``; ids as strings. Damage raises an error."""
    single = F.col("last") & (F.col("chunk") == 0)
    whole = archive.where(single).mapInArrow(read_rows, FOUND)
    large = archive.where(~single).repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(read_rows, FOUND)
    return whole.unionAll(large)


def write_and_read(pages: DataFrame, id_col: str = "page_id", **how) -> DataFrame:
    """Writes the archive to the shared folder, reads it back; ids have their own type again."""
    found = read_archive(written(to_archive(pages, id_col, **how), "warc"))
    kind = pages.schema[id_col].dataType
    return found.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
