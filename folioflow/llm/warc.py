"""WARC archives as a chunked record table.

A payload is never one value on its way through an archive: it is rows (record, chunk number) of at most ``CHUNK`` bytes,
each with the digest of all bytes up to its end, which the next chunk carries on. Writing makes each chunk one WARC record
of its own, a first segment or a continuation (WARC 1.1, record segmentation), through Spark's text sink, whose line
separator is the end of a WARC record. Reading streams each file through a parser that holds one block of input and one
chunk, whatever a record's length is, so archives of others with records of any size can be read too.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.shared import by_group, small_batches, written
from folioflow.storage import scratch

CHUNK = 1 << 20
#: Payload bytes of a batch that goes back to Spark.
BATCH_BYTES = 4 << 20
#: Shorter payloads are never replaced by a reference.
LEAST_SHARED = 1000
#: Revisits up to this number are broadcast (about 50 bytes each); more are joined by record.
FEW_REVISITS = 1 << 19
END = "\r\n\r\n"

CHUNKS = "record string, segment string, chunk int, page string, url string, payload binary, upto long, digest string, seal binary, last boolean"
READ = (
    "archive string, record string, type string, page string, url string, refers_to string, segment int, part int, n long, payload binary, "
    "digest string, stated string, total long, last boolean"
)


class _Rows:
    """Rows that become a batch when they hold enough bytes or are many."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int) -> bool:
        self.rows.append(row)
        self.size += size + 200
        return self.size >= BATCH_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.size = [], 0
        return out


CHUNK_ROWS = pa.schema([
    ("record", pa.string()), ("segment", pa.string()), ("chunk", pa.int32()), ("page", pa.string()), ("url", pa.string()), ("payload", pa.binary()),
    ("upto", pa.int64()), ("digest", pa.string()), ("seal", pa.binary()), ("last", pa.bool_()),
])
READ_ROWS = pa.schema([
    ("archive", pa.string()), ("record", pa.string()), ("type", pa.string()), ("page", pa.string()), ("url", pa.string()), ("refers_to", pa.string()),
    ("segment", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("payload", pa.binary()), ("digest", pa.string()), ("stated", pa.string()),
    ("total", pa.int64()), ("last", pa.bool_()),
])


def _cut(run: str, size: int):
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out = TaskContext.get().partitionId(), 0, _Rows(CHUNK_ROWS)
        name = lambda *at: f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr((run, part, *at)).encode()).digest())}"
        for batch in batches:
            payloads = batch.column("payload")
            for i, (page, url) in enumerate(zip(batch.column("page").to_pylist(), batch.column("url").to_pylist(), strict=True)):
                payload = memoryview(payloads[i].as_buffer())
                sha, seal, n = hashlib.sha1(), hashlib.blake2b(digest_size=32), len(payload)
                for chunk, at in enumerate(range(0, max(n, 1), size), 1):
                    piece = bytes(payload[at : at + size])
                    sha.update(piece)
                    seal.update(piece)
                    row = (name(seq), name(seq, chunk) if chunk > 1 else name(seq), chunk, page, url, piece, at + len(piece), sha.hexdigest(), seal.digest(), at + size >= n)
                    if out.add(row, len(piece)):
                        yield out.batch()
                seq += 1
        yield out.batch()

    return partition


def chunk_table(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", size: int = CHUNK) -> DataFrame:
    """Rows (record, chunk) with the payload's bytes, the number of bytes up to the chunk's end (``upto``) and the digests of those: ``digest``
    (SHA-1, hexadecimal) and ``seal`` (BLAKE2b, by which payloads are compared). A null html is an empty payload of one empty chunk."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    rows = small_batches(pages).select(F.col(page_id).cast("string").alias("page"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    return rows.mapInArrow(_cut(uuid.uuid4().hex, size), CHUNKS)


def revisits(chunks: DataFrame, page_type: str = "long", least: int = LEAST_SHARED) -> DataFrame:
    """Records to be replaced by a reference: record, refers_record, refers_page. Of equal payloads of at least ``least`` bytes the one with the largest page
    stays, of several such the one with the largest record; a null page is smaller than any. Groups of any size are split (``by_group``)."""
    whole = chunks.filter(F.col("last") & (F.col("upto") >= least)).select("record", F.col("page").cast(page_type).alias("page"), "upto", "digest", "seal")
    groups = whole.groupBy("seal", "upto").agg(F.count("*").alias("n_rows"), F.max(F.struct("page", "record")).alias("stays")).filter("n_rows > 1")
    rows = by_group(whole, written(groups, "warc-groups"), ["seal", "upto"], "n_rows")
    return rows.filter("record <> stays.record").select("record", F.col("stays.record").alias("refers_record"), F.col("stays.page").cast("string").alias("refers_page"))


def _field(name: str, value) -> F.Column:
    """A header line, or nothing for a null. Line breaks would end it, so they, blanks and other control characters are written in per cent form."""
    safe = value.cast("string")
    for code in (*range(33), 127):
        safe = F.replace(safe, F.lit(chr(code)), F.lit(quote(chr(code))))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def write_archives(chunks: DataFrame, references: DataFrame, path: str, few: int = FEW_REVISITS) -> None:
    """WARC files of ``chunks``, one record each, and of ``references`` (of ``revisits``) as revisit records without payload, below ``path``.

    Only the references travel: they are broadcast up to ``few`` (counted first); beyond, both sides are joined by record. A file is
    one gzip stream that sequential readers can read; a task that is run again replaces its file.
    """
    stored = references.withColumnRenamed("record", "of")
    if references.count() <= few:
        joined = chunks.join(F.broadcast(stored), F.col("record") == F.col("of"), "left")
    else:
        joined = chunks.hint("merge").join(stored, F.col("record") == F.col("of"), "left").sortWithinPartitions("record", "chunk")
    again = F.col("of").isNotNull()
    rows = joined.filter(~again | F.col("last"))
    first = (F.col("chunk") == 1) | again
    alone = again | (F.col("last") & (F.col("chunk") == 1))
    http = F.when(first, F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"), F.lit(END))).otherwise("")
    body = F.when(again, F.lit("").cast("binary")).otherwise(F.col("payload"))
    when = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    brackets = lambda x: F.concat(F.lit("<"), x, F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(again, "revisit").when(first, "response").otherwise("continuation")),
        _field("WARC-Record-ID", brackets(F.when(again, F.col("record")).otherwise(F.col("segment")))),
        F.concat(F.lit("WARC-Date: "), when, F.lit("\r\n")),
        _field("WARC-Target-URI", F.col("url")),
        _field("X-Page-Id", F.col("page")),
        F.concat(F.when(F.col("last"), "WARC-Payload-Digest: sha1:").otherwise("X-Digest-So-Far: sha1:"), F.col("digest"), F.lit("\r\n")),
        _field("WARC-Segment-Number", F.when(~alone, F.col("chunk"))),
        _field("WARC-Segment-Origin-ID", F.when(~first, brackets(F.col("record")))),
        _field("WARC-Segment-Total-Length", F.when(~alone & F.col("last"), F.col("upto") + len("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END))),
        _field("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _field("WARC-Refers-To", brackets(F.col("refers_record"))),
        _field("X-Refers-To-Page-Id", F.col("refers_page")),
        _field("X-Payload-Length", F.when(again, F.col("upto"))),
        F.when(first, "Content-Type: application/http;msgtype=response\r\n").otherwise("Content-Type: application/octet-stream\r\n"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string"), F.lit(END)),
    )
    record = F.concat(header.cast("binary"), http.cast("binary"), body).cast("string")
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


class Archive:
    """Bytes of an archive, plain or gzip of any number of members, from a file object: one block is held."""

    def __init__(self, file, block: int = 1 << 18):
        self.file, self.block, self.held, self.inflate = file, block, bytearray(), None
        start = file.read(block)
        if start[:2] == b"\x1f\x8b":
            self.inflate = zlib.decompressobj(31)
        self.raw = start

    def more(self) -> bool:
        """Adds up to a few blocks to what is held; false at the end."""
        while True:
            data, self.raw = self.raw or self.file.read(self.block), b""
            if not data:
                return False
            if self.inflate is None:
                self.held += data
                return True
            got = self.inflate.decompress(data, 4 * self.block)
            self.raw = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            self.held += got
            if got:
                return True

    def header(self, most: int | None = None) -> bytes | None:
        """Up to an empty line, which goes too; null at the end of the archive or if there is none in the next ``most`` bytes."""
        at = 0
        while True:
            found = self.held.find(b"\r\n\r\n", at, most)
            if found >= 0:
                out = bytes(self.held[:found])
                del self.held[: found + 4]
                return out
            if most is not None and len(self.held) >= most:
                return None
            at = max(0, len(self.held) - 3)
            if not self.more():
                return None

    def skip_blank(self) -> None:
        """Line ends between records."""
        while True:
            rest = self.held.lstrip(b"\r\n")
            self.held = bytearray(rest)
            if rest or not self.more():
                return

    def pieces(self, n: int, size: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces of ``size``; ends early where the archive does."""
        while n > 0:
            want = min(n, size)
            while len(self.held) < want and self.more():
                pass
            piece = bytes(self.held[:want])
            if not piece:
                return
            del self.held[: len(piece)]
            n -= len(piece)
            yield piece


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with a blank carries on the one above."""
    found: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def sha1_of(label: str | None) -> str | None:
    """Hexadecimal SHA-1 of a labelled digest, which may be in base 32; null for another algorithm."""
    if not label or not label.lower().startswith("sha1:"):
        return None
    value = label[5:]
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex() if len(value) == 32 else None


def parsed(name: str, file, size: int = CHUNK, payload: bool = True) -> Iterator[tuple]:
    """Rows of READ from one archive: responses, resources, continuations and revisits; other records are passed over."""
    archive, chained, sha = Archive(file), None, hashlib.sha1()
    while True:
        archive.skip_blank()
        head = archive.header()
        if head is None:
            return
        if not head.startswith(b"WARC/"):
            raise ValueError(f"{name}: no WARC record where one should begin")
        f = fields(head)
        kind, n = f.get("warc-type", ""), int(f.get("content-length", "0"))
        if kind not in ("response", "resource", "continuation", "revisit"):
            for _ in archive.pieces(n, size):
                pass
            continue
        number = int(f.get("warc-segment-number", "1"))
        record = (f.get("warc-segment-origin-id") or f.get("warc-record-id", "")).strip("<>")
        wrapped = 0
        if kind != "continuation" and f.get("content-type", "").startswith("application/http"):
            http = archive.header(n)
            wrapped = len(http) + 4 if http is not None else 0
            n -= wrapped
        if number == 1:
            sha, chained = hashlib.sha1(), (record, 0)
        linked = chained == (record, number - 1)
        ends = "warc-segment-total-length" in f or "warc-segment-number" not in f
        stated, refers = sha1_of(f.get("warc-payload-digest")), f.get("x-refers-to-page-id")
        base = (name, record, "response" if kind == "continuation" else kind, f.get("x-page-id"), f.get("warc-target-uri"), refers, number)
        if kind == "revisit":
            for _ in archive.pieces(n, size):
                pass
            yield (*base, 1, 0, b"" if payload else None, stated, stated, int(f.get("x-payload-length", "-1")), True)
            continue
        held, part, left = b"", 0, n
        for piece in archive.pieces(n, size):
            if part:
                yield (*base, part, len(held), held if payload else None, sha.hexdigest() if linked else None, None, None, False)
            held, part, left = piece, part + 1, left - len(piece)
            sha.update(piece)
        if left:
            raise ValueError(f"{name}: record {record} ends early")
        yield (*base, max(part, 1), len(held), held if payload else None, sha.hexdigest() if linked else None, stated, None, ends)
        chained = (record, number) if linked else None


def _read(size: int, payload: bool):
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        out = _Rows(READ_ROWS)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inner = fs.FileSystem.from_uri(path)
                with system.open_input_stream(inner, compression=None) as file:
                    for row in parsed(path, file, size, payload):
                        if out.add(row, len(row[9] or b"")):
                            yield out.batch()
        yield out.batch()

    return partition


def read_chunks(spark: SparkSession, path: str, size: int = CHUNK, payload: bool = True) -> DataFrame:
    """The chunked record table (READ) of all archives below ``path``, in any file system that pyarrow opens. Files are dealt to tasks by their
    sizes. ``digest`` is that of the payload up to the chunk's end, null where earlier segments lie in another file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.mapInArrow(_read(size, payload), READ)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    record, sha = None, hashlib.sha1()
    schema = pa.schema([("record", pa.string()), ("chained", pa.string())])
    for batch in batches:
        done = []
        for own, payload in zip(batch.column("record").to_pylist(), batch.column("payload"), strict=True):
            if own != record:
                if record is not None:
                    done.append((record, sha.hexdigest()))
                record, sha = own, hashlib.sha1()
            sha.update(memoryview(payload.as_buffer()))
        yield pa.RecordBatch.from_pylist([dict(zip(("record", "chained"), x, strict=True)) for x in done], schema=schema)
    if record is not None:
        yield pa.RecordBatch.from_pylist([{"record": record, "chained": sha.hexdigest()}], schema=schema)


def read_records(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """One row per record below ``path``: record, type, page, url, refers_to, payload_bytes, payload_digest, intact (the digest is the stated one, or none is).

    Payloads are hashed as they stream by. A record whose segments lie in several files is read once more, its chunks sorted and
    hashed one after the other.
    """
    chunks = written(read_chunks(spark, path, size, payload=False), "warc-read")
    one = (
        chunks.groupBy("record").agg(
            *(F.max(c).alias(c) for c in ("type", "page", "url", "refers_to", "stated", "total")), F.sum("n").alias("n"),
            F.max_by("digest", F.struct("segment", "part")).alias("digest"), F.bool_or(F.col("digest").isNull()).alias("loose"),
        )
    )
    scattered = chunks.filter(F.col("digest").isNull() & (F.col("type") != "revisit")).select("record").distinct()
    if not scattered.isEmpty():
        again = read_chunks(spark, path, size).join(scattered, "record", "left_semi").repartition("record").sortWithinPartitions("record", "segment", "part")
        one = one.join(again.select("record", "payload").mapInArrow(_chain, "record string, chained string"), "record", "left").withColumn("digest", F.coalesce("chained", "digest"))
    revisit = F.col("type") == "revisit"
    return one.select(
        "record", "type", "page", "url", "refers_to", F.when(revisit, F.col("total")).otherwise(F.col("n")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.coalesce(F.col("digest") == F.col("stated"), F.lit(True)).alias("intact"),
    )


def archived(pages: DataFrame, page_id: str = "page_id", size: int = CHUNK, few: int = FEW_REVISITS) -> DataFrame:
    """``pages`` written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, url, intact.

    Null html is an empty payload; a null page_id or url leaves its header out; rows that repeat a page_id are records of their own, and of those with
    equal payloads one is the response. Other columns are not read. An empty table gives none. Payloads of any length stream in chunks.
    """
    kind = pages.schema[page_id].dataType.simpleString()
    chunks = written(chunk_table(pages, page_id, size=size), "warc-chunks")
    path = scratch(pages.sparkSession, "warc-archives")
    write_archives(chunks, written(revisits(chunks, kind), "warc-revisits"), path, few)
    found = read_records(pages.sparkSession, path, size)
    return found.select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"), "url", "intact"
    )


def op11_warc(spark, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` as it comes back from the archives."""
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url", "intact")
