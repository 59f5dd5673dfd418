"""WARC archives: a writer through Spark's own file committer and a splittable reader.

An archive is a file of gzip members, one for each record.  The reader cuts archives into byte ranges; a task
looks for the gzip magic in its range, decodes the header of each candidate member to see that it is a record,
and owns the records that start inside its range, reading on past the range's end to finish the last.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MAGIC = b"\x1f\x8b\x08"
#: An empty gzip member; the line separator between the records of a file (a fixed value).
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
RANGE, BLOCK, LEVEL = 16 << 20, 1 << 18, 4
RANGES_A_TASK = 16
#: Records with smaller payloads are never revisits.
MIN_REVISIT = 0
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def roles(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload (bytes), refers_to (null for responses).

    Of rows with equal payloads of at least ``min_revisit`` bytes, those with the largest page_id are responses
    (more than one only if rows repeat) and the others refer to them; a null page_id refers to the largest of
    its group and is a response if the group has only nulls.  Groups are counted on the tasks first; the largest
    of the hot contents are broadcast, those of the rest joined.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("content", F.unhex(F.sha2("payload", 256)))
    best = shared.cut(rows.groupBy("content").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    refers = F.when((F.length("payload") >= min_revisit) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    # Contents of a thousandth of all copies or more are few: they are broadcast, so their rows stay where they are.
    least = (best.agg(F.sum("n")).first()[0] or 0) / shared.HEAVY
    hot = F.broadcast(best.where(F.col("n") >= least).select("content", F.col("first").alias("hot"), F.lit(True).alias("is_hot")))
    known = rows.join(hot, "content", "left")
    # Rows of hot contents have no match in the join of the rest and are dealt out evenly.
    deal = F.when(F.col("is_hot"), F.pmod(F.xxhash64("page_id", "url"), F.lit(shared.tasks(pages.sparkSession))) + 1).otherwise(0)
    rest = best.where(F.col("n") < least).select("content", F.col("first").alias("cold"), F.lit(0).cast("long").alias("deal"))
    found = known.withColumn("deal", deal.cast("long")).join(rest, ["content", "deal"], "left")
    return found.withColumn("first", F.coalesce("hot", "cold")).select("page_id", "url", "payload", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member.  A revisit holds the HTTP header alone, with digest and length of the full payload."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[3:3] = [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write(records: DataFrame, path: str) -> None:
    """Writes page_id, url, payload, refers_to as archives under ``path``.

    Members go through Spark's text writer as raw bytes, so the committer's guarantees hold on any store and a
    lost task leaves nothing behind.  An empty gzip member separates them, which readers skip.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([record(*x) for x in rows], pa.binary())], names=["value"])

    shared.bounded_batches(records.sparkSession)
    rows = records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


_RECORD = "page_id long, record_type string, refers_to long, target_uri string, payload_digest string, payload_bytes long, payload binary, file string, position long"


def read(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """All records of the archives under ``path``, with their payload (null for revisits) and place.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload; a response whose payload doesn't
    match its digest raises, as do bytes between records that are no member and a member that is damaged or cut short:
    a range decodes the member that follows its last one too, so the first of a range is never lost unseen.  Ranges
    of ``size`` bytes are dealt to tasks, ``RANGES_A_TASK`` to each at most; memory holds one record at a time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > 0).select("path", "length")
    ranges = shared.cut(files.select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {size}L)")).alias("begin")))
    count = ranges.count()
    n = max(1, min(shared.tasks(spark) * 4, count), count // RANGES_A_TASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, length, begin in zip(*(b.column(c).to_pylist() for c in ("path", "length", "begin")), strict=True):
                rows, held = [], 0
                for row in _scan(file, length, begin, min(length, begin + size)):
                    rows.append(row)
                    held += len(row[6] or b"")
                    if held > 8 << 20 or len(rows) >= 2000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return ranges.repartition(n, F.xxhash64("path", "begin")).mapInArrow(run, _RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    columns = [x.split() for x in _RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(columns)], names=[c for c, _ in columns])


def _open(uri: str) -> pa.NativeFile:
    """The file through Arrow's store of that scheme (local, HDFS, S3, GCS)."""
    store, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return store.open_input_file(name)


def _scan(file: str, length: int, begin: int, end: int) -> Iterator[tuple]:
    """Records whose member starts in [begin, end).

    From the file's start, and after each record, a member must follow or the file end; only before a range's first
    member, where a record of an earlier range may end, are bytes passed over.
    """
    with _open(file) as f:
        at, aligned = begin, begin == 0
        while at < end:
            if not aligned:
                window = f.read_at(min(BLOCK, end - at) + len(MAGIC) - 1, at)
                hit = window.find(MAGIC)
                if hit < 0:
                    at += max(1, len(window) - len(MAGIC) + 1) if len(window) >= len(MAGIC) else end - at
                    continue
                at += hit
                if at >= end:
                    return
            got = _member(f, at, length)
            if got is None:
                if aligned:
                    raise ValueError(f"{file}, byte {at}: a damaged or truncated record")
                at += 1
                continue
            text, used = got
            if text:
                yield _parsed(text, file, at)
            at, aligned = at + used, True
        # The next range can't tell a damaged first record from the end of this one, so it is decoded here too.
        if aligned and at < length and _member(f, at, length) is None:
            raise ValueError(f"{file}, byte {at}: a damaged or truncated record")


def _member(f: pa.NativeFile, at: int, length: int) -> tuple[bytes, int] | None:
    """The content and size of the member at ``at``; None if no record's member (or empty one) starts there."""
    unpack, out, pos, step = zlib.decompressobj(31), [], at, 1 << 14
    checked = False
    try:
        while not unpack.eof:
            data = f.read_at(min(step, length - pos), pos)
            if not data:
                return None
            pos, step = pos + len(data), min(2 * step, 1 << 20)
            out.append(unpack.decompress(data))
            if not checked and sum(map(len, out)) >= 7:
                if not b"".join(out).startswith(b"WARC/1."):
                    return None
                checked = True
    except zlib.error:
        return None
    text = b"".join(out)
    if text and not checked:
        return None
    if text:
        head = text.find(b"\r\n\r\n")
        size = re.search(rb"(?i)\r\ncontent-length: *(\d+)", text[: max(head, 0)])
        if head < 0 or size is None or len(text) != head + 8 + int(size[1]):
            return None
    return text, pos - len(unpack.unused_data) - at


def _parsed(text: bytes, file: str, position: int) -> tuple:
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(re.findall(r"(?m)^([^:\r\n]+): *([^\r\n]*)", head.decode("utf-8", "replace").partition("\r\n")[2]))
    block = rest[:-4]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, known = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda s: int(m[1]) if (m := re.search(r":(-?\d+)>", s)) else None
    if kind == "revisit":
        size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
        return number(fields["WARC-Record-ID"]), kind, number(fields["WARC-Refers-To"]), fields["WARC-Target-URI"], known, size, None, file, position
    if digest(payload) != known:
        raise ValueError(f"{file}, byte {position}: the payload doesn't match its digest")
    return number(fields["WARC-Record-ID"]), kind, None, fields["WARC-Target-URI"], known, len(payload), payload, file, position


def archive(pages: DataFrame, min_revisit: int = MIN_REVISIT, size: int = RANGE) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and returns what reading them back gives.

    A null html is an empty payload, a null url is about:blank; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = shared.fresh_path(spark, "warc")
    write(roles(pages, min_revisit), path)
    return read(spark, path, size)
