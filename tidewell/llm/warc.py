"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id into shards of about ``SHARD_BYTES`` of
payload; shard boundaries are exact functions of the data.  A shard's files
roll when their compressed size passes ``roll_bytes``.  Headers, record ids and
digests are regenerated from the record, gzip members carry no time, so equal
tables give equal bytes.  Files appear under temporary names, are renamed when
complete, and count once a manifest (written by Spark's own commit) names them;
a lost executor's shard is simply written again, byte for byte.

Equal payloads of at least ``MIN_REVISIT`` bytes are stored once: the smallest
page id is the response, others are revisits that refer to it.  Only digests
are shuffled to find them; payloads are shuffled once, to their shard.

Cases: a null html is an empty payload; rows with one id and one payload are
one response and revisits of that id; a row without an id is written first,
as a revisit where a page with an id has its payload, else as a response; an
empty table gives no file and an empty manifest; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm._common import drop_at_exit, only, shared_dir, stored, tidy

MIN_REVISIT = 100
SHARD_BYTES = 32_000_000
ROLL_BYTES = 16_000_000
DATE = "2000-01-01T00:00:00Z"
#: Equal-width cells of the id range that one counting pass tells apart.
CELLS = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "shard bigint, seq bigint, file string, records bigint, bytes bigint, sha256 string"
_MANIFEST = pa.schema([("shard", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("records", pa.int64()),
                       ("bytes", pa.int64()), ("sha256", pa.string())])
ROWS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_ROWS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64())])


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, nth: int, refers_to: int | None, date: str) -> bytes:
    """One WARC record; the same arguments always give the same bytes."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    rid = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{digest}/{nth}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{rid}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}/{digest}/0')}>",
                 f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Shard:
    """The files of one shard, each under a temporary name until it is whole."""

    def __init__(self, base: str, shard: int, roll: int, level: int):
        self.fs, self.root = _fs(base)
        self.shard, self.roll, self.level, self.seq, self.out = shard, roll, level, 0, None

    def put(self, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.temp = posixpath.join(self.root, "_temporary", f"{self.shard:06d}-{self.seq:05d}.{uuid.uuid4().hex}")
            self.out, self.size, self.n, self.sha = self.fs.open_output_stream(self.temp), 0, 0, hashlib.sha256()
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)  # header without time or name
        member = z.compress(data) + z.flush()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.n += 1
        if self.size >= self.roll:
            yield self.close()

    def close(self) -> tuple:
        self.out.close()
        name = f"{self.shard:06d}-{self.seq:05d}.warc.gz"
        self.fs.move(self.temp, posixpath.join(self.root, name))
        row = (self.shard, self.seq, name, self.n, self.size, self.sha.hexdigest())
        self.out, self.seq = None, self.seq + 1
        return row


def _write(base: str, roll: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out, page = None, None, object()
        done: list[tuple] = []
        for batch in batches:
            for shard, pid, digest, refers, url, payload in zip(*[batch.column(i) for i in range(6)]):
                shard, pid, digest, refers = shard.as_py(), pid.as_py(), digest.as_py(), refers.as_py()
                if shard != at:
                    if out and out.out:
                        done.append(out.close())
                    at, out, page = shard, _Shard(base, shard, roll, level), object()
                if pid != page:
                    page, first, seen = pid, {}, {}
                if refers is not None:  # a note that precedes the page's rows
                    first[digest] = refers
                    continue
                data = (payload.as_py() or "").encode()
                nth = seen[digest] = seen.get(digest, -1) + 1
                ref = first.get(digest)
                if ref is None and nth and pid is not None and len(data) >= MIN_REVISIT:
                    ref = pid
                done += out.put(record(pid, url.as_py(), data, digest, nth, ref, date))
        if out and out.out:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], schema=_MANIFEST)

    return tidy(run)


def read_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member."""
    z, buffer = zlib.decompressobj(31), bytearray()
    for data in chunks:
        while data:
            buffer += z.decompress(data)
            data = b""
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
                cut = buffer.index(b"\r\n\r\n")
                head = dict(x.split(": ", 1) for x in buffer[:cut].decode().split("\r\n")[1:])
                n = int(head["Content-Length"])
                yield head, bytes(buffer[cut + 4 : cut + 4 + n])
                buffer = bytearray()


def _chunks(stream, n: int = 1 << 20) -> Iterator[bytes]:
    while data := stream.read(n):
        yield data


def _read(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(base)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(posixpath.join(root, name), compression=None) as f:
                    for head, block in read_records(_chunks(f)):
                        if head["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
                            raise ValueError(f"{name}: block digest of {head['WARC-Record-ID']} differs")
                        cut = block.index(b"\r\n\r\n") + 4
                        size = int(block[:cut].rpartition(b"Content-Length: ")[2])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if head["WARC-Type"] == "response" and (
                            size != len(block) - cut or hashlib.sha256(block[cut:]).hexdigest() != digest):
                            raise ValueError(f"{name}: payload of {head['WARC-Record-ID']} differs")
                        page, ref = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                        rows.append((page and int(page), size, digest, head["WARC-Type"], ref and int(ref)))
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000]), _ROWS.types)], schema=_ROWS)

    return tidy(run)


def shard_bounds(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """Upper page ids (exclusive) of all shards but the last; sizes: page_id, n.

    One counting pass over CELLS equal cells of the id range; cells that hold
    much more than a shard are told apart again, so clustered ids come out even.
    The driver sees at most CELLS rows a pass.
    """
    r = sizes.agg(F.min("page_id"), F.max("page_id")).first()
    if r[0] is None:
        return []

    def cells(lo: int, hi: int) -> list[tuple[int, int, int]]:  # [start, end), bytes
        width = max(1, -(-(hi - lo) // CELLS))
        got = (
            sizes.where((F.col("page_id") >= lo) & (F.col("page_id") < hi))
            .groupBy(F.floor((F.col("page_id").cast("decimal(20,0)") - lo) / width).cast("bigint").alias("c")).agg(F.sum("n").alias("n")).collect()
        )
        out = []
        for c, n in sorted((x.c, x.n) for x in got):
            a, b = lo + c * width, min(hi, lo + (c + 1) * width)
            out += cells(a, b) if n > 4 * shard_bytes and b - a > 1 else [(a, b, n)]
        return out

    bounds, size = [], 0
    for start, _, n in cells(r[0], r[1] + 1):
        if size and size + n > shard_bytes:
            bounds.append(start)
            size = 0
        size += n
    return bounds


def write(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
    level: int = 5,
    date: str = DATE,
) -> DataFrame:
    """Write one record per row below ``path``; returns the manifest."""
    spark = pages.sparkSession
    p = only(pages, id_col, url_col, html_col).toDF("page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("bigint"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = p.withColumn("digest", F.sha2(payload, 256)).withColumn("n", F.length(payload).cast("bigint"))
    brief = stored(p.select("page_id", "digest", "n"), "digests")
    # boundaries count a record's overhead too
    bounds = shard_bounds(brief.select("page_id", (F.col("n") + 500).alias("n")), shard_bytes)
    shared = brief.where(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1 and first is not null").select("digest", "first")
    notes = brief.join(shared, "digest").where("page_id is null or page_id <> first").select(
        "page_id", "digest", F.col("first").alias("refers_to"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")
    ).distinct()
    rows = p.select("page_id", "digest", F.lit(None).cast("bigint").alias("refers_to"), "url", "html").unionByName(notes)
    edges = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else None
    shard = F.coalesce(_rank(edges, bounds), F.lit(0)) if bounds else F.lit(0)
    rows = rows.select(shard.cast("bigint").alias("shard"), "page_id", "digest", "refers_to", "url", "html")
    fs, root = _fs(path)
    fs.create_dir(posixpath.join(root, "_temporary"))
    made = (
        rows.repartitionById(len(bounds) + 1, F.col("shard").cast("int"))
        .sortWithinPartitions("shard", "page_id", F.col("refers_to").isNull(), "digest", "url")
        .mapInArrow(_write(path, roll_bytes, level, date), MANIFEST)
    )
    manifest = f"{path}/_manifest"
    made.write.mode("overwrite").parquet(manifest)
    fs.delete_dir(posixpath.join(root, "_temporary"))
    return spark.read.schema(MANIFEST).parquet(manifest)


def _rank(edges, bounds: list[int]):
    """How many bounds are <= page_id: a few comparisons a level, in a tree of expressions."""
    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("page_id") < bounds[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    if len(bounds) <= 256:
        return F.when(F.col("page_id").isNotNull(), tree(0, len(bounds)))
    return F.when(F.col("page_id").isNotNull(), F.size(F.filter(edges, lambda b: b <= F.col("page_id"))))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files that the manifest names, digests verified."""
    files = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest").select("file")
    n = max(1, min(files.count(), 10_000))
    return files.repartition(n, "file").mapInArrow(_read(path), ROWS)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write to the shared folder and read everything back."""
    path = shared_dir(pages.sparkSession, "warc")
    write(pages, path, **options)
    drop_at_exit(pages.sparkSession, path)
    return read(pages.sparkSession, path)
