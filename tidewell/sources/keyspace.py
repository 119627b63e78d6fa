"""A keyspace as a Spark data source: one input partition per shard.

``register(spark)``, then
``spark.read.format("keyspace").option("path", ...).option("shards", n)``.
A shard is one file of length-prefixed records (key, type, value, ttl, size);
keys whose time to live says they are gone are left out.  The stream reader
pages through a shard list with an offset per pass, as a rolling scan does.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from tidewell.functions.scalars import unframe
from tidewell.shipping import ship

SCHEMA = "key binary, type string, value binary, ttl_ms bigint, size bigint"


class Shard(InputPartition):
    def __init__(self, path: str):
        self.path = path


def pack_record(key: bytes, kind: str, value: bytes, ttl_ms: int | None) -> bytes:
    parts = [key, kind.encode(), value, None if ttl_ms is None else str(ttl_ms).encode()]
    body = b"".join(b"\xff\xff\xff\xff" if p is None else len(p).to_bytes(4, "big") + p for p in parts)
    return len(body).to_bytes(4, "big") + body


# Schemes of Hadoop's connectors and what the same stores are called here.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file"}


def filesystem(uri: str):
    """(file system, path in it, prefix that makes a path a URI again) of a Hadoop path."""
    from pyarrow import fs

    scheme, sep, rest = uri.partition("://")
    if not sep:
        return fs.LocalFileSystem(), uri.removeprefix("file:"), ""
    plain = SCHEMES.get(scheme)
    if plain is None:
        raise ValueError(f"no file system for {scheme}:// here; known: {', '.join(sorted(SCHEMES))}")
    system, path = fs.FileSystem.from_uri(f"{plain}://{rest}")
    host = rest.split("/", 1)[0] if plain in ("hdfs", "viewfs") else ""
    return system, path, f"{scheme}://{host}"


def read_records(path: str) -> Iterator[tuple]:
    system, name, _ = filesystem(path)
    with system.open_input_stream(name) as f:
        while head := f.read(4):
            body = f.read(int.from_bytes(head, "big"))
            key, kind, value, ttl = unframe(bytes(body))
            ms = None if ttl is None else int(ttl)
            if value is not None and ms != -2:
                yield bytes(key), kind.decode(), bytes(value), ms, len(value)


def write_shards(rows, path: str, shards: int) -> int:
    """Rows (key, type, value, ttl_ms) as shard files below a path; how many rows."""
    import pyarrow as pa

    def run(batches):
        import uuid

        system, root, _ = filesystem(path)
        name, n = f"{root}/{uuid.uuid4().hex}", 0
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{name}.tmp") as f:
            for b in batches:
                for r in zip(*[c.to_pylist() for c in b.columns]):
                    f.write(pack_record(*r))
                    n += 1
        system.move(f"{name}.tmp", f"{name}.shard")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    ship(rows.sparkSession)
    cols = rows.selectExpr("cast(key AS binary) AS key", "type", "cast(value AS binary) AS value", "ttl_ms")
    return cols.repartition(shards).mapInArrow(run, "n bigint").agg({"n": "sum"}).first()[0] or 0


def _shards(options: dict) -> list[str]:
    from pyarrow import fs

    system, root, prefix = filesystem(options["path"])
    found = system.get_file_info(fs.FileSelector(root))
    return [prefix + f.path for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.path.endswith(".tmp")]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Shard(p) for p in _shards(self.options)]

    def read(self, partition: Shard) -> Iterator[tuple]:
        return read_records(partition.path)


class _Stream(SimpleDataSourceStreamReader):
    """Each batch reads the next shard whole; after the last the scan starts over on the next run."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"shard": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        names = _shards(self.options)
        if start["shard"] >= len(names):
            return iter([]), start
        return read_records(names[start["shard"]]), {"shard": start["shard"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        names = _shards(self.options)
        for i in range(start["shard"], end["shard"]):
            yield from read_records(names[i])


class KeyspaceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyspace"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark) -> None:
    """Make the format known to a session and its workers."""
    ship(spark).dataSource.register(KeyspaceSource)
