"""Keyset chunks: half-open, gap-free key ranges that a copy works through.

Boundaries are every n-th key.  They come from a range partitioning by key and
per-partition counts, so no task sorts the whole table; a single global window
would.  Predicates compare key tuples lexicographically with exactly typed
bounds and repeat the first component alone, which is what reaches Parquet.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Chunk:
    """Keys in [lo, hi); None is unbounded."""

    lo: tuple | None
    hi: tuple | None


def numbered(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys with their rank from 1 in key order (column ``rn``), without a global sort task.

    The range-partitioned keys are checkpointed with the number of their
    partition, so that counts and ranks see one and the same split.
    """
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None) or f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        df.sparkSession.sparkContext.setCheckpointDir(base)
    parts = df.select(*key).repartitionByRange(*[F.col(k).asc() for k in key]).withColumn("__p", F.spark_partition_id()).checkpoint()
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
    local = parts.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*key)))
    return local.join(F.broadcast(before.select("__p", F.coalesce("before", F.lit(0)).alias("before"))), "__p").select(
        *key, (F.col("before") + F.col("__r")).alias("rn"))


def key_text(df: DataFrame, key: list[str]) -> list[Column]:
    """Key values as text that :func:`in_chunk` reads back exactly, whatever the session's time zone."""
    kind = lambda k: df.schema[k].dataType.typeName()
    one = lambda k: F.hex(k) if kind(k) == "binary" else F.unix_micros(k).cast("string") if kind(k) == "timestamp" else F.col(k).cast("string")
    return [one(k).alias(k) for k in key]


def boundaries(df: DataFrame, key: list[str], rows: int) -> DataFrame:
    """Keys that start a chunk, without the first: every ``rows``-th."""
    return numbered(df, key).where((F.col("rn") > 1) & ((F.col("rn") - 1) % rows == 0)).orderBy("rn")


def plan(df: DataFrame, key: list[str], rows: int, most: int = 1_000_000) -> list[Chunk]:
    """The chunks of a table; the first and last are unbounded, an empty table is one chunk.

    Bounds are texts of :func:`key_text`.  A table of one chunk is only counted.
    """
    if df.count() <= rows:
        return [Chunk(None, None)]
    cut = [tuple(r) for r in boundaries(df, key, rows).limit(most).select(*key_text(df, key)).collect()]
    edges = [None, *cut, None]
    return [Chunk(a, b) for a, b in zip(edges, edges[1:])]


def _value(df: DataFrame, column: str, v) -> Column:
    """A bound as a literal of the key's type: a text of :func:`key_text`, or a plain value."""
    kind = df.schema[column].dataType
    if isinstance(v, str) and kind.typeName() == "binary":
        return F.unhex(F.lit(v))
    if isinstance(v, str) and kind.typeName() == "timestamp":
        return F.timestamp_micros(F.lit(v).cast("bigint"))
    return F.lit(v).cast(kind)


def _typed(df: DataFrame, key: list[str], bound: tuple) -> Column:
    return F.struct(*[_value(df, k, v).alias(k) for k, v in zip(key, bound)])


def in_chunk(df: DataFrame, key: list[str], chunk: Chunk) -> Column:
    tests = [F.lit(True)]
    row = F.struct(*key)
    if chunk.lo is not None:
        first = _value(df, key[0], chunk.lo[0])
        tests += [F.col(key[0]) >= first, row >= _typed(df, key, chunk.lo)]
    if chunk.hi is not None:
        first = _value(df, key[0], chunk.hi[0])
        tests += [F.col(key[0]) <= first, row < _typed(df, key, chunk.hi)]
    return reduce(lambda a, b: a & b, tests)


def scan(df: DataFrame, key: list[str], chunk: Chunk, columns: list[str] | None = None) -> DataFrame:
    return df.where(in_chunk(df, key, chunk)).select(*(columns or df.columns))


def delete_range(df: DataFrame, key: list[str], chunk: Chunk) -> DataFrame:
    return df.where(~in_chunk(df, key, chunk))


def chunk_counts(df: DataFrame, key: list[str], rows: int) -> DataFrame:
    """Rows per chunk of the plan (chunk, n)."""
    n = numbered(df, key)
    return n.groupBy(F.floor((F.col("rn") - 1) / rows).cast("bigint").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


def blocks(df: DataFrame) -> DataFrame:
    """Physical ranges for tables without a key: every row with its file and the file block it lies in."""
    return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))


def block_plan(df: DataFrame) -> list[tuple[str, int]]:
    """The (file, block) ranges of a table in order: one row for each split reaches the driver."""
    return [tuple(r) for r in blocks(df).select("__file", "__block").distinct().orderBy("__file", "__block").collect()]


def block_scan(df: DataFrame, lo: tuple[str, int] | None, hi: tuple[str, int] | None) -> DataFrame:
    """Rows whose block is in [lo, hi); files outside are not read."""
    b, at = blocks(df), F.struct("__file", "__block")
    edge = lambda x: F.struct(F.lit(x[0]).alias("__file"), F.lit(x[1]).cast("bigint").alias("__block"))
    if lo is not None:
        b = b.where((F.col("__file") >= lo[0]) & (at >= edge(lo)))
    if hi is not None:
        b = b.where((F.col("__file") <= hi[0]) & (at < edge(hi)))
    return b.drop("__file", "__block")


def page_after(df: DataFrame, key: list[str], last: tuple | None, n: int) -> DataFrame:
    """The next n rows in key order after a cursor: a bounded rolling scan."""
    if last is not None:
        df = df.where((F.col(key[0]) >= _value(df, key[0], last[0])) & (F.struct(*key) > _typed(df, key, last)))
    return df.orderBy(*key).limit(n)
