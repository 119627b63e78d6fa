"""Helpers shared by the corpus operators.

Everything here is row- or batch-local, so it runs the same on one machine
and on a cluster.
"""

from __future__ import annotations

import ctypes
import functools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.shipping import ship

#: Memo entries after which a worker forgets the word hashes it has computed.
MEMO_WORDS = 150_000

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_K = np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)

#: a-z for A-Z, blanks for every other ASCII byte that is no letter or digit.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, vectorised."""
    h = (h ^ (h >> _S33)) * _M1
    h = (h ^ (h >> _S33)) * _M2
    return h ^ (h >> _S33)


def tidy(run):
    """A batch function that hands freed memory back when its task ends.

    Worker processes outlive tasks and stages; what a stage needed must not
    count against the next one.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


class WordHasher(dict):
    """64-bit hashes of byte words, remembered while the worker sees them again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of word hashes (none if it is shorter)."""
    if len(h) < n:
        return h[:0]
    g = h[: len(h) - n + 1]
    for i in range(1, n):
        g = mix(g * _K + h[i : len(h) - n + 1 + i])
    return g


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-case A-Z, then the maximal runs without ASCII white space."""
    return text.encode().lower().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-case A-Z, then the runs of letters, digits and non-ASCII characters."""
    return text.encode().translate(ALNUM).split() if text else []


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the cluster names none (tests), the session's warehouse serves.  The
    path names its file system, which need not be the workers' default.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    full = re.sub("^file:/(?!/)", "file:///", full)
    return f"{full.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    Cuts the lineage so that later uses neither recompute it nor depend on the
    executors that made it.
    """
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder of this session deleted when its driver ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns, whatever else the table has; the start of every operator with workers."""
    ship(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in cols])


def pieces(values: list[str | None], limit: int = 8_000_000) -> Iterator[slice]:
    """Slices of a batch whose texts stay under so many characters, one text at least."""
    at, size = 0, 0
    for i, v in enumerate(values):
        n = len(v) if v else 0
        if i > at and size + n > limit:
            yield slice(at, i)
            at, size = i, 0
        size += n
    if at < len(values):
        yield slice(at, len(values))
