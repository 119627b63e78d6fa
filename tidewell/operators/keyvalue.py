"""Key-value keyspaces: (key, type, value, ttl_ms, size) rows without captured changes.

They converge by reconciliation: rolling re-reads of the source upsert, a
sweep over the target's keys deletes what the source has no longer.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.globs import selected
from tidewell.functions.scalars import live_ttl
from tidewell.operators.changes import missing, reread, upsert
from tidewell.operators.chunks import key_text, page_after

#: Hinted keys that are held; beyond that the hints count as lost, and everything is looked at again.
MOST_HINTS = 100_000

# What a time to live of a key says.
GONE, FOREVER = -2, -1
TYPES = ["string", "list", "set", "zset", "hash", "stream"]


def live(df: DataFrame, include: list[str] = [], exclude: list[str] = [], types: list[str] = []) -> DataFrame:  # noqa: B006
    """Selected keys that still exist, with the TTL to restore them with."""
    if bad := set(types) - set(TYPES):
        raise ValueError(f"unknown key types {sorted(bad)}")
    out = df.where(F.col("ttl_ms").isNull() | (F.col("ttl_ms") != GONE)).where(F.col("value").isNotNull())
    out = out.where(selected(F.col("key").cast("string"), include, exclude, keys=True))
    if types:
        out = out.where(F.col("type").isin(types))
    return out.withColumn("restore_ttl_ms", live_ttl(F.col("ttl_ms")))


def size_level(warn_bytes: int, refuse_bytes: int):
    if refuse_bytes and warn_bytes > refuse_bytes:
        raise ValueError("the warning size is above the refusal size")
    s = F.col("size")
    level = F.when(s >= refuse_bytes, "refuse") if refuse_bytes else F
    return (level.when(s >= warn_bytes, "warn") if warn_bytes else level.when(F.lit(False), "warn")).otherwise("ok")


def size_guard(df: DataFrame, warn_bytes: int, refuse_bytes: int) -> DataFrame:
    """The rows with their level; a refused value fails the job that meets it."""
    level = size_level(warn_bytes, refuse_bytes)
    stop = F.raise_error(F.concat(F.lit("value too large: "), F.col("key").cast("string")))
    return df.withColumn("size_level", F.when(level == "refuse", stop.cast("string")).otherwise(level))


def sweep(target_keys: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Target keys the source has no longer."""
    return missing(target_keys, source, key)


def end_of(page: DataFrame, key: list[str], most: int) -> tuple | None:
    """The last key of a full page, as text; None where the scan came to its end."""
    n, last = page.agg(F.count(F.lit(1)), F.max(F.struct(*key)).alias("k")).first()
    if n < most:
        return None
    return tuple(page.sparkSession.createDataFrame([last], page.schema).select(*key_text(page, key)).first())


@dataclass
class Rolling:
    """Where a rolling scan stands; ``None`` starts over.  Priority keys go first, each once."""

    cursor: tuple | None = None
    priority: list[tuple] = field(default_factory=list)

    def hint(self, keys: list[tuple]) -> None:
        self.priority = list(dict.fromkeys([*self.priority, *keys]))
        if len(self.priority) > MOST_HINTS:
            self.gap()

    def gap(self) -> None:
        """Hints were lost: everything has to be looked at again."""
        self.cursor = None
        self.priority = []

    def step(self, df: DataFrame, key: list[str], most: int) -> DataFrame:
        """The next keys to look at, at most ``most``; the cursor moves behind them."""
        first, self.priority = self.priority[:most], self.priority[most:]
        spark = df.sparkSession
        kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)
        out = spark.createDataFrame(first, kinds) if first else None
        if most > len(first):
            page = page_after(df.select(*key), key, self.cursor, most - len(first)).checkpoint()
            at = end_of(page, key, most - len(first))
            self.cursor, rest = at, page
            out = out.unionByName(rest) if out is not None else rest
        return out.distinct()


@dataclass
class Sweeper:
    """A pass over the target's keys in pages; what the source lacks is to be deleted."""

    cursor: tuple | None = None
    passes: int = 0
    seen: int = 0

    def step(self, target: DataFrame, source: DataFrame, key: list[str], most: int) -> DataFrame:
        page = page_after(target.select(*key), key, self.cursor, most).checkpoint()
        self.cursor = end_of(page, key, most)
        if self.cursor is None:  # the pass is over
            self.passes, self.seen = self.passes + 1, 0
        else:
            self.seen += most
        return missing(page, source, key)

    def lag(self, target_keys: int) -> int:
        """Keys the current pass has not looked at yet."""
        return max(0, target_keys - self.seen)


def reconcile(source: DataFrame, target: DataFrame, key: list[str], rolling: Rolling, sweeper: Sweeper, most: int) -> DataFrame:
    """The target after one pass: some keys re-read from the source, some of its own checked for deletion."""
    fresh = reread(source, rolling.step(source, key, most), key).select(*target.columns)
    gone = sweeper.step(target, source, key, most)
    return upsert(target.join(gone, key, "left_anti"), fresh, key)
