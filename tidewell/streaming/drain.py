"""A sync driven by Structured Streaming.

Delta files arrive as a stream; every micro-batch appends them to the delta
table and runs one drain.  Offsets only bound what a batch reads: what is
consumed is decided by the set difference, so files that arrive out of order
or twice are applied all the same, and a replayed batch changes nothing.
Event-time watermarks are not used anywhere, for they would drop late keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators import changes
from tidewell.sources.store import Store


def drain_batches(
    spark: SparkSession, source: Store, target: Store, table: str, key: list[str], name: str, clock, *, before_confirm=None
):
    """The function for ``foreachBatch``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        new = batch.dropDuplicates(["delta_id"])
        if source.exists(f"delta_{table}"):
            new = new.join(source.read(f"delta_{table}").select("delta_id"), "delta_id", "left_anti").select(*batch.columns)
        source.append(f"delta_{table}", new)
        source.compact(f"delta_{table}")
        track = source.read(f"track_{table}") if source.exists(f"track_{table}") else spark.createDataFrame(
            [], "target string, delta_id bigint, consumed_at timestamp")
        dirty = changes.dirty_keys(source.read(f"delta_{table}"), track, name)
        if dirty.isEmpty():
            return
        rows = source.read(table)
        target.commit({table: changes.apply_pass(rows, target.read(table) if target.exists(table) else rows.limit(0), dirty, key)})
        if before_confirm:
            before_confirm(batch_id)
        source.append(f"track_{table}", changes.newly_confirmed(track, dirty, name, clock()))
        source.compact(f"track_{table}")

    return run


def start(
    spark: SparkSession, path: str, schema: str, checkpoint: str, batch_function, *, files_per_batch: int = 1, once: bool = True, interval: str = "1 second"
) -> StreamingQuery:
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch_function)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
