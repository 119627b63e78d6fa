"""Backlog, retention caps, laggards and purging of consumed deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.scalars import age_seconds, escalation


def targets_frame(spark: SparkSession, targets: list[str]) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(targets)], "target string, position int")


def backlog(delta: DataFrame, track: DataFrame, targets: list[str], now, table_bytes: int = 0) -> DataFrame:
    """Per target: unconsumed deltas, age of the oldest, and its share of the table's bytes.

    The deltas are read once: consumption per delta becomes one set of targets,
    which is then tested for each configured target.
    """
    seen = track.where(F.col("target").isin(targets)).groupBy("delta_id").agg(F.collect_set("target").alias("seen"))
    d = delta.select("delta_id", "rc_at").join(seen, "delta_id", "left")
    left = lambda t: ~F.coalesce(F.array_contains("seen", t), F.lit(False))
    one = d.agg(F.count(F.lit(1)).alias("total"), F.array(*[
        F.struct(F.lit(t).alias("target"), F.lit(i).alias("position"), F.count_if(left(t)).alias("rows"), F.min(F.when(left(t), F.col("rc_at"))).alias("oldest"))
        for i, t in enumerate(targets)]).alias("x")) if targets else d.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "x", F.expr("cast(array() as array<struct<target:string,position:int,rows:bigint,oldest:timestamp>>)"))
    return one.select("total", F.explode("x").alias("x")).select(
        "x.target", "x.position", "x.rows",
        F.when(F.col("total") > 0, F.floor(F.lit(table_bytes) * F.col("x.rows") / F.col("total"))).otherwise(0).cast("bigint").alias("bytes"),
        F.when(F.col("x.rows") > 0, age_seconds(F.lit(now).cast("timestamp"), F.col("x.oldest"))).otherwise(0.0).alias("oldest_age"),
        (F.col("x.rows") > 0).alias("has_backlog"))


def laggard(backlogs: DataFrame) -> DataFrame:
    """The target with the oldest backlog; of several the first configured."""
    w = Window.orderBy(F.desc("oldest_age"), "position")
    return backlogs.where("has_backlog").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def over_cap(backlogs: DataFrame, max_age: float = 0, max_bytes: int = 0, table_bytes: int = 0) -> DataFrame:
    """Targets to sacrifice: each whose age passes the cap; the laggard if the table's bytes do."""
    out = backlogs.where(F.col("has_backlog") & (F.col("oldest_age") > max_age)) if max_age > 0 else backlogs.limit(0)
    if max_bytes > 0 and table_bytes > max_bytes:
        out = out.unionByName(laggard(backlogs)).distinct()
    return out.select("target").distinct().orderBy("target")


def consumed_by_all(delta: DataFrame, track: DataFrame, targets: list[str]) -> DataFrame:
    """Deltas every configured target has consumed; without targets, all."""
    if not targets:
        return delta.select("delta_id")
    n = len(set(targets))
    done = track.where(F.col("target").isin(targets)).groupBy("delta_id").agg(F.count_distinct("target").alias("n")).where(F.col("n") == n)
    return delta.select("delta_id").join(done, "delta_id", "left_semi")


def purge(delta: DataFrame, track: DataFrame, targets: list[str], sacrificed: list[str] = []) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """Delta and track after purging.  Sacrificed targets lose all their track rows and no longer count;
    track rows of deltas that are gone go as well, so neither grows without bound."""
    gone = consumed_by_all(delta, track, [t for t in targets if t not in sacrificed])
    kept = delta.join(gone, "delta_id", "left_anti")
    live = track.where(~F.col("target").isin(sacrificed)) if sacrificed else track
    return kept, live.join(kept.select("delta_id"), "delta_id", "left_semi")


def proximity(backlogs: DataFrame, max_age: float = 0, max_bytes: int = 0) -> DataFrame:
    """How near each target is to a cap, 0 to 1, and how loud that is."""
    parts = [F.lit(0.0)]
    if max_age > 0:
        parts.append(F.col("oldest_age") / max_age)
    if max_bytes > 0:
        parts.append(F.col("bytes") / max_bytes)
    p = F.least(F.lit(1.0), F.greatest(*parts, F.lit(0.0)))
    return backlogs.select("target", p.alias("proximity"), escalation(p).alias("level"))
