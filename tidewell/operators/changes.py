"""Change processing on keyed tables: what is dirty, re-reading it, applying it.

Deltas carry keys only, never row images.  What is unconsumed is a set
difference (deltas without a track row of the target), never a position in a
log, so a delta that becomes visible late is still found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Key = list[str]


def dirty_keys(delta: DataFrame, track: DataFrame, target: str, limit: int = 0) -> DataFrame:
    """Deltas the target has not consumed, the oldest ``limit`` of them (all if 0)."""
    seen = track.where(F.col("target") == target).select("delta_id")
    left = delta.join(seen, "delta_id", "left_anti")
    return left.orderBy("delta_id").limit(limit) if limit > 0 else left


def coalesced(dirty: DataFrame, key: Key) -> DataFrame:
    """One row per key with its delta count and range; ids stay in ``dirty`` for confirmation."""
    return dirty.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_deltas"), F.min("delta_id").alias("first_delta"), F.max("delta_id").alias("last_delta"))


def _present(df: DataFrame, key: Key) -> DataFrame:
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    return df.withColumn(key[0], F.when(null, F.raise_error(F.lit("null key component"))).otherwise(F.col(key[0])))


def reread(source: DataFrame, keys: DataFrame, key: Key) -> DataFrame:
    """Current source rows of the keys.  Catalyst broadcasts the keys if they are few."""
    return source.join(keys.select(*key).distinct(), key, "left_semi")


def missing(keys: DataFrame, source: DataFrame, key: Key) -> DataFrame:
    """Keys the source no longer has."""
    return keys.select(*key).distinct().join(source.select(*key), key, "left_anti")


def upsert(target: DataFrame, staged: DataFrame, key: Key, generated: list[str] = []) -> DataFrame:  # noqa: B006
    """Staged rows replace target rows with their key; generated columns stay the target's own to compute.

    Where every column is a key there is nothing to replace: only new keys are added.
    """
    cols = [c for c in target.columns if c not in generated]
    staged = _present(staged.select(*cols), key)
    if set(cols) == set(key):
        return target.unionByName(staged.join(target.select(*key), key, "left_anti").distinct(), allowMissingColumns=True)
    return target.join(staged.select(*key), key, "left_anti").unionByName(staged, allowMissingColumns=True)


def delete_absent(target: DataFrame, dirty: DataFrame, staged: DataFrame, key: Key) -> DataFrame:
    """Drop target rows whose key is dirty and was not found at the source."""
    gone = dirty.select(*key).distinct().join(staged.select(*key), key, "left_anti")
    return target.join(gone, key, "left_anti")


def apply_pass(source: DataFrame, target: DataFrame, dirty: DataFrame, key: Key) -> DataFrame:
    """The target after one pass over the dirty keys.

    Dirty target rows go, current source rows of the dirty keys come: two joins
    against the same small key set, whatever operation the deltas name.
    """
    keys = _present(coalesced(dirty, key).select(*key), key)
    return target.join(keys, key, "left_anti").unionByName(reread(source, keys, key).select(*target.columns))


def newly_confirmed(track: DataFrame, dirty: DataFrame, target: str, now) -> DataFrame:
    """Track rows for the exact delta ids that were applied, without those that are there."""
    done = dirty.select(F.lit(target).alias("target"), "delta_id", F.lit(now).cast("timestamp").alias("consumed_at")).distinct()
    return done.join(track, ["target", "delta_id"], "left_anti")


def confirm(track: DataFrame, dirty: DataFrame, target: str, now) -> DataFrame:
    """Track with what was applied; confirming twice changes nothing."""
    return track.unionByName(newly_confirmed(track, dirty, target, now))


def snapshot_diff(before: DataFrame, after: DataFrame, key: Key) -> DataFrame:
    """Keys with I, U or D that turn one snapshot into the other; nulls compare as values."""
    rest = [c for c in before.columns if c not in key]
    same = reduce(lambda a, b: a & b, [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in rest], F.lit(True))
    on = reduce(lambda a, b: a & b, [F.col(f"b.{k}") == F.col(f"a.{k}") for k in key])
    b = before.withColumn("__b", F.lit(1)).alias("b")
    a = after.withColumn("__a", F.lit(1)).alias("a")
    op = F.when(F.col("__b").isNull(), "I").when(F.col("__a").isNull(), "D").when(~same, "U")
    return b.join(a, on, "full").select(*[F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in key], op.alias("rc_op")).where("rc_op is not null")


def capture(before: DataFrame, after: DataFrame, key: Key, first_id: int, now) -> DataFrame:
    """Deltas of two snapshots, numbered from ``first_id`` on; ids ascend but leave gaps and follow no order of keys."""
    d = snapshot_diff(before, after, key).withColumnsRenamed({k: f"k{i}" for i, k in enumerate(key, 1)})
    return d.withColumn("delta_id", F.monotonically_increasing_id() + F.lit(first_id)).withColumn("rc_at", F.lit(now).cast("timestamp"))


def pk_change_expand(updates: DataFrame, old_key: Key, new_key: Key) -> DataFrame:
    """An update that changes the key is the deletion of the old and the insertion of the new."""
    moved = reduce(lambda a, b: a | b, [~F.col(o).eqNullSafe(F.col(n)) for o, n in zip(old_key, new_key)])
    entry = lambda op, cols: F.struct(F.lit(op).alias("rc_op"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(cols, 1)])
    rows = F.when(moved, F.array(entry("D", old_key), entry("U", new_key))).otherwise(F.array(entry("U", new_key)))
    keep = [c for c in updates.columns if c not in {*old_key, *new_key}]
    return updates.select(*keep, F.explode(rows).alias("x")).select(*keep, "x.*")


def orphans(child: DataFrame, parent: DataFrame, child_cols: Key, parent_cols: Key) -> DataFrame:
    """Child rows whose foreign key, all of it non-null, has no parent."""
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in child_cols])
    p = parent.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(parent_cols)]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(child_cols)])
    return child.where(full).join(p, on, "left_anti")


def orphan_counts(edges: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(edge, n_orphans) of single-column references: (name, child, column, parent, column).

    Every child is read once, whatever number of references it has: its keys
    are counted per reference before anything is shuffled, and one join with
    the parents' keys settles all references.
    """
    by_child: dict[int, tuple[DataFrame, list]] = {}
    whole = {"byte", "short", "integer", "long"}
    kinds = {df.schema[c].dataType.typeName() for _, child, cc, parent, pc in edges for df, c in ((child, cc), (parent, pc))}
    kind = "bigint" if kinds <= whole else "string"  # one type for all keys
    for i, (_, child, c, _, _) in enumerate(edges):
        by_child.setdefault(id(child), (child, []))[1].append(F.struct(F.lit(i).alias("e"), F.col(c).cast(kind).alias("k")))
    every = lambda dfs: reduce(DataFrame.unionByName, dfs)
    keys = every([child.select(F.explode(F.array(*entries)).alias("x")).select("x.*") for child, entries in by_child.values()])
    keys = keys.where("k is not null").groupBy("e", "k").agg(F.count(F.lit(1)).alias("n"))
    known = every([parent.select(F.lit(i).alias("e"), F.col(c).cast(kind).alias("k")) for i, (_, _, _, parent, c) in enumerate(edges)])
    found = keys.join(known, ["e", "k"], "left_anti").groupBy("e").agg(F.sum("n").alias("n_orphans"))
    names = keys.sparkSession.createDataFrame([(i, e[0]) for i, e in enumerate(edges)], "e int, edge string")
    return names.join(found, "e", "left").select("edge", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"))


def nulled(rows: DataFrame, columns: Key) -> DataFrame:
    """First pass of a cyclic load: references left out."""
    return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in columns})


def filled(loaded: DataFrame, rows: DataFrame, key: Key, columns: Key) -> DataFrame:
    """Second pass: references filled in by key; rows that were not loaded change nothing."""
    fill = rows.select(*key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    j = loaded.join(fill, key, "left")
    return j.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in loaded.columns])
