"""Connected components of a graph of links, as DataFrames.

Each partition first contracts its own links by union-find, which leaves one
link per node and partition; alternating large- and small-star rounds then
make every node point at the least node of its component.  Links are never
gathered on the driver and a node of any degree is only ever aggregated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._common import ship, stored, tidy

#: Links a task contracts at a time.
CONTRACT = 500_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) for every node of the links that is not its own."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for i, p in enumerate(parent):  # parents are smaller, hence final
        parent[i] = parent[p]
    root = np.asarray(parent, np.int64)
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out():
        t = pa.Table.from_batches(held)
        a, b = union_find(t.column(0).to_numpy(), t.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    for x in batches:
        held.append(x)
        size += x.num_rows
        if size >= CONTRACT:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One star round over links u > v (v the smaller end)."""
    near = e.select("u", "v")
    if large:
        near = near.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    if large:  # (v, m) for the neighbours above u, that is for links seen from their smaller end
        new = e.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"))
    else:  # (v, m) for the neighbours below u, and (u, m)
        new = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return new.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that is not the least of its component.

    ``links`` has two bigint columns.  Null ends and self links are ignored.
    """
    ship(links.sparkSession)
    a, b = links.columns
    e = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = e.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v"))
    e = stored(e.mapInArrow(tidy(_contract), "u bigint, v bigint").distinct(), "links")
    mark = lambda d: d.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
    was = mark(e)
    while was[0] != was[2] or _chained(e):  # not one link per node, or a target that is a node itself
        e = stored(_star(_star(e, True), False), "links")
        now = mark(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _chained(e: DataFrame) -> bool:
    return not e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi").isEmpty()
