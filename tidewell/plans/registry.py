"""Kinds of endpoints by name.

A kind supplies a reader and a writer of tables; built-in is ``store``.  Others
(JDBC databases, keyspaces) register themselves where their drivers are at hand.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from tidewell.sources.store import Store


class Endpoint(Protocol):
    """What a sync needs of a side: current rows, and commits of several tables at once."""

    def exists(self, table: str) -> bool: ...

    def read(self, table: str) -> DataFrame: ...

    def commit(self, tables: dict[str, DataFrame]) -> int: ...


_KINDS: dict[str, Callable[[SparkSession, dict], Endpoint]] = {}


def register(name: str, make: Callable[[SparkSession, dict], Endpoint]) -> None:
    if name in _KINDS:
        raise ValueError(f"an endpoint kind {name} is registered already")
    _KINDS[name] = make


def connect(spark: SparkSession, options: dict) -> Endpoint:
    kind = options.get("engine")
    if kind not in _KINDS:
        raise ValueError(f"unknown endpoint kind {kind!r}; known: {sorted(_KINDS)}")
    return _KINDS[kind](spark, options)


register("store", lambda spark, options: Store(spark, options["path"]))
