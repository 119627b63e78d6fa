"""Table metadata: columns, keys, foreign keys, and how they are introspected.

Spark knows types and nullability; keys, foreign keys and generated columns are
declared beside the data and checked against it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.globs import select_names


@dataclass(frozen=True)
class Column:
    name: str
    data_type: str
    nullable: bool = True
    generated: bool = False
    identity: bool = False
    auto_update: bool = False
    charset: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    name: str
    child: str
    child_columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    deferrable: bool = False


@dataclass(frozen=True)
class TableMeta:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    unique_keys: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    partitioned: bool = False
    storage: str = "default"

    @property
    def key(self) -> tuple[str, ...]:
        """The key that identifies rows: the primary key, else the first unique key."""
        return self.primary_key or (self.unique_keys[0] if self.unique_keys else ())

    @property
    def transport(self) -> list[str]:
        """Columns that are carried: source order, without generated ones."""
        return [c.name for c in self.columns if not c.generated]

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)


# Namespaces that belong to the databases themselves.
SYSTEM = {"pg_catalog", "information_schema", "pg_toast", "mysql", "performance_schema", "sys"}


def candidates(listing: DataFrame) -> DataFrame:
    """Tables of users in a catalog listing (namespace, name, is_partition): no system
    namespaces, and no partitions, which their parent stands for."""
    own = ~F.col("namespace").isin(*SYSTEM) & ~F.col("namespace").startswith("pg_temp")
    return listing.where(own & ~F.coalesce("is_partition", F.lit(False)))


@dataclass
class Catalog:
    tables: dict[str, TableMeta] = field(default_factory=dict)
    capabilities: frozenset[str] = frozenset()

    def select(self, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> list[TableMeta]:
        return [self.tables[n] for n in select_names(list(self.tables), list(include), list(exclude))]

    def foreign_keys(self) -> list[ForeignKey]:
        return sorted((fk for t in self.tables.values() for fk in t.foreign_keys), key=lambda f: (f.child, f.name, f.parent))


def introspect(name: str, df: DataFrame, *, key=(), unique=(), foreign_keys=(), generated=(), **more) -> TableMeta:
    """Metadata of a DataFrame and what is declared about it."""
    known = set(df.columns)
    for c in [*key, *generated, *(c for u in unique for c in u), *(c for f in foreign_keys for c in f.child_columns)]:
        if c not in known:
            raise ValueError(f"{name} has no column {c}")
    cols = tuple(Column(f.name, f.dataType.simpleString(), f.nullable and f.name not in key, f.name in generated) for f in df.schema)
    return TableMeta(name, cols, tuple(key), tuple(map(tuple, unique)), tuple(foreign_keys), **more)


def columns_frame(spark: SparkSession, tables: Iterable[TableMeta]) -> DataFrame:
    rows = [(t.name, i, c.name, c.data_type, c.nullable, c.generated, c.identity, c.charset) for t in tables for i, c in enumerate(t.columns)]
    return spark.createDataFrame(
        rows, "table_name string, ordinal int, column_name string, data_type string, nullable boolean, generated boolean, identity boolean, charset string")


def key_columns(spark: SparkSession, tables: Iterable[TableMeta]) -> DataFrame:
    """(table, key columns in key order): key attributes joined to their ordinals and gathered in order."""
    rows = [(t.name, list(t.key)) for t in tables]
    keys = spark.createDataFrame(rows, "table_name string, names array<string>").select("table_name", F.posexplode("names").alias("ord", "column_name"))
    return keys.groupBy("table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "column_name"))), lambda x: x["column_name"]).alias("key"))


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that cannot identify a row: repeated, or with a null component."""
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    null = F.lit(False)
    for k in key:
        null = null | F.col(k).isNull()
    return g.where((F.col("n") > 1) | null)
