"""Validation of a sync before anything is copied: findings as a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.types import charset_level, my_level, my_parse, pg_level, pg_parse, reason, worst
from tidewell.plans import graph
from tidewell.sources.catalog import TableMeta, columns_frame

SEVERITIES = ["INFO", "WARN", "BLOCK"]
FINDINGS = "severity string, table_name string, category string, message string, seq int"


@dataclass(frozen=True)
class Dialect:
    """What differs between the two kinds of database that are checked."""

    name: str
    level: object
    blocks_cycles: bool
    storage: str | None = None
    parse: object = pg_parse
    risky, bad = "type", "type"


PG = Dialect("pg", pg_level, True)
MYSQL = Dialect("mysql", my_level, False, storage="innodb", parse=my_parse)
object.__setattr__(MYSQL, "risky", "type-risky")
object.__setattr__(MYSQL, "bad", "type-incompatible")


def compare_columns(source: DataFrame, target: DataFrame, level=pg_level, parse=pg_parse) -> DataFrame:
    """Columns of both sides by name: status, level and the reason for it."""
    s = source.where(~F.col("generated")).select("table_name", "column_name", F.col("data_type").alias("source_type"), F.col("charset").alias("sc"))
    t = target.select("table_name", "column_name", F.col("data_type").alias("target_type"), F.col("charset").alias("tc"), "nullable", "generated", "identity")
    both = s.join(t, ["table_name", "column_name"], "full")
    status = F.when(F.col("target_type").isNull(), "missing").when(F.col("source_type").isNull(), "extra").otherwise("matched")
    types, sets = level(F.col("source_type"), F.col("target_type")), charset_level(F.col("sc"), F.col("tc"))
    grade = F.when(status == "matched", worst(types, sets))
    why = F.when(grade != types, F.concat("sc", F.lit(" to "), "tc", F.lit(" may lose characters"))).otherwise(reason(F.col("source_type"), F.col("target_type"), grade, parse))
    return both.select("table_name", "column_name", "source_type", "target_type", status.alias("status"), grade.alias("level"),
                       F.when(status == "matched", why).alias("reason"), "nullable", "generated", "identity")


def findings(spark: SparkSession, source: list[TableMeta], target: list[TableMeta], dialect: Dialect = PG) -> DataFrame:
    """All findings; the first dialect's are sorted by table, severity (worst first)
    and category, the second's keep the order in which they are made."""
    rows: list[tuple[str, str, str, str]] = []
    have = {t.name: t for t in target}
    for t in source:
        if not t.key:
            rows.append(("WARN", t.name, "no-key", "no primary or unique key; the table is skipped"))
        if dialect.storage and t.storage.lower() not in (dialect.storage, "default"):
            rows.append(("BLOCK", t.name, "non-innodb", f"storage engine {t.storage} has no transactions"))
        if t.name not in have:
            rows.append(("BLOCK", t.name, "missing-table" if dialect is PG else "missing-target", "the target has no such table"))
        elif dialect is MYSQL and any(u != t.key for u in have[t.name].unique_keys):
            rows.append(("BLOCK", t.name, "secondary-unique", "a further unique key of the target could absorb an upsert"))
    shared = [t for t in source if t.name in have]
    cols = compare_columns(columns_frame(spark, shared), columns_frame(spark, [have[t.name] for t in shared]), dialect.level, dialect.parse)
    # metadata: as many rows as there are columns
    for r in cols.orderBy("table_name", "column_name").collect():
        if r.status == "missing":
            rows.append(("BLOCK", r.table_name, "missing-column", f"{r.column_name} is missing at the target"))
        elif r.status == "extra" and dialect is PG and not r.nullable and not r.generated and not r.identity:
            rows.append(("WARN", r.table_name, "extra-not-null", f"{r.column_name} exists at the target only and takes no null"))
        elif r.level == "risky":
            rows.append(("WARN", r.table_name, dialect.risky, f"{r.column_name}: {r.reason}"))
        elif r.level == "incompatible":
            rows.append(("BLOCK", r.table_name, dialect.bad, f"{r.column_name}: {r.reason}"))
    parts = graph.components(source)
    if big := graph.giant(parts):
        rows.append(("WARN", big.tables[0], "giant-component", f"{len(big.tables)} tables hang together"))
    for fk in graph.dangling(source):
        rows.append(("WARN", fk.child, "dangling-fk", f"{fk.name} refers to {fk.parent}, which is not selected"))
    for e in graph.cyclic_edges(source):
        rows.append(("BLOCK" if e.strategy == "blocked" and dialect.blocks_cycles else "INFO", e.key.child, "cyclic-fk", f"{e.key.name}: {e.strategy}"))
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], FINDINGS)
    if dialect is PG:
        return df.orderBy("table_name", F.array_position(F.lit(SEVERITIES), F.col("severity")).desc(), "category", "seq")
    return df.orderBy("seq")


def keyspace_findings(spark: SparkSession, source_dump: int, target_dump: int, source_modules: set[str], target_modules: set[str]) -> DataFrame:
    rows = []
    if target_dump < source_dump:
        rows.append(("BLOCK", None, "rdb-version", f"target dump version {target_dump} is older than {source_dump}"))
    rows += [("BLOCK", None, "missing-module", m) for m in sorted(source_modules - target_modules)]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], FINDINGS)


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def blocked(found: DataFrame) -> bool:
    return not found.where("severity = 'BLOCK'").limit(1).isEmpty()


def render(found: DataFrame) -> str:
    """One line per finding, and a verdict."""
    rows = found.collect()
    lines = [f"{r.severity:5} {r.table_name or '-'} {r.category}: {r.message}" for r in rows]
    n = {s: sum(r.severity == s for r in rows) for s in SEVERITIES}
    return "\n".join([*lines, ", ".join(f"{n[s]} {s}" for s in SEVERITIES), "blocked" if n["BLOCK"] else "ok"])
