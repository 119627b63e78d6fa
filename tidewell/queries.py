"""The engine's operators as queries over the supplied tables, each with its SQL.

Change data is derived from ``events`` (deltas on customers), ``customer``
(a source and a stale target) and fixed metadata rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import globs, scalars, types
from tidewell.operators import changes, chunks, keyvalue, retention
from tidewell.plans import preflight, status
from tidewell.sources.catalog import Column, TableMeta, key_violations

NOW = datetime(2024, 1, 31)
KEY = ["c_custkey"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_CTE = {
    "delta": "delta AS (SELECT event_id AS delta_id, user_id AS c_custkey, CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS rc_op, ts AS rc_at FROM events)",
    "track": "track AS (SELECT 'a' AS target, delta_id FROM delta WHERE delta_id % 3 = 0 UNION ALL SELECT 'b', delta_id FROM delta WHERE delta_id < 4000)",
    "src": "src AS (SELECT * FROM customer WHERE c_custkey % 7 <> 0)",
    "tgt": "tgt AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 11 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment "
    "FROM customer WHERE c_custkey % 5 <> 0)",
    "dirty": "dirty AS (SELECT * FROM delta ANTI JOIN (SELECT delta_id FROM track WHERE target = 'a') USING (delta_id))",
}


def _with(names: str, body: str) -> str:
    """Named derived tables, then a body; one that adds tables of its own starts with a comma."""
    return f"WITH {', '.join(_CTE[n] for n in names.split())} {body}"


def query(sql: str | None = None):
    """Register a query and, where SQL can say it, its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class _Data:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def delta(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("delta_id"), F.col("user_id").alias("c_custkey"),
            F.when(F.col("event_type") == "error", "D").otherwise("U").alias("rc_op"), F.col("ts").cast("timestamp").alias("rc_at"))

    @property
    def track(self) -> DataFrame:
        d = self.delta.select("delta_id")
        at = F.lit(NOW).alias("consumed_at")
        return d.where("delta_id % 3 = 0").select(F.lit("a").alias("target"), "delta_id", at).unionByName(
            d.where("delta_id < 4000").select(F.lit("b").alias("target"), "delta_id", at))

    @property
    def src(self) -> DataFrame:
        return self.table("customer").where("c_custkey % 7 <> 0")

    @property
    def tgt(self) -> DataFrame:
        c = self.table("customer").where("c_custkey % 5 <> 0")
        return c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 11 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))

    def dirty(self, limit: int = 0) -> DataFrame:
        return changes.dirty_keys(self.delta, self.track, "a", limit)


# -- change sets ------------------------------------------------------------------


@query(_with("delta track", "SELECT delta_id, c_custkey, rc_op FROM delta ANTI JOIN (SELECT delta_id FROM track WHERE target = 'a') USING (delta_id)"))
def dirty_keys(spark, d):
    return _Data(spark, d).dirty().select("delta_id", "c_custkey", "rc_op")


@query(_with("delta track dirty", "SELECT delta_id, c_custkey, rc_op FROM dirty ORDER BY delta_id LIMIT 1000"))
def dirty_keys_limited(spark, d):
    return _Data(spark, d).dirty(1000).select("delta_id", "c_custkey", "rc_op")


@query(_with("delta track dirty", "SELECT c_custkey, count(*) AS n_deltas, min(delta_id) AS first_delta, max(delta_id) AS last_delta FROM dirty GROUP BY c_custkey"))
def coalesced_keys(spark, d):
    return changes.coalesced(_Data(spark, d).dirty(), KEY)


@query(_with("delta track src dirty", "SELECT * FROM src SEMI JOIN dirty USING (c_custkey)"))
def reread_rows(spark, d):
    x = _Data(spark, d)
    return changes.reread(x.src, x.dirty(), KEY)


@query(_with("delta track src dirty", "SELECT DISTINCT c_custkey FROM dirty ANTI JOIN src USING (c_custkey)"))
def missing_at_source(spark, d):
    x = _Data(spark, d)
    return changes.missing(x.dirty(), x.src, KEY)


@query(_with("delta track src tgt dirty", """, staged AS (SELECT * FROM src SEMI JOIN dirty USING (c_custkey))
SELECT * FROM tgt ANTI JOIN staged USING (c_custkey) UNION ALL BY NAME SELECT * FROM staged"""))
def apply_upsert(spark, d):
    x = _Data(spark, d)
    return changes.upsert(x.tgt, changes.reread(x.src, x.dirty(), KEY), KEY)


@query(_with("delta track src tgt dirty", """SELECT * FROM tgt WHERE c_custkey NOT IN (
SELECT c_custkey FROM dirty WHERE c_custkey NOT IN (SELECT c_custkey FROM src))"""))
def apply_delete_absent(spark, d):
    x = _Data(spark, d)
    return changes.delete_absent(x.tgt, x.dirty(), changes.reread(x.src, x.dirty(), KEY), KEY)


@query(_with("delta track src tgt dirty", "SELECT * FROM tgt ANTI JOIN dirty USING (c_custkey) UNION ALL BY NAME SELECT * FROM src SEMI JOIN dirty USING (c_custkey)"))
def apply_pass(spark, d):
    x = _Data(spark, d)
    return changes.apply_pass(x.src, x.tgt, x.dirty(), KEY)


@query(_with("delta track dirty", "SELECT target, delta_id FROM track UNION SELECT 'a', delta_id FROM dirty"))
def confirm_track(spark, d):
    x = _Data(spark, d)
    once = changes.confirm(x.track, x.dirty(), "a", NOW)
    return changes.confirm(once, x.dirty(), "a", NOW).select("target", "delta_id")


@query(_with("src tgt", """SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey,
CASE WHEN b.c_custkey IS NULL THEN 'I' WHEN a.c_custkey IS NULL THEN 'D' ELSE 'U' END AS rc_op
FROM tgt b FULL JOIN src a ON a.c_custkey = b.c_custkey
WHERE b.c_custkey IS NULL OR a.c_custkey IS NULL OR (a.c_name, a.c_nationkey, a.c_acctbal, a.c_mktsegment) IS DISTINCT FROM (b.c_name, b.c_nationkey, b.c_acctbal, b.c_mktsegment)"""))
def snapshot_diff_iud(spark, d):
    x = _Data(spark, d)
    return changes.snapshot_diff(x.tgt, x.src, KEY)


@query("""WITH u AS (SELECT event_id AS delta_id, user_id AS old_key, CASE WHEN event_id % 4 = 0 THEN user_id + 1 WHEN event_id % 9 = 0 THEN NULL ELSE user_id END AS new_key FROM events)
SELECT delta_id, 'D' AS rc_op, old_key AS k1 FROM u WHERE old_key IS DISTINCT FROM new_key UNION ALL SELECT delta_id, 'U', new_key FROM u""")
def pk_change_expand(spark, d):
    e = _Data(spark, d).table("events")
    u = e.select(F.col("event_id").alias("delta_id"), F.col("user_id").alias("old_key"),
                 F.when(F.col("event_id") % 4 == 0, F.col("user_id") + 1).when(F.col("event_id") % 9 == 0, None).otherwise(F.col("user_id")).alias("new_key"))
    return changes.pk_change_expand(u, ["old_key"], ["new_key"])


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def transport_projection(spark, d):
    df = _Data(spark, d).table("events")
    t = TableMeta("events", tuple(Column(f.name, f.dataType.simpleString(), generated=f.name == "props") for f in df.schema), ("event_id",))
    return df.select(*t.transport)


# -- chunks -----------------------------------------------------------------------


@query("SELECT o_orderkey, rn FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE rn > 1 AND (rn - 1) % 4000 = 0")
def keyset_boundaries(spark, d):
    return chunks.boundaries(_Data(spark, d).table("orders"), ["o_orderkey"], 4000)


@query("SELECT conv_id, turn, rn FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS rn FROM conversations) WHERE rn > 1 AND (rn - 1) % 100 = 0")
def keyset_boundaries_composite(spark, d):
    return chunks.boundaries(_Data(spark, d).table("conversations"), ["conv_id", "turn"], 100)


@query("SELECT CAST(floor((rn - 1) / 100) AS BIGINT) AS chunk, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY conv_id, turn) AS rn FROM conversations) GROUP BY 1")
def chunk_row_counts(spark, d):
    return chunks.chunk_counts(_Data(spark, d).table("conversations"), ["conv_id", "turn"], 100)


@query("SELECT * FROM conversations WHERE (conv_id > 19 OR (conv_id = 19 AND turn >= 1)) AND (conv_id < 60 OR (conv_id = 60 AND turn < 2))")
def chunk_range_scan(spark, d):
    df = _Data(spark, d).table("conversations")
    return chunks.scan(df, ["conv_id", "turn"], chunks.Chunk((19, 1), (60, 2)))


@query("SELECT * FROM conversations WHERE NOT ((conv_id, turn) >= (40, 3))")
def resume_range_delete(spark, d):
    df = _Data(spark, d).table("conversations")
    return chunks.delete_range(df, ["conv_id", "turn"], chunks.Chunk((40, 3), None))


@query("SELECT * FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark, d):
    return chunks.page_after(_Data(spark, d).table("orders"), ["o_orderkey"], (100,), 50)


# -- references ---------------------------------------------------------------------

EDGES = [
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey"),
]


@query(" UNION ALL ".join(
    f"SELECT '{c}.{cc}' AS edge, count(*) AS n_orphans FROM {c} WHERE {cc} IS NOT NULL AND {cc} NOT IN (SELECT {pc} FROM {p} WHERE {pc} % 7 <> 0)" for c, cc, p, pc in EDGES))
def fk_orphans_all_edges(spark, d):
    x = _Data(spark, d)
    tables = {t: x.table(t) for t in {e[0] for e in EDGES} | {e[2] for e in EDGES}}
    return changes.orphan_counts([(f"{c}.{cc}", tables[c], cc, tables[p].where(F.col(pc) % 7 != 0), pc) for c, cc, p, pc in EDGES])


@query("SELECT * FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def fk_orphan_rows(spark, d):
    x = _Data(spark, d)
    return changes.orphans(x.table("orders"), x.table("customer").where("c_custkey % 7 <> 0"), ["o_custkey"], ["c_custkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS o_custkey, o_orderpriority FROM orders")
def null_then_fill(spark, d):
    """References left out of all rows, then filled in for those whose second pass has come."""
    o = _Data(spark, d).table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return changes.filled(changes.nulled(o, ["o_custkey"]), o.where("o_orderkey % 3 <> 0"), ["o_orderkey"], ["o_custkey"])


# -- retention ----------------------------------------------------------------------

_BACKLOG = """backlog AS (
  SELECT t.target, t.position, count(*) FILTER (WHERE k.delta_id IS NULL) AS rows, count(*) AS total,
    min(d.rc_at) FILTER (WHERE k.delta_id IS NULL) AS oldest
  FROM (VALUES ('a', 0), ('b', 1), ('c', 2)) t(target, position) CROSS JOIN delta d LEFT JOIN track k ON k.delta_id = d.delta_id AND k.target = t.target GROUP BY ALL),
aged AS (SELECT target, position, rows, CAST(floor(1000000 * rows / total) AS BIGINT) AS bytes, rows > 0 AS has_backlog,
  CASE WHEN rows > 0 THEN (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(oldest)) / 1000000.0 ELSE 0.0 END AS oldest_age FROM backlog)"""
TARGETS = ["a", "b", "c"]


def _backlog(spark, d):
    x = _Data(spark, d)
    return retention.backlog(x.delta, x.track, TARGETS, NOW, 1_000_000)


@query(_with("delta track", f", {_BACKLOG} SELECT target, rows, bytes, has_backlog, CAST(oldest_age AS DOUBLE) AS oldest_age FROM aged"))
def backlog_by_target(spark, d):
    return _backlog(spark, d).select("target", "rows", "bytes", "has_backlog", "oldest_age")


@query(_with("delta track", f", {_BACKLOG} SELECT target FROM aged WHERE has_backlog AND oldest_age > 2500000"))
def over_cap_age(spark, d):
    return retention.over_cap(_backlog(spark, d), max_age=2_500_000)


@query(_with("delta track", f", {_BACKLOG} SELECT target FROM aged WHERE has_backlog ORDER BY oldest_age DESC, position LIMIT 1"))
def laggard_by_age(spark, d):
    return retention.laggard(_backlog(spark, d)).select("target")


@query(_with("delta track", "SELECT delta_id FROM track WHERE target IN ('a', 'b') GROUP BY delta_id HAVING count(DISTINCT target) = 2"))
def purgeable(spark, d):
    x = _Data(spark, d)
    return retention.consumed_by_all(x.delta, x.track, ["a", "b"])


@query(_with("delta track", "SELECT target, delta_id FROM track WHERE target <> 'a' AND delta_id NOT IN (SELECT delta_id FROM track WHERE target = 'b')"
             " UNION ALL SELECT 'delta', delta_id FROM delta WHERE delta_id NOT IN (SELECT delta_id FROM track WHERE target = 'b')"))
def purge_after_sacrifice(spark, d):
    x = _Data(spark, d)
    delta, track = retention.purge(x.delta, x.track, ["a", "b"], ["a"])
    return track.select("target", "delta_id").unionByName(delta.select(F.lit("delta").alias("target"), "delta_id"))


@query(_with("delta track", f""", {_BACKLOG}, p AS (SELECT target, least(1.0, greatest(CAST(oldest_age AS DOUBLE) / 3000000, CAST(bytes AS DOUBLE) / 2000000, 0.0)) AS proximity FROM aged)
SELECT target, proximity, CASE WHEN proximity < 0.5 THEN 'INFO' WHEN proximity < 0.9 THEN 'WARN' ELSE 'ERROR' END AS level FROM p"""))
def retention_proximity_levels(spark, d):
    return retention.proximity(_backlog(spark, d), max_age=3_000_000, max_bytes=2_000_000)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL")
def unusable_key_check(spark, d):
    return key_violations(_Data(spark, d).table("lineitem"), ["l_orderkey", "l_linenumber"])


# -- metadata ---------------------------------------------------------------------------

# Type pairs that the rules are exercised with.
PG_TYPES = [
    "smallint", "integer", "bigint", "numeric", "numeric(10,2)", "numeric(12,4)", "numeric(20,0)", "real", "double precision", "text", "character varying",
    "character varying(30)", "character varying(50)", "character(5)", "character", "boolean", "uuid", "date", "timestamp without time zone",
    "timestamp(3) without time zone", "timestamp with time zone", "time without time zone", "time with time zone", "json", "jsonb", "bytea", "interval", "hstore", "citext",
]
MY_TYPES = [
    "tinyint", "int", "int unsigned", "int(10) unsigned", "bigint", "decimal", "decimal(10,2)", "decimal(12,4)", "float", "double", "bit(1)", "char(3)", "varchar(50)",
    "varchar(100)", "tinytext", "text", "longtext", "binary(8)", "varbinary(16)", "blob", "longblob", "date", "time", "datetime", "datetime(6)", "timestamp", "year",
    "enum('a','b')", "enum('a')", "set('x')", "json", "point",
]


def _values(rows: list[tuple]) -> str:
    q = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + ")"


def _pairs(spark: SparkSession, names: list[str]) -> DataFrame:
    """All ordered pairs of a fixed list of type names."""
    return spark.createDataFrame([(a, b) for a in names for b in names], "source string, target string")


# Families and sizes once more, as patterns, for the SQL alone.
_PG_FAMILY = """CASE WHEN regexp_full_match({x}, 'smallint|integer|int|bigint|int[248]') THEN 'integer' WHEN {x} IN ('numeric', 'decimal') THEN 'numeric'
 WHEN regexp_full_match({x}, 'real|double precision|float[48]') THEN 'float' WHEN regexp_full_match({x}, 'text|(var|bp)?char|character( varying)?') THEN 'text'
 WHEN starts_with({x}, 'timestamp') THEN CASE WHEN regexp_matches({x}, 'with time zone|tz$') THEN 'timestamptz' ELSE 'timestamp' END
 WHEN regexp_full_match({x}, 'time(tz| with(out)? time zone)?') THEN CASE WHEN regexp_matches({x}, 'with time zone|tz$') THEN 'timetz' ELSE 'time' END
 WHEN {x} IN ('boolean', 'uuid', 'date', 'json', 'jsonb', 'bytea', 'interval') THEN {x} END"""
_PG_BITS = "CASE WHEN {x} IN ('smallint', 'int2') THEN 2 WHEN {x} IN ('integer', 'int', 'int4', 'real', 'float4') THEN 4 ELSE 8 END"
_MY_FAMILY = """CASE WHEN regexp_full_match({x}, '(tiny|small|medium|big)?int|integer') THEN 'int' WHEN {x} IN ('decimal', 'numeric', 'dec', 'fixed') THEN 'decimal'
 WHEN {x} IN ('float', 'double', 'real') THEN 'float' WHEN regexp_full_match({x}, '(var)?char') THEN 'char' WHEN regexp_full_match({x}, '(var)?binary') THEN 'binary'
 WHEN regexp_full_match({x}, '(tiny|medium|long)?(text|blob)') THEN {x}[-4:] WHEN {x} IN ('bit', 'date', 'time', 'datetime', 'timestamp', 'year', 'enum', 'set', 'json') THEN {x} END"""
_MY_SIZE = "CASE WHEN starts_with({x}, 'tiny') THEN 1 WHEN starts_with({x}, 'small') THEN 2 WHEN starts_with({x}, 'medium') THEN 3 WHEN starts_with({x}, 'big') OR starts_with({x}, 'long') THEN 5 WHEN starts_with({x}, 'int') THEN 4 ELSE 2 END"


_M = r"\(\s*([0-9]+(?:\s*,\s*[0-9]+)*)\s*\)"


def _pg_side(x: str, p: str) -> str:
    mods = f"regexp_extract(lower({x}), '{_M}', 1)"
    return f"""trim(regexp_replace(regexp_replace(lower({x}), '{_M}', ''), '\\s+', ' ', 'g')) AS {p}base, {mods} <> '' AS {p}has,
TRY_CAST(nullif(split_part({mods}, ',', 1), '') AS INT) AS {p}0, TRY_CAST(nullif(trim(split_part({mods}, ',', 2)), '') AS INT) AS {p}1"""


def _pg_limit(p: str) -> str:
    return f"CASE WHEN {p}base IN ('character', 'char', 'bpchar') THEN coalesce({p}0, 1) WHEN {p}base IN ('character varying', 'varchar') THEN coalesce({p}0, -1) ELSE -1 END"


@query(f"""WITH x AS (SELECT a.t AS source, b.t AS target, {_pg_side('a.t', 's')}, {_pg_side('b.t', 't')}
  FROM {_values([(t,) for t in PG_TYPES])} a(t) CROSS JOIN {_values([(t,) for t in PG_TYPES])} b(t)),
y AS (SELECT *, coalesce({_PG_FAMILY.format(x='sbase')}, 'other') AS sf, coalesce({_PG_FAMILY.format(x='tbase')}, 'other') AS tf,
  {_PG_BITS.format(x='sbase')} AS sw, {_PG_BITS.format(x='tbase')} AS tw, {_pg_limit('s')} AS sl, {_pg_limit('t')} AS tl FROM x)
SELECT source, target, CASE
 WHEN source = target THEN 'identical'
 WHEN tf = 'text' THEN CASE WHEN tl < 0 OR (sf = 'text' AND sl >= 0 AND sl <= tl) THEN 'widening' ELSE 'risky' END
 WHEN sf = tf THEN CASE
  WHEN sf IN ('integer', 'float') THEN CASE WHEN tw >= sw THEN 'widening' ELSE 'risky' END
  WHEN sf = 'numeric' THEN CASE WHEN NOT thas OR (shas AND t0 >= s0 AND coalesce(t1, 0) >= coalesce(s1, 0)) THEN 'widening' ELSE 'risky' END
  WHEN sf IN ('timestamp', 'timestamptz', 'time', 'timetz') THEN CASE WHEN coalesce(t0, 6) >= coalesce(s0, 6) THEN 'widening' ELSE 'risky' END
  WHEN sf = 'other' THEN 'risky' ELSE 'widening' END
 WHEN sf = 'integer' AND tf = 'numeric' THEN CASE WHEN NOT thas OR (coalesce(t1, 0) = 0 AND t0 >= 19) THEN 'widening' ELSE 'risky' END
 WHEN sf || '>' || tf IN ('date>timestamp', 'json>jsonb', 'jsonb>json') THEN 'widening'
 WHEN (sf IN ('integer', 'numeric') AND tf = 'float') OR (sf IN ('numeric', 'float') AND tf IN ('integer', 'numeric')) THEN 'risky'
 WHEN sf IN ('date', 'timestamp', 'timestamptz') AND tf IN ('date', 'timestamp', 'timestamptz') THEN 'risky'
 WHEN sf IN ('time', 'timetz') AND tf IN ('time', 'timetz') THEN 'risky'
 WHEN sf = 'other' OR tf = 'other' THEN 'risky' ELSE 'incompatible' END AS level FROM y""")
def pg_type_rules(spark, d):
    return _pairs(spark, PG_TYPES).withColumn("level", types.pg_level(F.col("source"), F.col("target")))


def _my_side(x: str, p: str) -> str:
    inner = f"regexp_extract({x}, '^[^ (]*\\(([^)]*)', 1)"
    return f"""regexp_extract({x}, '^([^ (]*)', 1) AS {p}base, contains({x}, 'unsigned') AS {p}u,
TRY_CAST(nullif(split_part({inner}, ',', 1), '') AS INT) AS {p}0, TRY_CAST(nullif(split_part({inner}, ',', 2), '') AS INT) AS {p}1"""


@query(f"""WITH x AS (SELECT a.t AS source, b.t AS target, {_my_side('a.t', 's')}, {_my_side('b.t', 't')}
  FROM {_values([(t,) for t in MY_TYPES])} a(t) CROSS JOIN {_values([(t,) for t in MY_TYPES])} b(t)),
y AS (SELECT *, coalesce({_MY_FAMILY.format(x='sbase')}, 'geometry-or-other') AS sf, coalesce({_MY_FAMILY.format(x='tbase')}, 'geometry-or-other') AS tf,
  {_MY_SIZE.format(x='sbase')} AS sr, {_MY_SIZE.format(x='tbase')} AS tr FROM x)
SELECT source, target, CASE
 WHEN source = target THEN 'identical'
 WHEN sf = tf THEN CASE
  WHEN sf = 'int' THEN CASE WHEN su = tu AND tr >= sr THEN 'widening' ELSE 'risky' END
  WHEN sf = 'decimal' THEN CASE WHEN coalesce(t0, 10) >= coalesce(s0, 10) AND coalesce(t1, 0) >= coalesce(s1, 0) THEN 'widening' ELSE 'risky' END
  WHEN sf = 'float' THEN CASE WHEN sbase = 'float' AND tbase IN ('double', 'real') THEN 'widening' WHEN sbase = tbase THEN 'identical' ELSE 'risky' END
  WHEN sf IN ('char', 'binary', 'datetime', 'timestamp', 'time') THEN CASE WHEN coalesce(t0, 0) >= coalesce(s0, 0) THEN 'widening' ELSE 'risky' END
  WHEN sf IN ('text', 'blob') THEN CASE WHEN tr >= sr THEN 'widening' ELSE 'risky' END
  WHEN sf IN ('enum', 'set') THEN 'risky' ELSE 'identical' END
 WHEN sf IN ('int', 'decimal', 'float', 'bit') AND tf IN ('int', 'decimal', 'float', 'bit') THEN 'risky'
 WHEN (sf IN ('char', 'text') AND tf IN ('char', 'text')) OR (sf IN ('binary', 'blob') AND tf IN ('binary', 'blob')) THEN 'widening'
 WHEN sf IN ('date', 'time', 'datetime', 'timestamp', 'year') AND tf IN ('date', 'time', 'datetime', 'timestamp', 'year') THEN 'risky'
 WHEN (sf IN ('enum', 'set') AND tf IN ('char', 'text')) OR (sf IN ('char', 'text') AND tf IN ('enum', 'set')) THEN 'risky'
 WHEN sf IN ('json', 'geometry-or-other', 'enum', 'set') OR tf IN ('json', 'geometry-or-other', 'enum', 'set') THEN 'incompatible'
 WHEN tf IN ('char', 'text') THEN 'risky' ELSE 'incompatible' END AS level FROM y""")
def mysql_type_rules(spark, d):
    return _pairs(spark, MY_TYPES).withColumn("level", types.my_level(F.col("source"), F.col("target")))


@query("""WITH c AS (SELECT 't' || (o_orderkey % 50) AS table_name, 'c' || o_orderkey AS column_name,
  CASE WHEN o_orderkey % 7 <> 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'bigint' ELSE 'text' END END AS source_type,
  CASE WHEN o_orderkey % 5 <> 0 THEN CASE o_custkey % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'bigint' ELSE 'text' END END AS target_type FROM orders)
SELECT *, CASE WHEN target_type IS NULL THEN 'missing' WHEN source_type IS NULL THEN 'extra' ELSE 'matched' END AS status,
 CASE WHEN source_type = target_type THEN 'identical' WHEN source_type = 'text' AND target_type IS NOT NULL THEN 'incompatible' WHEN source_type = 'bigint' AND target_type = 'integer' THEN 'risky'
  WHEN source_type IS NOT NULL AND target_type IS NOT NULL THEN 'widening' END AS level,
 CASE WHEN source_type = target_type THEN '' WHEN source_type = 'text' AND target_type IS NOT NULL THEN 'text to ' || target_type || ': text values are no integer values'
  WHEN source_type = 'bigint' AND target_type = 'integer' THEN 'bigint to integer may lose range or fraction'
  WHEN source_type IS NOT NULL AND target_type IS NOT NULL THEN source_type || ' to ' || target_type || ': every value fits' END AS reason
FROM c WHERE source_type IS NOT NULL OR target_type IS NOT NULL""")
def schema_compare_columns(spark, d):
    k, kinds = F.col("o_orderkey"), F.array(*[F.lit(x) for x in ("integer", "bigint", "text")])
    o = _Data(spark, d).table("orders")

    def side(has, by) -> DataFrame:
        none = F.lit(None).cast("string")
        return o.where(has).select(
            F.concat(F.lit("t"), (k % 50).cast("string")).alias("table_name"), F.concat(F.lit("c"), k.cast("string")).alias("column_name"),
            F.element_at(kinds, (by % 3 + 1).cast("int")).alias("data_type"), F.lit(True).alias("nullable"), F.lit(False).alias("generated"),
            F.lit(False).alias("identity"), none.alias("charset"))

    out = preflight.compare_columns(side(k % 7 != 0, k), side(k % 5 != 0, F.col("o_custkey")))
    return out.select("table_name", "column_name", "source_type", "target_type", "status", "level", "reason")


@query("""WITH n AS (SELECT DISTINCT event_type || '.' || user_id || CASE WHEN event_id % 3 = 0 THEN '_audit' WHEN event_id % 3 = 1 THEN '' ELSE '.Old' END AS name FROM events)
SELECT name FROM n WHERE (name GLOB 'c*.1?' OR name GLOB '*.?2*') AND NOT name GLOB '*_audit'""")
def glob_select_tables(spark, d):
    e = _Data(spark, d).table("events")
    i = F.col("event_id") % 3
    end = F.when(i == 0, "_audit").when(i == 1, "").otherwise(".Old")
    names = e.select(F.concat("event_type", F.lit("."), F.col("user_id").cast("string"), end).alias("name")).distinct()
    return names.where(globs.selected(F.col("name"), ["c*.1?", "*.?2*"], ["*_audit"]))


_KV = """kv AS (SELECT event_type || ':' || user_id || ':' || event_id AS key, event_type AS type, props AS value,
  CASE WHEN event_id % 5 = 0 THEN -2 WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 0 ELSE event_id * 10 END AS ttl_ms, strlen(props) AS size FROM events)"""


def _kv(spark, d) -> DataFrame:
    e = _Data(spark, d).table("events")
    i = F.col("event_id")
    return e.select(
        F.concat_ws(":", "event_type", F.col("user_id").cast("string"), i.cast("string")).alias("key"), F.col("event_type").alias("type"), F.col("props").alias("value"),
        F.when(i % 5 == 0, -2).when(i % 3 == 0, None).when(i % 7 == 0, 0).otherwise(i * 10).cast("bigint").alias("ttl_ms"),
        F.octet_length("props").cast("bigint").alias("size"))


@query(f"WITH {_KV} SELECT key FROM kv WHERE regexp_full_match(key, '[c-p].*:[0-9].*:.*[^0-4]') AND NOT regexp_full_match(key, '.*:.*7')")
def redis_glob_keys(spark, d):
    return _kv(spark, d).where(globs.selected(F.col("key"), ["[p-c]*:[0-9]*:*[^0-4]"], ["*:*7"], keys=True)).select("key")


@query(f"WITH {_KV} SELECT key, CAST(CASE WHEN ttl_ms IS NULL THEN 0 WHEN ttl_ms < 1 THEN 1 ELSE ttl_ms END AS BIGINT) AS restore_ttl_ms FROM kv WHERE ttl_ms IS NULL OR ttl_ms <> -2")
def kv_live_keys_ttl(spark, d):
    return keyvalue.live(_kv(spark, d)).select("key", "restore_ttl_ms")


@query("""SELECT event_id, CASE WHEN event_id % 1500 >= 1000 THEN 'refuse' WHEN event_id % 1500 >= 12 THEN 'warn' ELSE 'ok' END AS size_level FROM events""")
def kv_size_guard_levels(spark, d):
    e = _Data(spark, d).table("events").withColumn("size", F.col("event_id") % 1500)
    return e.select("event_id", keyvalue.size_level(12, 1000).alias("size_level"))


@query(f"""WITH {_KV} SELECT key, 'string' AS type FROM kv WHERE size < 1000 AND (ttl_ms IS NULL OR ttl_ms <> -2) AND type IN ('click', 'view')""")
def kv_type_filtered(spark, d):
    """Keys of some kinds, none of them too large to carry."""
    kv = keyvalue.size_guard(_kv(spark, d), 12, 1000).where("size_level <> 'refuse'")
    kind = F.when(F.col("type").isin("click", "view"), "string").otherwise("stream")
    return keyvalue.live(kv.withColumn("type", kind), types=["string"]).select("key", "type")


@query(f"""WITH {_KV}, live AS (SELECT key, value FROM kv WHERE ttl_ms IS NULL OR ttl_ms <> -2), old AS (SELECT key, 'old' AS value FROM kv WHERE size % 2 = 0 UNION ALL SELECT 'own:' || n, 'own' FROM range(9) t(n))
SELECT key, value FROM live UNION ALL SELECT key, value FROM old WHERE key NOT IN (SELECT key FROM live)""")
def kv_restore_replace(spark, d):
    """Live source keys written over what the target has under them."""
    kv = _kv(spark, d)
    old = kv.where("size % 2 = 0").select("key", F.lit("old").alias("value")).unionByName(spark.range(9).select(F.concat(F.lit("own:"), F.col("id").cast("string")).alias("key"), F.lit("own").alias("value")))
    return changes.upsert(old, keyvalue.live(kv).select("key", "value"), ["key"])


@query(_with("src tgt", "SELECT c_custkey FROM tgt ANTI JOIN src USING (c_custkey)"))
def delete_sweep(spark, d):
    x = _Data(spark, d)
    return keyvalue.sweep(x.tgt, x.src, KEY)


# -- reports and functions -------------------------------------------------------------------


@query("""WITH p AS (SELECT 'table' || (o_orderkey % 40) AS table_name, min(CAST(o_orderkey % 40 < 30 AS INT)) = 1 AS copy_done FROM orders WHERE o_orderkey % 40 < 35 GROUP BY 1),
c AS (SELECT 'table' || k AS table_name, string_agg(target || '/' || last || '/' || CAST(k % 3 = 0 AS VARCHAR) || '/' || CAST(k * 60 AS VARCHAR), ',' ORDER BY target) AS targets
  FROM (SELECT o_orderkey % 40 AS k, CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS target, max(o_orderkey) AS last FROM orders GROUP BY ALL) WHERE k >= 5 GROUP BY k)
SELECT table_name, coalesce(copy_done, false) AS copy_done, coalesce(targets, '') AS targets FROM p FULL JOIN c USING (table_name)""")
def status_report(spark, d):
    o = _Data(spark, d).table("orders").select(
        (F.col("o_orderkey") % 40).alias("k"), F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("b").alias("target"), F.col("o_orderkey").alias("delta_id"))
    o = o.withColumn("table_name", F.concat(F.lit("table"), F.col("k").cast("string")))
    progress = o.where("k < 35").select("table_name", (F.col("k") < 30).alias("done"))
    cursors = o.where("k >= 5").select("table_name", "target", F.lit("streaming").alias("phase"), (F.col("k") % 3 == 0).alias("needs_reseed"),
                                       F.timestamp_micros(F.unix_micros(F.lit(NOW)) - F.col("k") * 60_000_000).alias("updated_at")).distinct()
    r = status.report(progress, cursors, o.select("table_name", "target", "delta_id"), NOW)
    line = F.transform("targets", lambda t: F.concat_ws("/", t["target"], t["last_delta"].cast("string"), t["needs_reseed"].cast("string"), t["cursor_age"].cast("bigint").cast("string")))
    return r.select("table_name", "copy_done", F.array_join(line, ",").alias("targets"))


@query("SELECT event_id AS id, event_type AS event, ts AS created_at FROM events ORDER BY event_id DESC LIMIT 20")
def recent_events_topn(spark, d):
    e = _Data(spark, d).table("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("event"), F.col("ts").alias("created_at"))
    return status.recent_events(e)


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'INFO' WHEN o_orderkey % 3 = 1 THEN 'WARN' ELSE 'BLOCK' END AS severity, count(*) AS n FROM orders GROUP BY 1")
def severity_counts(spark, d):
    o = F.col("o_orderkey") % 3
    return preflight.severity_counts(_Data(spark, d).table("orders").select(F.when(o == 0, "INFO").when(o == 1, "WARN").otherwise("BLOCK").alias("severity")))


@query(r"""SELECT doc_id, concat_ws(chr(9), CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 10 = 0 THEN '\N' ELSE
replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') END, lang) AS line FROM documents""")
def tsv_encode(spark, d):
    t = _Data(spark, d).table("documents").withColumn("text", F.when(F.col("doc_id") % 10 == 0, None).otherwise(F.col("text")))
    return t.select("doc_id", scalars.tsv_line("doc_id", "text", "lang").alias("line"))


@query("SELECT doc_id, text, lang FROM documents")
def tsv_round_trip(spark, d):
    t = _Data(spark, d).table("documents").select("doc_id", scalars.tsv_line("text", "lang").alias("line"))
    return t.select("doc_id", *scalars.tsv_parse(F.col("line"), ["text", "lang"]))


_UNITS = [("B", 1), ("kb", 10**3), ("KiB", 2**10), (" MB", 10**6), ("mib", 2**20), ("GB", 10**9), (" GiB", 2**30), ("", 1), ("xb", None), ("e3", None)]


@query("""WITH u(i, unit, bytes) AS (VALUES (0, 'B', 1), (1, 'kb', 1000), (2, 'KiB', 1024), (3, ' MB', 1000000), (4, 'mib', 1048576), (5, 'GB', 1000000000), (6, ' GiB', 1073741824), (7, '', 1), (8, 'xb', NULL), (9, 'e3', NULL))
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND i BETWEEN 1 AND 6 THEN CAST(floor((o_orderkey + 0.5) * bytes) AS BIGINT) WHEN o_orderkey % 4 = 0 AND i = 7 THEN NULL WHEN o_orderkey % 4 = 0 AND i = 0 THEN o_orderkey
 WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderkey * bytes END AS bytes FROM orders JOIN u ON o_orderkey % 10 = i""")
def byte_size_parse(spark, d):
    """Sizes made of a number, whole, with a fraction or below zero, and a unit, known or not."""
    k = F.col("o_orderkey")
    number = F.concat(F.when(k % 4 == 1, "-").otherwise(""), k.cast("string"), F.when(k % 4 == 0, ".5").otherwise(""))
    unit = F.element_at(F.array(*[F.lit(u) for u, _ in _UNITS]), (k % 10 + 1).cast("int"))
    return _Data(spark, d).table("orders").select("o_orderkey", scalars.byte_size_column(F.concat(number, unit)).alias("bytes"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE (o_orderkey % 12) * 10000 + CASE WHEN o_orderkey % 5 <> 3 THEN (o_custkey % 100) * 100 ELSE 0 END
 + CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey % 77 ELSE 0 END END AS number FROM orders""")
def version_number(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    major, minor, patch = (k % 12).cast("string"), (c % 100).cast("string"), (k % 77).cast("string")
    dot = lambda *x: F.concat_ws(".", *x)
    banner = (F.when(k % 5 == 0, F.concat(dot(major, minor, patch), F.lit("-log"))).when(k % 5 == 1, F.concat(dot(major, minor, patch), F.lit(" (build 7.7)")))
              .when(k % 5 == 2, dot(major, minor)).when(k % 5 == 3, major).otherwise(F.concat(F.lit("v"), major)))
    return _Data(spark, d).table("orders").select("o_orderkey", scalars.version_number(banner).cast("bigint").alias("number"))


# -- graphs ----------------------------------------------------------------------------------


def supplied_tables() -> list[TableMeta]:
    """The supplied tables with their references; lineitem has no usable key."""
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
            "documents": "doc_id", "labels": "doc_id", "events": "event_id", "pages": "page_id", "benchmark": "item_id", "embeddings": "vec_id"}
    cols = lambda t: {keys[t]} | {cc for c, cc, _, _ in EDGES if c == t} if t in keys else {cc for c, cc, _, _ in EDGES if c == t}
    fks = lambda t: tuple(ForeignKey(f"{c}_{cc}", c, (cc,), p, (pc,)) for c, cc, p, pc in EDGES if c == t)
    return [TableMeta(t, tuple(Column(c, "bigint") for c in sorted(cols(t))), (keys[t],) if t in keys else (), (), fks(t)) for t in [*keys, "lineitem"]]


from tidewell import queries_sync  # noqa: E402,F401  (registers the queries about syncs and metadata)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
