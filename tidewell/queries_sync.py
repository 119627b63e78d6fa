"""Queries about metadata, graphs, functions of people and configuration, and whole syncs.

Where SQL cannot derive an answer (wording, exit codes), it states the answer,
written by hand from the rule.
"""

from __future__ import annotations

import contextlib
import io
import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import scalars, types
from tidewell.operators import chunks, keyvalue
from tidewell.plans import graph, preflight, status
from tidewell.plans.config import load
from tidewell.plans.engine import OrphansLeft, Syncer
from tidewell.plans.migrations import migrate
from tidewell.plans.registry import connect
from tidewell.queries import EDGES, KEY, NOW, _Data, _kv, _values, _with, query
from tidewell.sources import keyspace
from tidewell.sources.catalog import Column, ForeignKey, TableMeta, candidates, introspect, key_columns
from tidewell.sources.store import Locked, Store


def _root(spark: SparkSession, what: str) -> str:
    base = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    return f"{base}/{what}-{uuid.uuid4().hex}"


def _sync(spark: SparkSession, tables: dict[str, tuple[DataFrame, dict]], targets: tuple[str, ...] = ("a",), **tuning) -> Syncer:
    """A sync of its own in the shared folder, gone when the driver ends."""
    root = _root(spark, "sync")
    source = Store(spark, f"{root}/source")
    source.commit({n: df for n, (df, _) in tables.items()})
    source.drop_at_exit(root)
    metas = [introspect(n, df, **how) for n, (df, how) in tables.items()]
    tuning = {"chunk_rows": 1_000_000, "drain_batch": 1_000_000, "sleep": lambda s: None, "clock": lambda: NOW, **tuning}
    return Syncer(spark, "demo", source, Store(spark, f"{root}/state"), {t: Store(spark, f"{root}/{t}") for t in targets}, metas, **tuning)


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# -- graphs -------------------------------------------------------------------------


def supplied_tables() -> list[TableMeta]:
    """The supplied tables with their references; lineitem has no usable key."""
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
            "documents": "doc_id", "labels": "doc_id", "events": "event_id", "pages": "page_id", "benchmark": "item_id", "embeddings": "vec_id"}
    cols = lambda t: {keys[t]} | {cc for c, cc, _, _ in EDGES if c == t} if t in keys else {cc for c, cc, _, _ in EDGES if c == t}
    fks = lambda t: tuple(ForeignKey(f"{c}_{cc}", c, (cc,), p, (pc,)) for c, cc, p, pc in EDGES if c == t)
    return [TableMeta(t, tuple(Column(c, "bigint") for c in sorted(cols(t))), (keys[t],) if t in keys else (), (), fks(t)) for t in [*keys, "lineitem"]]


# A schema with everything that makes loading hard: (child, parent, nullable, deferrable).
_HARD = [("emp", "emp", True, False), ("team", "team", False, True), ("a", "b", False, False), ("b", "a", True, False), ("c", "a", False, False), ("d", "c", False, False),
         ("x", "y", False, False), ("z", "y", False, False), ("y", "outside", False, False), ("w", "elsewhere", True, False)]
_HARD_NAMES = ["a", "b", "c", "d", "emp", "loner", "team", "w", "x", "y", "z"]


def hard_tables() -> list[TableMeta]:
    """Self-references, a cycle with what hangs on it, references to tables that are not selected."""
    out = []
    for n in _HARD_NAMES:
        mine = [e for e in _HARD if e[0] == n]
        cols = (Column("id", "bigint", False), *[Column(f"to_{p}", "bigint", null) for _, p, null, _ in mine])
        out.append(TableMeta(n, cols, ("id",), (), tuple(ForeignKey(f"{n}_{p}", n, (f"to_{p}",), p, ("id",), later) for _, p, _, later in mine)))
    return out


_SUPPLIED = f"""nodes(n) AS (VALUES ('benchmark'), ('customer'), ('documents'), ('embeddings'), ('events'), ('labels'), ('lineitem'), ('nation'), ('orders'), ('pages'), ('part'), ('region'), ('supplier')),
edges(child, parent) AS (SELECT DISTINCT child, parent FROM {_values([(c, p) for c, _, p, _ in EDGES])} t(child, parent))"""
_HARD_SQL = """nodes(n) AS (VALUES ('a'), ('b'), ('c'), ('d'), ('emp'), ('loner'), ('team'), ('w'), ('x'), ('y'), ('z')),
raw(child, parent, nullable, later) AS (VALUES ('emp', 'emp', true, false), ('team', 'team', false, true), ('a', 'b', false, false), ('b', 'a', true, false), ('c', 'a', false, false),
 ('d', 'c', false, false), ('x', 'y', false, false), ('z', 'y', false, false), ('y', 'outside', false, false), ('w', 'elsewhere', true, false)),
edges AS (SELECT child, parent FROM raw WHERE parent IN (SELECT n FROM nodes))"""
_LINKED = """linked(n, m) AS (SELECT n, n FROM nodes UNION SELECT l.n, CASE WHEN e.child = l.m THEN e.parent ELSE e.child END FROM linked l JOIN edges e ON l.m IN (e.child, e.parent)),
part AS (SELECT n AS table_name, min(m) AS component FROM linked GROUP BY n)"""
_UP = "up(n, m) AS (SELECT child, parent FROM edges UNION SELECT u.n, e.parent FROM up u JOIN edges e ON e.child = u.m)"


def _components(spark: SparkSession, tables: list[TableMeta]) -> DataFrame:
    rows = [(c.tables[0], t, t in c.cyclic) for c in graph.components(tables) for t in c.tables]
    return _rows(spark, rows, "component string, table_name string, cyclic boolean")


# cyclic: on a cycle, or a descendant of one
_COMPONENTS = "SELECT component, table_name, table_name IN (SELECT u.n FROM up u WHERE u.m IN (SELECT n FROM up WHERE n = m)) AS cyclic FROM part"


@query(f"WITH RECURSIVE {_SUPPLIED}, {_LINKED}, {_UP} {_COMPONENTS}")
def fk_components(spark, d):
    return _components(spark, supplied_tables())


@query(f"WITH RECURSIVE {_HARD_SQL}, {_LINKED}, {_UP} {_COMPONENTS}")
def fk_components_hard(spark, d):
    return _components(spark, hard_tables())


# one table at a time: the first by name whose parents have all gone before
_ORDER = """k(done) AS (SELECT CAST([] AS VARCHAR[]) UNION ALL
 SELECT list_append(done, (SELECT min(n) FROM nodes WHERE NOT list_contains(done, n) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.child = n AND NOT list_contains(done, e.parent))))
 FROM k WHERE EXISTS (SELECT 1 FROM nodes WHERE NOT list_contains(done, n) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.child = n AND NOT list_contains(done, e.parent)))),
o AS (SELECT unnest(done) AS n, generate_subscripts(done, 1) AS i FROM (SELECT done FROM k ORDER BY len(done) DESC LIMIT 1)),
every AS (SELECT n, i FROM o UNION ALL SELECT n, 1000 + row_number() OVER (ORDER BY n) FROM nodes WHERE n NOT IN (SELECT n FROM o))
SELECT p.component, CAST(row_number() OVER (PARTITION BY p.component ORDER BY e.i) - 1 AS INT) AS position, p.table_name FROM part p JOIN every e ON e.n = p.table_name"""


def _order(spark: SparkSession, tables: list[TableMeta]) -> DataFrame:
    rows = [(c.tables[0], i, t) for c in graph.components(tables) for i, t in enumerate(c.order)]
    return _rows(spark, rows, "component string, position int, table_name string")


@query(f"WITH RECURSIVE {_SUPPLIED}, {_LINKED}, {_ORDER}")
def topological_order(spark, d):
    return _order(spark, supplied_tables())


@query(f"WITH RECURSIVE {_HARD_SQL}, {_LINKED}, {_ORDER}")
def topological_order_hard(spark, d):
    return _order(spark, hard_tables())


@query(f"WITH RECURSIVE {_SUPPLIED}, {_UP} SELECT n AS table_name, m AS reached FROM up")
def fk_reachability(spark, d):
    t = supplied_tables()
    return _rows(spark, [(x.name, r) for x in t for r in sorted(graph.reachable(t, x.name))], "table_name string, reached string")


@query(f"""WITH RECURSIVE {_HARD_SQL}, {_UP} SELECT child, parent, CASE WHEN later THEN 'deferred' WHEN nullable THEN 'null-then-fill' ELSE 'blocked' END AS strategy
FROM raw WHERE child = parent OR EXISTS (SELECT 1 FROM up WHERE n = raw.parent AND m = raw.child)""")
def cyclic_edges(spark, d):
    return _rows(spark, [(e.key.child, e.key.parent, e.strategy) for e in graph.cyclic_edges(hard_tables())], "child string, parent string, strategy string")


@query(f"WITH {_HARD_SQL} SELECT child, parent FROM raw WHERE parent NOT IN (SELECT n FROM nodes)")
def dangling_edges(spark, d):
    return _rows(spark, [(f.child, f.parent) for f in graph.dangling(hard_tables())], "child string, parent string")


@query(f"""WITH RECURSIVE {_SUPPLIED}, {_LINKED}, s AS (SELECT component, count(*) AS n_tables, (SELECT count(*) FROM nodes) AS total FROM part GROUP BY component)
SELECT component, n_tables FROM s WHERE total >= 5 AND n_tables >= 0.6 * total""")
def giant_component(spark, d):
    big = graph.giant(graph.components(supplied_tables()))
    return _rows(spark, [(big.tables[0], len(big.tables))] if big else [], "component string, n_tables bigint")


@query("SELECT * FROM (VALUES ('b', 'to_a'), ('emp', 'to_emp')) t(table_name, columns)")
def fill_columns(spark, d):
    """Columns that a cyclic load fills in afterwards."""
    return _rows(spark, [(t, ",".join(c)) for t, c in sorted(graph.fill_columns(hard_tables()).items())], "table_name string, columns string")


@query("""SELECT * FROM (VALUES ('region', 'r_regionkey'), ('nation', 'n_nationkey'), ('customer', 'c_custkey'), ('supplier', 's_suppkey'), ('part', 'p_partkey'), ('orders', 'o_orderkey'),
 ('documents', 'doc_id'), ('labels', 'doc_id'), ('events', 'event_id'), ('pages', 'page_id'), ('benchmark', 'item_id'), ('embeddings', 'vec_id'), ('conversations', 'conv_id,turn')) t(table_name, key)""")
def key_columns_by_table(spark, d):
    talk = TableMeta("conversations", (Column("turn", "bigint"), Column("conv_id", "bigint")), (), (("conv_id", "turn"), ("turn",)))
    return key_columns(spark, [*supplied_tables(), talk]).select("table_name", F.array_join("key", ",").alias("key"))


# -- catalogs and pre-flight ----------------------------------------------------------


@query("""SELECT 'public' AS namespace, 't' || c_custkey AS name FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 10 <> 0""")
def catalog_candidates(spark, d):
    """A listing with system namespaces, temporary ones and partitions among the tables of users."""
    k = F.col("c_custkey")
    space = F.when(k % 4 == 0, "public").when(k % 4 == 1, "information_schema").when(k % 4 == 2, "pg_temp_7").otherwise("mysql")
    listing = _Data(spark, d).table("customer").select(space.alias("namespace"), F.concat(F.lit("t"), k.cast("string")).alias("name"), F.when(k % 10 == 0, True).alias("is_partition"))
    return candidates(listing).select("namespace", "name")


def _two_sides() -> tuple[list[TableMeta], list[TableMeta]]:
    col = lambda n, t, null=True, **kw: Column(n, t, null, **kw)
    source = [TableMeta("o", (col("id", "integer", False), col("note", "character varying(50)"), col("gone", "text"), col("flag", "boolean")), ("id",)),
              TableMeta("lost", (col("id", "uuid", False),), ("id",)), TableMeta("log", (col("line", "text"),))]
    target = [TableMeta("o", (col("id", "bigint", False), col("note", "character varying(30)"), col("flag", "integer"), col("must", "date", False), col("may", "date"),
                              col("made", "date", False, generated=True)), ("id",)), TableMeta("log", (col("line", "text"),))]
    return source, target


def _positions(found: DataFrame, spark: SparkSession) -> DataFrame:
    rows = [(i, r.severity, r.table_name, r.category, r.message) for i, r in enumerate(found.collect())]  # as many as there are findings
    return _rows(spark, rows, "position int, severity string, table_name string, category string, message string")


@query("""SELECT * FROM (VALUES (0, 'INFO', 'b', 'cyclic-fk', 'b_a: null-then-fill'), (1, 'INFO', 'emp', 'cyclic-fk', 'emp_emp: null-then-fill'), (2, 'WARN', 'log', 'no-key', 'no primary or unique key; the table is skipped'),
 (3, 'BLOCK', 'lost', 'missing-table', 'the target has no such table'), (4, 'BLOCK', 'o', 'missing-column', 'gone is missing at the target'),
 (5, 'BLOCK', 'o', 'type', 'flag: boolean to integer: boolean values are no integer values'), (6, 'WARN', 'o', 'extra-not-null', 'must exists at the target only and takes no null'),
 (7, 'WARN', 'o', 'type', 'note: character varying(50) to character varying(30) may lose length')) t(position, severity, table_name, category, message)
UNION ALL SELECT 100 + row_number() OVER (), * FROM (VALUES ('BLOCK', 'a', 'cyclic-fk', 'a_b: blocked'), ('INFO', 'team', 'cyclic-fk', 'team_team: deferred'),
 ('WARN', 'w', 'dangling-fk', 'w_elsewhere refers to elsewhere, which is not selected'), ('WARN', 'y', 'dangling-fk', 'y_outside refers to outside, which is not selected'))""")
def preflight_findings(spark, d):
    """All kinds of findings: of the two sides and two tables on cycles in their order, then of the hard schema those not among them."""
    s, t = _two_sides()
    pick = [x for x in hard_tables() if x.name in ("b", "emp")] + [TableMeta("a", (Column("id", "bigint", False), Column("to_b", "bigint", True)), ("id",), (), (ForeignKey("a_b", "a", ("to_b",), "b", ("id",), True),))]
    first = preflight.findings(spark, [*s, *pick], [*t, *pick]).where("not (table_name = 'a')")
    rest = preflight.findings(spark, hard_tables(), hard_tables()).where("table_name in ('a', 'team', 'w', 'y')")
    one, two = _positions(first, spark), _positions(rest, spark)
    return one.unionByName(two.withColumn("position", F.col("position") + 101))


@query("""SELECT * FROM (VALUES (0, 'BLOCK', 'old', 'non-innodb'), (1, 'BLOCK', 'u', 'secondary-unique'), (2, 'BLOCK', 'lost', 'missing-target'), (3, 'WARN', 'log', 'no-key'),
 (4, 'WARN', 'u', 'type-risky'), (5, 'WARN', 'u', 'type-risky'), (6, 'BLOCK', 'u', 'missing-column'), (7, 'BLOCK', 'u', 'type-incompatible'), (8, 'WARN', 'd', 'dangling-fk'), (9, 'INFO', 'self', 'cyclic-fk'))
 t(position, severity, table_name, category)""")
def preflight_findings_second(spark, d):
    """The second dialect: transactions, further unique keys, character sets; cycles never block."""
    table = lambda n, cols, **kw: TableMeta(n, tuple(Column("id", "int", False) if c == "id" else Column(c, *t) for c, t in cols.items()), ("id",), **kw)
    mine = {"id": ("int",)}
    fk = lambda c, p: (ForeignKey(f"{c}_{p}", c, ("id",), p, ("id",)),)
    sets = lambda x: ("varchar(9)", True, False, False, False, x)
    source = [table("old", mine, storage="MyISAM"), table("u", {**mine, "b": ("bigint",), "c": sets("utf8mb4"), "gone": ("int",), "j": ("json",)}, storage="InnoDB"),
              table("lost", mine), TableMeta("log", (Column("x", "int"),)), table("d", mine, foreign_keys=fk("d", "nowhere")), table("self", mine, foreign_keys=fk("self", "self"))]
    target = [table("old", mine), table("u", {**mine, "b": ("int",), "c": sets("latin1"), "j": ("int",), "more": ("int",)}, unique_keys=(("id",), ("b",))),
              TableMeta("log", (Column("x", "int"),)), table("d", mine), table("self", mine)]
    return _positions(preflight.findings(spark, source, target, preflight.MYSQL), spark).drop("message")


@query("SELECT * FROM (VALUES ('BLOCK', 'rdb-version', 'target dump version 9 is older than 11'), ('BLOCK', 'missing-module', 'json'), ('BLOCK', 'missing-module', 'search')) t(severity, category, message)")
def preflight_findings_keyspace(spark, d):
    return preflight.keyspace_findings(spark, 11, 9, {"json", "search", "bloom"}, {"bloom"}).select("severity", "category", "message")


@query("""SELECT * FROM (VALUES (0, 'WARN  log no-key: no primary or unique key; the table is skipped'), (1, 'BLOCK lost missing-table: the target has no such table'),
 (2, 'BLOCK o missing-column: gone is missing at the target'), (3, 'BLOCK o type: flag: boolean to integer: boolean values are no integer values'),
 (4, 'WARN  o extra-not-null: must exists at the target only and takes no null'), (5, 'WARN  o type: note: character varying(50) to character varying(30) may lose length'),
 (6, '0 INFO, 3 WARN, 3 BLOCK'), (7, 'blocked')) t(position, line)""")
def preflight_render(spark, d):
    lines = preflight.render(preflight.findings(spark, *_two_sides())).split("\n")
    return _rows(spark, list(enumerate(lines)), "position int, line string")


_SETS = ["utf8mb4", "utf8mb3", "utf8", "UTF8", "latin1", "", None]


@query("""WITH s(name, folded) AS (VALUES ('utf8mb4', 'utf8mb4'), ('utf8mb3', 'utf8mb3'), ('utf8', 'utf8mb3'), ('UTF8', 'utf8mb3'), ('latin1', 'latin1'), ('', NULL), (NULL, NULL))
SELECT a.name AS source, b.name AS target, CASE WHEN a.folded IS NULL OR b.folded IS NULL OR a.folded = b.folded THEN 'identical' WHEN a.folded = 'utf8mb3' AND b.folded = 'utf8mb4' THEN 'widening' ELSE 'risky' END AS level
FROM s a CROSS JOIN s b""")
def charset_rules(spark, d):
    pairs = _rows(spark, [(a, b) for a in _SETS for b in _SETS], "source string, target string")
    return pairs.withColumn("level", types.charset_level(F.col("source"), F.col("target")))


# -- keys, codecs, functions of configuration ---------------------------------------------


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(epoch_us(ts) AS VARCHAR) AS ts, upper(hex(encode(event_type))) AS event_type FROM events")
def key_text(spark, d):
    """Key values as text: whole numbers, instants in microseconds, bytes in hex."""
    e = _Data(spark, d).table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").cast("binary").alias("event_type"))
    return e.select(*chunks.key_text(e, ["event_id", "ts", "event_type"]))


@query("SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND (ts < TIMESTAMP '2024-01-20 12:00:00' OR (ts = TIMESTAMP '2024-01-20 12:00:00' AND event_id < 5))")
def key_text_range(spark, d):
    """A chunk between bounds that were kept as text."""
    e = _Data(spark, d).table("events")
    typed = e.withColumn("ts", F.col("ts").cast("timestamp"))
    bound = typed.sparkSession.sql("SELECT TIMESTAMP'2024-01-10 00:00:00' AS ts, 0L AS event_id UNION ALL SELECT TIMESTAMP'2024-01-20 12:00:00', 5L").orderBy("ts")
    lo, hi = (tuple(r) for r in bound.select(*chunks.key_text(bound, ["ts", "event_id"])).collect())
    return chunks.scan(typed, ["ts", "event_id"], chunks.Chunk(lo, hi))


@query("""SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS key FROM orders""")
def key_json(spark, d):
    return _Data(spark, d).table("orders").select("o_orderkey", scalars.key_json("o_orderkey", "o_custkey", "o_orderstatus").alias("key"))


@query("""SELECT doc_id, printf('%08X', octet_length(encode(lang))) || hex(encode(lang)) || CASE WHEN doc_id % 9 = 0 THEN 'FFFFFFFF' ELSE printf('%08X', octet_length(encode(text))) || hex(encode(text)) END AS record FROM documents""")
def binary_frame(spark, d):
    t = _Data(spark, d).table("documents").withColumn("text", F.when(F.col("doc_id") % 9 != 0, F.col("text")))
    return t.select("doc_id", F.hex(scalars.frame(["lang", "text"])).alias("record"))


@query("""SELECT * FROM (VALUES ('`plain`', 0), ('`a``b`', 1), ('`s`.`t`', 2), ('`s.x`.`t y`', 3)) t(quoted, i)""")
def quoted_names(spark, d):
    names = [("plain",), ("a`b",), ("s", "t"), ("s.x", "", "t y")]
    return _rows(spark, [(scalars.quote_name(*n), i) for i, n in enumerate(names)], "quoted string, i int")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'mariadb' WHEN 1 THEN 'dragonfly' WHEN 2 THEN 'valkey' WHEN 3 THEN 'keydb' ELSE 'standard' END AS vendor, o_orderkey % 5 > 1 AS supported FROM orders""")
def vendor_detection(spark, d):
    k = F.col("o_orderkey")
    words = F.array(*[F.lit(x) for x in ("10.11-MariaDB", "df 1.2 DRAGONFLY", "Valkey 8", "KeyDB", "8.0.36")])
    banner = F.concat(F.element_at(words, (k % 5 + 1).cast("int")), F.lit(" "), k.cast("string"))
    return _Data(spark, d).table("orders").select("o_orderkey", scalars.vendor(banner).alias("vendor"), scalars.vendor_supported(banner).alias("supported"))


@query("SELECT event_id, event_type AS role, CAST(user_id AS VARCHAR) AS users, '' AS absent FROM events")
def info_fields(spark, d):
    """Fields of a report with one field to a line."""
    e = _Data(spark, d).table("events")
    info = F.concat(F.lit("# Section\r\nrole:"), "event_type", F.lit("\r\nusers_x:9\r\nusers:"), F.col("user_id").cast("string"), F.lit("\r\n"))
    return e.select("event_id", *[scalars.info_field(info, n).alias(n) for n in ("role", "users", "absent")])


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang FROM documents")
def empty_to_null(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return _Data(spark, d).table("documents").select("doc_id", scalars.empty_to_null(t).alias("lang"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '-' WHEN o_orderkey < 60 THEN o_orderkey || 's' WHEN o_orderkey < 3600 THEN (o_orderkey // 60) || 'm' || (o_orderkey % 60) || 's'
 ELSE (o_orderkey // 3600) || 'h' || (o_orderkey % 3600 // 60) || 'm' END AS age FROM orders""")
def human_age(spark, d):
    k = F.col("o_orderkey")
    return _Data(spark, d).table("orders").select("o_orderkey", scalars.human_age(F.when(k % 11 != 0, k.cast("double") + 0.4)).alias("age"))


def _said(f, *args) -> str:
    try:
        return str(f(*args))
    except ValueError:
        return "error"


_DURATIONS = ["5s", "1h30m", "500ms", "-1.5s", "0", "2us", "1m0.5s", "5", "", "5 s", "s", "1d"]


@query("""SELECT * FROM (VALUES ('5s', '5000000000'), ('1h30m', '5400000000000'), ('500ms', '500000000'), ('-1.5s', '-1500000000'), ('0', '0'), ('2us', '2000'), ('1m0.5s', '60500000000'),
 ('5', 'error'), ('', 'error'), ('5 s', 'error'), ('s', 'error'), ('1d', 'error')) t(text, nanoseconds)""")
def durations(spark, d):
    return _rows(spark, [(t, _said(scalars.duration_ns, t)) for t in _DURATIONS], "text string, nanoseconds string")


_ENV = ["x${A}y", "${B:-d}", "${EMPTY:-e}", "${EMPTY}", "$${A} $5", "${A}${A}", "${B}", "${A", "${1x}", "plain"]


@query("""SELECT * FROM (VALUES ('x${A}y', 'x1y'), ('${B:-d}', 'd'), ('${EMPTY:-e}', 'e'), ('${EMPTY}', ''), ('$${A} $5', '${A} $5'), ('${A}${A}', '11'), ('${B}', 'error'), ('${A', 'error'), ('${1x}', 'error'),
 ('plain', 'plain')) t(text, expanded)""")
def env_expansion(spark, d):
    return _rows(spark, [(t, _said(scalars.expand_env, t, {"A": "1", "EMPTY": ""})) for t in _ENV], "text string, expanded string")


# published values of 64-bit FNV-1a
@query("SELECT name, CAST(h - 18446744073709551616 AS BIGINT) AS number FROM (VALUES ('', 14695981039346656037::HUGEINT), ('a', 12638187200555641996), ('foobar', 9625390261332436968)) t(name, h)")
def lock_numbers(spark, d):
    return _rows(spark, [(n, scalars.fnv1a64(n)) for n in ("", "a", "foobar")], "name string, number bigint")


@query("SELECT * FROM (VALUES ('db.example:5432', 'db.example', 5432), ('db.example', 'db.example', 99), ('[::1]:7', '::1', 7), ('[fe80::2]', 'fe80::2', 99), (' h:1 ', 'h', 1)) t(text, host, port)")
def host_ports(spark, d):
    return _rows(spark, [(t, *scalars.host_port(t, 99)) for t in ("db.example:5432", "db.example", "[::1]:7", "[fe80::2]", " h:1 ")], "text string, host string, port int")


@query("""SELECT * FROM (VALUES ('disable', 'disable', 'DISABLED'), ('allow', 'allow', 'PREFERRED'), ('prefer', 'prefer', 'PREFERRED'), ('require', 'require', 'REQUIRED'), ('verify-ca', 'verify-ca', 'VERIFY_CA'),
 ('verify-full', 'verify-full', 'VERIFY_IDENTITY'), ('maybe', 'error', 'error')) t(mode, first, second)""")
def tls_modes(spark, d):
    one = lambda m, k: _said(lambda: next(iter(scalars.tls_option(m, k).values())))
    return _rows(spark, [(m, one(m, "pg"), one(m, "mysql")) for m in (*scalars.TLS_MODES, "maybe")], "mode string, first string, second string")


@query("SELECT CAST(i AS INT) AS attempt, CAST(least(200 * power(2, i), 5000) AS BIGINT) AS ms FROM range(12) t(i)")
def backoff(spark, d):
    return _rows(spark, [(i, scalars.backoff_ms(i)) for i in range(12)], "attempt int, ms bigint")


_CONFIG = """
state_store: {engine: store, path: /state}
sources: {s: {engine: store, path: /s}}
targets: {t: {engine: store, path: "${WHERE:-/t}"}, u: {engine: store, path: /u}}
syncs:
  - {name: one, source: s, targets: [t, u], exclude: ["*_audit"], tuning: {drain_interval: 5s, retention: {max_age: 1h, max_bytes: 10GB}, chunk_rows: 7}}
  - {name: two, source: s, targets: [u]}
"""


@query("""SELECT * FROM (VALUES ('one', 't,u', '*_audit', 5000000000, 3600000000000, 10000000000, 7, 1000), ('two', 'u', '', 1000000000, 86400000000000, 0, 10000, 1000))
 t(name, targets, exclude, drain_interval_ns, max_age_ns, max_bytes, chunk_rows, drain_batch)""")
def config_syncs(spark, d):
    rows = [(s.name, ",".join(s.targets), ",".join(s.exclude), s.drain_interval_ns, s.max_age_ns, s.max_bytes, s.chunk_rows, s.drain_batch) for s in load(_CONFIG, {}).syncs]
    return _rows(spark, rows, "name string, targets string, exclude string, drain_interval_ns bigint, max_age_ns bigint, max_bytes bigint, chunk_rows int, drain_batch int")


@query("""SELECT * FROM (VALUES ('sinks for syncs', 'error'), ('unknown target', 'error'), ('two engines', 'error'), ('bare duration', 'error'), ('name twice', 'error')) t(change, outcome)""")
def config_errors(spark, d):
    bad = {"sinks for syncs": ("syncs:", "sinks:"), "unknown target": ("targets: [u]", "targets: [v]"), "two engines": ("u: {engine: store", "u: {engine: other"),
           "bare duration": ("5s", "5"), "name twice": ("name: two", "name: one")}
    return _rows(spark, [(k, _said(load, _CONFIG.replace(*v), {})) for k, v in bad.items()], "change string, outcome string")


# -- keyspaces and pages ---------------------------------------------------------------


@query("""SELECT event_type || ':' || event_id AS key, 'string' AS type, props AS value, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 10 END AS ttl_ms, CAST(strlen(props) AS BIGINT) AS size
FROM events WHERE event_id % 5 <> 0""")
def keyspace_scan(spark, d):
    """Shard files written, then read through the data source with a partition for each."""
    e, i = _Data(spark, d).table("events"), F.col("event_id")
    ttl = F.when(i % 5 == 0, -2).when(i % 3 == 0, None).otherwise(i * 10).cast("bigint")
    path = _root(spark, "keyspace")
    Store(spark, path).drop_at_exit(path)
    keyspace.write_shards(e.select(F.concat("event_type", F.lit(":"), i.cast("string")).alias("key"), F.lit("string").alias("type"), F.col("props").alias("value"), ttl.alias("ttl_ms")), path, 6)
    keyspace.register(spark)
    got = spark.read.format("keyspace").option("path", path).load()
    return got.select(F.col("key").cast("string").alias("key"), "type", F.col("value").cast("string").alias("value"), "ttl_ms", "size")


@query("SELECT c_custkey FROM (VALUES (5), (70)) t(c_custkey) UNION SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 48)")
def rolling_page(spark, d):
    """What a rolling scan looks at next: hinted keys first, each once, then its page."""
    r = keyvalue.Rolling()
    r.hint([(5,), (70,), (5,)])
    return r.step(_Data(spark, d).table("customer"), KEY, 50)


@query(_with("tgt", "SELECT c_custkey FROM tgt WHERE c_custkey > 20 ORDER BY c_custkey LIMIT 60"))
def target_key_page(spark, d):
    return chunks.page_after(_Data(spark, d).tgt.select(*KEY), KEY, ("20",), 60)


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem")
def keyless_block_copy(spark, d):
    """A table without a key, copied in ranges of file blocks."""
    df = _Data(spark, d).table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    edges = [None, *chunks.block_plan(df)[1:], None]
    store = Store(spark, _root(spark, "blocks"))
    store.drop_at_exit(store.root)
    for a, b in zip(edges, edges[1:]):
        store.append("lineitem", chunks.block_scan(df, a, b))
    return store.read("lineitem")


# -- reports ---------------------------------------------------------------------------


@query("SELECT le, count(*) FILTER (WHERE value <= le OR le IS NULL) AS n FROM (VALUES (0.05::DOUBLE), (0.1), (0.25), (0.5), (1), (2.5), (5), (10), (30), (60), (NULL)) b(le) CROSS JOIN events GROUP BY le")
def latency_histogram(spark, d):
    return status.histogram(_Data(spark, d).table("events"), "value")


@query(" UNION ALL ".join(f"SELECT '{c}.{cc}' AS edge, EXISTS (SELECT 1 FROM {c} WHERE {cc} NOT IN (SELECT {pc} FROM {p})) AS orphans" for c, cc, p, pc in EDGES if c != "lineitem"))
def orphans_exist(spark, d):
    """The check before a commit: is any row without its parent?"""
    from tidewell.operators.changes import orphans

    x = _Data(spark, d)
    some = [(f"{c}.{cc}", not orphans(x.table(c).select(cc), x.table(p), [cc], [pc]).limit(1).isEmpty()) for c, cc, p, pc in EDGES if c != "lineitem"]
    return _rows(spark, some, "edge string, orphans boolean")


# -- syncs -----------------------------------------------------------------------------


def _customers(spark: SparkSession, d: str, **tuning) -> tuple[_Data, Syncer]:
    x = _Data(spark, d)
    return x, _sync(spark, {"customer": (x.table("customer"), {"key": KEY})}, **tuning)


@query(_with("src", "SELECT * FROM src"))
def stream_drain_converges(spark, d):
    """A store that drains deltas until none are left equals its source."""
    x, s = _customers(spark, d)
    s.bring_up()
    s.change("customer", x.src)
    s.drain_until_empty("a")
    return s.targets["a"].read("customer").select(*x.src.columns)


@query("SELECT * FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey > 75")
def resume_after_source_change(spark, d):
    """A copy that stops half way; keys below its mark go before it resumes; nothing is missing at the end."""
    x, s = _customers(spark, d, chunk_rows=25, chunks_per_commit=1)
    s.install_capture()
    n = iter(range(100))

    def stop(new) -> None:
        if next(n) == 3:
            raise InterruptedError

    with contextlib.suppress(InterruptedError):
        s.copy("a", s.parts[0], hook=stop)
    s.chunk_rows = 1_000_000
    s.change("customer", x.table("customer").where("c_custkey % 7 <> 0 OR c_custkey > 75"))
    s.bring_up()
    s.drain_until_empty("a")
    return s.targets["a"].read("customer").select(*x.src.columns)


@query("SELECT * FROM customer")
def operator_reseed_restores(spark, d):
    """A damaged target, an operator's request, a restart, a pass."""
    x, s = _customers(spark, d)
    s.bring_up()
    s.targets["a"].commit({"customer": s.targets["a"].read("customer").where("c_custkey < 9")})
    s.flag_reseed("a", ["customer"])
    s.bring_up()
    s.run_pass()
    return s.targets["a"].read("customer").select(*x.src.columns)


@query("""SELECT 'b' AS target, 'customer' AS table_name, 0::BIGINT AS deltas_left, count(*) AS rows_at_b FROM customer WHERE c_custkey % 7 <> 0""")
def retention_sacrifice(spark, d):
    """One target beyond the cap: its deltas go, it is flagged, copied again and complete."""
    x, s = _customers(spark, d, targets=("a", "b"), max_age=60)
    s.bring_up()
    s.change("customer", x.src)
    s.drain_until_empty("a")
    s.clock = lambda: NOW + timedelta(seconds=61)
    lost = [(t, n) for t in s.retain() for n in s.needs_reseed(t)]
    left = s.delta(s.tables[0]).count()
    for t, _ in lost:
        s.reseed(t)
    return _rows(spark, [(t, n, left, s.targets[t].read(n).count()) for t, n in lost], "target string, table_name string, deltas_left bigint, rows_at_b bigint")


@query("""SELECT 'before' AS step, n_nationkey, n_regionkey FROM nation WHERE n_regionkey < 3 UNION ALL SELECT 'after', n_nationkey, n_regionkey FROM nation""")
def fk_retry(spark, d):
    """Children whose parents have not come are not committed; once these are there, they are."""
    x = _Data(spark, d)
    nation, region = x.table("nation"), x.table("region")
    fk = ForeignKey("f", "nation", ("n_regionkey",), "region", ("r_regionkey",))
    s = _sync(spark, {"region": (region.where("r_regionkey < 3"), {"key": ["r_regionkey"]}), "nation": (nation.where("n_regionkey < 3"), {"key": ["n_nationkey"], "foreign_keys": [fk]})}, attempts=2)
    s.bring_up()
    s.change("nation", nation)
    with contextlib.suppress(OrphansLeft):
        s.drain("a", s.parts[0])
    see = lambda step: s.targets["a"].read("nation").select(F.lit(step).alias("step"), "n_nationkey", "n_regionkey")
    before = see("before")
    s.change("region", region)
    s.drain("a", s.parts[0])
    return before.unionByName(see("after"))


@query("""SELECT n_nationkey AS id, (n_nationkey + 1) % 25 AS up, n_name AS name FROM nation""")
def cyclic_load(spark, d):
    """Rows that refer to each other in a ring: left null, filled in, checked, committed as one; a second start copies nothing."""
    n = _Data(spark, d).table("nation").select(F.col("n_nationkey").alias("id"), ((F.col("n_nationkey") + 1) % 25).alias("up"), F.col("n_name").alias("name"))
    s = _sync(spark, {"ring": (n, {"key": ["id"], "foreign_keys": [ForeignKey("f", "ring", ("up",), "ring", ("id",))]})})
    s.bring_up()
    s.bring_up()
    return s.targets["a"].read("ring")


@query("""SELECT key, value FROM (SELECT 'k' || c_custkey AS key, c_name AS value FROM customer WHERE c_custkey <= 120 AND c_custkey % 2 = 0)""")
def keyspace_converges(spark, d):
    """Passes over a keyspace: rolling re-reads bring what the source has, sweeps delete what it has not, across a restart."""
    kv = _Data(spark, d).table("customer").where("c_custkey <= 120").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("value"), "c_custkey")
    s = _sync(spark, {"kv": (kv.where("c_custkey % 2 = 0").drop("c_custkey"), {"key": ["key"], "storage": "keyspace"})}, drain_batch=45)
    s.targets["a"].commit({"kv": kv.where("c_custkey % 3 = 0").select("key", F.lit("stale").alias("value"))})
    s.bring_up()
    for _ in range(3):
        s = Syncer(spark, "demo", s.source, s.state, s.targets, s.tables, clock=lambda: NOW, drain_batch=45)
        s.run_pass()
    return s.targets["a"].read("kv")


_LOST = """SELECT * FROM (VALUES (0, 'INFO', 'capture.installed'), (1, 'INFO', 'table.cutover_to_streaming'), (2, 'WARN', 'target.unreachable'), (3, 'INFO', 'target.recovered'),
 (4, 'INFO', 'reseed_started'), (5, 'INFO', 'table.cutover_to_streaming'), (6, 'INFO', 'capture.removed')) t(position, level, event)"""


@query(_LOST)
def sync_events(spark, d):
    """What a sync tells of an outage and a reseed, in order."""
    x, s = _customers(spark, d)
    s.bring_up()
    drain, reach = s.drain, s._reachable
    s.drain, s._reachable = lambda t, c: 1 / 0, lambda t: False
    s.run_pass()
    s.run_pass()
    s.drain, s._reachable = drain, reach
    s.flag_reseed("a", ["customer"])
    s.run_pass()
    s.remove_capture()
    rows = [(i, r.level, r.event) for i, r in enumerate(s.events().orderBy("id").collect())]
    return _rows(spark, rows, "position int, level string, event string")


@query(_with("src", """, n AS (SELECT (SELECT count(*) FROM customer) AS copied, (SELECT count(*) FROM customer WHERE c_custkey % 7 = 0) AS deleted)
SELECT metric, CAST(value AS DOUBLE) AS value FROM (SELECT unnest(['rows_copied_total', 'delta_purged_total', 'delta_backlog_rows', 'replication_lag_seconds', 'target_up', 'reseed_total', 'errors_total',
 'apply_batch_seconds']) AS metric, unnest([copied, deleted, 0, 0, 1, 1, 0, 2]) AS value FROM n)"""))
def sync_metrics(spark, d):
    """Metrics after a change, two passes and a reseed."""
    x, s = _customers(spark, d, max_age=3600)
    s.bring_up()
    copied = s.telemetry.values[("rows_copied_total", (("sync", "demo"), ("table", "customer")))]
    s.change("customer", x.src)
    s.run_pass()
    s.flag_reseed("a", ["customer"])
    s.run_pass()
    now = {k[0]: v for k, v in s.telemetry.values.items()}
    now |= {"rows_copied_total": copied, "errors_total": now.get("errors_total", 0.0), "apply_batch_seconds": s.telemetry.observed["a"][-2]}
    names = ["rows_copied_total", "delta_purged_total", "delta_backlog_rows", "replication_lag_seconds", "target_up", "reseed_total", "errors_total", "apply_batch_seconds"]
    return _rows(spark, [(n, float(now[n])) for n in names], "metric string, value double")


@query("SELECT 'customer' AS table_name, true AS copy_done, 'a' AS target, 'streaming' AS phase, count(*) AS last_delta, false AS needs_reseed FROM customer WHERE c_custkey % 7 = 0")
def state_after_pass(spark, d):
    x, s = _customers(spark, d)
    s.bring_up()
    s.change("customer", x.src.repartition(1))
    s.drain_until_empty("a")
    track = s.track(s.tables[0]).withColumn("table_name", F.lit("customer"))
    r = status.report(s.progress(), s.cursors(), track.groupBy("table_name", "target").agg(F.count(F.lit(1)).alias("delta_id")), NOW)
    return r.select("table_name", "copy_done", F.explode("targets").alias("t")).select("table_name", "copy_done", "t.target", "t.phase", "t.last_delta", "t.needs_reseed")


@query("SELECT * FROM (VALUES ('first', true), ('second', false), ('after', true)) t(owner, held)")
def ownership_lock(spark, d):
    root = _root(spark, "lock")
    one, two = Store(spark, root), Store(spark, root)
    one.drop_at_exit(root)
    rows = []
    with one.lock("x") as held:
        rows.append(("first", held()))
        try:
            with two.lock("x"):
                rows.append(("second", True))
        except Locked:
            rows.append(("second", False))
    with two.lock("x") as held:
        rows.append(("after", held()))
    return _rows(spark, rows, "owner string, held boolean")


@query("SELECT 3 AS version, 3::BIGINT AS ran")
def schema_version(spark, d):
    """Migrations in order, once each, whatever was applied before."""
    store = Store(spark, _root(spark, "migrations"))
    store.drop_at_exit(store.root)
    ran: list[int] = []
    steps = [(i, lambda s, i=i: ran.append(i)) for i in (1, 2, 3)]
    migrate(store, steps[:2])
    migrate(store, steps)
    return store.read("schema_version").agg(F.max("version").alias("version"), F.lit(len(ran)).cast("bigint").alias("ran"))


@query("SELECT r_regionkey, r_name FROM region")
def registry_endpoint(spark, d):
    """A side of a sync made by the name of its kind."""
    store = connect(spark, {"engine": "store", "path": _root(spark, "endpoint")})
    store.drop_at_exit(store.root)
    store.commit({"region": _Data(spark, d).table("region")})
    return store.read("region")


@query("""SELECT * FROM (VALUES ('version', 0), ('nonsense', 2), ('status', 2), ('validate', 1), ('capture-install', 0), ('run', 0), ('validate again', 0), ('reseed', 0), ('run again', 0), ('capture-remove', 0))
 t(command, code)""")
def command_codes(spark, d):
    from tidewell import cli

    root = _root(spark, "commands")
    store = Store(spark, f"{root}/source")
    store.drop_at_exit(root)
    store.commit({"region": _Data(spark, d).table("region")})
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".yml") as f:  # the driver's own configuration file
        f.write("region: {key: [r_regionkey]}\n")
        f.flush()
        args = ["--root", root, "--tables", f.name]
        with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
            rows = [("version", cli.main(["version"])), ("nonsense", cli.main(["nonsense"])), ("status", cli.main(["status"]))]
            for c in ("validate", "capture-install", "run", "validate again", "reseed", "run again", "capture-remove"):
                rows.append((c, cli.main([c.split()[0], *args], spark)))
    return _rows(spark, rows, "command string, code int")
