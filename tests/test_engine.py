"""State machines on small tables: convergence, replay, retention, cycles, streams."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.operators import changes, chunks, keyvalue, retention
from tidewell.plans import graph, preflight
from tidewell.plans.config import load
from tidewell.plans.engine import OrphansLeft, Syncer
from tidewell.plans.migrations import migrate
from tidewell.sources.catalog import Column, ForeignKey, TableMeta, introspect
from tidewell.sources.store import Locked, Store

NOW = datetime(2024, 1, 31)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def meta(name, key, *fks, cols=("id",), **more):
    return TableMeta(name, tuple(Column(c, "int", **more) for c in cols), key, (), tuple(fks))


def fk(child, parent, *cols, deferrable=False):
    return ForeignKey(f"{child}_{parent}", child, cols or ("id",), parent, ("id",), deferrable)


def syncer(spark, tmp_path, tables, targets=("a",), **more):
    store = lambda n: Store(spark, f"file://{tmp_path}/{n}")
    source = store("source")
    source.commit({n: df for n, (df, _) in tables.items()})
    metas = [introspect(n, df, **kw) for n, (df, kw) in tables.items()]
    return Syncer(spark, "s", source, store("state"), {t: store(f"target_{t}") for t in targets}, metas, clock=lambda: NOW, sleep=lambda s: None, **more)


def frame(spark, data, schema="id int, note string"):
    return spark.createDataFrame(data, schema)


# -- graph ------------------------------------------------------------------------


def test_components_and_order():
    tables = [meta("child", ("id",), fk("child", "parent")), meta("parent", ("id",)), meta("loner", ("id",)), meta("emp", ("id",), fk("emp", "emp")),
              meta("x", ("id",), fk("x", "y")), meta("y", ("id",), fk("y", "x")), meta("z", ("id",), fk("z", "x")), meta("d", ("id",), fk("d", "outside"))]
    got = {c.tables: c for c in graph.components(tables)}
    assert got[("child", "parent")].order == ("parent", "child")
    assert got[("emp",)].cyclic == ("emp",)
    assert got[("x", "y", "z")].cyclic == ("x", "y", "z")  # z depends on the cycle
    assert ("d",) in got and [f.child for f in graph.dangling(tables)] == ["d"]
    assert list(got) == sorted(got)


def test_cyclic_strategies_and_giant():
    loop = lambda **kw: graph.cyclic_edges([TableMeta("t", (Column("id", "int", False), Column("up", "int", kw.get("null", False))), ("id",), (),
                                                     (ForeignKey("f", "t", ("up",), "t", ("id",), kw.get("defer", False)),))])[0].strategy
    assert (loop(), loop(null=True), loop(defer=True)) == ("blocked", "null-then-fill", "deferred")
    many = [meta(f"t{i}", ("id",), *([fk(f"t{i}", "t0")] if 0 < i < 4 else [])) for i in range(6)]
    assert graph.giant(graph.components(many)).tables == ("t0", "t1", "t2", "t3")
    assert graph.giant(graph.components(many[:4])) is None


def test_preflight(spark):
    col = lambda n, t, null=True, **kw: Column(n, t, null, **kw)
    source = [TableMeta("a", (col("id", "integer"), col("v", "boolean"), col("w", "bigint"), col("gone", "text")), ("id",)), TableMeta("nokey", (col("x", "text"),)), TableMeta("lost", (col("id", "text"),), ("id",))]
    target = [TableMeta("a", (col("id", "bigint"), col("v", "integer"), col("w", "integer"), col("must", "text", False)), ("id",)), TableMeta("nokey", (col("x", "text"),))]
    found = preflight.findings(spark, source, target)
    assert [(r.severity, r.table_name, r.category) for r in found.collect()] == [
        ("BLOCK", "a", "missing-column"), ("BLOCK", "a", "type"), ("WARN", "a", "extra-not-null"), ("WARN", "a", "type"), ("BLOCK", "lost", "missing-table"), ("WARN", "nokey", "no-key")]
    assert preflight.blocked(found) and "blocked" in preflight.render(found)
    my = preflight.findings(spark, [TableMeta("a", (col("id", "int"),), ("id",), storage="myisam")], [TableMeta("a", (col("id", "int"),), ("id",), (("u",),))], preflight.MYSQL)
    assert [r.category for r in my.collect()] == ["non-innodb", "secondary-unique"]
    assert [r.category for r in preflight.keyspace_findings(spark, 11, 10, {"json"}, set()).collect()] == ["rdb-version", "missing-module"]


# -- operators ---------------------------------------------------------------------


def test_late_ids_are_found(spark):
    delta = frame(spark, [(i, i) for i in (1, 2, 5)], "delta_id bigint, k int")
    track = frame(spark, [("t", 1), ("t", 2), ("t", 5)], "target string, delta_id bigint")
    late = delta.unionByName(frame(spark, [(3, 9)], "delta_id bigint, k int"))
    assert [r.delta_id for r in changes.dirty_keys(late, track, "t").collect()] == [3]
    assert changes.dirty_keys(late, track, "other", 2).count() == 2


def test_upsert_of_key_only_table_and_null_key(spark):
    t = frame(spark, [(1,), (2,)], "id int")
    assert rows(changes.upsert(t, frame(spark, [(2,), (3,)], "id int"), ["id"])) == [(1,), (2,), (3,)]
    with pytest.raises(Exception, match="null key"):
        changes.upsert(frame(spark, [(1, "a")]), frame(spark, [(None, "b")]), ["id"]).collect()


def test_generated_columns_stay_out(spark):
    df = frame(spark, [(1, 2, 3, 6)], "id int, w int, h int, area int")
    assert introspect("g", df, key=["id"], generated=["area"]).transport == ["id", "w", "h"]


def test_null_then_fill(spark):
    e = frame(spark, [(1, None, "x"), (2, 1, "y"), (3, 9, "z")], "id int, up int, n string")
    first = changes.nulled(e, ["up"])
    assert rows(first.select("up").distinct()) == [(None,)]
    assert rows(changes.filled(first, e, ["id"], ["up"])) == rows(e)


def test_orphans_ignore_partly_null_keys(spark):
    c = frame(spark, [(1, 1, None), (2, 1, 1), (3, 5, 5)], "id int, a int, b int")
    p = frame(spark, [(1, 1)], "a int, b int")
    assert [r.id for r in changes.orphans(c, p, ["a", "b"], ["a", "b"]).collect()] == [3]


@pytest.mark.parametrize("n,size", [(0, 3), (1, 3), (3, 3), (10, 3), (100, 7)])
def test_chunks_are_gap_free(spark, n, size):
    df = spark.range(n).select((F.col("id") % 5).alias("a"), F.col("id").cast("string").alias("b"))
    plan = chunks.plan(df, ["a", "b"], size)
    assert plan[0].lo is None and plan[-1].hi is None and all(x.hi == y.lo for x, y in zip(plan, plan[1:]))
    got = [chunks.scan(df, ["a", "b"], c).collect() for c in plan]
    assert sum(map(len, got)) == n and all(len(g) == size for g in got[:-1])
    for c, g in zip(plan, got):
        assert chunks.delete_range(df, ["a", "b"], c).count() == n - len(g)


def test_chunk_predicate_reaches_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("a"), F.col("id").alias("b")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = chunks.scan(df, ["a", "b"], chunks.Chunk((10, 1), (20, 5)))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(a,10)" in plan and "LessThanOrEqual(a,20)" in plan


def test_backlog_laggard_and_ties(spark):
    delta = frame(spark, [(i, i % 2, NOW - timedelta(seconds=100 - i)) for i in range(10)], "delta_id bigint, k int, rc_at timestamp")
    track = frame(spark, [("b", i, NOW) for i in range(5)], "target string, delta_id bigint, consumed_at timestamp")
    b = retention.backlog(delta, track, ["c", "a", "b"], NOW, 1000)
    got = {r.target: (r.rows, r.bytes, r.oldest_age) for r in b.collect()}
    assert got == {"a": (10, 1000, 100.0), "b": (5, 500, 95.0), "c": (10, 1000, 100.0)}
    assert retention.laggard(b).first().target == "c"  # first configured of equals
    assert [r.target for r in retention.over_cap(b, max_age=97).collect()] == ["a", "c"]
    assert [r.target for r in retention.over_cap(b, max_bytes=10, table_bytes=11).collect()] == ["c"]
    assert retention.consumed_by_all(delta, track, []).count() == 10


def test_keyspace(spark):
    kv = frame(spark, [(b"user:1", "string", b"x", None, 1), (b"user:2", "hash", b"x", -2, 1), (b"user:3:tmp", "string", b"x", 5, 1), (b"o", "list", b"x", 0, 9), (b"gone", "list", None, 3, 0)],
               "key binary, type string, value binary, ttl_ms bigint, size bigint")
    assert [bytes(r.key) for r in keyvalue.live(kv, ["user:*"], ["user:*:tmp"]).collect()] == [b"user:1"]
    assert [r.restore_ttl_ms for r in keyvalue.live(kv, types=["list"]).collect()] == [1]
    with pytest.raises(ValueError):
        keyvalue.live(kv, types=["nope"])
    assert {r.size_level for r in keyvalue.size_guard(kv, 5, 0).collect()} == {"ok", "warn"}
    with pytest.raises(Exception, match="too large"):
        keyvalue.size_guard(kv, 5, 9).collect()
    keys = spark.range(5).select(F.col("id").alias("k"))
    roll, seen = keyvalue.Rolling(), []
    roll.hint([(4,), (4,)])
    for _ in range(3):
        seen.append(sorted(r.k for r in roll.step(keys, ["k"], 2).collect()))
    assert seen == [[0, 4], [1, 2], [3, 4]]


def test_reconciliation_converges(spark):
    rng = random.Random(4)
    kv = lambda d: frame(spark, sorted(d.items()), "key string, value string")
    source = {f"k{i:03}": f"v{i}" for i in range(40)}
    target = {f"k{i:03}": "stale" for i in range(20, 60)}
    roll, sweep, t = keyvalue.Rolling(), keyvalue.Sweeper(), kv(target)
    for step in range(8):
        if step == 2:
            source["k007"] = "changed"
            roll.hint([("k007",)])
        if step == 4:
            source.pop(f"k{rng.randint(20, 39):03}")
            roll.gap()
            sweep.cursor = None
        t = spark.createDataFrame(keyvalue.reconcile(kv(source), t, ["key"], roll, sweep, 15).collect(), "key string, value string")
    for _ in range(4):
        t = spark.createDataFrame(keyvalue.reconcile(kv(source), t, ["key"], roll, sweep, 15).collect(), "key string, value string")
    assert rows(t) == rows(kv(source)) and sweep.passes >= 2 and sweep.lag(40) <= 40


def test_registry_and_candidates(spark, tmp_path):
    from tidewell.plans import registry
    from tidewell.sources.catalog import candidates

    assert isinstance(registry.connect(spark, {"engine": "store", "path": f"file://{tmp_path}/x"}), Store)
    for bad in (lambda: registry.connect(spark, {"engine": "nope"}), lambda: registry.register("store", print)):
        with pytest.raises(ValueError):
            bad()
    listing = frame(spark, [("public", "t", False), ("public", "t_p1", True), ("mysql", "user", False), ("pg_temp_3", "x", None), ("app", "u", None)], "namespace string, name string, is_partition boolean")
    assert sorted(r.name for r in candidates(listing).collect()) == ["t", "u"]


def test_keyspace_source(spark, tmp_path):
    from tidewell.sources.keyspace import KeyspaceSource, pack_record

    for i in range(3):
        (tmp_path / f"shard{i}").write_bytes(b"".join(pack_record(f"{i}:{j}".encode(), "string", bytes([j]), [None, 7, -2][j]) for j in range(3)))
    spark.dataSource.register(KeyspaceSource)
    df = spark.read.format("keyspace").option("path", f"file://{tmp_path}").load()
    assert df.rdd.getNumPartitions() == 3
    assert sorted((bytes(r.key), r.ttl_ms) for r in df.collect()) == sorted((f"{i}:{j}".encode(), [None, 7][j]) for i in range(3) for j in range(2))


# -- syncs ----------------------------------------------------------------------------


def test_converges_through_random_changes(spark, tmp_path):
    rng = random.Random(7)
    data = {i: f"n{i}" for i in range(20)}
    s = syncer(spark, tmp_path, {"t": (frame(spark, list(data.items())), {"key": ["id"]})}, targets=("a", "b"), drain_batch=3, chunk_rows=6)
    s.bring_up()
    for round_ in range(3):
        for _ in range(6):
            i = rng.randint(0, 25)
            if rng.random() < 0.4:
                data.pop(i, None)
            else:
                data[i] = f"v{rng.random():.3f}"
        s.change("t", frame(spark, list(data.items()) or [(None, None)]))
        crash = rng.random() < 0.5
        if crash:
            with pytest.raises(ZeroDivisionError):
                s.drain_component("a", s.parts[0], before_confirm=lambda: 1 / 0)
        for t in ("a", "b")[: 1 + round_ % 2]:
            s.drain_until_empty(t)
            assert rows(s.targets[t].read("t")) == rows(frame(spark, list(data.items())))
    s.drain_until_empty("b")
    assert rows(s.targets["b"].read("t")) == rows(s.source.read("t"))
    s.retain()
    assert s.delta(s.tables[0]).count() == 0 and s.track(s.tables[0]).count() == 0


def test_passes_write_only_changed_buckets(spark, tmp_path):
    data = {i: f"n{i}" for i in range(200)}
    s = syncer(spark, tmp_path, {"t": (frame(spark, list(data.items())), {"key": ["id"]})}, buckets=16, chunk_rows=50)
    s.bring_up()
    store = s.targets["a"]
    before = store.manifest()["tables"]["t"]["parts"]
    assert store.bucketing("t") == (["id"], 16) and rows(store.read("t")) == rows(frame(spark, list(data.items())))
    data[5] = "new"
    data[1000] = "more"
    del data[7]
    s.change("t", frame(spark, list(data.items())))
    assert s.drain_until_empty("a") == 3
    after = store.manifest()["tables"]["t"]["parts"]
    assert rows(store.read("t")) == rows(frame(spark, list(data.items())))
    assert 1 <= sum(before.get(b) != after.get(b) for b in set(before) | set(after)) <= 3
    s.change("t", frame(spark, []))
    s.drain_until_empty("a")
    assert store.read("t").count() == 0 and store.vacuum() > 0
    s.flag_reseed("a", ["t"])
    assert s.reseed("a") == 1 and store.bucketing("t")[1] == 16


def test_child_before_parent_waits(spark, tmp_path):
    key = ForeignKey("f", "child", ("pid",), "parent", ("id",))
    s = syncer(spark, tmp_path, {"parent": (frame(spark, [(1, "p")]), {"key": ["id"]}),
                                 "child": (frame(spark, [(1, 1)], "id int, pid int"), {"key": ["id"], "foreign_keys": [key]})}, attempts=2)
    s.bring_up()
    s.change("child", frame(spark, [(1, 1), (2, 2)], "id int, pid int"))
    with pytest.raises(OrphansLeft):
        s.drain("a", s.parts[0])
    assert rows(s.targets["a"].read("child")) == [(1, 1)]  # nothing of it was committed
    s.change("parent", frame(spark, [(1, "p"), (2, "q")]))
    assert s.drain("a", s.parts[0]) == 2
    assert rows(s.targets["a"].read("child")) == [(1, 1), (2, 2)]


def test_cyclic_copy_and_keyless_skip(spark, tmp_path):
    key = ForeignKey("f", "emp", ("up",), "emp", ("id",))
    e = frame(spark, [(1, 2), (2, 1), (3, None)], "id int, up int")
    s = syncer(spark, tmp_path, {"emp": (e, {"key": ["id"], "foreign_keys": [key]}), "log": (frame(spark, [(1, "x")]), {})})
    s.bring_up()
    assert s.skipped == ["log"] and rows(s.targets["a"].read("emp")) == rows(e)


def _crash_on(n):
    calls = []

    def crash(new):
        calls.append(1)
        if len(calls) == n:
            raise RuntimeError("lost")

    return crash


def test_copy_resumes_behind_its_watermark(spark, tmp_path):
    data = [(i, f"n{i}") for i in range(50)]
    s = syncer(spark, tmp_path, {"t": (frame(spark, data), {"key": ["id"]})}, chunk_rows=10, chunks_per_commit=2)
    with pytest.raises(RuntimeError):
        s.copy("a", s.parts[0], hook=_crash_on(2))
    assert s.targets["a"].read("t").count() == 20
    # rows beyond the watermark are cleared before they are copied again
    s.targets["a"].append("t", frame(spark, [(20, "stale"), (49, "stale")]))
    assert s.copy("a", s.parts[0]) == 3
    assert rows(s.targets["a"].read("t")) == rows(frame(spark, data))
    assert s.copy("a", s.parts[0]) == 0


@pytest.mark.parametrize("change", ["delete", "insert", "both"])
def test_copy_resumes_by_key_whatever_happened_below(spark, tmp_path, change):
    data = {i * 10: f"n{i}" for i in range(100)}
    s = syncer(spark, tmp_path, {"t": (frame(spark, list(data.items())), {"key": ["id"]})}, chunk_rows=10, chunks_per_commit=2, drain_batch=1000)
    s.install_capture()
    with pytest.raises(RuntimeError):
        s.copy("a", s.parts[0], hook=_crash_on(3))
    assert s.progress().first().watermark == ["400"]
    if change != "insert":
        for i in range(0, 100, 10):
            del data[i]
    if change != "delete":
        data |= {i: "new" for i in range(201, 210)}
    s.change("t", frame(spark, list(data.items())))
    s.bring_up()
    assert s.targets["a"].read("t").where("id >= 400").count() == 60
    s.drain_until_empty("a")
    assert rows(s.targets["a"].read("t")) == rows(frame(spark, list(data.items())))


def test_keys_as_text_come_back(spark):
    df = spark.sql("""SELECT timestamp_micros(id * 1000001 + 7) AS t, cast(id AS double) / 3 AS d, cast(concat('k', id) AS binary) AS b, date_add(DATE'2024-01-01', cast(id AS int)) AS e,
                      cast(id AS decimal(20, 5)) / 7 AS n FROM range(40)""")
    for key in ("t", "d", "b", "e", "n"):
        plan = chunks.plan(df, [key], 9)
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kathmandu")
        try:
            assert [chunks.scan(df, [key], c).count() for c in plan] == [9, 9, 9, 9, 4], key
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_blocks_cover_a_table_without_a_key(spark, tmp_path):
    spark.range(0, 1000, 1, 4).selectExpr("id % 3 AS a", "id AS b").write.parquet(f"{tmp_path}/log")
    df = spark.read.parquet(f"{tmp_path}/log")
    plan = chunks.block_plan(df)
    assert len(plan) == 4
    edges = [None, *plan[1:], None]
    parts = [chunks.block_scan(df, a, b) for a, b in zip(edges, edges[1:])]
    assert parts[0].columns == ["a", "b"] and sorted(r.b for p in parts for r in p.collect()) == list(range(1000))
    assert all(p.count() == 250 for p in parts)


def test_operator_reseed_survives_passes_and_restarts(spark, tmp_path):
    data = [(i, f"n{i}") for i in range(20)]
    tables = {"t": (frame(spark, data), {"key": ["id"]})}
    s = syncer(spark, tmp_path, tables)
    s.bring_up()
    s.targets["a"].commit({"t": s.targets["a"].read("t").where("id < 5")})
    s.flag_reseed("a", ["t"])
    s.touch("a")
    s.bring_up()  # a restart
    assert s.needs_reseed("a") == ["t"]
    s.run_pass()
    assert rows(s.targets["a"].read("t")) == rows(frame(spark, data)) and s.needs_reseed("a") == []
    assert s.telemetry.values[("reseed_total", (("sync", "s"), ("target", "a")))] == 1


def test_idle_passes_write_nothing(spark, tmp_path):
    s = syncer(spark, tmp_path, {"t": (frame(spark, [(1, "a")]), {"key": ["id"]})})
    s.bring_up()
    s.run_pass()
    files = lambda: sorted(str(p) for p in tmp_path.rglob("*") if p.is_file() and "checkpoints" not in str(p))
    before = files()
    s.run_pass()
    s.run_pass()
    assert files() == before
    s.clock = lambda: NOW + timedelta(seconds=61)  # after a while cursors are refreshed
    s.run_pass()
    assert s.cursors().first().updated_at == NOW + timedelta(seconds=61)


def test_writers_lose_nothing(spark, tmp_path):
    from tidewell.sources.store import Conflict

    a, b = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    a.commit({"t": spark.range(2), "u": spark.range(1)})
    # an append of another writer between reading and committing stays
    a.commit(append={"t": spark.range(2, 3)}, hook=lambda new: b.append("t", spark.range(3, 5)))
    assert rows(a.read("t")) == [(i,) for i in range(5)]
    # a rewrite of what changed meanwhile is refused, one of another table is not
    base = a.manifest()
    b.append("t", spark.range(5, 6))
    with pytest.raises(Conflict):
        a.commit({"t": spark.range(1)}, base=base)
    a.commit({"u": spark.range(7)}, base=base)
    assert a.read("t").count() == 6 and a.read("u").count() == 7

    def racing(notes):
        if "x" not in notes:
            b.note(lambda n: {**n, "x": 1, "y": 1})
        return {**notes, "x": notes.get("x", 0) + 1}

    a.note(racing)
    assert a.notes("x") == 2 and a.notes("y") == 1


def test_many_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def work(i):
        store = Store(spark, f"file://{tmp_path}/s")
        for _ in range(5):
            store.note(lambda n: {**n, "count": n.get("count", 0) + 1})
            store.log("l", {"v": i})

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, range(4)))
    s = Store(spark, f"file://{tmp_path}/s")
    assert s.notes("count") == 20
    assert sorted(r.id for r in s.read_log("l", "id bigint, v int").collect()) == list(range(1, 21))
    assert s.fold_log("l", "id bigint, v int", most=5) and s.log("l", {"v": 9}) == 21
    assert sorted(r.id for r in s.read_log("l", "id bigint, v int").collect()) == list(range(1, 22))


def test_lock_lease_and_takeover(spark, tmp_path):
    now = {"t": 1000.0}
    one, two = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    with one.lock("x", lease=60, clock=lambda: now["t"]) as held:
        with pytest.raises(Locked), two.lock("x", clock=lambda: now["t"]):
            pass
        now["t"] += 61  # the first has died, as far as anyone can tell
        with two.lock("x", clock=lambda: now["t"]) as mine:
            assert mine() and not held()
            with pytest.raises(Locked), one.lock("x", clock=lambda: now["t"]):
                pass
    with one.lock("x", clock=lambda: now["t"]):
        pass


def test_loop_goes_on_after_errors(spark, tmp_path):
    s = syncer(spark, tmp_path, {"t": (frame(spark, [(1, "a")]), {"key": ["id"]})})
    s.bring_up()
    s.retain = lambda: 1 / 0
    s.reseed = lambda target: 1 / 0
    turns = iter(range(2))
    s.run(stop=lambda: next(turns, None) is None, interval=0)
    assert {r.event for r in s.events().collect()} >= {"retention_error", "reseed_error"}
    assert s.telemetry.values[("errors_total", (("sync", "s"), ("category", "reseed")))] == 2


def test_unreachable_targets_are_told_once_and_recover(spark, tmp_path):
    s = syncer(spark, tmp_path, {"t": (frame(spark, [(1, "a")]), {"key": ["id"]})})
    s.bring_up()
    real, reach = s.drain, s._reachable
    s.drain, s._reachable = lambda t, c: 1 / 0, lambda t: False
    s.run_pass()
    s.run_pass()
    assert 'target_up{sync="s",target="a"} 0' in s.telemetry.text()
    s.drain, s._reachable = real, reach
    s.run_pass()
    assert [r.event for r in s.events().orderBy("id").collect()][-2:] == ["target.unreachable", "target.recovered"]
    assert 'target_up{sync="s",target="a"} 1' in s.telemetry.text()


def test_keyspaces_converge_across_restarts(spark, tmp_path):
    kv = "key string, value string"
    source = {f"k{i:03}": f"v{i}" for i in range(40)}
    make = lambda first: {"kv": (frame(spark, sorted(first.items()), kv), {"key": ["key"], "storage": "keyspace"})}
    s = syncer(spark, tmp_path, make(source), drain_batch=15)
    s.targets["a"].commit({"kv": frame(spark, [(f"k{i:03}", "stale") for i in range(20, 60)], kv)})
    s.bring_up()
    for step in range(8):
        if step == 2:
            source["k001"] = "changed"
            s.source.commit({"kv": frame(spark, sorted(source.items()), kv)})
            s.hint("a", "kv", [("k001",)])
            s.run_pass()
            assert s.targets["a"].read("kv").where("key = 'k001'").first().value == "changed"
        s = Syncer(spark, "s", s.source, s.state, s.targets, s.tables, clock=lambda: NOW, drain_batch=15)  # a restart
        s.run_pass()
    assert rows(s.targets["a"].read("kv")) == rows(frame(spark, sorted(source.items()), kv))
    assert s.state.notes("scans")["a/kv"]["passes"] >= 2


def test_hints_beyond_their_bound_are_a_gap(monkeypatch):
    monkeypatch.setattr(keyvalue, "MOST_HINTS", 3)
    r = keyvalue.Rolling(cursor=("x",))
    r.hint([("a",), ("b",), ("a",)])
    assert r.priority == [("a",), ("b",)] and r.cursor == ("x",)
    r.hint([("c",), ("d",)])
    assert r.priority == [] and r.cursor is None


def test_cyclic_parts_are_copied_once(spark, tmp_path):
    key = ForeignKey("f", "emp", ("up",), "emp", ("id",))
    s = syncer(spark, tmp_path, {"emp": (frame(spark, [(1, 2), (2, 1)], "id int, up int"), {"key": ["id"], "foreign_keys": [key]})})
    s.bring_up()
    n = s.targets["a"].manifest()["commit"]
    s.bring_up()
    assert s.targets["a"].manifest()["commit"] == n


def test_metrics_and_server(spark, tmp_path):
    import urllib.request

    from tidewell.plans import status

    s = syncer(spark, tmp_path, {"t": (frame(spark, [(1, "a"), (2, "b")]), {"key": ["id"]})}, max_age=120)
    s.bring_up()
    s.change("t", frame(spark, [(1, "b"), (2, "b")]))
    s.clock = lambda: NOW + timedelta(seconds=60)
    s.gauges("a")
    text = s.telemetry.text()
    for line in ('delta_backlog_rows{sync="s",target="a",table="t"} 1', 'replication_lag_seconds{sync="s",target="a",table="t"} 60', "# TYPE delta_backlog_rows gauge",
                 'rows_copied_total{sync="s",table="t"} 2', 'table_phase_info{sync="s",table="t",phase="streaming"} 1'):
        assert line in text
    assert "retention.cap_approaching" in {r.event for r in s.events().collect()}
    s.run_pass()
    assert 'apply_batch_seconds_count{sync="s",target="a"} 1' in s.telemetry.text() and 'delta_purged_total{sync="s",table="t"} 1' in s.telemetry.text()
    server = status.serve(0, lambda: text, lambda: [{"table": "t"}])
    get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{p}").read().decode()
    assert get("/metrics") == text and get("/status") == '[{"table": "t"}]' and get("/healthz") == "ok"
    server.shutdown()


def test_copy_merges_into_rows(spark, tmp_path):
    s = syncer(spark, tmp_path, {"t": (frame(spark, [(1, "new"), (2, "b")]), {"key": ["id"]})})
    s.targets["a"].commit({"t": frame(spark, [(1, "old"), (9, "own")])})
    s.copy("a", s.parts[0], mode="merge")
    assert rows(s.targets["a"].read("t")) == [(1, "new"), (2, "b"), (9, "own")]


def test_target_beyond_cap_is_copied_again(spark, tmp_path):
    s = syncer(spark, tmp_path, {"t": (frame(spark, [(1, "a")]), {"key": ["id"]})}, targets=("up", "down"), max_age=60)
    s.bring_up()
    s.change("t", frame(spark, [(1, "b"), (2, "c")]))
    s.drain_until_empty("up")
    s.clock = lambda: NOW + timedelta(seconds=61)
    assert s.retain() == ["down"] and s.needs_reseed("down") == ["t"]
    assert s.delta(s.tables[0]).count() == 0  # no longer pinned
    assert s.reseed("down") == 1 and s.needs_reseed("down") == []
    assert rows(s.targets["down"].read("t")) == rows(s.source.read("t"))
    assert {r.event for r in s.events().collect()} >= {"target.needs_reseed", "reseed_started", "table.cutover_to_streaming"}


def test_pass_survives_a_failing_target(spark, tmp_path):
    s = syncer(spark, tmp_path, {"t": (frame(spark, [(1, "a")]), {"key": ["id"]})}, targets=("bad", "good"))
    s.bring_up()
    s.change("t", frame(spark, [(1, "b")]))
    real = s.drain
    s.drain = lambda t, c: 1 / 0 if t == "bad" else real(t, c)
    assert s.run_pass() == {"bad": -1, "good": 1}
    assert s.delta(s.tables[0]).count() == 1  # still dirty for the other


def test_store_lock_vacuum_and_migrations(spark, tmp_path):
    a = Store(spark, f"file://{tmp_path}/s")
    with a.lock("x"), pytest.raises(Locked):
        with Store(spark, f"file://{tmp_path}/s").lock("x"):
            pass
    with a.lock("x"):
        pass
    a.commit({"t": spark.range(1)})
    a.commit({"t": spark.range(2)})
    assert a.vacuum() == 1 and a.read("t").count() == 2
    with pytest.raises(RuntimeError):
        a.commit({"t": spark.range(3)}, hook=lambda new: (_ for _ in ()).throw(RuntimeError("no")))
    assert a.read("t").count() == 2
    ran = []
    steps = [(1, lambda s: ran.append(1)), (2, lambda s: ran.append(2))]
    assert migrate(a, steps[:1]) == 1 and migrate(a, steps) == 2 and migrate(a, steps) == 2 and ran == [1, 2]
    with pytest.raises(ValueError):
        migrate(a, [(2, print)])


def test_stream_replays_and_converges(spark, tmp_path):
    from tidewell.streaming.drain import drain_batches, start

    src, dst = Store(spark, f"file://{tmp_path}/src"), Store(spark, f"file://{tmp_path}/dst")
    src.commit({"t": frame(spark, [(i, f"v{i}") for i in range(10) if i % 3])})
    dst.commit({"t": frame(spark, [(i, "old") for i in range(12)])})
    schema = "delta_id bigint, id int, rc_op string, rc_at timestamp"
    ids = list(range(12))
    random.Random(3).shuffle(ids)  # ids out of order across files
    for n, part in enumerate((ids[:4], ids[4:8], ids[8:])):
        frame(spark, [(100 + i, i, "U", NOW) for i in part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    fail = {"on": True}

    def boom(batch):
        if batch == 1 and fail["on"]:
            raise RuntimeError("lost")

    def go():
        f = drain_batches(spark, src, dst, "t", ["id"], "a", lambda: NOW, before_confirm=boom)
        q = start(spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/cp", f)
        q.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        go()
    fail["on"] = False
    go()
    assert rows(dst.read("t")) == rows(src.read("t"))
    assert src.read("track_t").count() == 12


def test_config():
    text = """
sources: {s: {engine: pg, dsn: "${DSN}"}}
targets: {t: {engine: pg}}
syncs:
  - name: one
    source: s
    targets: [t]
    exclude: ["*_audit"]
    tuning: {drain_interval: 5s, retention: {max_age: 1h, max_bytes: 10GB}}
"""
    c = load(text, {"DSN": "x"})
    assert c.syncs[0].drain_interval_ns == 5 * 10**9 and c.syncs[0].max_bytes == 10**10 and c.sources["s"]["dsn"] == "x"
    for bad in (text.replace("syncs:", "sinks:"), text.replace("targets: [t]", "targets: [u]"), text.replace("t: {engine: pg}", "t: {engine: my}"), text.replace("5s", "5")):
        with pytest.raises(ValueError):
            load(bad, {"DSN": "x"})


def test_commands(spark, tmp_path, capsys):
    from tidewell.cli import main

    assert main(["version"]) == 0 and main(["nonsense"]) == 2 and main(["status"]) == 2
    Store(spark, f"file://{tmp_path}/source").commit({"t": frame(spark, [(1, "a")]), "log": frame(spark, [(1, "x")])})
    (tmp_path / "tables.yml").write_text("t: {key: [id]}\nlog: {}\n")
    args = ["--root", f"file://{tmp_path}", "--tables", str(tmp_path / "tables.yml")]
    assert main(["validate", *args], spark) == 1  # no target table yet
    assert main(["capture-install", *args], spark) == 0
    assert main(["run", *args], spark) == 0
    assert main(["validate", *args], spark) == 0
    assert main(["status", *args], spark) == 0
    target = Store(spark, f"file://{tmp_path}/target_a")
    target.commit({"t": target.read("t").limit(0)})
    assert main(["reseed", *args], spark) == 0 and main(["run", *args], spark) == 0
    assert rows(target.read("t")) == [(1, "a")]
    assert main(["capture-remove", *args], spark) == 0
    assert "captured 1 tables, skipped 1" in capsys.readouterr().out


def test_commands_by_configuration(spark, tmp_path):
    from tidewell.cli import main

    Store(spark, f"file://{tmp_path}/src").commit({"t": frame(spark, [(1, "a")]), "t_audit": frame(spark, [(1, "x")])})
    (tmp_path / "tables.yml").write_text("t: {key: [id]}\nt_audit: {key: [id]}\n")
    (tmp_path / "c.yml").write_text(f"""
state_store: {{engine: store, path: "file://{tmp_path}/state"}}
sources: {{s: {{engine: store, path: "file://{tmp_path}/src", tables: "{tmp_path}/tables.yml"}}}}
targets: {{x: {{engine: store, path: "file://{tmp_path}/x"}}}}
syncs:
  - {{name: one, source: s, targets: [x], exclude: ["*_audit"], tuning: {{drain_interval: 1ms, chunk_rows: 5}}}}
""")
    args = ["--config", str(tmp_path / "c.yml")]
    assert main(["run", *args, "--port", "0"], spark) == 0 and main(["status", *args], spark) == 0
    x = Store(spark, f"file://{tmp_path}/x")
    assert x.exists("t") and not x.exists("t_audit")
    assert main(["run", *args, "--sync", "nope"], spark) == 2 and main(["run", "--config", "/nowhere"], spark) == 2
    with Store(spark, f"file://{tmp_path}/state").lock("one"):
        assert main(["run", *args], spark) == 1
