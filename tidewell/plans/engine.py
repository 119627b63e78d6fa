"""A sync: bring a target store to a source store and keep it there.

Both sides are :class:`~tidewell.sources.store.Store`; deltas and track are
tables of the source side; cursors and events belong to a state store, and how
far a copy got is kept with the target's data, in the same commit.  One
commit carries a whole component of tables, so the target is never seen with a
child whose parent is missing.  Confirmation follows the commit: a crash in
between replays, and replaying changes nothing.

Tables whose storage is ``keyspace`` have no captured changes: they converge by
rolling re-reads and a sweep over the target's keys, both of which go on where
they stood after a restart.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.scalars import backoff_ms
from tidewell.operators import changes, chunks, keyvalue, retention
from tidewell.plans import graph
from tidewell.plans.status import Telemetry
from tidewell.sources.catalog import TableMeta
from tidewell.sources.store import Conflict, Store, bucket_of

PROGRESS = "sync string, target string, table_name string, done boolean, watermark array<string>"
CURSORS = "sync string, target string, table_name string, phase string, needs_reseed boolean, updated_at timestamp"
EVENTS = "id bigint, sync string, target string, table_name string, level string, event string, message string, created_at timestamp"
DELTA_TAIL = "delta_id bigint, rc_op string, rc_at timestamp"


class OrphansLeft(RuntimeError):
    """A commit would leave children without parents; a later pass may bring them."""


@dataclass
class Syncer:
    spark: SparkSession
    name: str
    source: Store
    state: Store
    targets: dict[str, Store]
    tables: list[TableMeta]
    clock: Callable[[], datetime] = datetime.now
    chunk_rows: int = 10_000
    chunks_per_commit: int = 100
    buckets: int = 0  # hash buckets of a target table; 0 writes a table as a whole
    drain_batch: int = 1_000
    max_age: float = 0
    max_bytes: int = 0
    attempts: int = 5
    sleep: Callable[[float], None] = time.sleep
    touch_every: float = 60.0  # seconds after which an idle pass refreshes its cursors
    vacuum_age: float = 3600.0  # seconds that a version without a name is left alone
    telemetry: Telemetry | None = None
    _by_name: dict[str, TableMeta] = field(default_factory=dict)

    def __post_init__(self) -> None:
        sc = self.spark.sparkContext
        if sc.getCheckpointDir() is None:  # spark.checkpoint.dir is unset, as in tests
            sc.setCheckpointDir(f"{self.state.root}/checkpoints")
        self.skipped = [t.name for t in self.tables if not t.key]  # keyless tables are left out, with a warning
        self.tables = [t for t in self.tables if t.key]
        self._by_name = {t.name: t for t in self.tables}
        self.parts = graph.components([t for t in self.tables if t.storage != "keyspace"])
        self.keyspaces = [t for t in self.tables if t.storage == "keyspace"]
        self.rolling: dict[tuple[str, str], keyvalue.Rolling] = {}
        self.telemetry = self.telemetry or Telemetry(self.name)
        self._down: set[str] = set()

    # -- state ------------------------------------------------------------

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def progress(self) -> DataFrame:
        """How far each target's copies got; kept with the target's data."""
        rows = []
        for target, store in self.targets.items():
            try:
                rows += [(self.name, target, t, x["done"], x.get("watermark")) for t, x in store.notes(f"progress/{self.name}").items()]
            except Exception:  # noqa: BLE001 - a target that cannot be reached has no report
                continue
        return self._frame(rows, PROGRESS)

    def cursors(self) -> DataFrame:
        rows = [(x["sync"], x["target"], x["table_name"], x["phase"], x["needs_reseed"], datetime.fromisoformat(x["updated_at"]))
                for x in self.state.notes("cursors").values()]
        return self._frame(rows, CURSORS)

    def events(self) -> DataFrame:
        return self.state.read_log("events", EVENTS)

    def event(self, target: str, table: str | None, level: str, event: str, message: str = "") -> None:
        self.state.log("events", {"sync": self.name, "target": target, "table_name": table, "level": level, "event": event, "message": message,
                                  "created_at": str(self.clock())})

    def _cursors(self, target: str, tables: Iterable[str], change: Callable[[dict | None], dict | None]) -> None:
        """Change cursors one by one; what other writers do to them meanwhile is kept."""

        def put(notes: dict) -> dict:
            held = notes.setdefault("cursors", {})
            for t in tables:
                k = f"{self.name}/{target}/{t}"
                if (new := change(held.get(k))) is not None:
                    held[k] = {"sync": self.name, "target": target, "table_name": t, **new}
            return notes

        self.state.note(put)

    def cursor(self, target: str, tables: Iterable[str], phase: str, needs_reseed: bool = False) -> None:
        at = self.clock().isoformat()
        self._cursors(target, tables, lambda old: {"phase": phase, "needs_reseed": needs_reseed, "updated_at": at})

    def touch(self, target: str) -> None:
        """A healthy pass: cursors are as of now.  Whatever else they say stays, a wish for a reseed above all."""
        now = self.clock()

        def change(old: dict | None) -> dict | None:
            if old and (now - datetime.fromisoformat(old["updated_at"])).total_seconds() < self.touch_every:
                return None
            return {"phase": "streaming", "needs_reseed": False, **(old or {}), "updated_at": now.isoformat()}

        self._cursors(target, self._by_name, change)

    def needs_reseed(self, target: str) -> list[str]:
        return sorted(x["table_name"] for x in self.state.notes("cursors").values()
                      if x["sync"] == self.name and x["target"] == target and x["needs_reseed"])

    def flag_reseed(self, target: str, tables: Iterable[str]) -> None:
        """An operator's request: the next pass copies the tables' components again."""
        self.cursor(target, sorted(tables), "initial_copy", True)

    # -- capture ------------------------------------------------------------

    def _delta_schema(self, t: TableMeta) -> str:
        return ", ".join(f"{k} {t.column(k).data_type}" for k in t.key) + ", " + DELTA_TAIL

    def delta(self, t: TableMeta) -> DataFrame:
        name = f"delta_{t.name}"
        return self.source.read(name) if self.source.exists(name) else self._frame([], self._delta_schema(t))

    def track(self, t: TableMeta) -> DataFrame:
        name = f"track_{t.name}"
        return self.source.read(name) if self.source.exists(name) else self._frame([], "target string, delta_id bigint, consumed_at timestamp")

    def install_capture(self) -> list[str]:
        """Empty delta and track tables for every keyed table; what was captured already stays."""
        new = {}
        for t in self.tables:
            if t.storage != "keyspace" and not self.source.exists(f"delta_{t.name}"):
                new |= {f"delta_{t.name}": self.delta(t), f"track_{t.name}": self.track(t)}
        if new:
            self.source.commit(new)
            self.event("", None, "INFO", "capture.installed", f"{len(new) // 2} tables")
        return sorted(t.name for t in self.tables)

    def remove_capture(self) -> int:
        """Drop delta and track tables; how many tables were captured."""
        names = [t.name for t in self.tables if self.source.exists(f"delta_{t.name}")]
        if names:
            self.source.drop([f"{k}_{n}" for n in names for k in ("delta", "track")])
            self.event("", None, "INFO", "capture.removed", f"{len(names)} tables")
        return len(names)

    def change(self, table: str, after: DataFrame) -> int:
        """Replace a source table and record what changed, in one commit."""
        t, base = self._by_name[table], self.source.manifest()
        d = self.delta(t)
        first = (d.agg(F.max("delta_id")).first()[0] or 0) + 1
        made = changes.snapshot_diff(self.source.read(table), after, list(t.key))
        made = made.withColumn("delta_id", F.monotonically_increasing_id() + F.lit(first)).withColumn("rc_at", F.lit(self.clock()))
        return self.source.commit({table: after}, append={f"delta_{table}": made.select(*d.columns)}, base=base)

    # -- initial copy ---------------------------------------------------------

    def _done(self, target: str, name: str) -> dict | None:
        return self.targets[target].notes(f"progress/{self.name}").get(name)

    def _mark(self, name: str, done: bool, watermark: list | None) -> Callable[[dict], dict]:
        """The note that goes with a commit of copied rows."""

        def put(notes: dict) -> dict:
            notes.setdefault(f"progress/{self.name}", {})[name] = {"done": done, "watermark": watermark}
            return notes

        return put

    def copy(self, target: str, component: graph.Component, mode: str = "direct", hook=None) -> int:
        """Copy a component, parents first; returns the chunks copied.

        Runs of ``chunks_per_commit`` chunks are appended; the key they reach up
        to is kept in the same commit.  A restart plans from that key on, so
        rows that came or went below it in between shift nothing; rows at or
        beyond it are cleared first.  ``merge`` upserts into a target that has
        rows already.  Cyclic components are loaded with their references null,
        filled in, checked and committed as one.
        """
        if component.cyclic or mode == "merge":
            return self._copy_whole(target, component, mode, hook)
        store, total = self.targets[target], 0
        for name in component.order:
            t, key = self._by_name[name], list(self._by_name[name].key)
            done = self._done(target, name)
            if done and done["done"]:
                continue
            rows = self.source.read(name).select(*t.transport)
            plain = store.exists(name) and not store.bucketing(name)
            mark = done["watermark"] if done and plain else None  # a table that an earlier copy put in buckets starts over
            rest = chunks.Chunk(tuple(mark) if mark else None, None)
            if not plain:
                store.commit({name: rows.limit(0)})
            elif not chunks.scan(store.read(name), key, rest).limit(1).isEmpty():
                store.commit({name: chunks.delete_range(store.read(name), key, rest)})
            plan = chunks.plan(chunks.scan(rows, key, rest), key, self.chunk_rows)
            plan[0] = chunks.Chunk(rest.lo, plan[0].hi)
            self.telemetry.set("initial_copy_rows_target", len(plan) * self.chunk_rows, table=name)
            for i in range(0, len(plan), self.chunks_per_commit):
                last = min(i + self.chunks_per_commit, len(plan)) - 1
                end = plan[last].hi
                note = self._mark(name, end is None and not self.buckets, list(end) if end else mark)
                seen, started = Observation(), time.time()
                part = chunks.scan(rows, key, chunks.Chunk(plan[i].lo, end)).observe(seen, F.count(F.lit(1)).alias("n"))
                store.commit(append={name: part}, hook=hook, note=note)
                self.telemetry.copied(name, seen.get["n"], time.time() - started)
                mark = list(end) if end else mark
                total += last + 1 - i
            if self.buckets:
                store.commit(bucketed={name: (store.read(name), key, self.buckets)}, note=self._mark(name, True, None))
        return total

    def _copy_whole(self, target: str, component: graph.Component, mode: str, hook) -> int:
        store, staged = self.targets[target], {}
        if mode == "direct" and all((self._done(target, n) or {"done": False})["done"] for n in component.order):
            return 0
        for e in graph.cyclic_edges(self.tables):
            if e.strategy == "blocked":
                raise ValueError(f"{e.key.child}.{e.key.name} is on a cycle and can be neither deferred nor left null")
        cyclic = graph.fill_columns(self.tables)
        for name in component.order:
            t, key = self._by_name[name], list(self._by_name[name].key)
            rows = self.source.read(name).select(*t.transport)
            if name in cyclic:
                rows = changes.filled(changes.nulled(rows, cyclic[name]), rows, key, cyclic[name])
            staged[name] = changes.upsert(store.read(name), rows, key) if mode == "merge" and store.exists(name) else rows
        check = self._validate(component, store)

        def both(new: dict[str, DataFrame]) -> None:
            check(new)
            if hook:
                hook(new)

        def mark(notes: dict) -> dict:
            for n in staged:
                notes = self._mark(n, True, None)(notes)
            return notes

        if self.buckets:
            store.commit(bucketed={n: (df, list(self._by_name[n].key), self.buckets) for n, df in staged.items()}, hook=both, note=mark)
        else:
            store.commit(staged, hook=both, note=mark)
        return len(staged)

    def bring_up(self) -> None:
        """Capture first, then copy each component and cut over to streaming.  What a cursor asks for stays asked for."""
        self.install_capture()
        for target, store in self.targets.items():
            for c in self.parts:
                self.copy(target, c)
                known = self.state.notes("cursors")
                new = [n for n in c.tables if known.get(f"{self.name}/{target}/{n}", {}).get("phase") != "streaming"]
                new = [n for n in new if not known.get(f"{self.name}/{target}/{n}", {}).get("needs_reseed")]
                if new:
                    self.cursor(target, new, "streaming")
                    self.event(target, new[0], "INFO", "table.cutover_to_streaming")
            for t in self.keyspaces:
                if not store.exists(t.name):
                    store.commit({t.name: self.source.read(t.name).select(*t.transport).limit(0)})
                self.cursor(target, [t.name], "streaming", t.name in self.needs_reseed(target))

    # -- streaming ------------------------------------------------------------

    def _validate(self, component: graph.Component, store: Store):
        edges = [fk for n in component.tables for fk in self._by_name[n].foreign_keys if fk.parent in self._by_name]

        def check(new: dict[str, DataFrame]) -> None:
            get = lambda n: new.get(n) if n in new else store.read(n)
            for fk in edges:
                if fk.child in new or fk.parent in new:
                    if not changes.orphans(get(fk.child), get(fk.parent), list(fk.child_columns), list(fk.parent_columns)).limit(1).isEmpty():
                        raise OrphansLeft(f"{fk.child}.{fk.name}")

        return check

    def drain_component(self, target: str, component: graph.Component, *, before_confirm=None) -> int:
        """One transaction: the oldest dirty keys of each table, current values, one commit, then confirmation."""
        store = self.targets[target]
        new, parts, dirty = {}, {}, {}
        for name in component.order:
            t, key = self._by_name[name], list(self._by_name[name].key)
            d = changes.dirty_keys(self.delta(t), self.track(t), target, self.drain_batch).checkpoint()
            if d.isEmpty():
                continue
            dirty[name] = d
            rows = self.source.read(name).select(*t.transport)
            if how := store.bucketing(name):  # only buckets that hold dirty keys are read and written
                ids = sorted(r[0] for r in d.select(bucket_of(*how)).distinct().collect())
                parts[name] = changes.apply_pass(rows, store.read(name, ids), d, key), ids
            else:
                new[name] = changes.apply_pass(rows, store.read(name), d, key)
        if not dirty:
            return 0
        store.commit(new, replace=parts, hook=self._validate(component, store))
        if before_confirm:
            before_confirm()
        done = {}
        for n, d in dirty.items():
            old = self.track(self._by_name[n])
            done[f"track_{n}"] = changes.newly_confirmed(old, d, target, self.clock())
        self.source.commit(append=done)
        return sum(d.count() for d in dirty.values())

    def drain(self, target: str, component: graph.Component) -> int:
        """Retry what only lacks a parent, each time with a fresh re-read; anything else fails at once."""
        for attempt in range(self.attempts):
            try:
                return self.drain_component(target, component)
            except OrphansLeft:
                if attempt + 1 == self.attempts:
                    raise
                self.sleep(backoff_ms(attempt) / 1000)
        return 0

    def drain_until_empty(self, target: str) -> int:
        total = 0
        for c in self.parts:
            while n := self.drain(target, c):
                total += n
        return total

    # -- retention -------------------------------------------------------------

    def backlog(self, t: TableMeta, table_bytes: int = 0) -> DataFrame:
        return retention.backlog(self.delta(t), self.track(t), list(self.targets), self.clock(), table_bytes)

    def retain(self, table_bytes: dict[str, int] | None = None) -> list[str]:
        """Purge every table against all targets; targets beyond a cap are sacrificed and reseeded.

        Nothing is written where there is nothing to purge.  A change that is
        captured meanwhile wins: the purge is left to the next pass.
        """
        lost: dict[str, set[str]] = {}
        sizes = table_bytes or {}
        for c in self.parts:
            for t in (self._by_name[n] for n in c.tables):
                n, base = sizes.get(t.name, 0), self.source.manifest()
                if self.delta(t).limit(1).isEmpty():
                    continue
                over = [r.target for r in retention.over_cap(self.backlog(t, n), self.max_age, self.max_bytes, n).collect()]
                counted = [x for x in self.targets if x not in over]
                purged = retention.consumed_by_all(self.delta(t), self.track(t), counted).count()
                if not purged and not over:
                    continue
                delta, track = retention.purge(self.delta(t), self.track(t), list(self.targets), over)
                try:
                    self.source.commit({f"delta_{t.name}": delta, f"track_{t.name}": track}, base=base)
                except Conflict:
                    continue
                self.telemetry.purged(t.name, purged)
                for target in over:
                    lost.setdefault(target, set()).update(c.tables)
        for target, names in lost.items():
            self.flag_reseed(target, names)
            self.event(target, None, "ERROR", "target.needs_reseed", f"{len(names)} tables will be copied again")
        return sorted(lost)

    def reseed(self, target: str) -> int:
        """Copy flagged components again: emptied children first, their progress forgotten with them, their track reset."""
        flagged = set(self.needs_reseed(target))
        n = 0
        for c in self.parts:
            if not flagged & set(c.tables):
                continue
            self.event(target, c.tables[0], "INFO", "reseed_started")
            base = self.source.manifest()
            self.source.commit({f"track_{x}": self.track(self._by_name[x]).where(F.col("target") != target) for x in c.tables}, base=base)
            store = self.targets[target]

            def forget(notes: dict, c=c) -> dict:
                held = notes.get(f"progress/{self.name}", {})
                notes[f"progress/{self.name}"] = {k: v for k, v in held.items() if k not in c.tables}
                return notes

            store.commit({x: store.read(x).limit(0) for x in reversed(c.order) if store.exists(x)}, note=forget)
            self.copy(target, c)
            self.cursor(target, c.tables, "streaming")
            self.event(target, c.tables[0], "INFO", "table.cutover_to_streaming", "copied again")
            self.telemetry.reseeded(target)
            n += 1
        for t in self.keyspaces:
            if t.name in flagged:  # nothing to copy: every key is looked at again
                self.state.note(lambda x, k=f"{target}/{t.name}": {**x, "scans": {a: b for a, b in x.get("scans", {}).items() if a != k}})
                self.cursor(target, [t.name], "streaming")
                n += 1
        return n

    # -- keyspaces ---------------------------------------------------------------

    def hint(self, target: str, table: str, keys: list[tuple]) -> None:
        """Keys that a lossy notification names: the next pass looks at them first."""
        self.rolling.setdefault((target, table), keyvalue.Rolling()).hint(keys)

    def reconcile(self, target: str, table: str) -> tuple[int, int]:
        """One bounded step for a keyspace: (keys looked at, keys deleted).

        Where the scans stand is kept in the state store after the target's
        commit; a step that is lost in between is done again.
        """
        t, key, store = self._by_name[table], list(self._by_name[table].key), self.targets[target]
        at = self.state.notes("scans").get(f"{target}/{table}", {})
        roll = self.rolling.setdefault((target, table), keyvalue.Rolling())
        roll.cursor = tuple(at["roll"]) if at.get("roll") else None
        sweep = keyvalue.Sweeper(tuple(at["sweep"]) if at.get("sweep") else None, at.get("passes", 0), at.get("seen", 0))
        started = at.get("started") or self.clock().isoformat()
        source, old = self.source.read(table).select(*t.transport), store.read(table)
        hints = list(roll.priority)
        page = roll.step(source, key, self.drain_batch)
        gone = sweep.step(old, source, key, self.drain_batch).checkpoint()
        fresh = changes.reread(source, page, key)
        deleted, looked = gone.count(), page.count()
        try:
            differs = changes.snapshot_diff(changes.reread(old, page, key), fresh, key).where("rc_op <> 'D'")
            if deleted or not differs.limit(1).isEmpty():
                store.commit({table: changes.upsert(old.join(gone, key, "left_anti"), fresh.select(*old.columns), key)})
        except Exception:
            roll.priority = hints
            raise
        over = sweep.passes > at.get("passes", 0)
        if over:
            lag = (self.clock() - datetime.fromisoformat(started)).total_seconds()
            self.telemetry.set("delete_reconciliation_lag_seconds", lag, target=target, table=table)
        self.telemetry.add("deletes_reconciled_total", deleted, target=target, table=table)
        new = {"roll": roll.cursor and list(roll.cursor), "sweep": sweep.cursor and list(sweep.cursor), "passes": sweep.passes, "seen": sweep.seen,
               "started": None if over else started}
        if {k: v for k, v in new.items() if k not in ("passes", "started")} != {k: v for k, v in at.items() if k not in ("passes", "started")}:
            self.state.note(lambda x: {**x, "scans": {**x.get("scans", {}), f"{target}/{table}": new}})
        return looked, deleted

    # -- the loop ----------------------------------------------------------------

    def _guard(self, target: str, category: str, step: Callable):
        """A step whose failure is recorded and left to the next pass."""
        try:
            return step()
        except Exception as e:  # noqa: BLE001
            self.telemetry.add("errors_total", 1, category=category)
            self.event(target, None, "ERROR", f"{category}_error", str(e)[:500])
            return None

    def run_pass(self) -> dict[str, int]:
        """Drain every target, then retention whatever happened, then gauges, sweeps and reseeds of healthy targets."""
        out = {}
        for target in self.targets:
            started = time.time()
            try:
                out[target] = sum(self.drain(target, c) for c in self.parts)
                self.telemetry.batch(target, time.time() - started, out[target])
            except Exception as e:  # noqa: BLE001 - a failing target must not stop the others; it stays dirty
                out[target] = -1
                self.telemetry.add("errors_total", 1, category="drain")
                if self._reachable(target):
                    self.event(target, None, "ERROR", "drain_error", str(e)[:500])
                elif target not in self._down:  # told once, until it is back
                    self._down.add(target)
                    self.event(target, None, "WARN", "target.unreachable", str(e)[:500])
            self.telemetry.set("target_up", float(out[target] >= 0 or self._reachable(target)), target=target)
            if out[target] >= 0 and target in self._down:
                self._down.discard(target)
                self.event(target, None, "INFO", "target.recovered")
        self._guard("", "retention", self.retain)
        for target in self.targets:
            if out[target] < 0:
                continue
            self._guard(target, "gauges", lambda t=target: self.gauges(t, out[t] > 0))
            self._guard(target, "state", lambda t=target: self.touch(t))
            for t in self.keyspaces:
                self._guard(target, "delete_sweep", lambda a=target, b=t.name: self.reconcile(a, b))
            self._guard(target, "reseed", lambda t=target: self.reseed(t))
        return out

    def gauges(self, target: str, worked: bool = True) -> None:
        """Backlog, lag and phase of a target's tables; a backlog near its cap is told."""
        phase = {x["table_name"]: x["phase"] for x in self.state.notes("cursors").values() if x["sync"] == self.name and x["target"] == target}
        for c in self.parts:
            for t in (self._by_name[n] for n in c.tables):
                self.telemetry.phase(t.name, phase.get(t.name, "initial_copy"))
                b = retention.backlog(self.delta(t), self.track(t), [target], self.clock())
                for r in b.join(retention.proximity(b, self.max_age, self.max_bytes), "target").collect():
                    of = {"target": target, "table": t.name}
                    self.telemetry.set("delta_backlog_rows", r.rows, **of)
                    self.telemetry.set("delta_backlog_bytes", r.bytes, **of)
                    self.telemetry.set("delta_oldest_unconsumed_age_seconds", r.oldest_age, **of)
                    self.telemetry.set("replication_lag_seconds", r.oldest_age, **of)
                    if r.level != "INFO":
                        self.event(target, t.name, r.level, "retention.cap_approaching", f"{r.proximity:.2f} of the cap")

    def tidy(self) -> None:
        """Between passes: fold what many small commits left, delete what nothing names."""
        self.state.fold_log("events", EVENTS)
        for t in self.tables:
            for table in (f"delta_{t.name}", f"track_{t.name}"):
                self.source.compact(table)
        for store in [self.source, self.state, *self.targets.values()]:
            store.vacuum(self.vacuum_age)

    def _reachable(self, target: str) -> bool:
        try:
            self.targets[target].manifest()
        except Exception:  # noqa: BLE001
            return False
        return True

    def run(self, *, interval: float = 1.0, stop: Callable[[], bool] = lambda: False, tidy_every: int = 100) -> None:
        """Passes until asked to stop, for as long as the sync's lock is held; a pass is never cut short."""
        passes = 0
        with self.state.lock(self.name) as held:
            while not stop():
                if not held():
                    raise RuntimeError(f"the lock of {self.name} was lost")
                self.run_pass()
                passes += 1
                if passes % tidy_every == 0:
                    self._guard("", "tidy", self.tidy)
                self.sleep(interval)
