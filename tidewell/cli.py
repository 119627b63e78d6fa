"""Commands: validate, run, status, capture-install, capture-remove, reseed, version.

``python -m tidewell.cli COMMAND --config FILE [--sync NAME]``: the file names
sources, targets, the state store and syncs (see :mod:`tidewell.plans.config`).
An endpoint of engine ``store`` has a ``path``; a source also names the file
that declares its tables (``tables``: keys, references, generated columns).
``--root FOLDER --tables FILE`` is the short form for stores side by side.
Exit codes: 0 fine, 1 blocked or failed, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tidewell.plans import preflight, registry, status
from tidewell.plans.config import Config, Sync, load
from tidewell.plans.engine import Syncer
from tidewell.sources.catalog import Catalog, ForeignKey, introspect
from tidewell.sources.store import Locked, Store

VERSION = "0.2.0"


def _tables(source: Store, path: str) -> Catalog:
    import yaml

    with open(path) as f:
        declared = yaml.safe_load(f) or {}
    metas = {}
    for name, d in declared.items():
        fks = tuple(ForeignKey(k["name"], name, tuple(k["columns"]), k["parent"], tuple(k["parent_columns"]), k.get("deferrable", False)) for k in d.get("foreign_keys", []))
        metas[name] = introspect(name, source.read(name), key=d.get("key", []), foreign_keys=fks, generated=d.get("generated", []), storage=d.get("storage", "default"))
    return Catalog(metas)


def _short(a: argparse.Namespace) -> tuple[Config, str]:
    """The configuration that ``--root`` stands for."""
    at = lambda n: {"engine": "store", "path": f"{a.root}/{n}"}
    sync = Sync(a.sync or "default", "source", list(a.targets), a.include or [], a.exclude or [], 0, 0, 0)
    return Config({"source": {**at("source"), "tables": a.tables}}, {t: at(f"target_{t}") for t in a.targets}, [sync], at("state")), sync.name


def _syncer(spark: SparkSession, config: Config, sync: Sync) -> Syncer:
    side = config.sources[sync.source]
    source = registry.connect(spark, side)
    chosen = _tables(source, side["tables"]).select(sync.include, sync.exclude)
    targets = {t: registry.connect(spark, config.targets[t]) for t in sync.targets}
    tuning = {"chunk_rows": sync.chunk_rows, "drain_batch": sync.drain_batch, "max_age": sync.max_age_ns / 1e9, "max_bytes": sync.max_bytes}
    return Syncer(spark, sync.name, source, registry.connect(spark, {"engine": "store", **config.state}), targets, chosen, **tuning)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewell")
    p.add_argument("command", choices=["validate", "run", "status", "capture-install", "capture-remove", "reseed", "version"])
    p.add_argument("--config")
    p.add_argument("--root")
    p.add_argument("--tables")
    p.add_argument("--sync")
    p.add_argument("--targets", nargs="+", default=["a"])
    p.add_argument("--include", nargs="*")
    p.add_argument("--exclude", nargs="*")
    p.add_argument("--passes", type=int, default=1, help="passes of run; 0: until interrupted")
    p.add_argument("--port", type=int, help="serve /metrics, /status and /healthz while running")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    if a.command == "version":
        print(VERSION)
        return 0
    if not a.config and not (a.root and a.tables):
        print("--config, or --root and --tables, are needed", file=sys.stderr)
        return 2
    try:
        if a.config:
            with open(a.config) as f:
                config = load(f.read())
            name = a.sync or config.syncs[0].name
        else:
            config, name = _short(a)
        sync = next(s for s in config.syncs if s.name == name)
    except (OSError, ValueError, IndexError, StopIteration) as e:
        print(f"configuration: {e or 'no such sync'}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("tidewell").getOrCreate()
    s = _syncer(spark, config, sync)
    if a.command == "validate":
        worst = 0
        for target, store in s.targets.items():
            found = preflight.findings(spark, s.tables, [introspect(t.name, store.read(t.name), key=t.key) for t in s.tables if store.exists(t.name)])
            print(preflight.render(found))
            if preflight.blocked(found):
                s.event(target, None, "ERROR", "preflight.blocked")
                worst = 1
        return worst
    if a.command == "capture-install":
        print(f"captured {len(s.install_capture())} tables, skipped {len(s.skipped)} without a key")
    elif a.command == "capture-remove":
        print(f"removed {s.remove_capture()} tables")
    elif a.command == "run":
        return _run(s, a, sync)
    elif a.command == "reseed":
        for t in sync.targets:
            s.flag_reseed(t, [x.name for x in s.tables])
    else:
        _report(s).show(truncate=False)
        status.recent_events(s.events()).show(truncate=False)
    return 0


def _report(s: Syncer):
    track = None
    for t in s.tables:
        one = s.track(t).selectExpr(f"'{t.name}' AS table_name", "target", "delta_id")
        track = one if track is None else track.unionByName(one)
    return status.report(s.progress(), s.cursors().where(f"sync = '{s.name}'"), track, s.clock())


def _run(s: Syncer, a: argparse.Namespace, sync: Sync) -> int:
    server = None
    if a.port is not None:
        rows = lambda: [json.loads(r) for r in _report(s).toJSON().collect()]
        server = status.serve(a.port, s.telemetry.text, rows, lambda: any(s._reachable(t) for t in s.targets))
    try:
        s.bring_up()
        left = iter(range(a.passes))
        s.run(stop=lambda: a.passes > 0 and next(left, None) is None, interval=sync.drain_interval_ns / 1e9)
    except Locked as e:
        print(e, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        pass
    finally:
        if server:
            server.shutdown()
    return 0


if __name__ == "__main__":
    sys.exit(main())
