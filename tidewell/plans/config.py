"""Configuration: strict YAML with sizes, durations and environment references."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from tidewell.functions.scalars import byte_size, duration_ns, expand_env

# Defaults of a sync.
DRAIN_INTERVAL, MAX_AGE, CONNECTIONS, CHUNK_ROWS, DRAIN_BATCH = "1s", "24h", 4, 10_000, 1_000


@dataclass
class Sync:
    name: str
    source: str
    targets: list[str]
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    drain_interval_ns: int = 0
    max_age_ns: int = 0
    max_bytes: int = 0
    source_connections: int = CONNECTIONS
    target_connections: int = CONNECTIONS
    chunk_rows: int = CHUNK_ROWS
    drain_batch: int = DRAIN_BATCH


@dataclass
class Config:
    sources: dict[str, dict]
    targets: dict[str, dict]
    syncs: list[Sync]
    state: dict = field(default_factory=dict)
    log_level: str = "info"
    log_format: str = "json"


def _only(d: dict | None, where: str, *known: str) -> dict:
    d = d or {}
    if extra := set(d) - set(known):
        raise ValueError(f"{where}: unknown fields {sorted(extra)}")
    return d


def load(text: str, env: dict[str, str] | None = None) -> Config:
    import yaml

    raw = yaml.safe_load(expand_env(text, dict(os.environ) if env is None else env)) or {}
    _only(raw, "config", "logging", "observability", "state_store", "sources", "targets", "syncs")
    log = _only(raw.get("logging"), "logging", "level", "format")
    _only(raw.get("observability"), "observability", "metrics_addr", "status_addr", "otlp_endpoint")
    sources, targets = raw.get("sources") or {}, raw.get("targets") or {}
    for side in (sources, targets):
        for name, e in side.items():
            if not isinstance(e, dict) or "engine" not in e:
                raise ValueError(f"endpoint {name} names no engine")
    syncs, names = [], set()
    for s in raw.get("syncs") or []:
        _only(s, "sync", "name", "source", "targets", "include", "exclude", "tuning")
        tune = _only(s.get("tuning"), "tuning", "drain_interval", "retention", "pool", "chunk_rows", "drain_batch")
        keep = _only(tune.get("retention"), "retention", "max_age", "max_bytes")
        pool = _only(tune.get("pool"), "pool", "max_source_connections", "max_target_connections")
        if not s.get("name") or s["name"] in names:
            raise ValueError(f"a sync needs a name of its own: {s.get('name')!r}")
        names.add(s["name"])
        if s.get("source") not in sources:
            raise ValueError(f"{s['name']}: unknown source {s.get('source')!r}")
        if not s.get("targets") or (bad := [t for t in s["targets"] if t not in targets]):
            raise ValueError(f"{s['name']}: unknown targets {bad if s.get('targets') else []}")
        kinds = {sources[s["source"]]["engine"], *(targets[t]["engine"] for t in s["targets"])}
        if len(kinds) > 1:
            raise ValueError(f"{s['name']}: source and targets must be of one engine, not {sorted(kinds)}")
        syncs.append(Sync(
            s["name"], s["source"], list(s["targets"]), list(s.get("include") or []), list(s.get("exclude") or []),
            duration_ns(tune.get("drain_interval", DRAIN_INTERVAL)), duration_ns(keep.get("max_age", MAX_AGE)), byte_size(keep.get("max_bytes", 0)),
            int(pool.get("max_source_connections", CONNECTIONS)), int(pool.get("max_target_connections", CONNECTIONS)),
            int(tune.get("chunk_rows", CHUNK_ROWS)), int(tune.get("drain_batch", DRAIN_BATCH))))
    return Config(sources, targets, syncs, raw.get("state_store") or {}, log.get("level", "info"), log.get("format", "json"))
