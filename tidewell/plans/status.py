"""Status reports over the state tables, and the metric and event vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import age_seconds

# Phases, event names, metric names with their kinds and labels that operators see.
PHASES = ["initial_copy", "streaming"]
EVENTS = ["target.unreachable", "target.recovered", "target.needs_reseed", "retention.cap_approaching", "preflight.blocked", "capture.installed",
          "capture.removed", "table.cutover_to_streaming"]
METRICS = {
    "rows_copied_total": ("counter", ["sync", "table"]),
    "initial_copy_rows_target": ("gauge", ["sync", "table"]),
    "throughput_rows_per_second": ("gauge", ["sync"]),
    "replication_lag_seconds": ("gauge", ["sync", "target", "table"]),
    "delta_backlog_rows": ("gauge", ["sync", "target", "table"]),
    "delta_backlog_bytes": ("gauge", ["sync", "target", "table"]),
    "delta_oldest_unconsumed_age_seconds": ("gauge", ["sync", "target", "table"]),
    "delta_purged_total": ("counter", ["sync", "table"]),
    "reseed_total": ("counter", ["sync", "target"]),
    "target_up": ("gauge", ["sync", "target"]),
    "apply_batch_seconds": ("histogram", ["sync", "target"]),
    "errors_total": ("counter", ["sync", "category"]),
    "table_phase_info": ("gauge", ["sync", "table", "phase"]),
    "delete_reconciliation_lag_seconds": ("gauge", ["sync", "target", "table"]),
    "deletes_reconciled_total": ("counter", ["sync", "target", "table"]),
}
#: Upper ends of the latency histogram's buckets, in seconds.
BUCKETS = [0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60]


def histogram(df: DataFrame, seconds: str) -> DataFrame:
    """Cumulative bucket counts (le, n) of a column of durations; the last bucket, null, has all."""
    counts = df.agg(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(seconds) <= b).alias("n")) for b in BUCKETS],
                            F.struct(F.lit(None).cast("double").alias("le"), F.count(seconds).alias("n"))).alias("x"))
    return counts.select(F.explode("x").alias("x")).select("x.*")


class Telemetry:
    """The metrics of a sync, kept by the process that runs it."""

    def __init__(self, sync: str):
        self.sync = sync
        self.values: dict[tuple[str, tuple], float] = {}
        self.observed: dict[str, list[float]] = {}  # by target: a count for each bucket, of all, and the sum

    def _key(self, name: str, labels: dict) -> tuple[str, tuple]:
        known = METRICS[name][1]
        return name, tuple((k, str({"sync": self.sync, **labels}[k])) for k in known)

    def set(self, name: str, value: float, **labels) -> None:
        self.values[self._key(name, labels)] = float(value)

    def add(self, name: str, value: float, **labels) -> None:
        k = self._key(name, labels)
        self.values[k] = self.values.get(k, 0.0) + value

    def copied(self, table: str, rows: int, seconds: float) -> None:
        self.add("rows_copied_total", rows, table=table)
        self.set("throughput_rows_per_second", throughput(rows, seconds))

    def purged(self, table: str, rows: int) -> None:
        self.add("delta_purged_total", rows, table=table)

    def reseeded(self, target: str) -> None:
        self.add("reseed_total", 1, target=target)

    def batch(self, target: str, seconds: float, rows: int) -> None:
        seen = self.observed.setdefault(target, [0.0] * (len(BUCKETS) + 2))
        for i, b in enumerate(BUCKETS):
            seen[i] += seconds <= b
        seen[-2] += 1
        seen[-1] += seconds
        if rows:
            self.set("throughput_rows_per_second", throughput(rows, seconds))

    def phase(self, table: str, phase: str) -> None:
        for p in PHASES:
            self.set("table_phase_info", float(p == phase), table=table, phase=p)

    def text(self) -> str:
        """Metrics as text for a scraper."""
        out = []
        for name, (kind, _) in METRICS.items():
            rows = sorted((k[1], v) for k, v in self.values.items() if k[0] == name)
            if kind == "histogram":
                for target, seen in sorted(self.observed.items()):
                    label = f'sync="{self.sync}",target="{target}"'
                    rows += [(f'{name}_bucket{{{label},le="{b:g}"}}', n) for b, n in zip(BUCKETS, seen)]
                    rows += [(f'{name}_bucket{{{label},le="+Inf"}}', seen[-2]), (f"{name}_sum{{{label}}}", seen[-1]), (f"{name}_count{{{label}}}", seen[-2])]
            if rows:
                out.append(f"# TYPE {name} {kind}")
                out += [f"{k} {v:g}" if isinstance(k, str) else f"{name}{{{','.join(f'{a}={chr(34)}{b}{chr(34)}' for a, b in k)}}} {v:g}" for k, v in rows]
        return "\n".join([*out, ""])


def report(progress: DataFrame, cursors: DataFrame, track: DataFrame, now) -> DataFrame:
    """One row per table known from either side: copy state and its targets' cursors.

    The last confirmed delta is computed from track, which is what was confirmed.
    """
    last = track.groupBy("table_name", "target").agg(F.max("delta_id").alias("last_delta"))
    c = cursors.join(last, ["table_name", "target"], "left").select(
        "table_name",
        F.struct("target", "phase", F.coalesce("last_delta", F.lit(0)).alias("last_delta"), "needs_reseed",
                 age_seconds(F.lit(now).cast("timestamp"), F.col("updated_at")).alias("cursor_age")).alias("t"))
    c = c.groupBy("table_name").agg(F.array_sort(F.collect_list("t")).alias("targets"))
    p = progress.groupBy("table_name").agg(F.min("done").alias("copy_done"))
    return p.join(c, "table_name", "full").select(
        "table_name", F.coalesce("copy_done", F.lit(False)).alias("copy_done"),
        F.coalesce("targets", F.array().cast(c.schema["targets"].dataType)).alias("targets"))


def recent_events(events: DataFrame, n: int = 20) -> DataFrame:
    return events.orderBy(F.desc("id")).limit(n)


def throughput(consumed: int, seconds: float) -> float:
    return consumed / seconds if seconds > 0 else 0.0


def serve(port: int, metrics, report_rows, healthy=lambda: True):
    """A small HTTP server with /metrics, /status and /healthz; the arguments are functions."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            ok = healthy()
            pages = {"/metrics": metrics, "/status": lambda: json.dumps(report_rows(), default=str), "/healthz": lambda: "ok" if ok else "failing"}
            code = 404 if self.path not in pages else 503 if self.path == "/healthz" and not ok else 200
            body = pages[self.path]().encode() if code != 404 else b""
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a) -> None:
            pass

    server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
