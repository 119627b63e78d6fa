"""Scalar functions: sizes, durations, environment, versions, ages, keys, codecs.

Those that meet data are Spark expressions; those that only read configuration
or report to people are plain Python.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units and duration units in use.
BYTE_UNITS = {"TIB": 1 << 40, "GIB": 1 << 30, "MIB": 1 << 20, "KIB": 1 << 10, "TB": 10**12, "GB": 10**9, "MB": 10**6, "KB": 10**3, "B": 1, "": 1}
TIME_UNITS = {"h": 3_600_000_000_000, "m": 60_000_000_000, "s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "µs": 1_000, "ns": 1}
MAX_INT64 = (1 << 63) - 1
_SIZE = r"^\s*([0-9]*\.?[0-9]+|[0-9]+\.)\s*([KMGT]I?B|B|)\s*$"


def byte_size(text: str | int) -> int:
    """Bytes of '10GB', '2 KiB', 1024; sizes below zero and anything else raise."""
    m = re.match(_SIZE, str(text).upper())
    if not m or (not m[2] and "." in m[1]):
        raise ValueError(f"invalid byte size {text!r}")
    n = int(Decimal(m[1]) * BYTE_UNITS[m[2]])
    if n > MAX_INT64:
        raise ValueError(f"byte size {text!r} is out of range")
    return n


def byte_size_column(text: Column) -> Column:
    """The same per row; null where the text is no size."""
    s = F.upper(text)
    number, unit = F.regexp_extract(s, _SIZE, 1), F.regexp_extract(s, _SIZE, 2)
    units = F.create_map(*[F.lit(x) for k, v in BYTE_UNITS.items() for x in (k, v)])
    plain = (unit == "") & F.contains(number, F.lit("."))
    value = F.try_multiply(number.try_cast("decimal(28,9)"), units[unit].cast("decimal(19,0)"))
    return F.when((number != "") & ~plain, value.try_cast("bigint"))


def duration_ns(text: str) -> int:
    """Nanoseconds of '1h30m', '500ms', '-2s'; a bare number raises, except 0."""
    s = str(text).strip()
    if not isinstance(text, str) or not re.fullmatch(r"[+-]?(?:0|(?:(?:\d+\.?\d*|\.\d+)(?:ns|us|µs|ms|s|m|h))+)", s):
        raise ValueError(f"invalid duration {text!r}")
    total = sum(Decimal(n) * TIME_UNITS[u] for n, u in re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)", s))
    return int(-total if s.startswith("-") else total)


def expand_env(text: str, env: dict[str, str]) -> str:
    """${V}, ${V:-default} and the escape $${; a name without a value raises."""

    def put(m: re.Match) -> str:
        if m[0].startswith("$$"):
            return "${"
        name, has, default = m[1].partition(":-")
        if not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise ValueError(f"invalid variable name {name!r}")
        value = env.get(name)
        if value is None or (has and not value):
            if not has:
                raise ValueError(f"environment variable {name} is not set")
            return default
        return value

    out = re.sub(r"\$\$\{|\$\{([^}]*)\}", put, text)
    if re.search(r"\$\{[^}]*$", re.sub(r"\$\$\{", "", text)):
        raise ValueError("unclosed ${")
    return out


def version_number(text: Column) -> Column:
    """major * 10000 + minor * 100 + patch of '8.0.36-log'; missing parts are 0."""
    s = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)*)", 1)
    part = lambda i: F.coalesce(F.try_element_at(F.split(s, r"\."), F.lit(i)).try_cast("int"), F.lit(0))
    return F.when(s != "", part(1) * 10000 + part(2) * 100 + part(3))


def vendor(text: Column) -> Column:
    """Which server a version banner names; only some are supported."""
    t = F.lower(text)
    has = lambda w: F.contains(t, F.lit(w))
    return F.when(has("mariadb"), "mariadb").when(has("dragonfly"), "dragonfly").when(has("valkey"), "valkey").when(has("keydb"), "keydb").otherwise("standard")


def vendor_supported(text: Column) -> Column:
    return ~vendor(text).isin("mariadb", "dragonfly")


def age_seconds(now: Column, then: Column) -> Column:
    """Seconds from then to now, at microsecond precision, never below 0."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.greatest(F.lit(0.0), (us(now) - us(then)) / F.lit(1_000_000.0))


def human_age(seconds: Column) -> Column:
    s = F.floor(seconds)
    return (
        F.when(seconds.isNull(), "-")
        .when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm%ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh%dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
    )


def escalation(proximity: Column) -> Column:
    return F.when(proximity < 0.5, "INFO").when(proximity < 0.9, "WARN").otherwise("ERROR")


def live_ttl(ttl_ms: Column) -> Column:
    """TTL to restore with: none for keys that never expire, 1 ms for less than one."""
    return F.when(ttl_ms.isNull() | (ttl_ms < 0), F.lit(0)).when(ttl_ms < 1, F.lit(1)).otherwise(ttl_ms).cast("bigint")


def absolute_ttl(ttl_ms: Column, now_ms: Column) -> Column:
    t = live_ttl(ttl_ms)
    return F.when(t == 0, t).otherwise(now_ms + t)


def info_field(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf"(?m)^{re.escape(name)}:([^\r\n]*)", 1)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def fnv1a64(text: str) -> int:
    """Signed 64-bit FNV-1a, a lock's number from its name."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


def backoff_ms(attempt: int, base: int = 200, cap: int = 5000) -> int:
    return min(base << attempt, cap)


def host_port(text: str, default: int) -> tuple[str, int]:
    host, sep, port = text.strip().rpartition(":")
    return (host.strip("[]"), int(port)) if sep and port.isdigit() else (text.strip().strip("[]"), default)


# TLS modes by the options of two public JDBC drivers.
TLS_MODES = {
    "disable": ("disable", "DISABLED"), "allow": ("allow", "PREFERRED"), "prefer": ("prefer", "PREFERRED"), "require": ("require", "REQUIRED"),
    "verify-ca": ("verify-ca", "VERIFY_CA"), "verify-full": ("verify-full", "VERIFY_IDENTITY"),
}


def tls_option(mode: str, dialect: str) -> dict[str, str]:
    """The JDBC option for a TLS mode; an unknown mode raises."""
    if mode not in TLS_MODES:
        raise ValueError(f"unknown TLS mode {mode!r}")
    pg, my = TLS_MODES[mode]
    return {"sslmode": pg} if dialect == "pg" else {"sslMode": my}


def csv_list(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def quote_name(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts if p)


def key_json(*cols: str) -> Column:
    """A key tuple as JSON; integers stay exact because fields keep their types."""
    return F.to_json(F.struct(*cols))


# The escapes of tab-separated text, backslash first.
TSV_ESCAPES = [("\\", "\\\\"), ("\0", "\\0"), ("\b", "\\b"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\x1a", "\\Z")]


def tsv_field(c: Column) -> Column:
    s = c.cast("string")
    for raw, escaped in TSV_ESCAPES:
        s = F.replace(s, F.lit(raw), F.lit(escaped))
    return F.coalesce(s, F.lit("\\N"))


def tsv_line(*cols: str) -> Column:
    return F.concat_ws("\t", *[tsv_field(F.col(c)) for c in cols])


def tsv_parse(line: Column, names: list[str]) -> list[Column]:
    """Fields of a line as strings; the inverse of :func:`tsv_line`.

    Doubled backslashes are split off first, so that what follows one is not
    taken for an escape.
    """

    def plain(part: Column) -> Column:
        for raw, escaped in TSV_ESCAPES[1:]:
            part = F.replace(part, F.lit(escaped), F.lit(raw))
        return part

    out = []
    for i, n in enumerate(names):
        field = F.element_at(F.split(line, "\t", -1), i + 1)
        value = F.array_join(F.transform(F.split(field, r"\\\\", -1), plain), "\\")
        out.append(F.when(field == "\\N", F.lit(None).cast("string")).otherwise(value).alias(n))
    return out


def frame(cols: list[str]) -> Column:
    """Length-prefixed binary record: each field a 4-byte big-endian length and its bytes; null has length -1."""
    be = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    one = lambda c: F.when(F.col(c).isNull(), F.unhex(F.lit("FFFFFFFF"))).otherwise(
        F.concat(be(F.octet_length(F.col(c).cast("binary"))), F.col(c).cast("binary")))
    return F.concat(*[one(c) for c in cols])


def unframe(data: bytes) -> list[bytes | None]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big", signed=True)
        at += 4
        if n >= 0 and at + n > len(data):
            raise ValueError("truncated record")
        out.append(None if n < 0 else data[at : at + n])
        at += max(0, n)
    return out
