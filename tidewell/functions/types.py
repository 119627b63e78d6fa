"""Column type compatibility as Spark expressions over pairs of type strings.

A pair is identical, widening, risky or incompatible.  Families are small
literal maps, rules are ``when`` chains: a whole catalog is classified in one
projection, without a join or Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ["identical", "widening", "risky", "incompatible"]

# Type names of the first dialect by family, and their widths.
PG_FAMILIES = {
    "integer": "smallint int2 integer int int4 bigint int8".split(),
    "numeric": ["numeric", "decimal"],
    "float": ["real", "float4", "double precision", "float8"],
    "text": ["text", "character varying", "varchar", "character", "char", "bpchar", '"char"'],
    "boolean": ["boolean", "bool"],
    "uuid": ["uuid"],
    "date": ["date"],
    "timestamp": ["timestamp without time zone", "timestamp"],
    "timestamptz": ["timestamp with time zone", "timestamptz"],
    "time": ["time without time zone", "time"],
    "timetz": ["time with time zone", "timetz"],
    "json": ["json"],
    "jsonb": ["jsonb"],
    "bytea": ["bytea"],
    "interval": ["interval"],
}
PG_WIDTH = {"smallint": 16, "int2": 16, "integer": 32, "int": 32, "int4": 32, "bigint": 64, "int8": 64,
            "real": 32, "float4": 32, "double precision": 64, "float8": 64}
PG_PAIRS = {
    "widening": ["date>timestamp", "json>jsonb", "jsonb>json"],
    "risky": ["integer>float", "numeric>integer", "numeric>float", "float>numeric", "float>integer", "date>timestamptz",
              "timestamp>timestamptz", "timestamptz>timestamp", "timestamp>date", "timestamptz>date", "time>timetz", "timetz>time"],
}

# The same for the second dialect.
MY_FAMILIES = {
    "int": "tinyint smallint mediumint int integer bigint".split(),
    "decimal": "decimal numeric dec fixed".split(),
    "float": "float double real".split(),
    "bit": ["bit"],
    "char": ["char", "varchar"],
    "text": "tinytext text mediumtext longtext".split(),
    "binary": ["binary", "varbinary"],
    "blob": "tinyblob blob mediumblob longblob".split(),
    **{t: [t] for t in "date time datetime timestamp year enum set json".split()},
}
MY_RANK = {"tinyint": 1, "smallint": 2, "mediumint": 3, "int": 4, "integer": 4, "bigint": 5,
           "tinytext": 1, "text": 2, "mediumtext": 3, "longtext": 4, "tinyblob": 1, "blob": 2, "mediumblob": 3, "longblob": 4}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _family(base: Column, families: dict[str, list[str]], other: str) -> Column:
    return F.coalesce(_map({t: f for f, ts in families.items() for t in ts})[base], F.lit(other))


_MODS = r"\(\s*([0-9]+(?:\s*,\s*[0-9]+)*)\s*\)"


def pg_parse(t: Column) -> dict[str, Column]:
    """base, family, has (modifiers), m0, m1 of a canonical type string."""
    s = F.lower(F.trim(t))
    mods = F.regexp_extract(s, _MODS, 1)
    base = F.trim(F.regexp_replace(F.regexp_replace(s, _MODS, ""), r"\s+", " "))
    at = lambda i: F.regexp_extract(mods, r"^\s*([0-9]+)\s*(?:,\s*([0-9]+))?", i)
    number = lambda c: F.when(c != "", c.cast("int"))
    return {"base": base, "family": _family(base, PG_FAMILIES, "other"), "has": mods != "", "m0": number(at(1)), "m1": number(at(2))}


def pg_level(source: Column, target: Column) -> Column:
    s, t = pg_parse(source), pg_parse(target)
    width = _map(PG_WIDTH)
    limit = lambda p: (  # noqa: E731  -1: no limit
        F.when(p["base"].isin("character", "char", "bpchar"), F.coalesce(p["m0"], F.lit(1)))
        .when(p["base"].isin("character varying", "varchar"), F.coalesce(p["m0"], F.lit(-1)))
        .otherwise(F.lit(-1))
    )
    good = lambda c: F.when(c, "widening").otherwise("risky")
    zero = F.lit(0)
    to_text = good((limit(t) < 0) | ((s["family"] == "text") & (limit(s) >= 0) & (limit(s) <= limit(t))))
    numeric = good(
        ~t["has"] | (s["has"] & (t["m0"] >= s["m0"]) & (F.coalesce(t["m1"], zero) >= F.coalesce(s["m1"], zero)))
    )
    same = (
        F.when(s["family"].isin("integer", "float"), good(width[t["base"]] >= width[s["base"]]))
        .when(s["family"] == "numeric", numeric)
        .when(s["family"].isin("timestamp", "timestamptz", "time", "timetz"), good(F.coalesce(t["m0"], F.lit(6)) >= F.coalesce(s["m0"], F.lit(6))))
        .when(s["family"] == "other", "risky")
        .otherwise("widening")
    )
    pair = F.concat(s["family"], F.lit(">"), t["family"])
    cross = (
        F.when(pair == "integer>numeric", good(~t["has"] | ((F.coalesce(t["m1"], zero) == 0) & (t["m0"] >= 19))))
        .when(pair.isin(PG_PAIRS["widening"]), "widening")
        .when(pair.isin(PG_PAIRS["risky"]), "risky")
        .when((s["family"] == "other") | (t["family"] == "other"), "risky")
        .otherwise("incompatible")
    )
    return (
        F.when(source == target, "identical")
        .when(t["family"] == "text", to_text)
        .when(s["family"] == t["family"], same)
        .otherwise(cross)
    )


def my_parse(t: Column) -> dict[str, Column]:
    """raw, base, family, unsigned, a0, a1 (null without arguments)."""
    raw = F.trim(F.lower(t))
    base = F.regexp_extract(raw, r"^([^ (]*)", 1)
    inner = F.regexp_extract(raw, r"^[^ (]*\(([^)]*)", 1)
    arg = lambda i: F.regexp_extract(inner, r"^\s*([0-9]+)\s*(?:,\s*([0-9]+)\s*)?", i)
    number = lambda c: F.when(c != "", c.cast("int"))
    return {"raw": raw, "base": base, "family": _family(base, MY_FAMILIES, "geometry-or-other"),
            "unsigned": F.contains(raw, F.lit("unsigned")), "a0": number(arg(1)), "a1": number(arg(2))}


def my_level(source: Column, target: Column) -> Column:
    s, t = my_parse(source), my_parse(target)
    rank = _map(MY_RANK)
    good = lambda c: F.when(c, "widening").otherwise("risky")
    arg = lambda p, k, d: F.coalesce(p[k], F.lit(d))
    fam = s["family"]
    same = (
        F.when(fam == "int", good((s["unsigned"] == t["unsigned"]) & (rank[t["base"]] >= rank[s["base"]])))
        .when(fam == "decimal", good((arg(t, "a0", 10) >= arg(s, "a0", 10)) & (arg(t, "a1", 0) >= arg(s, "a1", 0))))
        .when(fam == "float", F.when((s["base"] == "float") & t["base"].isin("double", "real"), "widening")
              .when(s["base"] == t["base"], "identical").otherwise("risky"))
        .when(fam.isin("char", "binary", "datetime", "timestamp", "time"), good(arg(t, "a0", 0) >= arg(s, "a0", 0)))
        .when(fam.isin("text", "blob"), good(rank[t["base"]] >= rank[s["base"]]))
        .when(fam.isin("enum", "set"), "risky")
        .otherwise("identical")
    )
    has = lambda *names: (fam.isin(*names), t["family"].isin(*names))
    numbers, strings, octets = has("int", "decimal", "float", "bit"), has("char", "text"), has("binary", "blob")
    times, members, opaque = has("date", "time", "datetime", "timestamp", "year"), has("enum", "set"), has("json", "geometry-or-other")
    cross = (
        F.when(numbers[0] & numbers[1], "risky")
        .when((strings[0] & strings[1]) | (octets[0] & octets[1]), "widening")
        .when(times[0] & times[1], "risky")
        .when((members[0] & strings[1]) | (strings[0] & members[1]), "risky")
        .when(opaque[0] | opaque[1] | members[0] | members[1], "incompatible")
        .when(strings[1], "risky")
        .otherwise("incompatible")
    )
    return F.when(s["raw"] == t["raw"], "identical").when(fam == t["family"], same).otherwise(cross)


# What a risky change may lose, by the family of the target.
LOSES = {
    "integer": "range or fraction", "numeric": "digits", "float": "precision", "text": "length", "timestamp": "fractional seconds or the zone",
    "timestamptz": "fractional seconds, or assumes a zone", "time": "fractional seconds or the zone", "timetz": "fractional seconds, or assumes a zone", "date": "the time of day",
    "int": "sign, range or fraction", "decimal": "digits", "bit": "range", "char": "length", "binary": "length", "blob": "length",
    "datetime": "fractional seconds", "year": "month and day", "enum": "members", "set": "members",
}


def reason(source: Column, target: Column, level: Column, parse=pg_parse) -> Column:
    """Why a pair has its level, in words; empty for equal types."""
    s, t = parse(source), parse(target)
    to = F.concat(source, F.lit(" to "), target)
    loses = F.coalesce(_map(LOSES)[t["family"]], F.lit("what the other type does not know"))
    return (
        F.when(level == "identical", "")
        .when(level == "widening", F.concat(to, F.lit(": every value fits")))
        .when(level == "risky", F.concat(to, F.lit(" may lose "), loses))
        .otherwise(F.concat(to, F.lit(": "), s["family"], F.lit(" values are no "), t["family"], F.lit(" values")))
    )


def charset_level(source: Column, target: Column) -> Column:
    """Character set change; an unknown side counts as no change."""
    fold = lambda c: F.when(F.lower(c) == "utf8", "utf8mb3").otherwise(F.lower(F.coalesce(c, F.lit(""))))
    s, t = fold(source), fold(target)
    return F.when((s == "") | (t == "") | (s == t), "identical").when((s == "utf8mb3") & (t == "utf8mb4"), "widening").otherwise("risky")


def worst(*levels: Column) -> Column:
    rank = F.greatest(*[F.array_position(F.lit(LEVELS), x) for x in levels])
    return F.element_at(F.lit(LEVELS), rank.cast("int"))
