"""Vectors for globs, type rules, sizes, durations, versions, codecs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewell.functions import globs, scalars, types

def matches(pattern: str, text: str) -> bool:
    """A key glob by recursion over both strings; what the regular expression has to agree with."""
    if not pattern:
        return not text
    c = pattern[0]
    if c == "*":
        return any(matches(pattern[1:], text[i:]) for i in range(len(text) + 1))
    if c == "[":
        end, members, i = len(pattern), set(), 1
        no = pattern[1:2] == "^"
        i += no
        while i < len(pattern):
            if pattern[i] == "]":
                end = i + 1
                break
            if pattern[i] == "\\" and i + 1 < len(pattern):
                members.add(pattern[i + 1])
                i += 2
            elif pattern[i + 1 : i + 2] == "-" and i + 2 < len(pattern) and pattern[i + 2] != "]":
                lo, hi = sorted(pattern[i : i + 3 : 2])
                members |= set(map(chr, range(ord(lo), ord(hi) + 1)))
                i += 3
            else:
                members.add(pattern[i])
                i += 1
        return bool(text) and (text[0] in members) != no and matches(pattern[end:], text[1:])
    if c == "\\" and len(pattern) > 1:
        return text[:1] == pattern[1] and matches(pattern[2:], text[1:])
    return bool(text) and c in ("?", text[0]) and matches(pattern[1:], text[1:])


def test_key_globs_agree_with_a_matcher(spark):
    rng = random.Random(11)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(rng.randint(0, n)))
    tail = ["[", "[^", "x[", "a\\", "[c-a]", "[a-", "a|b", "(b)", "^a$", "a.c"]
    patterns = sorted({some("ab*?[]^-\\", 7) for _ in range(250)} | set(tail))
    texts = sorted({some("abc^-]\\|.", 4) for _ in range(60)} | {"\n", "a\nb"})
    for p in patterns:
        df = spark.createDataFrame([(t,) for t in texts], "s string") if p == patterns[0] else df
        pattern = re.compile(globs.key_glob_regex(p))
        assert [bool(pattern.search(t)) for t in texts] == [matches(p, t) for t in texts], p
    few = rng.sample(patterns, 12)
    got = df.select("s", *[F.col("s").rlike(globs.key_glob_regex(p)).alias(str(i)) for i, p in enumerate(few)]).collect()
    assert all(r[i + 1] is matches(p, r.s) for r in got for i, p in enumerate(few))


def test_table_globs():
    names = ["app.users", "app.users_old", "app.user_roles", "log.hits", "log.hits_old"]
    pick = globs.select_names
    assert pick(names, [], []) == names
    assert pick(names, ["app.*"], ["*_old"]) == ["app.users", "app.user_roles"]
    assert pick(names, ["*hits"], []) == ["log.hits"]  # * crosses dots
    assert pick(names, ["APP.*"], []) == []
    assert pick(names, ["app.user?"], []) == ["app.users"]
    with pytest.raises(ValueError):
        pick(names, [""], [])


ORDER = ["identical", "widening", "risky", "incompatible"]


def grades(spark, level, names):
    df = spark.createDataFrame([(a, b) for a in names for b in names], "s string, t string")
    return {(r.s, r.t): r.g for r in df.select("s", "t", level(F.col("s"), F.col("t")).alias("g")).collect()}


@pytest.mark.parametrize("ladder", [["int2", "int4", "int8"], ["float4", "float8"], ["char(3)", "char(4)", "varchar(9)", "text"], ["time(0)", "time(3)", "time"],
                                    ["decimal(6,1)", "decimal(7,1)", "decimal(7,4)", "decimal"]])
def test_first_dialect_widens_upwards(spark, ladder):
    g = grades(spark, types.pg_level, ladder)
    for i, a in enumerate(ladder):
        for j, b in enumerate(ladder):
            assert g[a, b] == ("identical" if i == j else "widening" if i < j else "risky"), (a, b)


@pytest.mark.parametrize("ladder", [["tinyint", "smallint", "mediumint", "bigint"], ["char(2)", "varchar(2)", "varchar(3)"][::2], ["tinytext", "mediumtext", "longtext"], ["tinyblob", "blob"],
                                    ["time(1)", "time(6)"], ["decimal(5,0)", "dec(6,0)", "numeric(6,2)"], ["varbinary(4)", "varbinary(5)"]])
def test_second_dialect_widens_upwards(spark, ladder):
    g = grades(spark, types.my_level, ladder)
    for i, a in enumerate(ladder):
        for j, b in enumerate(ladder):
            assert g[a, b] == ("identical" if i == j else "widening" if i < j else "risky"), (a, b)


def test_rules_between_families(spark):
    # rows are sources, columns targets, in the order of the names
    names = ["int4", "decimal", "float8", "text", "bool", "date", "timestamptz", "money"]
    want = """identical widening risky widening incompatible incompatible incompatible risky
              risky identical risky widening incompatible incompatible incompatible risky
              risky risky identical widening incompatible incompatible incompatible risky
              incompatible incompatible incompatible identical incompatible incompatible incompatible risky
              incompatible incompatible incompatible widening identical incompatible incompatible risky
              incompatible incompatible incompatible widening incompatible identical risky risky
              incompatible incompatible incompatible widening incompatible risky identical risky
              risky risky risky widening risky risky risky identical"""
    g = grades(spark, types.pg_level, names)
    assert [[g[a, b] for b in names] for a in names] == [line.split() for line in want.split("\n")]
    names = ["smallint", "smallint unsigned", "float", "tinytext", "blob", "year", "set('q')", "json"]
    want = """identical risky risky risky incompatible incompatible incompatible incompatible
              risky identical risky risky incompatible incompatible incompatible incompatible
              risky risky identical risky incompatible incompatible incompatible incompatible
              incompatible incompatible incompatible identical incompatible incompatible risky incompatible
              incompatible incompatible incompatible risky identical incompatible incompatible incompatible
              incompatible incompatible incompatible risky incompatible identical incompatible incompatible
              incompatible incompatible incompatible risky incompatible incompatible identical incompatible
              incompatible incompatible incompatible incompatible incompatible incompatible incompatible identical"""
    g = grades(spark, types.my_level, names)
    assert [[g[a, b] for b in names] for a in names] == [line.split() for line in want.split("\n")]


def test_reasons_say_what_is_lost(spark):
    df = spark.createDataFrame([("int8", "int2"), ("text", "text"), ("date", "text"), ("uuid", "bool")], "s string, t string")
    level = types.pg_level(F.col("s"), F.col("t"))
    got = [r[0] for r in df.select(types.reason(F.col("s"), F.col("t"), level)).collect()]
    assert got == ["int8 to int2 may lose range or fraction", "", "date to text: every value fits", "uuid to bool: uuid values are no boolean values"]


def test_charsets(spark):
    rows = [("utf8mb4", "utf8mb3", "risky"), ("utf8mb4", "utf8", "risky"), ("utf8", "utf8mb4", "widening"), ("latin1", "utf8mb4", "risky"), ("utf8", "utf8mb3", "identical"), (None, "x", "identical")]
    df = spark.createDataFrame(rows, "s string, t string, want string").withColumn("got", types.charset_level(F.col("s"), F.col("t")))
    assert df.where("got <> want").collect() == []


UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40}


def test_byte_sizes(spark):
    rng = random.Random(5)
    cases = [(f"{n}{rng.choice(['', ' '])}{rng.choice([u, u.upper(), u.title()])}", n * k) for u, k in UNITS.items() for n in (0, 3, 512)]
    cases += [("2.5 kib", 2560), (".5mb", 500_000)]
    assert [scalars.byte_size(t) for t, _ in cases] == [n for _, n in cases]
    df = spark.createDataFrame(cases, "s string, n bigint")
    assert df.where(~scalars.byte_size_column(F.col("s")).eqNullSafe(F.col("n"))).collect() == []


def test_bad_byte_sizes(spark):
    bad = ["-7MB", "seven", "", "2.5", "KB", "1 2", "9XB", str(10**30)]
    for text in bad:
        with pytest.raises(ValueError):
            scalars.byte_size(text)
    df = spark.createDataFrame([(t,) for t in bad], "s string")
    assert [r[0] for r in df.select(scalars.byte_size_column(F.col("s"))).collect()] == [None] * len(bad)


def test_durations():
    assert scalars.duration_ns("5s") == 5 * 10**9
    assert scalars.duration_ns("1h30m") == 5400 * 10**9
    assert scalars.duration_ns("500ms") == 500 * 10**6
    assert scalars.duration_ns("-1.5s") == -1_500_000_000
    for bad in ("nope", "5", "", 5, "5 s"):
        with pytest.raises(ValueError):
            scalars.duration_ns(bad)


def test_environment():
    env = {"A": "1", "EMPTY": ""}
    assert scalars.expand_env("x${A}y", env) == "x1y"
    assert scalars.expand_env("${B:-d}${EMPTY:-e}", env) == "de"
    assert scalars.expand_env("$${A} $5", env) == "${A} $5"
    for bad in ("${B}", "${A", "${1x}"):
        with pytest.raises(ValueError):
            scalars.expand_env(bad, env)


def test_rows_of_scalars(spark):
    df = spark.createDataFrame([("8.0.36-log", -5, "a:1\r\nrole:master\r\n"), ("10.11.6-MariaDB", 0, ""), ("7.4", None, ""), ("x", 99, "")], "v string, ttl bigint, info string")
    r = df.select(scalars.version_number(F.col("v")), scalars.live_ttl(F.col("ttl")), scalars.vendor_supported(F.col("v")), scalars.info_field(F.col("info"), "role"),
                  scalars.absolute_ttl(F.col("ttl"), F.lit(1000))).collect()
    assert [tuple(x) for x in r] == [(80036, 0, True, "master", 0), (101106, 1, False, "", 1001), (70400, 0, True, "", 0), (None, 99, True, "", 1099)]


def test_ages(spark):
    df = spark.createDataFrame([(0.0,), (59.9,), (61.0,), (7260.0,), (None,)], "s double")
    assert [r[0] for r in df.select(scalars.human_age(F.col("s"))).collect()] == ["0s", "59s", "1m1s", "2h1m", "-"]
    p = spark.createDataFrame([(0.0,), (0.5,), (0.89,), (0.9,)], "p double")
    assert [r[0] for r in p.select(scalars.escalation(F.col("p"))).collect()] == ["INFO", "WARN", "WARN", "ERROR"]


def test_text_codec_round_trip(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("a\\\t\n\r\0\b\x1aN0né") for _ in range(rng.randint(0, 12))), rng.choice([None, "", "\\N", "x"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", scalars.tsv_line("a", "b").alias("line")).select("a", "b", *[c.alias(f"{n}2") for n, c in zip("ab", scalars.tsv_parse(F.col("line"), ["a", "b"]))])
    assert got.where("not (a <=> a2) or not (b <=> b2)").collect() == []


def test_binary_frames(spark):
    df = spark.createDataFrame([(b"k", None, b""), (bytes(range(256)), b"\0", b"v" * 300)], "a binary, b binary, c binary")
    got = [scalars.unframe(bytes(r[0])) for r in df.select(scalars.frame(["a", "b", "c"])).collect()]
    assert got == [[b"k", None, b""], [bytes(range(256)), b"\0", b"v" * 300]]
    with pytest.raises(ValueError):
        scalars.unframe(b"\0\0\0\5ab")


def test_small_things():
    assert scalars.fnv1a64("") == 0xCBF29CE484222325 - (1 << 64)
    assert scalars.fnv1a64("a") == 0xAF63DC4C8601EC8C - (1 << 64)
    assert [scalars.backoff_ms(i) for i in range(6)] == [200, 400, 800, 1600, 3200, 5000]
    assert scalars.host_port("[::1]:7", 1) == ("::1", 7) and scalars.host_port("h", 6379) == ("h", 6379)
    assert scalars.tls_option("verify-full", "pg") == {"sslmode": "verify-full"} and scalars.tls_option("allow", "mysql") == {"sslMode": "PREFERRED"}
    with pytest.raises(ValueError):
        scalars.tls_option("maybe", "pg")
    assert scalars.csv_list(" a, ,b") == ["a", "b"]
    assert scalars.quote_name("a`b", "", "c") == "`a``b`.`c`"
