"""Glob patterns as Spark predicates.

Table-name globs know ``*`` and ``?``; ``*`` crosses dots.  Key globs also know
``[set]``, ``[^set]``, ranges (either way round) and ``\\x``.  Both are turned
into one anchored regular expression, so the test runs inside the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The very end: a dollar sign would let a last line end pass.
END = r"(?![\s\S])"


def table_glob_regex(pattern: str) -> str:
    if not pattern:
        raise ValueError("an empty pattern selects nothing; leave it out")
    body = "".join({"*": ".*", "?": "."}.get(c) or _literal(c) for c in pattern)
    return f"^(?s:{body}){END}"


def _literal(c: str) -> str:
    return c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c


def key_glob_regex(pattern: str) -> str:
    """The regular expression of a key glob; a class that never closes runs to the end."""
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\":
            i += i + 1 < n
            out.append(_literal(pattern[i]))
        elif c == "[":
            cls, i = _key_class(pattern, i + 1)
            out.append(cls)
            continue
        else:
            out.append(_literal(c))
        i += 1
    return f"^(?s:{''.join(out)}){END}"


def _key_class(p: str, i: int) -> tuple[str, int]:
    """The class that starts after '[' at i, and where the pattern goes on."""
    negated = i < len(p) and p[i] == "^"
    i += negated
    parts = []
    while i < len(p) and p[i] != "]":
        if p[i] == "\\" and i + 1 < len(p):
            parts.append(_literal(p[i + 1]))
            i += 2
        elif i + 2 < len(p) and p[i + 1] == "-" and p[i + 2] != "]":
            lo, hi = sorted((p[i], p[i + 2]))
            parts.append(f"{_literal(lo)}-{_literal(hi)}")
            i += 3
        else:
            parts.append(_literal(p[i]))
            i += 1
    body = "".join(parts)
    if not body:
        return ("." if negated else r"(?!)"), i + 1
    return f"[{'^' if negated else ''}{body}]", i + 1


def _any(name: Column, patterns: list[str], regex) -> Column:
    return name.rlike("|".join(f"(?:{regex(p)})" for p in patterns))


def selected(name: Column, include: list[str], exclude: list[str], *, keys: bool = False) -> Column:
    """Included (no pattern includes all) and not excluded; exclusion wins."""
    regex = key_glob_regex if keys else table_glob_regex
    test = _any(name, include, regex) if include else F.lit(True)
    return test & ~_any(name, exclude, regex) if exclude else test


def select_names(names: list[str], include: list[str], exclude: list[str]) -> list[str]:
    """The same for a short list on the driver; keeps its order."""
    inc = [re.compile(table_glob_regex(p)) for p in include]
    exc = [re.compile(table_glob_regex(p)) for p in exclude]
    return [n for n in names if (not inc or any(r.match(n) for r in inc)) and not any(r.match(n) for r in exc)]
