"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into normalised sentences; those that are known get their
identifier; the sequence of identifiers is matched against ordered rules, the
first rule that fits consuming the sentences it matched.  Sentences between
known ones that are not known themselves do not break a rule.  Where printed
notices name a holder inside a sentence, any name of up to 200 characters does.
"All rights reserved" before a licence's own text belongs to it; elsewhere it
is a statement of its own.

Every line is a sentence of its own, but a known sentence is also found where
it is wrapped over several lines, behind comment marks or not; it then counts as
one sentence.  Stops and blank lines end it (a blank line before an address
does not), and it begins and ends where a line or sentence does.

No shuffle and no Python: one projection over the scan, so the cost follows
the text and a hot source or copied document changes nothing.

Cases: null and empty texts have no sentences and no licence; a sentence that
occurs several times counts each time; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence notices, by identifier.
SENTENCES: dict[str, list[str]] = {
    "ApacheRef2": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\")",
        "This project is licensed under the Apache License 2.0",
    ],
    "ApacheFile": ["you may not use this file except in compliance with the License"],
    "ApacheCopy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "AsIsBasis": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"
    ],
    "ApacheSee": ["See the License for the specific language governing permissions and limitations under the License"],
    "MITRef": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the MIT License",
    ],
    "MITPerm": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ],
    "MITNotice": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software"
    ],
    "MITAsIs": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"
    ],
    "BSDPre": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ],
    "BSDSource": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer"
    ],
    "BSDBinary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution"
    ],
    "BSDEndorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission"
    ],
    "BSDRef2": ["Licensed under the BSD 2-Clause License"],
    "BSDRef3": ["Licensed under the BSD 3-Clause License"],
    "ISCPerm": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies"
    ],
    "GPLRef2": [
        "This work is licensed under the GNU General Public License, version 2",
    ],
    "GPLRef3": [
        "This work is licensed under the GNU General Public License, version 3",
        "This project is licensed under the GNU General Public License v3.0",
    ],
    "GPLFree": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version"
    ],
    "GPLFree2": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version"
    ],
    "GPLHope": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
    ],
    "GPLSee": ["See the GNU General Public License for more details"],
    "LGPLRef": ["This work is licensed under the GNU Lesser General Public License, version 3"],
    "AGPLRef": ["This work is licensed under the GNU Affero General Public License, version 3"],
    "MPLRef": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "UnlicensePD": ["This is free and unencumbered software released into the public domain"],
    "CC0Ref": ["Released under CC0 1.0", "To the extent possible under law, the author has waived all copyright"],
    "CCBYRef": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "CCBYSARef": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "CCBYNCRef": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "CCBYNDRef": ["Licensed under CC BY-ND 4.0"],
    "AllRights": ["All rights reserved"],
}

# Ordered rules, the most specific first.
RULES: list[tuple[str, list[str]]] = [
    ("BSD-3-Clause", ["AllRights", "BSDPre", "BSDSource", "BSDBinary", "BSDEndorse"]),
    ("BSD-2-Clause", ["AllRights", "BSDPre", "BSDSource", "BSDBinary"]),
    ("MIT", ["AllRights", "MITPerm", "MITNotice", "MITAsIs"]),
    ("ISC", ["AllRights", "ISCPerm"]),
    ("Apache-2.0", ["ApacheRef2", "ApacheFile", "ApacheCopy", "AsIsBasis", "ApacheSee"]),
    ("BSD-3-Clause", ["BSDPre", "BSDSource", "BSDBinary", "BSDEndorse"]),
    ("BSD-2-Clause", ["BSDPre", "BSDSource", "BSDBinary"]),
    ("MIT", ["MITPerm", "MITNotice", "MITAsIs"]),
    ("ISC", ["ISCPerm"]),
    ("GPL-3.0-or-later", ["GPLFree", "GPLHope", "GPLSee"]),
    ("GPL-2.0-or-later", ["GPLFree2", "GPLHope", "GPLSee"]),
    ("GPL-3.0-or-later", ["GPLFree"]),
    ("GPL-2.0-or-later", ["GPLFree2"]),
    ("Apache-2.0", ["ApacheRef2"]),
    ("MIT", ["MITRef"]),
    ("BSD-2-Clause", ["BSDRef2"]),
    ("BSD-3-Clause", ["BSDRef3"]),
    ("GPL-2.0-only", ["GPLRef2"]),
    ("GPL-3.0-only", ["GPLRef3"]),
    ("LGPL-3.0", ["LGPLRef"]),
    ("AGPL-3.0", ["AGPLRef"]),
    ("MPL-2.0", ["MPLRef"]),
    ("Unlicense", ["UnlicensePD"]),
    ("CC0-1.0", ["CC0Ref"]),
    ("CC-BY-4.0", ["CCBYRef"]),
    ("CC-BY-SA-4.0", ["CCBYSARef"]),
    ("CC-BY-NC-4.0", ["CCBYNCRef"]),
    ("CC-BY-ND-4.0", ["CCBYNDRef"]),
    ("All-Rights-Reserved", ["AllRights"]),
]

# Licences by what they allow a training corpus.
RESTRICTED = ["CC-BY-NC-4.0", "CC-BY-ND-4.0", "All-Rights-Reserved"]
COPYLEFT = ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC-BY-SA-4.0"]

# One more sentence and rule for every licence: its identifier in a source file's first lines.
SPDX = "SPDX-License-Identifier:"
for _licence in dict.fromkeys(name for name, _ in list(RULES) if name != "All-Rights-Reserved"):
    SENTENCES[f"Spdx {_licence}"] = [f"{SPDX} {_licence}"]
    RULES.append((_licence, [f"Spdx {_licence}"]))

# Where printed notices put a name, and the sentence's wording without it.
NAMES = [
    ("neither the name of ", " nor the names of its contributors", "the copyright holder"),
    ("neither the names of ", " nor the names of its contributors", "the copyright holder"),
]

#: Where one sentence ends: stops before white space, and every line end.
ENDS = r"[.!?;:]+[ \t\r\f]+|\n"
NOT_WORD = r"[^a-z0-9\n]+"
#: A line end that a known sentence may run across, with the marks that begin the next line.
WRAP = r"(?<![.!?;:])\n[^a-z0-9\n]*+(?:(?=[a-z0-9])|(?:\n[^a-z0-9\n]*+){1,3}(?=https?://))"
#: Stands for such a line end; no lowered text contains it.
SOFT = "N"


def _normal(s: str) -> list[str]:
    """The normalised sentences of a known text; what :func:`sentences` does in Spark."""
    import re

    text = s.lower().replace(SPDX.lower(), SPDX.lower()[:-1])
    return [x.strip() for x in re.sub(NOT_WORD, " ", re.sub(ENDS, "\n", text)).split("\n") if x.strip()]


def known_sentences(table: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """(normalised sentence, identifier); the parts of a split text form a sequence of their own."""
    out = {}
    for name, texts in (table or SENTENCES).items():
        for t in texts:
            parts = _normal(t)
            for i, p in enumerate(parts):
                out.setdefault(p, name if i == len(parts) - 1 else f"{name}{i}")
    return list(out.items())


def _rules(table=None, rules=None) -> list[tuple[str, list[str]]]:
    """Rules with the leading parts of split sentences in place."""
    out = []
    for licence, names in rules or RULES:
        seqs = [[]]
        for n in names:
            heads = list(dict.fromkeys(tuple(f"{n}{i}" for i in range(len(_normal(t)) - 1)) for t in (table or SENTENCES)[n]))
            seqs = [s + [*h, n] for s in seqs for h in heads]
        out += [(licence, s) for s in sorted(seqs, key=lambda s: -len(s))]
    return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _unwrap(text: Column, names: list[str]) -> Column:
    """Known sentences that run across soft line ends, each put on one line, the longest first."""
    known = F.array(*[F.lit(x) for x in sorted(names, key=len, reverse=True)])
    words = lambda x: F.replace(x, F.lit(" "), F.lit(f"(?: ?{SOFT}| )"))
    pattern = lambda x: F.concat(F.lit(f"(^|[\n{SOFT}]) ?"), words(x), F.lit(f" ?(?=[\n{SOFT}]|\\z)"))
    put = lambda t, x: F.regexp_replace(t, pattern(x), F.concat(F.lit("$1"), x))
    join = lambda t, j: F.aggregate(F.filter(known, lambda x: F.contains(j, x)), t, put)
    return _let(text, lambda t: _let(F.regexp_replace(t, f" ?{SOFT}", " "), lambda j: join(t, j)))


def _unnamed(words: Column) -> Column:
    """Names in known sentences replaced by the wording that the table has."""
    wide = lambda x: x.replace(" ", f"(?: ?{SOFT}| )")
    put = lambda w, n: F.regexp_replace(w, f"{wide(n[0])}[^\n]{{1,200}}?{wide(n[1])}", "neither the name of " + n[2] + n[1])
    return _let(words, lambda w: F.when(F.contains(w, F.lit("neither")), functools.reduce(put, NAMES, w)).otherwise(w))


def sentences(text: Column, names: list[str]) -> Column:
    plain = F.replace(F.lower(text), F.lit(SPDX.lower()), F.lit(SPDX.lower()[:-1]))
    lines = F.regexp_replace(F.regexp_replace(plain, WRAP, SOFT), ENDS, "\n")
    words = _unnamed(F.regexp_replace(lines, NOT_WORD.replace("^", f"^{SOFT}"), " "))
    names = [x for x in names if not x.startswith("spdx")]  # these stand on one line
    return F.filter(F.split(_unwrap(words, names), f" ?[\n{SOFT}] ?"), lambda s: F.trim(s) != "")


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    table: dict[str, list[str]] | None = None,
    rules: list[tuple[str, list[str]]] | None = None,
) -> DataFrame:
    """Per row: doc_id, n_sentences, n_known, sentence_ids, licenses (in text order), class."""
    known = known_sentences(table)
    ids = F.create_map(*[F.lit(x) for pair in known for x in pair])
    names = [s for s, _ in known]
    d = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(sentences(F.col(f"`{text_col}`"), names), F.array().cast("array<string>")).alias("s"),
    ).select(
        "doc_id",
        F.size("s").cast("bigint").alias("n_sentences"),
        F.transform(F.filter("s", lambda x: F.trim(x).isin(names)), lambda x: ids[F.trim(x)]).alias("k"),
    )
    seq = F.array_join(F.transform("k", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    for licence, parts in _rules(table, rules):
        seq = F.replace(seq, F.lit("".join(f"<{p}>" for p in parts)), F.lit(f"[{licence}]"))
    found = F.regexp_extract_all(seq, F.lit(r"\[([^\]]+)\]"), F.lit(1))
    return d.select(
        "doc_id",
        "n_sentences",
        F.size("k").cast("bigint").alias("n_known"),
        F.array_join("k", ",").alias("sentence_ids"),
        found.alias("l"),
    ).select(
        "doc_id",
        "n_sentences",
        "n_known",
        "sentence_ids",
        F.array_join("l", ",").alias("licenses"),
        F.when(F.arrays_overlap("l", F.lit(RESTRICTED)), "restricted")
        .when(F.arrays_overlap("l", F.lit(COPYLEFT)), "copyleft")
        .when(F.size("l") > 0, "permissive")
        .when(F.col("n_known") > 0, "partial")
        .otherwise("none")
        .alias("license_class"),
    )


def scan_sql(table: str = "documents") -> str:
    """The same scan as DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = known_sentences()
    names = "[" + ", ".join(q(s) for s, _ in known) + "]"
    ids = "MAP {" + ", ".join(f"{q(s)}: {q(i)}" for s, i in known) + "}"
    seq = "array_to_string(list_transform(k, lambda x: '<' || x || '>'), '')"
    for licence, parts in _rules():
        seq = f"replace({seq}, {q(''.join(f'<{p}>' for p in parts))}, {q(f'[{licence}]')})"
    some = lambda v: "list_has_any(l, [" + ", ".join(map(q, v)) + "])"
    return f"""
WITH a AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(
      replace(lower(coalesce(text, '')), '{SPDX.lower()}', '{SPDX.lower()[:-1]}'), '{ENDS}', chr(10), 'g'), '{NOT_WORD}', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s
  FROM {table}),
b AS (SELECT doc_id, len(s) AS n_sentences,
  list_transform(list_filter(s, lambda x: list_contains({names}, x)), lambda x: {ids}[x]) AS k FROM a),
c AS (SELECT doc_id, n_sentences, k, regexp_extract_all({seq}, '\\[([^\\]]+)\\]', 1) AS l FROM b)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(len(k) AS BIGINT) AS n_known,
  coalesce(array_to_string(k, ','), '') AS sentence_ids, coalesce(array_to_string(l, ','), '') AS licenses,
  CASE WHEN {some(RESTRICTED)} THEN 'restricted' WHEN {some(COPYLEFT)} THEN 'copyleft'
       WHEN len(l) > 0 THEN 'permissive' WHEN len(k) > 0 THEN 'partial' ELSE 'none' END AS license_class
FROM c"""
