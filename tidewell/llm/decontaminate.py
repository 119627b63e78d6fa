"""Benchmark decontamination by winnowing.

Each item's windows are ``window`` consecutive words (an item of fewer words is
one window).  Of every ``window - k + 1`` consecutive k-grams of a text the one
with the least hash is kept, so a shared span of ``window`` words always shares
a kept k-gram.  Document fingerprints are looked up among the items'; a hit is
extended word by word in both directions, and runs of at least a window count.

Items shorter than a window can have no such guarantee at the same k; they are
fingerprinted whole, one length at a time, and compared word by word as well.

The item side is broadcast in blocks of at most ``BLOCK_WORDS`` words, which
bounds what a worker holds whatever the size of the benchmark; every document
meets every block, and the marks of several blocks are united per document.

Cases: null or empty texts have no words; an item without an id marks words but
is not listed; repeated items or documents count as
often as they stand there (an item id once); ties of hashes keep the rightmost;
an empty item table marks nothing; columns beside id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._common import WordHasher, alnum_words, grams, only, ship, stored, tidy

WINDOW = 10
K = 6
BLOCK_WORDS = 4_000_000


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Positions of the rightmost least hash in every w consecutive ones (of all if fewer)."""
    if not len(g):
        return np.empty(0, np.int64)
    w = min(w, len(g))
    v = np.lib.stride_tricks.sliding_window_view(g[::-1], w)
    pos = (len(g) - 1 - (np.arange(len(v)) + v.argmin(axis=1)))[::-1]
    return pos[np.append(True, pos[1:] != pos[:-1])]


class Items:
    """Fingerprints and words of one block of benchmark items."""

    def __init__(self, rows: list[tuple[str, str | None]], window: int, k: int):
        self.window, self.k = window, k
        memo = WordHasher()
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.ids, self.words, texts = [], [], {}
        for item, text in rows:
            h = memo.of(alnum_words(text))
            if not len(h):
                continue
            # equal texts are matched once and answer for all their ids
            at = texts.setdefault(h.tobytes(), len(self.ids))
            if at == len(self.ids):
                self.ids.append(set())
                self.words.append(h)
            if item is not None:
                self.ids[at].add(item)
        for at, h in enumerate(self.words):
            n = k if len(h) >= window else len(h)
            g = grams(h, n)
            pos = winnow(g, window - k + 1) if len(h) >= window else np.zeros(1, np.int64)
            found.setdefault((n, len(h) >= window), []).append((g[pos], np.stack([np.full(len(pos), at), pos], 1)))
        self.tables = {}
        for key, parts in found.items():
            g, where = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(g, kind="stable")
            self.tables[key] = g[order], where[order]

    def marks(self, h: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs [start, end) of a document's words, and the items with windows in it."""
        runs: set[tuple[int, int]] = set()
        items: set[int] = set()
        for (n, long), (keys, where) in self.tables.items():
            g = grams(h, n)
            at = winnow(g, self.window - self.k + 1) if long and len(h) >= self.window else np.arange(len(g))
            if long and len(h) < self.window:
                continue
            lo = np.searchsorted(keys, g[at], "left")
            hi = np.searchsorted(keys, g[at], "right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                for item, q in where[a:b].tolist():
                    run = self._extend(h, p, self.words[item], q, n)
                    if run[1] - run[0] >= min(self.window, len(self.words[item])):
                        runs.add(run)
                        items.add(item)
        return sorted(runs), set().union(*[self.ids[i] for i in items])

    @staticmethod
    def _extend(h: np.ndarray, p: int, x: np.ndarray, q: int, n: int) -> tuple[int, int]:
        back = min(p, q)
        differ = np.flatnonzero(h[p - back : p] != x[q - back : q])
        start = p - back + (differ[-1] + 1 if len(differ) else 0)
        ahead = min(len(h) - p, len(x) - q)
        differ = np.flatnonzero(h[p : p + ahead] != x[q : q + ahead])
        return int(start), int(p + (differ[0] if len(differ) else ahead))


def united(runs: list[tuple[int, int]]) -> int:
    """Words covered by runs [start, end)."""
    total, end = 0, 0
    for a, b in sorted(runs):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _mark(shared, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, memo = shared.value, WordHasher()
        for batch in batches:
            n, runs, ids = [], [], []
            for text in batch.column(1):
                h = memo.of(alnum_words(text.as_py()))
                found, who = items.marks(h)
                n.append(len(h))
                runs.append([{"start": a, "end": b} for a, b in found])
                ids.append(sorted(who))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(runs, schema.field("runs").type), pa.array(ids, pa.list_(pa.string()))],
                schema=schema,
            )

    return tidy(run)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, k: int, limit: int) -> Iterator[Items]:
    """Read the items in bounded blocks; the driver holds one block at a time."""
    rows, size = [], 0
    for r in benchmark.select(F.col(f"`{item_col}`").cast("string"), F.col(f"`{text_col}`")).toLocalIterator():
        n = len(r[1]) // 2 if r[1] else 0
        if rows and size + n > limit:
            yield Items(rows, window, k)
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += n
    yield Items(rows, window, k)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    k: int = K,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per document row: doc_id, n_words, runs (word ranges [start, end) that lie
    in benchmark windows), items (ids of items with a window in it, sorted)."""
    d = only(docs, id_col, text_col).toDF("doc_id", "text")
    kind = dict(d.dtypes)["doc_id"]
    share = d.sparkSession.sparkContext.broadcast
    blocks = [share(b) for b in _blocks(benchmark, item_col, item_text_col, window, k, block_words)]
    if len(blocks) > 1:  # rows get a number, so that equal ids stay apart
        d = stored(d.select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("doc_id"), "text"), "texts")
        kind = f"struct<doc_id:{kind},row:bigint>"
    arrow = pa.schema([
        ("doc_id", _arrow_type(d)),
        ("n_words", pa.int64()),
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ])
    made = [
        d.mapInArrow(
            _mark(b, arrow),
            f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,end:bigint>>, items array<string>",
        )
        for b in blocks
    ]
    if len(made) == 1:
        return made[0]
    every = made[0]
    for x in made[1:]:
        every = every.unionByName(x)
    return (
        every.groupBy("doc_id")
        .agg(
            F.max("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        .withColumn("doc_id", F.col("doc_id.doc_id"))
    )


def _drop(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, memo = shared.value, WordHasher()
        for batch in batches:
            clean = [not items.marks(memo.of(alnum_words(t.as_py())))[0] for t in batch.column(text_at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return tidy(run)


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
          window: int = WINDOW, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows, with all their columns, that hold no benchmark window: one narrow pass, which goes by no id."""
    ship(docs.sparkSession)
    at, share = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast
    for b in _blocks(benchmark, item_col, item_text_col, window, k, block_words):
        docs = docs.mapInArrow(_drop(share(b), at), docs.schema)
    return docs


def _arrow_type(d: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(d.schema["doc_id"].dataType)


def report(marked: DataFrame) -> DataFrame:
    """Counts and digests of :func:`contamination`; no Python runs here."""
    covered = F.aggregate(
        F.col("runs"),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda a, r: F.struct(
            (a["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], a["end"]))).alias("n"),
            F.greatest(a["end"], r["end"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    return marked.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
