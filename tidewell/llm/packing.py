"""Sequence packing by best-fit decreasing.

Overlong documents are first cut into full windows; what is left of each
document (under one window) goes, largest first, to the tightest open window
that still takes it.  A segment tree over remaining capacities finds it.

Documents meet in hash buckets whose number follows the row count, so a bucket
holds some ``BUCKET_DOCS`` documents at any input size and the cost of keeping
buckets apart is at most a few windows each.  Only lengths and checksums are
shuffled, never token ids (unless ``ids=True`` asks for them).

Cases: a null or empty text is the end id alone; repeated rows are packed once
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._common import only, pieces, tidy

WINDOW = 2048
END_ID = 1
BUCKET_DOCS = 40_000
#: Texts whose characters are all below this go to the fast encoder.
FAST_BELOW = "ɐ"


class CapacityTree:
    """Open windows by remaining capacity; finds the smallest one that suffices."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) with the least room >= need, or None."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(sizes: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """(window number, offset) for each piece; pieces are 1..window long."""
    tree, made = CapacityTree(window), 0
    which, offset = [0] * len(sizes), [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[k]
        room, w = tree.take(n) or (window, made)
        made += w == made
        which[k], offset[k] = w, window - room
        if room > n:
            tree.add(room - n, w)
    return which, offset


@functools.lru_cache(maxsize=2)
def _full(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


@functools.lru_cache(maxsize=2)
def _fast(name: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path(f"{name}.json"), "rb") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(text: str | None, tokenizer: str = "byte_bpe_50k") -> np.ndarray:
    """The ids of ``tokenizers`` for a text.

    The same vocabulary in ``tiktoken`` is four times as fast; it is used where
    both are sure to split alike (Latin script), the named library elsewhere.
    """
    if not text:
        return np.empty(0, "<u4")
    if len(text) < 1_000_000 and (text.isascii() or max(text) < FAST_BELOW):
        return np.asarray(_fast(tokenizer).encode_to_numpy(text, allowed_special="all"), "<u4")
    return np.asarray(_full(tokenizer).encode(text, add_special_tokens=False).ids, "<u4")


def _measure(window: int, end_id: int, tokenizer: str, ids: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in pieces(texts):
                length, crcs, out = [], [], []
                for t in texts[part]:
                    x = np.append(encode(t, tokenizer), np.uint32(end_id)).astype("<u4")
                    cuts = [x[i : i + window] for i in range(0, len(x), window)]
                    length.append(len(x))
                    crcs.append([zlib.crc32(c.tobytes()) for c in cuts])
                    out.append(x.astype("<i4"))
                cols = [
                    batch.column(0)[part],
                    pa.array(length, pa.int64()),
                    pa.array(crcs, pa.list_(pa.int64())),
                ]
                if ids:
                    cols.append(pa.array(out, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return tidy(run)


def _pack(window: int, ids: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if not t or not t.num_rows:
            return
        docs, n, crcs = t.column(0).combine_chunks(), t.column(1).to_numpy(), t.column(2).to_pylist()
        rest = n % window
        left = np.flatnonzero(rest)
        which, offset = best_fit_decreasing(rest[left].tolist(), window)
        full = n // window
        # pieces: all full windows, then what is left of each document
        row = np.concatenate([np.repeat(np.arange(len(n)), full), left])
        nth = np.concatenate([np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full), full[left]])
        used = max(which, default=-1) + 1
        base = TaskContext.get().partitionId() << 36
        seq = np.concatenate([used + np.arange(full.sum()), np.asarray(which, np.int64)]) + base
        cols = {
            "doc_id": docs.take(pa.array(row)),
            "start": pa.array(nth * window, pa.int64()),
            "length": pa.array(np.minimum(window, n[row] - nth * window), pa.int64()),
            "ids_crc32": pa.array([crcs[r][k] for r, k in zip(row, nth)], pa.int64()),
            "doc_tokens": pa.array(n[row], pa.int64()),
            "sequence_id": pa.array(seq, pa.int64()),
            "offset": pa.array(np.concatenate([np.zeros(full.sum(), np.int64), np.asarray(offset, np.int64)])),
        }
        if ids:
            all_ids = t.column(3).combine_chunks()
            cols["ids"] = pa.array(
                [all_ids[r].values[k * window : (k + 1) * window] for r, k in zip(row.tolist(), nth.tolist())],
                pa.list_(pa.int32()),
            )
        yield from pa.table(cols).cast(schema).to_batches(max_chunksize=10_000)

    return tidy(run)


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    tokenizer: str = "byte_bpe_50k",
    bucket_docs: int = BUCKET_DOCS,
    ids: bool = False,
) -> DataFrame:
    """Pack documents into windows of at most ``window`` tokens.

    One row per piece: its document, place and length there, checksum of its
    ids, window (``sequence_id``) and offset in it; with ``ids`` the ids as well.
    """
    docs = only(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    arrow_id = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    docs = docs.select(F.col(f"`{id_col}`").cast("string" if arrow_id == pa.string() else kind).alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    buckets = max(1, -(-docs.select(F.lit(1)).count() // bucket_docs))
    more = ", ids array<int>" if ids else ""
    more_a = [("ids", pa.list_(pa.int32()))] if ids else []
    measured = docs.mapInArrow(
        _measure(window, end_id, tokenizer, ids, pa.schema(
            [("doc_id", arrow_id), ("n", pa.int64()), ("crcs", pa.list_(pa.int64())), *more_a])),
        f"doc_id {kind}, n bigint, crcs array<bigint>{more}",
    )
    dealt = measured.repartition(buckets, F.xxhash64("doc_id", "n", "crcs")).sortWithinPartitions("doc_id", "n", "crcs")
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return dealt.mapInArrow(
        _pack(window, ids, pa.schema([("doc_id", arrow_id), *[(c, pa.int64()) for c in longs], *more_a])),
        f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in longs) + more,
    )
