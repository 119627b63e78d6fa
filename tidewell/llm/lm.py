"""Language-model scoring with a log-frequency Bloom filter.

Words, pairs and triples of the training documents are counted in Spark.  A
count becomes a level on a logarithmic scale; a key of level q is put into a
Bloom filter q times, as (key, 1) .. (key, q).  Workers read a count back by
probing levels until one is absent: never less than the true level, and more
with a small known probability.

Probabilities are smoothed from the words up: a word's is (c+1)/(N+V+1), and
with the word or two words before it
``(count of all + weight * shorter probability) / (count before + weight)``,
so a context counts the more the oftener it was seen.  ``WEIGHTS`` are fixed
(found on held-out documents of one small table).

Counting combines before it shuffles: a task sends, for each range of hashes,
one compressed list of sorted keys and counts.  The filter is made range by
range where the counts are.  A filter of up to ``filter_bytes`` is broadcast
and texts are scored in one narrow pass.  A larger one stays where it is:
blocks of some 16 MB of text send their distinct keys to the ranges, once, and
get the levels back, in the order of the keys.  A block has a message for each
range, so these are many keys long even where there are thousands of ranges.

The unigram baseline uses exact counts: words with a share of at least 2^-20
of all tokens (so at most 2^20 of them) are broadcast, the others are joined.

Cases: a null or empty text is the end token alone; a null id is no remainder
that is held out, so it trains; repeated rows train and are scored each; with
nothing to train on every count is 0; extra columns are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._common import _K, WordHasher, ascii_words, mix, only, stored, tidy

#: Bits and probes for each level of a key: some 0.7 % of absent levels seem present.
BITS, PROBES = 12, 7
#: Bits of a block, which holds all probes of a level.
BLOCK = 512
FILTER_BYTES = 256 << 20
#: Text bytes for each range of hashes.
RANGE_BYTES = 8 << 20
#: Words that may be broadcast with exact counts.
FREQUENT = 1 << 20
#: Tokens that a task gathers before it combines them.
GATHER = 1_000_000
#: Documents that a task scores together.
SCORED = 250
#: Text bytes of a block that asks for its levels together, and what a row counts besides its text.
BLOCK_BYTES, ROW_BYTES = 16 << 20, 100
#: Keys whose levels are read together.
ASKED = 500_000
#: Weights of the shorter probability, for pairs and for triples.
WEIGHTS = 400.0, 10.0

END, START = np.uint64(0x5EED0E4D00000001), np.uint64(0x5EED0E4D00000002)


def _levels() -> np.ndarray:
    """Least count of each level: 1, 2, 3, 5, 8, 12, ... (steps of about sqrt 2)."""
    t = [1]
    while t[-1] < 1 << 60:
        t.append(max(t[-1] + 1, math.ceil(t[-1] * math.sqrt(2))))
    return np.asarray(t, np.int64)


LEVELS = _levels()
#: The count that stands for a level: the middle of its range; level 0 is absent.
DECODED = np.concatenate([[0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2])


def level(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, count, "right")


def _place(key: np.ndarray, n: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, bits) of (key, level n) in a range of so many blocks: nine bits of
    ``bits`` for each probe.  All probes of a level lie in one cache line."""
    h = mix(key + np.uint64((int(_K) * n) & 0xFFFFFFFFFFFFFFFF))
    return ((h >> np.uint64(32)) * blocks >> np.uint64(32)).astype(np.int64), mix(h ^ START)


def make_range(key: np.ndarray, count: np.ndarray) -> tuple[int, bytes]:
    """(blocks, filter) of one range's keys."""
    q = level(count)
    blocks = max(1, -(-int(q.sum()) * BITS // BLOCK))
    out = np.zeros(blocks * BLOCK, bool)
    n = 0
    while len(key):
        n += 1
        block, bits = _place(key, n, np.uint64(blocks))
        for i in range(PROBES):
            out[block * BLOCK + (bits >> np.uint64(9 * i) & np.uint64(BLOCK - 1)).astype(np.int64)] = True
        more = q > n
        key, q = key[more], q[more]
    return blocks, np.packbits(out, bitorder="little").tobytes()


def levels_of(key: np.ndarray, blocks: np.ndarray, start: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The level of each key, by membership probes until one fails; a key's range has
    so many blocks and begins at that block of the data."""
    out = np.zeros(len(key), np.int64)
    at = np.flatnonzero(blocks > 0)
    n = 0
    while len(at):
        n += 1
        block, bits = _place(key[at], n, blocks[at])
        word = (block + start[at]) * (BLOCK // 64)
        for i in range(PROBES):
            b = bits >> np.uint64(9 * i) & np.uint64(BLOCK - 1)
            ok = data[word + (b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63)) & np.uint64(1) > 0
            if not ok.all():
                at, word, bits = at[ok], word[ok], bits[ok]
            if not len(at):
                break
        out[at] = n
    return out


class Ranges:
    """Bloom filters over ranges of the hash space, back to back."""

    def __init__(self, ranges: int, sizes: list[tuple[int, int]], parts: Iterable[tuple[int, bytes]]):
        self.shift = np.uint64(64 - (ranges.bit_length() - 1))
        self.blocks = np.zeros(ranges, np.uint64)
        for r, n in sizes:
            self.blocks[r] = n
        ends = np.cumsum(self.blocks).astype(np.int64)
        self.start = ends - self.blocks.astype(np.int64)
        words = BLOCK // 64
        self.data = np.zeros(int(ends[-1]) * words, "<u8")
        for r, data in parts:
            self.data[self.start[r] * words : ends[r] * words] = np.frombuffer(data, "<u8")

    def __getstate__(self) -> dict:  # bytes are read back without a second copy
        return {**self.__dict__, "data": self.data.tobytes()}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = {**state, "data": np.frombuffer(state["data"], "<u8")}

    def range_of(self, key: np.ndarray) -> np.ndarray:
        return (key >> self.shift).astype(np.int64) if self.shift < 64 else np.zeros(len(key), np.int64)

    def levels(self, key: np.ndarray) -> np.ndarray:
        r = self.range_of(key)
        return levels_of(key, self.blocks[r], self.start[r], self.data)

    def counts(self, key: np.ndarray) -> np.ndarray:
        return DECODED[self.levels(key)]


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _K + right)


#: Keys of pairs and triples keep 48 bits, which within one range are enough.
_SHORT = ~np.uint64(0xFFFF)


def token_keys(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, pairs and triples that end at each token of a text; it starts behind two start marks."""
    before = np.append(START, h[:-1])
    two = pair_keys(np.append(START, before[:-1]), before)
    return h, pair_keys(before, h) & _SHORT, pair_keys(two, h) & _SHORT


def _packed(key: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts, compressed."""
    a = zlib.compress(np.diff(key, prepend=np.uint64(0)).astype("<u8").tobytes(), 1)
    return struct.pack("<I", len(a)) + a + zlib.compress(count.astype("<u4").tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack_from("<I", data)[0]
    return (np.cumsum(np.frombuffer(zlib.decompress(data[4 : 4 + n]), "<u8"), dtype=np.uint64),
            np.frombuffer(zlib.decompress(data[4 + n :]), "<u4").astype(np.int64))


def _by_range(key: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, first, last + 1) of sorted keys."""
    shift = np.uint64(64 - (ranges.bit_length() - 1))
    r = (key >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(key), np.int64)
    cut = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
    return list(zip(r[cut].tolist(), cut.tolist(), np.append(cut[1:], len(r)).tolist()))


def _gather(ranges: int):
    """(kind, range, list) rows: the words (0), pairs (1) and triples (2) of some documents, combined."""

    def out(kind: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        key, count = np.unique(np.concatenate(parts), return_counts=True)
        cut = _by_range(key, ranges)
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(cut), pa.int32()), pa.array([r for r, _, _ in cut], pa.int64()),
             pa.array([_packed(key[a:b], count[a:b]) for _, a, b in cut], pa.binary())],
            names=["kind", "r", "list"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, size = WordHasher(), ([], [], []), 0
        for batch in batches:
            for text in batch.column(0):
                h = np.append(memo.of(ascii_words(text.as_py())), END)
                for kind, key in enumerate(token_keys(h)):
                    held[kind].append(key)
                size += len(h)
                if size >= GATHER:
                    for kind in range(3):
                        yield out(kind, held[kind])
                        held[kind].clear()
                    size = 0
        if size:
            for kind in range(3):
                yield out(kind, held[kind])

    return tidy(run)


def _merged(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unpacked(x) for x in lists]
    key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _reduce(keep_counts: bool):
    def run(t: pa.Table) -> pa.Table:
        key, count = _merged(t.column("list").to_pylist())
        blocks, data = make_range(key, count)
        return pa.table({
            "kind": pa.array([t.column("kind")[0].as_py()], pa.int32()),
            "r": pa.array([t.column("r")[0].as_py()], pa.int64()),
            "blocks": pa.array([blocks], pa.int64()),
            "data": pa.array([data], pa.binary()),
            "tokens": pa.array([int(count.sum())], pa.int64()),
            "h": pa.array([key.view(np.int64) if keep_counts else []], pa.list_(pa.int64())),
            "c": pa.array([count if keep_counts else []], pa.list_(pa.int64())),
        })

    return run


_FILTER = "kind int, r bigint, blocks bigint, data binary, tokens bigint, h array<bigint>, c array<bigint>"


class Scorer:
    """What a worker needs to score texts, but for the levels of their keys."""

    def __init__(self, frequent: tuple[np.ndarray, np.ndarray], tokens: int, distinct: int, texts: int):
        self.frequent, self.tokens, self.distinct, self.texts = frequent, tokens, distinct, texts

    def exact(self, h: np.ndarray) -> np.ndarray:
        """Exact counts of frequent words, -1 for all others."""
        keys, counts = self.frequent
        if not len(keys):
            return np.full(len(h), -1)
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        return np.where(keys[at] == h, counts[at], -1)

    def logp(self, hs: list[np.ndarray], levels) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log10 probabilities by text; and every token's exact count, -1 where
        that is not broadcast.  ``levels(kind, keys)`` reads the filter for distinct keys."""
        owner = np.repeat(np.arange(len(hs)), [len(h) for h in hs])
        first = np.append(True, owner[1:] != owner[:-1])
        keys = [np.concatenate(k) for k in zip(*map(token_keys, hs))]
        w, at = np.unique(keys[0], return_inverse=True)
        known = self.exact(w)
        count = known.astype(np.float64)
        rare = np.flatnonzero(known < 0)  # the filter answers for these
        count[rare] = DECODED[levels(0, w[rare])]
        exact, c1 = known[at], count[at]
        back = lambda c: np.where(first, max(1, self.texts), np.append(0.0, c[:-1]))  # noqa: E731  counts one token before
        prob, shorter = (c1 + 1) / (self.tokens + self.distinct + 1), c1
        for kind, weight in zip((1, 2), WEIGHTS):
            k, where = np.unique(keys[kind], return_inverse=True)
            # neither more than what it ends with nor than its context
            c = np.minimum(DECODED[levels(kind, k)][where], shorter)
            before = back(shorter)
            c = np.minimum(c, before)
            prob = (c + weight * prob) / (before + weight)
            shorter = c
        return np.bincount(owner, np.log10(prob), len(hs)).astype(float), exact

    def rows(self, ids, hs: list[np.ndarray], docs, held, levels) -> pa.RecordBatch:
        score, count = self.logp(hs, levels)
        known, cut = count >= 0, np.cumsum([len(h) for h in hs])[:-1]
        rare_h, rare_n = [], []
        for x, k in zip(hs, np.split(known, cut)):
            u, c = np.unique(x[~k], return_counts=True)
            rare_h.append(u.view(np.int64))
            rare_n.append(c.astype(np.int32))
        owner = np.repeat(np.arange(len(hs)), [len(h) for h in hs])
        return pa.RecordBatch.from_arrays([
            ids, pa.array(score), pa.array([len(h) for h in hs], pa.int64()),
            pa.array(np.bincount(owner, known & (count > 0), len(hs)).astype(np.int64)),
            pa.array(np.bincount(owner, np.where(known, np.log10(np.maximum(count, 0) + 1.0), 0.0), len(hs)).astype(float)),
            pa.array(rare_h, pa.list_(pa.int64())), pa.array(rare_n, pa.list_(pa.int32())), docs, held,
        ], names=["rid", "score", "n_tokens", "known", "base", "rare_h", "rare_n", "doc_id", "held_out"])


def _hashed(texts: Iterable[str | None], memo: WordHasher) -> list[np.ndarray]:
    return [np.append(memo.of(ascii_words(t)), END) for t in texts]


def _score(shared, filters):
    """Texts scored with the filter at hand, a broadcast for each kind of key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = shared.value, WordHasher()
        for batch in batches:
            for i in range(0, batch.num_rows, SCORED):
                b = batch.slice(i, SCORED)
                hs = _hashed(b.column(1).to_pylist(), memo)
                yield model.rows(b.column(0), hs, b.column(2), b.column(3), lambda kind, k: filters[kind].value.levels(k))

    return tidy(run)


def _blocks(block_bytes: int):
    """Rows with the block they belong to: the number of its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = None, 0
        for batch in batches:
            of = []
            for rid, n in zip(batch.column(0).to_pylist(), pc.binary_length(batch.column(1)).to_pylist()):
                n = (n or 0) + ROW_BYTES
                if block is None or size + n > block_bytes:
                    block, size = rid, 0
                size += n
                of.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int64())], names=[*batch.schema.names, "block"])

    return tidy(run)


def _distinct(hs: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The distinct words, pairs and triples of some texts, sorted."""
    for kind in range(3):
        yield np.unique(np.concatenate([token_keys(h)[kind] for h in hs]))


def _ask(ranges: int):
    """(kind, range, block, list): the distinct keys of a block of texts, for the ranges that hold their levels."""

    def run(texts: pa.Table) -> pa.Table:
        block, rows = texts.column("block")[0].as_py(), []
        for kind, key in enumerate(_distinct(_hashed((t.as_py() for t in texts.column("text")), WordHasher()))):
            rows += [(kind, r, block, _packed(key[a:b], np.zeros(0))) for r, a, b in _by_range(key, ranges)]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["kind", "r", "block", "list"])

    return run


def _answer(asked: pa.Table, made: pa.Table) -> pa.Table:
    """The levels of the asked keys of one range (0 without a filter), in the order of the keys."""
    blocks = data = None
    if made.num_rows:
        blocks, data = made.column("blocks")[0].as_py(), np.frombuffer(made.column("data")[0].as_py(), "<u8")
    out, held, size = [], [], 0

    def flush():
        key = np.concatenate(held)
        level_ = np.zeros(len(key), np.uint8)
        if blocks:
            level_ = levels_of(key, np.full(len(key), blocks, np.uint64), np.zeros(len(key), np.int64), data).astype(np.uint8)
        out.extend(x.tobytes() for x in np.split(level_, np.cumsum([len(k) for k in held])[:-1]))
        held.clear()

    for x in asked.column("list"):
        held.append(_unpacked(x.as_py())[0])
        size += len(held[-1])
        if size >= ASKED:
            flush()
            size = 0
    if held:
        flush()
    return pa.table({"kind": asked.column("kind"), "r": asked.column("r"), "block": asked.column("block"), "levels": pa.array(out, pa.binary())})


def _score_block(shared):
    """The texts of one block scored with the levels that came back for it."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        hs = _hashed((t.as_py() for t in texts.column("text")), WordHasher())
        got = sorted(zip(*[answers.column(c).to_pylist() for c in ("kind", "r", "levels")]))
        known = [(key, np.frombuffer(b"".join(v for n, _, v in got if n == kind), np.uint8).astype(np.int64)) for kind, key in enumerate(_distinct(hs))]
        levels = lambda kind, k: known[kind][1][np.searchsorted(known[kind][0], k)]
        ids, docs, held = (texts.column(c).combine_chunks() for c in ("rid", "doc_id", "held_out"))
        part = lambda i: slice(i, i + SCORED)
        made = [shared.value.rows(ids[part(i)], hs[part(i)], docs[part(i)], held[part(i)], levels) for i in range(0, len(hs), SCORED)]
        return pa.Table.from_batches(made)

    return run


_MAIN = "rid bigint, score double, n_tokens bigint, known bigint, base double, rare_h array<bigint>, rare_n array<int>"


def _load(filters: DataFrame, kind: int, ranges: int) -> Ranges:
    """The filter of one kind on the driver, filled range by range into one array."""
    mine = filters.where(F.col("kind") == kind)
    return Ranges(ranges, mine.select("r", "blocks").collect(), ((x.r, x.data) for x in mine.select("r", "data").toLocalIterator()))


def score(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    held_fold: int = 2,
    filter_bytes: int = FILTER_BYTES,
    range_bytes: int = RANGE_BYTES,
    frequent: int = FREQUENT,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    d = only(docs, id_col, text_col).toDF("doc_id", "text")
    kind = d.dtypes[0][1]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_fold, F.lit(False))
    train = d.where(~held).select("text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << (size // range_bytes).bit_length()
    lists = train.mapInArrow(_gather(ranges), "kind int, r bigint, list binary")
    grouped = lists.groupBy("kind", "r")
    filters = stored(grouped.applyInArrow(lambda t: _reduce(t.column("kind")[0].as_py() == 0)(t), _FILTER), "filter")
    words = filters.where("kind = 0")
    total = words.agg(F.sum("tokens"), F.sum(F.size("h"))).first()
    tokens, distinct = int(total[0] or 0), int(total[1] or 0)
    least = max(1, -(-tokens // frequent))
    counts = words.select(F.explode(F.arrays_zip("h", "c")).alias("x")).select("x.h", "x.c")
    t = counts.where(F.col("c") >= least).toArrow()  # at most `frequent` rows
    fh, fc = t.column("h").to_numpy().view(np.uint64), t.column("c").to_numpy()
    order = np.argsort(fh)
    top = fh[order], fc[order]
    n_train = train.count()
    size = (filters.agg(F.sum("blocks")).first()[0] or 0) * BLOCK // 8
    rows = d.select(F.monotonically_increasing_id().alias("rid"), "text", "doc_id", held.alias("held_out"))
    model, schema = Scorer(top, tokens, distinct, n_train), f"{_MAIN}, doc_id {kind}, held_out boolean"
    if size <= filter_bytes:
        share = spark.sparkContext.broadcast
        shared = [share(_load(filters, k, ranges)) for k in range(3)]  # the driver holds one kind at a time
        scored = rows.mapInArrow(_score(share(model), shared), schema)
    else:
        rows = stored(rows.mapInArrow(_blocks(block_bytes), f"rid bigint, text string, doc_id {kind}, held_out boolean, block bigint"), "texts").groupBy("block")
        asked = rows.applyInArrow(_ask(ranges), "kind int, r bigint, block bigint, list binary")
        made = filters.select("kind", "r", "blocks", "data")
        answers = asked.groupBy("kind", "r").cogroup(made.groupBy("kind", "r")).applyInArrow(_answer, "kind int, r bigint, block bigint, levels binary")
        scored = rows.cogroup(answers.groupBy("block")).applyInArrow(_score_block(spark.sparkContext.broadcast(model)), schema)
    main = stored(scored, "scores")
    # words that are not broadcast: their exact counts by join, summed per document
    rare = main.select("rid", F.explode(F.arrays_zip("rare_h", "rare_n")).alias("x")).select("rid", F.col("x.rare_h").alias("h"), F.col("x.rare_n").alias("n"))
    looked = rare.join(counts.where(F.col("c") < least), "h").groupBy("rid").agg(
        F.sum("n").alias("known2"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("base2"))
    out = main.drop("rare_h", "rare_n").join(looked, "rid", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0)) - F.col("n_tokens") * math.log10(tokens + distinct + 1)).alias("base_score"),
        "score",
    )
