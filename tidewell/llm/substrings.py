"""Repeated-substring removal: every byte inside a string of ``span`` bytes that
starts anywhere else as well.

A document's windows of ``span`` bytes are grouped by their minimizer, the
leftmost least hash of their ``GRAM``-byte grams.  Equal windows have equal
minimizers at equal offsets, so only segments with one anchor gram have to be
compared, and the anchors, one per some 185 bytes, are all that is shuffled.

* Segments (all windows of one anchor) that are equal as a whole are settled
  by their digests, copies being combined before they are shuffled.
* One segment of each digest, where an anchor has several, is read again and
  sorted by deep-shallow sorting to the right and to the left of the anchor;
  neighbours' common prefixes tell for each window whether another has it.
* Anchors with more than ``HOT`` different segments are not sorted in one
  task: their windows' digests are counted, which combines before the shuffle.

Which rows the second reading sends is decided by a bitmap of bounded size; a
false positive only costs a row that the exact join then drops.  Texts without
removed bytes are never shuffled (likewise by bitmap).

Rows are told apart by a 64-bit hash of id and text, which every scan finds
again whatever order it reads in; rows equal in both have equal results.

Cases: null and empty texts have no bytes; texts under ``span`` bytes are never
touched; repeated rows are documents of their own, so all of both goes; long
texts are read in pieces; ties of hashes fall to the leftmost gram; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._common import _K, mix, only, stored, tidy
from tidewell.llm.suffixes import deep_shallow_sort

SPAN = 400
GRAM = 32
HOT = 2000
#: Most bits of a broadcast bitmap, and bits for each key below that.
BITMAP, KEY_BITS = 1 << 27, 16
#: Window starts that are looked at together.
STEP = 1 << 19

_POS = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte grams (k a power of two), by doubling."""
    h, n, power = mix(b.astype(np.uint64) + np.uint64(1)), 1, _BASE
    while n < k:
        h = h[:-n] * np.uint64(power) + h[n:]
        n, power = 2 * n, power * power & 0xFFFFFFFFFFFFFFFF
    return mix(h)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n, m = 1, v
    while 2 * n <= w:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    return np.minimum(m[: len(m) - (w - n)], m[w - n :]) if w > n else m


def anchors(b: bytes, span: int, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, position, first and last window start) of the anchors of a text."""
    for at in range(0, max(0, len(b) - span + 1), STEP):
        part = np.frombuffer(b[at : at + STEP + span - 1], np.uint8)
        h = gram_hashes(part, gram)
        low = sliding_min((h & ~_POS) | np.arange(len(h), dtype=np.uint64), span - gram + 1)
        pos = (low & _POS).astype(np.int64)
        first = np.flatnonzero(np.append(True, pos[1:] != pos[:-1]))
        last = np.append(first[1:], len(pos)) - 1
        yield h[pos[first]], pos[first] + at, first + at, last + at


def segments(b: bytes, span: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(anchor hash, segment digest, anchor position, first and last window start)."""
    for h, a, lo, hi in anchors(b, span):
        for x, p, i, j in zip(h.view(np.int64).tolist(), a.tolist(), lo.tolist(), hi.tolist()):
            yield x, xxhash.xxh3_64_intdigest(b[i : j + span], p - i) - (1 << 63), p, i, j


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_FOUND = "rid bigint, anchor bigint, seg bigint, at bigint, lo bigint, hi bigint, n int"
_FOUND_A = pa.schema([("rid", pa.int64()), ("anchor", pa.int64()), ("seg", pa.int64()), ("at", pa.int64()), ("lo", pa.int64()),
                      ("hi", pa.int64()), ("n", pa.int32())])


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _find(span: int):
    """One row per anchor and digest of a document (n: 1, or 2 if it stands there twice);
    rows without an anchor are windows already known to repeat inside the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                b = (text.as_py() or "").encode()
                mine: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
                for x, d, p, i, j in segments(b, span):
                    mine.setdefault((x, d), []).append((p, i, j))
                twice = []
                for (x, d), where in mine.items():
                    rows.append((rid, x, d, *where[0], min(2, len(where))))
                    if len(where) > 1:
                        twice += [(i, j + 1) for _, i, j in where]
                rows += [(rid, None, None, None, i, j - 1, 0) for i, j in union(twice)]
            while len(rows) >= 50_000:
                yield _batches(rows[:50_000], _FOUND_A)
                del rows[:50_000]
        if rows:
            yield _batches(rows, _FOUND_A)

    return tidy(run)


class Bitmap:
    """Membership of 64-bit keys by one bit each; false positives only."""

    def __init__(self, df: DataFrame, key):
        n = df.count()
        self.bits = 1 << max(10, min(BITMAP, n * KEY_BITS).bit_length() - 1)
        t = (
            df.select(F.pmod(key, F.lit(self.bits)).alias("at"))
            .selectExpr("shiftright(at, 6) AS w", "shiftleft(1L, cast(at % 64 AS int)) AS b")
            .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        )
        self.words = np.zeros(self.bits >> 6, np.int64)  # at most BITMAP / 64 rows came
        self.words[t.column("w").to_numpy()] = t.column("b").to_numpy()

    def has(self, key: np.ndarray) -> np.ndarray:
        at = key & (self.bits - 1)
        return self.words[at >> 6] >> (at & 63) & 1 > 0


def _key(anchor: np.ndarray, seg: np.ndarray, rid: int, lo: np.ndarray) -> np.ndarray:
    return anchor ^ seg ^ np.uint64((rid << 20) & 0xFFFFFFFFFFFFFFFF).astype(np.int64) ^ lo


def _key_column():
    """The same key as :func:`_key`, of the columns of those names."""
    return F.col("anchor").bitwiseXOR(F.col("seg")).bitwiseXOR(F.shiftleft("rid", 20)).bitwiseXOR(F.col("lo"))


_TEXT = "anchor bigint, seg bigint, rid bigint, at bigint, lo bigint, hi bigint, piece binary"
_TEXT_A = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("rid", pa.int64()), ("at", pa.int64()), ("lo", pa.int64()),
                     ("hi", pa.int64()), ("piece", pa.binary())])


def _reread(span: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, rows = shared.value, []
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                b = (text.as_py() or "").encode()
                found = list(segments(b, span))
                if not found:
                    continue
                x, d, p, i, j = (np.asarray(c, np.int64) for c in zip(*found))
                for k in np.flatnonzero(wanted.has(_key(x, d, rid, i))).tolist():
                    rows.append((*found[k][:2], rid, *found[k][2:], b[found[k][3] : found[k][4] + span]))
                if len(rows) >= 5_000:
                    yield _batches(rows, _TEXT_A)
                    rows = []
        if rows:
            yield _batches(rows, _TEXT_A)

    return tidy(run)


def shared_windows(members: list[tuple[int, int, int, bytes]], span: int) -> list[np.ndarray]:
    """For each (at, lo, hi, piece), all pieces different but of one anchor: the starts
    of its windows that another piece has at the same offset from the anchor."""
    left = [p[: a - lo][::-1] for a, lo, _, p in members]
    right = [p[a - lo :] for a, lo, _, p in members]
    n = len(members)
    classes = []
    t = np.arange(0, max(a - lo for a, lo, *_ in members) + 1)
    for side, depth, start in ((right, span - t, min(GRAM, *map(len, right))), (left, t, 0)):
        order, lcp = deep_shallow_sort(side, start)
        c = np.empty((len(t), n), np.int64)
        c[:, order] = np.cumsum(lcp[None, :] < depth[:, None], axis=1)
        # a string shorter than the depth has no window there, whoever it agrees with
        short = np.asarray([len(s) for s in side])[None, :] < depth[:, None]
        classes.append(np.where(short, -1 - np.arange(n), c))
    both = classes[0] * (2 * n + 3) + classes[1]
    both = np.where((classes[0] < 0) | (classes[1] < 0), np.iinfo(np.int64).min + np.arange(n), both)
    rank = np.argsort(both, axis=1, kind="stable")
    row = np.arange(len(t))[:, None]
    same = both[row, rank][:, 1:] == both[row, rank][:, :-1]
    hit = np.zeros(both.shape, bool)
    hit[row, rank[:, 1:]] |= same
    hit[row, rank[:, :-1]] |= same
    return [members[k][0] - t[hit[:, k]] for k in range(n)]


def _runs(starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    s = np.sort(starts)
    cut = np.flatnonzero(np.append(True, np.diff(s) > 1))
    ends = np.append(cut[1:], len(s)) - 1
    return [(int(s[a]), int(s[b])) for a, b in zip(cut, ends)]


_SPANS = "rid bigint, lo bigint, hi bigint"
_SPANS_A = pa.schema([("rid", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _sorted_groups(span: int):
    """Rows come sorted by anchor; each anchor's pieces are compared together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, group, last = [], [], None

        def settle():
            if len(group) > 1:
                for (rid, *_), starts in zip(group, shared_windows([g[1:] for g in group], span)):
                    if len(starts):
                        rows.extend((rid, a, b) for a, b in _runs(starts, span))

        for batch in batches:
            for anchor, rid, at, lo, hi, piece in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if anchor != last:
                    settle()
                    group, last = [], anchor
                    if len(rows) >= 10_000:
                        yield _batches(rows, _SPANS_A)
                        rows = []
                group.append((rid, at, lo, hi, piece))
        settle()
        if rows:
            yield _batches(rows, _SPANS_A)

    return tidy(run)


def _windows(span: int):
    schema = pa.schema([("w", pa.int64()), ("rid", pa.int64()), ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, rid, at, lo, hi, piece in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                rows = [(xxhash.xxh3_64_intdigest(piece[s - lo : s - lo + span], (anchor + at - s) & 0xFFFFFFFFFFFFFFFF) - (1 << 63), rid, s)
                        for s in range(lo, hi + 1)]
                yield _batches(rows, schema)

    return tidy(run)


def repeated_windows(rows: DataFrame, span: int, hot: int = HOT) -> DataFrame:
    """(rid, lo, hi): ranges of window starts that occur elsewhere; rows: rid, text."""
    share = rows.sparkSession.sparkContext.broadcast
    found = stored(rows.mapInArrow(_find(span), _FOUND), "anchors")
    inside = found.where("anchor is null").select("rid", "lo", "hi")
    found = found.where("anchor is not null")
    several = found.groupBy("anchor").agg(F.sum("n").alias("k")).where("k > 1").select("anchor")
    found = stored(found.join(several, "anchor"), "candidates")
    segs = found.groupBy("anchor", "seg").agg(F.sum("n").alias("c"), F.min(F.struct("rid", "at", "lo", "hi")).alias("one"))
    segs = stored(segs, "segments")
    whole = found.join(segs.where("c > 1").select("anchor", "seg"), ["anchor", "seg"]).select("rid", "lo", "hi")
    split = segs.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("c") == 1).alias("open")).where("k > 1 and open")
    members = stored(segs.join(split, "anchor").select("anchor", "seg", "one.*", "k"), "members")
    wanted = share(Bitmap(members, _key_column()))
    pieces = rows.mapInArrow(_reread(span, wanted), _TEXT).join(members, ["anchor", "seg", "rid", "at", "lo", "hi"])
    pieces = pieces.select("anchor", "rid", "at", "lo", "hi", "piece", "k")
    cool = pieces.where(F.col("k") <= hot).drop("k").repartition("anchor").sortWithinPartitions("anchor", "rid", "at").mapInArrow(
        _sorted_groups(span), _SPANS)
    out = inside.unionByName(whole).unionByName(cool)
    if not members.where(F.col("k") > hot).isEmpty():
        w = pieces.where(F.col("k") > hot).drop("k").mapInArrow(_windows(span), "w bigint, rid bigint, start bigint")
        twice = w.groupBy("w").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("w")
        out = out.unionByName(w.join(twice, "w").select("rid", F.col("start").alias("lo"), F.col("start").alias("hi")))
    return out


def _strip(span: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[] for _ in range(4 + keep)]
            for text, lo, hi in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                b = (text.as_py() or "").encode()
                gone = union([(x, y + span) for x, y in zip(lo or [], hi or [])])
                ends = [0, *[e for _, e in gone]]
                rest = b"".join(b[e:s] for e, s in zip(ends, [*[s for s, _ in gone], len(b)]))
                for c, v in zip(cols, (len(b), len(b) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest)):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"][: 5 + keep])

    return tidy(run)


def _holds(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("cut", pa.array(shared.value.has(batch.column(0).to_numpy())))

    return tidy(run)


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, hot: int = HOT, keep_bytes: bool = False
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes, the rest)."""
    d = only(docs, id_col, text_col).toDF("doc_id", "text").withColumn("rid", F.xxhash64("doc_id", "text"))
    kind = dict(d.dtypes)["doc_id"]
    spans = stored(repeated_windows(d.select("rid", "text"), span, hot), "spans")
    ranges = spans.groupBy("rid").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    wanted = d.sparkSession.sparkContext.broadcast(Bitmap(spans.select("rid").distinct(), F.col("rid")))
    flagged = d.select("rid", "doc_id", "text").mapInArrow(_holds(wanted), f"rid bigint, doc_id {kind}, text string, cut boolean")
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_bytes binary" * keep_bytes
    none = F.lit(None).cast("array<bigint>")
    same = flagged.where("not cut").select("doc_id", "text", none.alias("lo"), none.alias("hi"))
    cut = flagged.where("cut").join(ranges, "rid", "left").select("doc_id", "text", "lo", "hi")
    return same.mapInArrow(_strip(span, keep_bytes), schema).unionByName(cut.mapInArrow(_strip(span, keep_bytes), schema))
