"""Near-duplicate documents: SuperMinHash, banding, verification, union-find.

1. Each document becomes its set of distinct word shingles (64-bit hashes),
   a digest of that set, and a SuperMinHash signature.  Equal digests are one
   class, represented by the least id, so copies cost one row each.
2. Signatures are cut into bands; classes that agree on a band share a bucket.
   ``BANDS`` bands of ``ROWS`` registers miss a pair at the threshold with
   probability (1 - 0.8^6)^42 < 4e-6.
3. In each bucket all classes are compared with one pivot (whole sets, read
   from the texts).  Components follow; a bucket whose classes are then all in
   one component is settled.  Others meet further pivots, and what is still
   apart is paired only where both sides share one of their rarest shingles
   (prefix filter), which every link must.  No pair is dropped and groups of
   copies are never expanded into all pairs.
4. Components are found by partition-wise union-find and star rounds.

Cases: null or empty text: no shingles, linked with nothing; fewer words than
a shingle: the whole sequence is the one shingle; equal ids are one node; a
null id is linked with nothing and kept; ties of ids cannot arise (the least
id represents); ids are whole numbers, and texts that are none raise an error;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._common import _K, WordHasher, ascii_words, grams, mix, only, stored, tidy
from tidewell.llm.components import components

BANDS = 42
ROWS = 6
#: Shingles whose registers are drawn together.
CHUNK = 32_768
#: Rows of a bucket from which its head is broadcast rather than joined by hash, and most such buckets.
HOT_ROWS, MOST_HOT = 2_000, 100_000
#: Pairs of one text that are verified together; further ones go to tasks of their own.
PAIRS = 256
#: Further pivots per bucket before the exact pairing of what is left.
PIVOT_ROUNDS = 2

_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; a shorter text is one shingle."""
    if not len(h):
        return h
    return np.unique(grams(h, min(n, len(h))) ^ np.uint64(0 if len(h) >= n else len(h)))


def superminhash(sets: list[np.ndarray], m: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash registers of each set; row of a set is all ones if it is empty.

    Element x visits the registers in a random order p_0, p_1, ...; at step j it
    offers j + r_j to register p_j.  Steps end for a set when every register is
    below the next step.  All elements of a chunk take a step together.
    """
    reg = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    at = 0
    while at < len(sets):
        n, end = len(sets[at]), at + 1
        while end < len(sets) and n + len(sets[end]) <= CHUNK:
            n, end = n + len(sets[end]), end + 1
        if end - at > 1 or n <= CHUNK:
            _draw(np.concatenate(sets[at:end]), np.repeat(np.arange(end - at), [len(s) for s in sets[at:end]]), reg[at:end])
        else:  # one long text: its parts' registers have the same minima
            for i in range(0, n, CHUNK):
                x = sets[at][i : i + CHUNK]
                part = np.full((1, m), np.iinfo(np.uint64).max, np.uint64)
                _draw(x, np.zeros(len(x), np.int64), part)
                np.minimum(reg[at], part[0], out=reg[at])
        at = end
    return reg


def _draw(x: np.ndarray, owner: np.ndarray, reg: np.ndarray) -> None:
    m = reg.shape[1]
    if not len(x):
        return
    order = np.broadcast_to(np.arange(m, dtype=np.uint16 if m > 256 else np.uint8), (len(x), m)).copy()
    row, flat = np.arange(len(x)), reg.reshape(-1)
    for j in range(m):
        z = mix(x + np.uint64((int(_K) * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((z & _LOW) * np.uint64(m - j) >> _32).astype(np.int64)
        p = order[row, k].astype(np.int64)
        order[row, k] = order[row, j]
        np.minimum.at(flat, owner * m + p, (np.uint64(j) << _32) | (z >> _32))
        going = reg.max(axis=1) >= np.uint64((j + 1) << 32)
        go = going[owner]
        if not go.any():
            return
        if not go.all():
            x, owner, row = x[go], owner[go], row[go]


def band_hashes(reg: np.ndarray, bands: int, rows: int) -> np.ndarray:
    r = reg.reshape(len(reg), bands, rows)
    g = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _K, (len(reg), bands))
    for i in range(rows):
        g = mix(g * _K + r[:, :, i])
    return g


def _sketch(size: int, bands: int, rows: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHasher()
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                b = batch.slice(i, 1000)
                sets = [shingles(memo.of(ascii_words(t.as_py())), size) for t in b.column(1)]
                h = band_hashes(superminhash(sets, bands * rows), bands, rows).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * bands, h.reshape(-1)),
                    ],
                    schema=schema,
                )

    return tidy(run)


def _check(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, last, kept = WordHasher(), object(), np.empty(0, np.uint64)
        for batch in batches:
            a, b, good = batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, kept = a[i], shingles(memo.of(ascii_words(batch.column(2)[i].as_py())), size)
                y = shingles(memo.of(ascii_words(batch.column(3)[i].as_py())), size)
                both = len(np.intersect1d(kept, y, assume_unique=True))
                good[i] = 100 * both >= percent * (len(kept) + len(y) - both) and both > 0
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    return tidy(run)


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough.

    A text ``a`` with many pairs (the pivot of a large bucket) is sent to so
    many tasks that each verifies about ``PAIRS`` of them.
    """
    pairs = stored(pairs, "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("parts"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).join(parts, "a")
    left = left.select("a", "ta", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    dealt = by_bucket(pairs, parts.select("a", "parts", (F.col("parts") * PAIRS).cast("bigint").alias("k")), "a")
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    wide = dealt.join(right, "b").join(left, ["a", "part"]).select("a", "b", "ta", "tb")
    return wide.mapInArrow(_check(size, percent), "a bigint, b bigint")


def by_bucket(rows: DataFrame, heads: DataFrame, key: str = "h") -> DataFrame:
    """Rows joined with the one head (key, k rows, ...) of their bucket.

    Heads of large buckets are broadcast, so these buckets' rows are not dealt
    by the key.  There are never more than ``MOST_HOT`` of them: a bucket is
    large only beyond that share of all rows.
    """
    heads = stored(heads, "heads")
    total = heads.agg(F.sum("k")).first()[0] or 0
    limit = max(HOT_ROWS, total // MOST_HOT)
    hot = heads.where(F.col("k") > limit)
    if hot.isEmpty():
        return rows.join(heads, key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(heads.where(F.col("k") <= limit), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def _fits(percent: int):
    """Sizes at which a pair can be similar enough at all."""
    return F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")


def _rarest(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHasher()
        for batch in batches:
            for node, n, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                s = shingles(memo.of(ascii_words(text.as_py())), size).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(s), node.as_py())), pa.array(np.full(len(s), n.as_py())), pa.array(s)], names=["node", "n", "s"])

    return tidy(run)


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of buckets (h, node, n) whose nodes are in several components, with c."""
    m = members.join(labels.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    torn = m.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo <> hi").select("h", "k")
    return by_bucket(m, torn).drop("k")


def _empty(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def near_links(nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links among class representatives (node, n, bands)."""
    spark = nodes.sparkSession
    buckets = nodes.select("node", "n", F.explode("bands").alias("h"))
    heads = buckets.groupBy("h").agg(F.min(F.struct("node", "n")).alias("p"), F.count(F.lit(1)).alias("k")).where("k > 1")
    members = stored(by_bucket(buckets, heads).select("h", "node", "n", "p", "k"), "buckets")
    tried = (
        members.where("node <> p.node")
        .select(F.col("p.node").alias("a"), F.col("node").alias("b"), F.col("p.n").alias("na"), F.col("n").alias("nb"))
        .distinct().where(_fits(percent)).select("a", "b")
    )
    links = stored(verified(tried, texts, size, percent), "verified")
    labels = components(links)
    rest = members.where("k > 2").select("h", "node", "n")
    for i in range(PIVOT_ROUNDS):
        rest = stored(_apart(rest, labels).select("h", "node", "n", "c"), "apart")
        if rest.isEmpty():
            return links
        # another pivot: the member that comes first in an order of its own for this round
        first = rest.groupBy("h").agg(
            F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("o"), "node", "n", "c")).alias("p"), F.count(F.lit(1)).alias("k"))
        more = (
            by_bucket(rest, first).where("c <> p.c")
            .select(F.least("p.node", "node").alias("a"), F.greatest("p.node", "node").alias("b"), F.col("p.n").alias("na"), F.col("n").alias("nb"))
            .distinct().where(_fits(percent)).select("a", "b")
        )
        links = stored(links.unionByName(verified(more, texts, size, percent)), "verified")
        labels = components(links)
        rest = rest.select("h", "node", "n")
    rest = _apart(rest, labels)
    last = stored(rest.select("node", "n", "c").distinct(), "apart")
    if last.isEmpty():
        return links
    # exact: what is left can only be linked through one of its rarest shingles
    words = last.join(texts, "node").select("node", "n", "text").mapInArrow(_rarest(size, percent), "node bigint, n bigint, s bigint")
    words = stored(words.distinct(), "shingles")
    count = words.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    ranked = words.join(count, "s").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))
    need = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = ranked.select("node", "n", F.posexplode(F.slice("o", F.lit(1), need.cast("int"))).alias("at", "w"))
    prefix = prefix.where("w.df > 1").select("node", "n", "at", F.col("w.s").alias("s")).join(last.select("node", "c"), "node")
    x = prefix.select("s", F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("c").alias("ca"))
    y = prefix.select("s", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("c").alias("cb"))
    # a bound on the overlap if s is the first shingle in common; for that one it must suffice
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    pairs = (
        x.join(y, "s").where("a < b and ca <> cb").where(_fits(percent))
        .where((100 + percent) * room >= percent * (F.col("na") + F.col("nb")))
        .select("a", "b").distinct()
    )
    return stored(links.unionByName(verified(pairs, texts, size, percent)), "verified")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id reachable), kept."""
    d = only(docs, id_col, text_col).toDF("doc_id", "text")
    d = d.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])
    sketches = stored(
        d.mapInArrow(_sketch(shingle, bands, rows, arrow), "doc_id bigint, n bigint, key binary, bands array<bigint>"), "sketches")
    classes = sketches.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"))
    classes = stored(classes, "classes")
    reps = classes.select("node").distinct()
    nodes = sketches.join(reps.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").where("n > 0").select(
        F.col("doc_id").alias("node"), "n", "bands")
    links = near_links(nodes, d.withColumnRenamed("doc_id", "node"), shingle, percent)
    # equal ids with unequal texts are one node
    same = sketches.where("n > 0 and doc_id is not null").select("doc_id", "key").join(classes.select("key", "node"), "key").where(
        "doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    labels = components(links.unionByName(same))
    out = sketches.select("doc_id", "n").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("component", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )
