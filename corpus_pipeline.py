"""A training corpus from raw documents: quality, near duplicates, benchmark
passages, secrets, packing.

Each stage reads what the one before has written and keeps every column; the
last returns packed pieces.  No result goes by a position in a scan, which
changes with the cluster and with the joins that Spark picks by size: quality is
judged by content (equal texts of one language get one verdict), of near
duplicates the first by id and content stays, benchmark passages and secrets go
row by row in one narrow pass.

Cases: ids may be null, repeated or of any type, only the choice among near
duplicates and packing read them; null and empty texts fail the quality rules,
and where a stage gets them all the same they are no duplicates, clean and
without secrets; equal rows share their verdict, and of equal rows with words
one stays behind the second stage; very long texts are read whole; an empty
table gives an empty one with the same columns; further columns stay as they
are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, NumericType, StructType, VariantType

from tidewell.llm import decontaminate, neardup, packing, quality, secrets
from tidewell.llm._common import stored, table


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _bits(cols: list[Column]) -> Column:
    """128 bits that stand for the values of columns."""
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), *[x for c in cols for x in (c.isNull(), c)])), 16, "0")
    return F.concat(half("one"), half("two"))


def _content(docs: DataFrame, name: str) -> DataFrame:
    """A column with 128 bits that stand for text and language."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    return docs.withColumn(name, _bits([F.col("text"), lang]))


def _place(docs: DataFrame) -> Column:
    """What rows are ordered by, wherever they are read: id (null last), then all columns."""
    kind = docs.select("doc_id").schema[0].dataType
    by = F.col("doc_id") if isinstance(kind, NumericType) else F.col("doc_id").cast("string")
    cols = [
        F.to_json(F.struct(F.col(f"`{f.name}`")), {"ignoreNullFields": "false"})
        if isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType)) else F.col(f"`{f.name}`")
        for f in docs.schema
    ]
    return F.struct(by.isNull().alias("none"), by.alias("id"), _bits(cols).alias("bits"))


def _without(docs: DataFrame, against: DataFrame, name: str) -> DataFrame:
    """The rows whose key is not among ``against``, without the key.

    Texts are not shuffled where the keys fit a broadcast; Spark goes by the
    measured size of the written keys.
    """
    return docs.join(stored(against.distinct(), "verdicts"), name, "left_anti").drop(name)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the rules reject go."""
    name = _free(docs, "content")
    d = _content(docs, name)
    return _without(d, quality.judge(d, id_col=name).where("not kept").select(F.col("doc_id").alias(name)), name).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8; of each group the row with the least id stays, of equal ids one by content.

    The rows are written with numbers first, and every later scan, the last one
    included, reads these.  Numbers follow the scan, which a join in the stage
    before may have put in another order, so they only name rows.
    """
    name, place = _free(docs, "row"), _free(docs, "place")
    d = stored(docs.withColumn(place, _place(docs)).withColumn(name, F.monotonically_increasing_id()), "numbered")
    groups = neardup.near_duplicates(d, id_col=name).where("not kept").select(F.col("doc_id").alias(name), F.col("component_id").alias("of"))
    groups = stored(groups, "groups")  # all rows of a group but the one whose number names it
    groups = groups.unionByName(groups.select(F.col("of").alias(name), "of").distinct())
    first = groups.join(d.select(name, place), name).groupBy("of").agg(F.min(F.struct(place, name)).alias("first"))
    gone = groups.select(name).join(first.select(f"first.{name}"), name, "left_anti")
    return _without(d, gone, name).select(*[f"`{c}`" for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their rule's name; n_chars, if there, is counted anew."""
    out = secrets.redact(docs)
    if dict(out.dtypes).get("n_chars") in ("int", "bigint"):
        kind = dict(out.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: The stages need a language model, a forest and a tokenizer, which SQL cannot express;
#: tests hold each of them against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
