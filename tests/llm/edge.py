"""Small tables that hold every awkward case, and plain versions of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "a b c d e f g h i j k l m n o p"), (7, "a b c d e f g h i j k l m n o p"), (8, "A B c d e f g h i j k l m n o p"),
    (9, LONG), (9, LONG), (10, LONG + " tail"), (None, "a b c d e f g h i j k l m n o p"), (None, None), (11, "日本語 テキスト ünïcödé \U0001f600 \x00 nul"), (12, "<|endoftext|> special"),
    (13, "same line\nsame line\nsame line\nother"), (14, "x " * 500),
]


def documents(spark, extra=True, texts=TEXTS):
    """The texts as a documents table; columns with names that operators use themselves."""
    df = spark.createDataFrame([(i, t, "en" if k % 3 else None, f"src{k % 2}", None if t is None else len(t)) for k, (i, t) in enumerate(texts)],
                               "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if extra:
        for name in ("node", "n", "key", "rid", "kept", "component_id", "score", "id", "h", "k", "x", "__row2"):
            df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


def empty(spark):
    return documents(spark).limit(0)
