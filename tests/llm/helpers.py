"""Small tables with every awkward case: nulls, empty and long texts, ties, repeats, clashing column names."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards boxed twelve jars of very old plum jam near the harbour wall at dusk".split()


def prose(n, seed):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE) + rng.choice(["", "", "er", "ing", "s"]) for _ in range(n))


def odd_rows():
    long = prose(20_000, 5)
    return [
        (1, prose(80, 1), "en", "a", 0), (2, prose(80, 2), "en", "a", 0), (3, prose(80, 1), "de", "b", 0), (4, None, "en", "a", None), (5, "", None, None, 0),
        (6, "  \n\t ", "fr", None, 0), (7, long, "en", "c", 0), (8, "ünï©ödé 日本 😀 \x00 word", "xx", "c", 0), (None, prose(80, 1), "en", "a", 0), (None, None, None, None, None),
        (9, prose(40, 9), "en", "a", 0), (9, prose(40, 9), "en", "a", 0), (10, "one", "en", "b", 3),
    ]


def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """Columns under names that an operator might use itself."""
    from pyspark.sql import functions as F

    for name in ("id", "t", "fp", "key", "h", "n", "score_", "node", "size", "start", "block", "component", "media_", "host", "score", "media", "n_bytes", "pieces", "tokens", "judged", "language", "feature", "__k1", "head", "owner"):
        df = df.withColumn(name, F.lit("x"))
    return df
