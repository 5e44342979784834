"""Small documents that hold the awkward cases."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))


def awkward(spark):
    """Nulls in every column, empty and white-space texts, a very long text, ties, repeated rows."""
    texts = [None, "", "   \n\t ", LONG, "alpha beta gamma delta", "alpha beta gamma delta", "Alpha BETA gamma delta", "ça va <b>? 漢字  x\n\n y", "\x1c a\x0bb\x85c d", "it's we're <|endoftext|> 12345"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "alpha beta gamma delta", None, None, None), (77, "lone", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
