"""Small tables with every awkward case, shared by the tests of the operators."""

from pyspark.sql import types as T

SF_DIR = "/root/testdata/sf0.001"

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    # Names that operators use inside.
    *[T.StructField(name, T.StringType()) for name in ("id", "n_lines", "score", "window", "start", "n", "component", "rep", "found")],
])

LONG = "\n".join(f"line {i} of a very long text with words like w{i * 7919 % 1000} and é{i}" for i in range(4000))
AWKWARD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "one", "de"), (5, "one", "de"), (6, "one two three", None),
    (6, "one two three", None), (7, LONG, "en"), (8, LONG + "!", "en"), (9, "x" * 120, None), (None, "one two three", "en"), (None, None, None),
    (10, "é" * 70 + "\U0001f600", "fr"), (11, "▁ a  b c d", "en"),
]


def table(spark, rows):
    """A documents table of (id, text[, lang]) rows, with further columns of clashing names."""
    full = [(row[0], row[1], row[2] if len(row) > 2 else "en", *["other"] * 9) for row in rows]
    return spark.createDataFrame(full, DOCS)


def awkward(spark):
    return table(spark, AWKWARD)


def empty(spark):
    return table(spark, [])
