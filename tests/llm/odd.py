"""Small awkward tables: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

from pyspark.sql import types as T

LONG = "alpha beta gamma delta " * 12_000
PROSE = "The first words of a plain text about rivers, and how they bend on their way to the sea.\nAnother line follows that one with more words in it."

ROWS = [
    (0, PROSE, "en", "a", 10),
    (1, PROSE, "en", "a", 10),
    (1, PROSE, "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \n\t\r ", "xx", "b", 4),
    (5, LONG, "de", None, len(LONG)),
    (None, PROSE, "en", "a", 10),
    (None, None, None, None, None),
    (6, "!!! ### ||| $$$", "fr", "b", 15),
    (7, "é ﬁ 日本語 \U0001f600 word", "es", "b", 12),
]

BASE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Names that the operators use inside.
CLASHES = ["id", "t", "w", "key", "rep", "line", "row", "base", "n_words", "component", "score", "tokens", "m_0", "kept", "label", "features"]
WIDE = T.StructType([*BASE.fields, *[T.StructField(c, T.StringType()) for c in CLASHES]])


def documents(spark):
    """The awkward rows, with extra columns of clashing names."""
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in ROWS], WIDE).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], WIDE)


def by_row(df, *columns):
    """Collected rows of the columns, nulls first."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda t: tuple((v is not None, str(v)) for v in t))
