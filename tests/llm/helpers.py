"""Plain Python versions of what the operators compute, and a table of awkward documents."""

import re

from pyspark.sql.types import LongType, StringType, StructField, StructType

GAP = re.compile(r"[ \t\n\x0b\f\r]+")
DOCUMENTS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        # Names that operators might use themselves.
        StructField("key", StringType()),
        StructField("row", StringType()),
        StructField("size", StringType()),
        StructField("rank", LongType()),
        StructField("score", StringType()),
        StructField("class", StringType()),
        StructField("n_words", StringType()),
    ]
)


def words(text):
    return [w for w in GAP.split(text or "") if w]


def documents(spark, texts, langs=None, sources=None, ids=None):
    """A documents table with extra columns whose names clash."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = []
    for i, text in enumerate(texts):
        lang = langs[i % len(langs)] if langs else "en"
        source = sources[i % len(sources)] if sources else "s"
        rows.append((ids[i], text, lang, source, len(text or ""), "k", "r", "z", 7, "x", "c", "w"))
    return spark.createDataFrame(rows, DOCUMENTS)


def rows(df, *columns):
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)


AWKWARD = [
    None,
    "",
    "   \n\t ",
    "a",
    "two words",
    "three little words",
    "x " * 5000,
    "same text here again and again",
    "same text here again and again",
    "Ünï code   wörds 漢字 \x0b\x0cend",
    "line\nline\nline\nother",
]
