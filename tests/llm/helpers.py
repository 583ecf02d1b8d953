"""Small tables with the odd cases every operator must bear."""

from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 9973}" for i in range(60_000))


def odd_documents(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, an extra clashing column."""
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone"
    rows = [
        (1, passage, "en", "a", 3),
        (2, "x " + passage + " y", "en", "a", 3),
        (2, "x " + passage + " y", "en", "a", 3),
        (3, None, None, None, None),
        (4, "", "de", "b", 0),
        (None, "no id here, idiot", "en", "b", 5),
        (5, " \t\n ", "fr", None, 3),
        (6, LONG, "en", "a", 1),
        (6, "the same id, another text", "en", "c", 1),
        (7, "é" * 300_000, "es", "c", 1),
        (8, "Licensed under the MIT License. Apache License, Version 2", "en", "c", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("node", "label", "score", "key", "row", "size", "bucket", "range", "kind"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
