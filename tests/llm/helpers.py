"""Fixtures with the awkward rows that every operator has to take."""

from pyspark.sql import functions as F

EXTRA = "long string not in any other row "


def awkward(spark, rows):
    """Rows of (doc_id, text) with columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    clash = {"id": F.lit("x"), "node": F.lit(1), "shard": F.lit("s"), "slot": F.lit(None).cast("string"), "kept": F.lit(0), "leaks": F.lit("l"), "score": F.lit("s"), "n_lines": F.lit("n"), "n_tokens": F.lit("t"), "size": F.lit("z"), "__chunk": F.lit("c"), "line": F.lit("y"), "lang": F.lit(None).cast("string"), "source": F.lit("src"), "n_chars": F.lit(None).cast("bigint")}
    return df.withColumns(clash)


def long_text(word="wort", n=30_000):
    return " ".join(f"{word}{i % 997}" for i in range(n))


ROWS = [(1, "one two three four five six seven"), (2, None), (3, ""), (4, "  \t\n "), (None, "one two three four five six seven"), (5, "one two three four five six seven"), (5, "one two three four five six seven"), (6, long_text()), (7, long_text()), (8, "Élan ÉCOLE naïve"), (None, None), (9, "x")]
