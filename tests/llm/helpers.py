"""Small tables with the cases every operator must bear."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))
COPY = "the quick brown fox jumps over the lazy dog again and again until the day is over and all is said and done for good today"
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, None), (4, COPY, "en", "a"), (5, COPY, "en", "b"), (5, COPY, "en", "b"),
    (6, COPY.replace("fox", "cat"), None, "b"), (7, LONG, "en", "c"), (8, "Ünïcödé ça va? 漢字 😀 ok\nÜnïcödé ça va? 漢字 😀 ok", "fr", "a"), (None, "no id here, only a text with words", "en", None),
    (None, None, None, None), (10, "x", "de", "a"), (11, "a\x00b c", "en", "é"),
]
CLASHES = ("K1", "k2", "n_words", "Fingerprint", "key", "whole", "ids", "pii", "dropped", "quality", "score", "lang_pred", "lines", "words", "Winner", "text_", "base_failed", "n_lines")


def edge(spark):
    """ROWS with extra columns whose names clash with generated ones."""
    d = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({c: F.lit("kept") for c in CLASHES})


def empty(spark):
    return edge(spark).limit(0)


def extras_kept(df):
    for c in CLASHES:
        assert c in df.columns
        assert {r[0] for r in df.select(c).collect()} <= {"kept"}
