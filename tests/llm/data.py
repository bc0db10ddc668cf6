"""Small tables with what is odd: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD_DOCS = DOCS + ", id long, row string, k string, n int, words int, `a.b` string"


def odd_docs(spark):
    """Documents whose extra columns bear names that operators use inside."""
    long = "the quick brown fox jumps over the lazy dog again and again\n" * 3 + " ".join(f"w{i}" for i in range(60_000))
    rows = [
        (1, "one two three four five six seven eight nine ten", "en", "a", 48),
        (2, None, "en", "a", None),
        (3, "", "en", "a", 0),
        (4, " \n\t\n", None, None, 4),
        (5, long, "en", "a", len(long)),
        (None, "a text without an id, of some words", "de", "b", 35),
        (6, "one two three four five six seven eight nine ten", "en", "a", 48),
        (7, "naïve café — ünïcode 漢字 😀 ok", "fr", None, 30),
        (7, "naïve café — ünïcode 漢字 😀 ok", "fr", None, 30),
        (8, "one two three four five six seven eight nine ten", None, "b", 48),
    ]
    return spark.createDataFrame([(*r, 1, "x", None, 2, 3, "y") for r in rows], ODD_DOCS)


def docs(spark, texts, lang="en", source="a"):
    return spark.createDataFrame([(i, t, lang, source, len(t)) for i, t in enumerate(texts)], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
