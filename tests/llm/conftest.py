import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, long and repeated texts, a repeated id, and extra columns whose names operators use themselves."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    rows = [
        (1, "one two three four five six seven", "en", "a"), (1, "one two three four five six seven", "en", "a"),
        (2, None, "en", "b"), (3, "", None, "b"), (4, "  \n\t ", "fr", None), (None, "one two three four five six seven", "en", "a"),
        (5, "ONE two three four five six seven", "en", None), (6, "short", None, "c"), (7, "short", "de", "c"), (8, long, "en", "b"),
        (9, long + " tail", "en", "a"), (10, "é😀 ñ " * 50, "es", "a"), (11, "x" * 300_000, "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    extra = {c: F.lit(None).cast("string") for c in ("id", "size", "score", "n", "v", "rep", "component_id", "kept", "spans", "term", "key", "part", "root", "row", "y", "media", "record")}
    return df.withColumns(extra).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
