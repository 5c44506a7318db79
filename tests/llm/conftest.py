import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Null and empty texts, white space only, one word, ties, repeated rows, odd white space, a null id, a very long word.
EDGES = [
    (900_001, None, None, None, None), (900_002, "", "en", "s", 0), (900_003, " \t\n ", "en", None, 4), (900_004, "word", "en", "s", 4), (900_005, "12 34 !!", None, "s", 8),
    (900_006, "same text here twice over", "en", "s", 25), (900_006, "same text here twice over", "en", "s", 25), (900_007, "same text here twice over", "de", "t", 25),
    (900_008, "a b c \x1d d\x0b e", "fr", "s", 12), (None, "no id at all but words", "en", "s", 22), (900_009, "x" * 30_000, "en", "s", 30_000),
    (900_010, "the of " * 4_000, "en", "s", 28_000), (900_011, "😀 é ﬁ ▁ <|endoftext|> x", "en", "s", 22),
]


@pytest.fixture(scope="session")
def few(spark, sf):
    """200 documents of the table and the edge rows, in several files."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 200").select("doc_id", "text", "lang", "source", "n_chars")
    path = "/tmp/checkpoints/causeway-test-docs"
    docs.unionByName(spark.createDataFrame(EDGES, SCHEMA)).repartition(5).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def rows(few):
    return [tuple(r) for r in few.collect()]


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
