import random

import pytest

WORDS = "the quick brown fox jumps over lazy dog while many small birds sing in old green trees near river banks".split()
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "score double, spans string, result string, k0 string, id string, fp string, component_id string, length string")


def docs_of(spark, rows):
    """documents-like table with columns whose names clash with the operators' own."""
    full = [(i, t, lang, "src", len(t or ""), 9.5, "s", "r", "k", "i", "f", "c", "l") for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    """Null id, null and empty text, one very long text, repeated rows, ties, odd characters."""
    rng = random.Random(3)
    long_text = " ".join(rng.choice(WORDS) + str(rng.randrange(9000)) for _ in range(40_000))
    return [(1, None, "en"), (2, "", "en"), (3, "   \n\t ", None), (4, "x", "en"), (5, "the the the the the", "en"),
            (6, long_text, "en"), (7, "the quick brown fox jumps over the lazy dog", "en"),
            (7, "the quick brown fox jumps over the lazy dog", "en"), (8, "THE quick brown fox jumps over the lazy dog", "en"),
            (9, "1234 5678 !!! ---", "de"), (10, "日本 　 \U0001F600 é'll don't", None), (None, "a text without an id", "en"),
            (None, "a text without an id", "en"), (11, "\x00\x1c <|endoftext|> 's", "fr")]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return docs_of(spark, edge_rows).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
