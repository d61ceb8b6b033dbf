import pytest

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod " * 3000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s", 3, 1.0),
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s", 3, 1.0),
        (2, "alpha beta gamma delta epsilon zeta eta theta", None, None, None, None),
        (3, None, "en", "s", None, 2.0), (4, "", "en", "s", 0, 2.0), (5, "   ", "en", "s", 3, 2.0),
        (None, "no id at all here", "en", "s", 5, 2.0), (6, "one", "en", "s", 3, 2.0),
        (7, LONG, "en", "s", len(LONG), 2.0), (9, LONG, "en", "s", len(LONG), 2.0),
        (8, "mail a.b@c.de 10.0.0.1 or +1 (415) 555-1234 or 4111 1111 1111 1111 é𝒳", "en", "s", 9, 2.0),
        (8, "another text under the same id", "en", "s", 9, 2.0),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
