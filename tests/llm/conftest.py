import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, short and long texts, ties, repeated rows and a clashing extra column."""
    long = " ".join(f"word{i % 97}x{i}" for i in range(4000))
    rows = [
        (1, None, "a", 1), (2, "", "b", 2), (3, "   \n\t ", None, None), (4, "one", "rid", 4), (4, "one", "rid", 4),
        (None, "nothing here but a null id", "x", 5), (5, long, "y", 6), (6, long + " tail", "y", 7), (7, "ünïcödé wörds — “quoted” 　 text", "z", 8),
        (8, "a b c d", None, None), (9, "a b c d", None, None), (10, "x " * 300, "k", 1), (11, "x" * 900, "k", 1), (11, "another text, same id", "k", 2),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, rid string, n long")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
