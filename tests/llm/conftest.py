import pytest

DOCS = "doc_id long, text string, lang string, half long, key string, unit string, near long, label string, rep long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with extra columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", 1, "k", "u", 2, "l", 3) for i, t in rows], DOCS)

    return make


EDGES = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "lost words here"), (None, None), (7, "ünï 🤦🏼 码 " * 3000)]
