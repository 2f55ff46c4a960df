import pytest

# rows that every operator on texts must bear: null, empty, blank, repeated and very long
ODD_TEXTS = [None, "", " \n\t ", "one", "one", "two words", "x" * 20_000, "long text " * 4_000]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with columns whose names operators use inside."""
    rows = [(100 + i, t, "n", "node", 1, "unit") for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, rep string, block int, unit string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
