import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table from (doc_id, text) or longer rows, with columns that clash."""

    def make(rows):
        full = [(*row, "en", "src0", 1, "x")[:6] if len(row) == 2 else row for row in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, row long, ids string"
        ).repartition(3)

    return make


@pytest.fixture(scope="session")
def got():
    """Rows of a table as a sorted list of tuples of the named columns."""

    def collect(df, *names):
        return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)

    return collect
