import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Builds a documents table, with a column whose name clashes with the operators' own, from (doc_id, text) rows."""
    def build(rows):
        data = [(i, t, "en", "s", len(t or ""), True) for i, t in rows]
        return spark.createDataFrame(data, DOC + ", hits boolean").repartition(3)
    return build


ODD = [(1, None), (2, ""), (3, "   \n\n "), (4, "one"), (5, "word " * 60_000), (6, "naïve — “quoted” 日本"), (6, "same id, other text"),
       (7, "twice the same row"), (7, "twice the same row"), (None, "a row without an id"), (None, None)]


@pytest.fixture
def odd():
    return list(ODD)
