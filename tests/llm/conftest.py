import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """``docs(texts)``: a table of documents from texts, or from ``(id, text)`` pairs."""

    def make(rows, **other):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, other.get("lang", "en"), other.get("source", "s"), len(t or "")) for i, t in pairs], DOC)

    return make


def rows_by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
