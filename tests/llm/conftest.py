import pytest

CLASHING = "node string, rank string, key string, shard string, salt string, hash string, words string, row_id string, batch string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table with odd rows' own columns beside those of the contract."""

    def make(rows, extra=False):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + (", " + CLASHING if extra else "")
        full = []
        for r in rows:
            doc_id, text, source = (*r, "s")[:3] if len(r) < 3 else r
            base = (doc_id, text, "en", source, None if text is None else len(text))
            full.append(base + (None,) * 9 if extra else base)
        return spark.createDataFrame(full, schema)

    return make


LONG = "word " * 30_000

#: Nulls, empty and blank texts, repeated rows, one very long text.
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (4, "one", "b"), (5, "one", "c"),
    (None, "a row without an id", "a"), (6, LONG, "b"), (7, "é ü 日本 \U0001f600 and more words here to read", "a"),
]
