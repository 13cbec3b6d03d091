import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    """Texts, or (doc_id, text) pairs -> documents, with columns whose names operators use inside."""

    def make(rows, source="s"):
        full = [(*(r if isinstance(r, tuple) else (i, r)),) for i, r in enumerate(rows)]
        data = [(k, t, "en", source, len(t or ""), 1, "x", 2) for k, t in full]
        return spark.createDataFrame(data, DOCS + ", n_words int, fp string, `count` int")

    return make


@pytest.fixture(scope="session")
def odd(table):
    """Null, empty, blank, very long, tied and repeated rows, and a null doc_id."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    same = "the same words in the same order make the very same text for all who read it today and tomorrow too"
    return table([None, "", " \n\t ", long, same, same, (5, same), (None, "no id here at all, only words"), "one", "!!! ???"])


@pytest.fixture(scope="session")
def none(table):
    return table([("0",)][:0] or [])
