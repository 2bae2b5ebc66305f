import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, row long, size int"


@pytest.fixture
def docs_of(spark):
    """Documents from texts (or (text, lang, source)), with columns whose names the operators use inside."""
    def make(texts, ids=None):
        rows = []
        for i, t in enumerate(texts):
            text, lang, source = t if isinstance(t, tuple) else (t, "en", "s0")
            rows.append((i if ids is None else ids[i], text, lang, source, len(text or ""), 7, 9))
        return spark.createDataFrame(rows, DOC)

    return make


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
