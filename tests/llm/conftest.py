import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def shipped(spark):
    from folioscope.session import ship_package

    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def docs_of(shipped):
    """A documents table from texts (or pairs of id and text)."""

    def make(texts, lang="en"):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, lang, "s", len(t) if t else 0) for i, t in pairs]
        return shipped.createDataFrame(rows, DOC_SCHEMA)

    return make
