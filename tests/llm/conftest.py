import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of texts, or of (doc_id, text) pairs."""

    def make(texts, extra=False):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        df = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], DOCS)
        if extra:
            for name in ("digest", "score", "words", "kept", "shard", "start", "uid", "key", "label"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make
