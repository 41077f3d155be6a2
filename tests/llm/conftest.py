import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table from (doc_id, text[, lang[, source]]) with extra columns whose names clash with helpers."""

    def build(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("size", "key", "mr_c1", "mr_words", "t", "fp", "node", "spans"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return build
