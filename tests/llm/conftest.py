import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang) rows, with extra columns
    whose names the operators use themselves."""

    def build(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, len(r[1] or ""), 7, "x") for r in rows]
        return spark.createDataFrame(full, DOCUMENTS + ", digest int, shard string")

    return build
