import pytest


@pytest.fixture(scope="session")
def made(spark):
    """Small tables of documents from rows (doc_id, text, lang, source), with a column that clashes and an extra one."""

    def make(rows):
        return spark.createDataFrame([(*r, len(r[1] or ""), 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, extra int").repartition(3)

    return make
