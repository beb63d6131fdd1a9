import pytest


@pytest.fixture
def documents(spark):
    def make(*texts):
        rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return make
