import pytest

pytest.importorskip("codeloom.llm")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Texts (or (id, text) pairs) as a table of documents with an extra column of a clashing name."""

    def make(texts, extra=True):
        rows = [x if isinstance(x, tuple) else (k, x) for k, x in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            for name in ("words", "score", "kept", "piece", "ids", "fp", "key", "range", "component_id", "spans", "term"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make
