import pytest


@pytest.fixture(scope="session")
def make(spark):
    """A DataFrame of documents from texts (ids 0, 1, ...) or rows ``(doc_id, text)``, with columns whose names clash with results."""

    def build(texts, extra=True):
        rows = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", f"s{k % 2}", None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
        clash = {c: "x" for c in ("size", "score", "spans", "fingerprint", "bucket", "key", "slot", "level", "fp", "id", "n")} if extra else {}
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit(v) for c, v in clash.items()})

    return build
