import pytest


@pytest.fixture
def frame(spark):
    """docs from (doc_id, text) pairs, with columns whose names could clash."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        if not extra:
            return df
        from pyspark.sql import functions as F

        # names that operators use inside
        return df.select("*", *[F.lit("x").alias(c) for c in ("h", "t", "w", "n", "key", "row", "node", "words", "fp", "keys", "lines", "size", "kind", "block", "held", "score", "doc_key")])

    return make
