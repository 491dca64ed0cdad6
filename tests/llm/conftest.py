import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents of (doc_id, text[, lang[, source]]), with columns whose names clash with those operators use."""

    def make(rows):
        full = [(i, t, *(list(rest) + ["en", "a"][len(rest) :]), None if t is None else len(t)) for i, t, *rest in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        for extra in ("id", "t", "th", "h", "n", "k", "v", "c", "size", "taken", "sid", "keys", "raw", "digest", "x"):
            df = df.withColumn(extra, __import__("pyspark").sql.functions.lit("clash"))
        return df

    return make
