import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text[, source]) as documents, with columns whose names operators may use themselves."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in ("key", "id", "digest", "kept", "score", "row", "dedup_key", "mix_key", "size", "node", "lines", "_y"):
            df = df.withColumn(name, df["lang"])
        return df

    return make
