import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Turns (doc_id, text) pairs into a table with the columns of documents."""
    return lambda rows: spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same with columns of names that operators use inside."""
    from pyspark.sql import functions as F

    names = ("accepted", "dropped_lines", "new_text", "group_id", "key", "line", "rank", "part", "payload", "Salt", "head", "chain", "a.b", "n_tokens", "fingerprint")

    def build(rows):
        df = docs(rows)
        for n in names:
            df = df.withColumn(n, F.lit("x"))
        return df

    return build
