import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text, source) rows, with columns whose names results use too."""

    def build(rows, partitions=3):
        full = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in ("n_words", "kept", "score", "size", "target", "spans", "cls", "bucket", "items"):
            df = df.selectExpr("*", f"'x' AS {name}")
        return df.repartition(partitions)

    return build


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [(None, None, None), (1, None, "a"), (2, "", None), (3, "   \n\t ", "a"), (4, "one", "b"), (4, "one", "b"), (5, LONG, "b"), (6, "Ünï cödé \U0001F600 naïve\nline\nline\n", "c")]


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and very long texts, repeated rows."""
    return make(ODD)


@pytest.fixture(scope="session")
def none(make, spark):
    return make([(1, "a", "b")]).limit(0)
