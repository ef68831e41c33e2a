import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def docs(rows):
        return spark.createDataFrame([(r[0], r[1], *(r[2:] or ("en", "s")), None if r[1] is None else len(r[1])) for r in rows], SCHEMA)

    return docs


@pytest.fixture(scope="session")
def clash():
    """A frame with further columns whose names differ from its own in case only, or are those of the operators."""
    from pyspark.sql import functions as F

    def more(df):
        out = df
        for i, n in enumerate(("fp", "n_words", "_s_n_words", "_id", "m_symbols", "_kept", "pii", "component_id", "host", "verdict", "score", "_lang", "turns", "items")):
            if n not in df.columns:
                out = out.withColumn(n, F.lit(f"own {i}"))
        return out.toDF(*out.columns).withColumn("extra", F.lit(1)).toDF(*out.columns, "TEXT" if "text" in df.columns else "URL")

    return more
