import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make(spark):
    """Rows (doc_id, text) as documents."""

    def build(rows, **more):
        df = spark.createDataFrame([(d, x, "en", f"s{(d or 0) % 3}", len(x or "")) for d, x in rows], SHAPE)
        return df

    return build


@pytest.fixture(scope="session")
def small(spark):
    """The smallest documents table and its rows."""
    df = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    return df, [(r.doc_id, r.text) for r in df.collect()]
