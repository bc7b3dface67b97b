import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with nulls, repeats and extra columns that clash in name."""

    def make(rows):
        extra = ("label", "score", "kept", "rep", "bucket", "spans", "n_replaced", "piece", "lang", "source")
        schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in extra)
        return spark.createDataFrame([(i, t, *(["x"] * len(extra))) for i, t in rows], schema)

    return make
