import pytest


@pytest.fixture
def frame(spark):
    """DataFrame of documents from (doc_id, text) rows, with the columns of the table and a few that clash."""

    def build(rows, extra=()):
        rows = [(k, t, "en", "src0", None if t is None else len(t), *[x for _, x in extra]) for k, t in rows]
        names = "".join(f", `{n}` string" for n, _ in extra)
        return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long{names}")

    return build
