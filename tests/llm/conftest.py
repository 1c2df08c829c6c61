import pytest

#: Columns that clash with names that operators make themselves.
EXTRA = (
    "lang string, source string, id long, row string, fp long, score double, range int, "
    "bin int, place int, item int, gone_id int, gone int, key int, paragraph int, found_id int, n int"
)


@pytest.fixture
def docs(spark):
    """Documents with clashing extra columns from (doc_id, text) pairs."""

    def make(pairs):
        rows = [(i, t, "xx", "s", 7, "r", 1, 0.5, 2, *range(9)) for i, t in pairs]
        return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}")

    return make


#: Nulls in each column, empty texts, ties, repeated rows and a long text.
ODD = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, ""), (4, "  \t\n "), (5, "é" * 3), (6, "word " * 40_000), (6, "x y z")]
