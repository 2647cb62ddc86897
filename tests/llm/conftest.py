"""Tables of small documents with the awkward cases."""

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=True):
        """rows: (doc_id, text).  Extra columns clash with names the operators use inside."""
        if not extra:
            return spark.createDataFrame(rows, "doc_id long, text string")
        wide = [(i, t, "en", "s", 7, 8, 9) for i, t in rows]
        return spark.createDataFrame(
            wide, "doc_id long, text string, lang string, source string, row long, key long, head long"
        )

    return make


#: Nulls, empties, blanks only, ties and repeated rows.
AWKWARD = [
    (5, "a  b\tc"),
    (3, "a b c"),
    (9, " a b c"),
    (None, "a b c"),
    (7, None),
    (8, ""),
    (10, " \n "),
    (10, " \n "),
    (11, "x " * 20_000),
    (12, "x  " * 20_000),
    (None, None),
    (13, "é é"),
    (14, "é é"),
]


@pytest.fixture(scope="session")
def awkward(docs_of):
    return docs_of(AWKWARD)


@pytest.fixture(scope="session")
def odd_columns(spark):
    """Columns that clash with names used inside, hold a dot, or cannot be ordered."""
    rows = [
        (1, "a b c d e f", "u", 1, {"k": "x"}, "row"),
        (2, "a  b c d e f", "v", 2, {"k": "x"}, "row"),
        (4, "quite another text", "w", 4, {"k": "x"}, "row"),
        (None, None, "z", 5, {"k": "x"}, "row"),
        (None, "", "z", 5, {"k": "x"}, "row"),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, `__id` string, `a.b` int, tags map<string,string>, `row` string"
    )
