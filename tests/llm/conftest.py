import os

import pytest

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables():
    if not os.path.isdir(TABLES):
        pytest.skip("no test tables")
    return TABLES


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, a null id, repeated rows, a shared id, long runs, and a column with a clashing name."""
    prose = " ".join(f"word{i}" for i in range(120))
    rows = [
        (1, prose, "en", 1), (2, prose, "en", 2), (2, prose, "en", 2), (3, None, None, 3), (4, "", "de", 4), (5, " \n\t ", "fr", 5),
        (6, "one two", "en", 6), (7, prose + " tail of its own", "en", 7), (None, prose, "en", 8), (9, "x " * 3000, "en", 9),
        (10, "Ünïcode ﬁ 😀 " * 40, None, 10), (10, "another text under the same id", "en", 11), (11, "".join(f"{i}," for i in range(4000)), "en", 12),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
