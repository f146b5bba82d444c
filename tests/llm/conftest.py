import os

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, row int"
PAGES = "page_id long, url string, html string, host int"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


def odd_documents(spark, texts):
    """Documents with nulls, an empty and a very long text, repeated rows and columns whose names clash with those that operators make."""
    rows = [(i, t, "en", "s", len(t), "x", 1) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None, None, None), (901, "", "en", "s", 0, "x", 1), (902, " \t\n ", None, "s", 4, "x", 1)]
    rows += [(None, "a row without an id but with words in it", "en", None, 40, "x", 1), rows[0], rows[0]]
    rows += [(903, "long " * 30000 + "z" * 100000, "en", "t", 250000, "x", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
