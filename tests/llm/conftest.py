import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture()
def docs(spark):
    """A maker of small documents tables, with columns that clash with the operators' own."""

    def make(texts, first=0, **more):
        rows = [(None if t is Ellipsis else first + i, None if t is Ellipsis else t, "x", "src", 1, 2, 3) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, component long, rank long")

    return make


@pytest.fixture()
def odd(docs):
    from odd_rows import ODD

    return docs(ODD)
