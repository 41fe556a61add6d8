"""Every query of the library against its SQL, on the small tables."""

import pytest
from oracle import connect, differing

from millrace.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, con, name):
    df = QUERIES[name](spark, tiny)
    if name in SQL:
        assert differing(df, con, SQL[name]) == ""
    elif name == "indexed_search":
        assert df.columns == ["query_id", "vec_id", "score", "rank"]  # approximate; its recall is tested in test_vector_index
    else:
        assert name == "html_sections" and df.columns == ["source", "text"]  # the tables' pages have no sections; see section_texts
