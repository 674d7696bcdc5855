import subprocess
import sys

import pytest

from corvidex.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, sf, name):
    from tests.conftest import compare

    compare(spark, sf, queries.QUERIES[name], queries.SQL[name])


COLUMNS = {
    "p1_found": ["tbl", "rec_id", "kind"],
    "p3_found": ["field", "term", "mark"],
    "p4_found": ["query_id", "doc_id"],
    "p5_found": ["result_id", "line_no"],
    "p6_ids": ["doc_id", "ids"],
    "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.columns == COLUMNS[name] and df.count() > 0


def test_nothing_else_imports_this_package():
    code = "import sys; sys.modules['corvidex.llm'] = None; import __spark_entry__ as e; assert 'p2_found' in e.queries() and 'p3_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
