"""Every core query against its SQL on the smallest tables."""

import pytest

from corvidex.plans import core_queries, file_queries, retrieval_queries

ALL = {**retrieval_queries.QUERIES, **file_queries.QUERIES, **core_queries.QUERIES}
SQL = {**retrieval_queries.SQL, **file_queries.SQL, **core_queries.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, name):
    from tests.conftest import compare

    compare(spark, sf, ALL[name], SQL[name])


def test_only_results_as_text_have_no_sql():
    assert set(ALL) - set(SQL) == {"spell_suggestions"}


def test_entry_runs(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "score"]
