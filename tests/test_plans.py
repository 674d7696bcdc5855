"""What the plans must keep: pruning, pushdown, no Python and no needless shuffles in the retrieval engine."""

import re

import pytest

from corvidex.functions.query import parse_query
from corvidex.operators import index as ix
from corvidex.operators import match, rank
from corvidex.plans import inputs
from corvidex.plans.retrieval_queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def written(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    ix.write(inputs.index(spark, sf), path, 2)
    return ix.load(spark, path)


def test_terms_reach_the_scan(written):
    p = plan(written.term_doc.where("term IN ('buffer', 'close')"))
    assert re.search(r"PushedFilters: \[In\(term", p)
    p = plan(match.all_terms(written, parse_query("closed buffers")))
    assert re.search(r"PushedFilters: \[In\(term", p) and p.count("Exchange") == 1


def test_phrases_need_no_join_of_positions(written):
    p = plan(match.phrase(written, ["close", "too", "early"]))
    assert "Join" not in p and "term" in re.search(r"ReadSchema: (\S+)", p)[1]


def test_only_needed_columns_are_read(spark, sf):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(inputs.index(spark, sf).postings)
    assert "l_extendedprice" not in plan(QUERIES["page_rank"](spark, sf))


@pytest.mark.parametrize("name", ["postings", "term_stats", "page_rank", "num_views", "eval_metrics", "spell_edit2", "html_text_title", "link_extract", "rank_ql"])
def test_no_python_on_executors(spark, sf, name):
    # operators that run Python, by their names; entity names such as "rightArrow" may stand in literals
    assert not re.search("EvalPython|PythonUDF|InPandas|InArrow|MapInPython", plan(QUERIES[name](spark, sf)))


def test_counts_are_added_up_before_the_shuffle(spark, sf):
    p = plan(inputs.index(spark, sf).term_doc)
    assert p.count("partial_count") == 1 and p.count("Exchange") == 1


def test_a_page_is_not_a_full_sort(written):
    assert "TakeOrderedAndProject" in plan(rank.page(rank.query_likelihood(written, parse_query("closed buffers")), 10))


@pytest.mark.parametrize("name", ["rank_ql", "rank_cosine", "rank_comprehensive", "match_phrase", "prf_terms"])
def test_rankings_do_not_read_the_text_again(spark, sf, name):
    """The text is read once, when the index is written; what is asked of it later reads the index."""
    df = QUERIES[name](spark, sf)
    p = plan(df)
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", p)
    assert not any(re.search(r"\btext#", s) for s in scans)


def test_an_index_is_written_from_one_pass(spark, sf, tmp_path):
    idx = inputs.index(spark, sf)
    ix.write(idx, str(tmp_path / "i"), 2)
    again = ix.load(spark, str(tmp_path / "i"))
    assert again.scalars().collect() == idx.scalars().collect()
    assert sorted(map(tuple, again.doc_stats.select("doc_id", "length").collect())) == sorted(map(tuple, idx.doc_stats.select("doc_id", "length").collect()))
    assert re.search(r"PushedFilters: \[.*EqualTo\(doc_id", plan(again.doc_terms(10)))
    assert sorted(map(tuple, again.doc_terms(10).collect())) == sorted(map(tuple, idx.doc_terms(10).collect()))


def test_all_metrics_come_from_one_grouping(spark, sf):
    from corvidex.operators import evaluate as ev

    run = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 5)], "query int, rank bigint, doc_id bigint")
    qrels = spark.createDataFrame([(1, 5, "Good"), (2, 5, "Bad")], "query int, doc_id bigint, grade string")
    p = plan(ev.metrics(run, qrels))
    assert "Window" not in p and p.count("collect_list") <= 4
