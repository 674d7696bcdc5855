"""Counts per term with a few terms holding most rows."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvidex.operators.skew import dominant_terms, heavy_keys, occurrence_counts

SCHEMA = "term string, doc_id bigint, pos int, part_no int"


def brute(rows):
    seen, docs = defaultdict(set), defaultdict(set)
    for term, doc, pos, *_ in rows:
        t = (term or "").strip(" \t\r\n").lower()
        if t:
            seen[t].add((doc, pos))
            docs[t] |= {doc} if doc is not None else set()
    return {t: (len(s), len(docs[t])) for t, s in seen.items()}


ROWS = (
    [("The ", d, p, 0) for d in range(40) for p in range(20)]
    + [("the", d, 3, 1) for d in range(40)]  # flushed again, in another spelling
    + [(f"w{i}", i % 7, i, 0) for i in range(300)]
    + [(None, 1, 1, 0), ("", 1, 2, 0), ("  ", 1, 3, 0), ("x", None, None, 0), ("x", None, None, 1), ("y" * 50_000, 1, 9, 0)]
)


def test_counts_are_exact(spark):
    got = {r["term"]: (r["occurrences"], r["docs"]) for r in occurrence_counts(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got == brute(ROWS)


@pytest.mark.parametrize("share", [0.9, 0.2, 0.0005])
def test_counts_do_not_depend_on_what_is_heavy(spark, share):
    got = {r["term"]: (r["occurrences"], r["docs"]) for r in occurrence_counts(spark.createDataFrame(ROWS, SCHEMA), share=share).collect()}
    assert got == brute(ROWS)


def test_heavy_keys_are_found(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).select(F.lower(F.trim("term")).alias("term"))
    assert [r["term"] for r in heavy_keys(rows, "term", 0.1).collect()] == ["the"]


def test_dominant(spark):
    rows = [("a", 1, i, 0) for i in range(96)] + [("b", 1, i, 0) for i in range(2)] + [("c", 1, i, 0) for i in range(2)]
    counts = occurrence_counts(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["term"] for r in dominant_terms(counts).collect()) == ["a", "b", "c"]  # exactly the share counts
    assert sorted(r["term"] for r in dominant_terms(counts, 0.05).collect()) == ["a"]


def test_empty_and_clashing(spark):
    assert occurrence_counts(spark.createDataFrame([], SCHEMA)).count() == 0
    assert dominant_terms(occurrence_counts(spark.createDataFrame([], SCHEMA))).count() == 0
    more = spark.createDataFrame(ROWS, SCHEMA).withColumn("heavy", F.lit(1)).withColumn("occurrences", F.lit("x")).withColumn("docs", F.lit(None)).withColumn("n", F.lit(2))
    assert {r["term"]: (r["occurrences"], r["docs"]) for r in occurrence_counts(more).collect()} == brute(ROWS)


def test_no_task_gets_a_heavy_term_whole(spark):
    plan = occurrence_counts(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().toString()
    assert "LeftSemi" in plan and "LeftAnti" in plan and "Broadcast" in plan
