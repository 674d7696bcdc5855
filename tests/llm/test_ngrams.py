from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvidex.llm import ngrams

SCHEMA = "field string, record bigint, terms array<string>"


def brute(rows, longest):
    total, records = Counter(), defaultdict(set)
    for field, record, terms in rows:
        t = [x for x in terms or [] if x is not None]
        for i in range(len(t)):
            for n in range(1, longest + 1):
                if i + n <= len(t):
                    g = (field, tuple(t[i : i + n]))
                    total[g] += 1
                    records[g].add(record)
    return {g: (c, len(records[g])) for g, c in total.items()}


def run(spark, rows, longest, buckets=None):
    got = ngrams.ngram_counts(spark.createDataFrame(rows, SCHEMA), longest, buckets).collect()
    out = {(r["field"], tuple(r["gram"])): (r["total"], r["records"]) for r in got}
    assert len(out) == len(got)
    return out


ROWS = [("a", i, ["hot"] * (i % 4 + 1) + [f"w{i % 9}", "end"]) for i in range(60)] + [("b", 1, ["hot", "x"]), ("b", 1, ["x"]), ("a", None, ["hot", None, "end"]), ("a", 3, None), ("a", 4, []), ("a", 5, ["", "é", "y" * 20_000])]


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
@pytest.mark.parametrize("buckets", [1, 7])
def test_counts(spark, longest, buckets):
    assert run(spark, ROWS, longest, buckets) == brute(ROWS, longest)


def test_stack_on_any_lists():
    import pyarrow as pa

    @given(st.lists(st.tuples(st.integers(0, 4), st.lists(st.sampled_from("abc"), max_size=6)), max_size=20), st.integers(1, 4))
    @settings(max_examples=100, deadline=None)
    def check(lists, longest):
        rows = sorted((("f", 0, t[i : i + longest], r) for r, t in lists for i in range(len(t))), key=lambda x: x[2], reverse=True)
        cols = list(zip(*rows)) or [[], [], [], []]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.list_(pa.string()), pa.int64()))], names=["field", "bucket", "suffix", "record"])
        got = {}
        for b in ngrams.stacked(iter([batch])):
            got |= {(r["field"], tuple(r["gram"])): (r["total"], r["records"]) for r in b.to_pylist()}
        assert got == brute([("f", r, t) for r, t in lists], longest)

    check()


def test_marks(spark):
    rows = [("f", i, ["all"] + (["tenth"] if i < 2 else []) + (["three"] if i < 3 else [])) for i in range(20)]
    got = {r["gram"][0]: r["mark"] for r in ngrams.marked_terms(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"all": "common", "tenth": "rare", "three": "common"}


def test_lists_of_tables(spark):
    scored = spark.createDataFrame([(1, "Café_au LAIT 2x"), (1, "Café_au LAIT 2x"), (2, None), (3, "")], "result_id bigint, title string").withColumn("field", F.lit("z")).withColumn("record", F.lit(0))
    prf = spark.createDataFrame([(9, 1, " Lait "), (9, 1, " Lait "), (9, 2, "LAIT"), (8, 1, None), (7, 1, "  ")], "run_id bigint, pos_in_run int, c0 string")
    lists = ngrams.title_and_expansion_terms(scored, prf)
    assert sorted((r["field"], r["record"], r["terms"]) for r in lists.collect()) == [("c0", 7, []), ("c0", 8, []), ("c0", 9, ["lait"]), ("c0", 9, ["lait"]), ("title", 1, ["café", "au", "lait", "2x"]), ("title", 3, [])]
    counts = {(r["field"], r["gram"][0]): (r["total"], r["records"]) for r in ngrams.marked_terms(lists).collect()}
    assert counts["c0", "lait"] == (2, 1) and counts["title", "lait"] == (1, 1)


def test_empty(spark):
    assert ngrams.ngram_counts(spark.createDataFrame([], SCHEMA), 3).count() == 0
    with pytest.raises(ValueError):
        ngrams.ngram_counts(spark.createDataFrame([], SCHEMA), 0)
