import random
from statistics import mean, median

import pytest
from pyspark.sql import functions as F

from corvidex.llm import fusion

SCHEMA = "g string, item bigint, a double, b double, c double, d double"
WEIGHTS = {"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0}


def brute(rows):
    best = {}
    for g, item, *scores in rows:
        old = best.setdefault((g, item), [None] * 4)
        for i, s in enumerate(scores):
            if s is not None and s == s and (old[i] is None or s > old[i]):
                old[i] = s
    out = {}
    for g in {g for g, _ in best}:
        items = {i: s for (h, i), s in best.items() if h == g}
        ranks = {i: [] for i in items}
        for k in range(4):
            for i, s in items.items():
                known = [x[k] for x in items.values() if x[k] is not None]
                ranks[i].append(len(items) + 1 if s[k] is None else sum(x > s[k] for x in known) + (sum(x == s[k] for x in known) + 1) / 2)
        order = sorted(items, key=lambda i: (median(ranks[i]), mean(ranks[i]), i is not None, i or 0))
        out |= {(g, i): (median(ranks[i]), mean(ranks[i]), p) for p, i in enumerate(order, 1)}
    return out


def run(spark, rows, weights=None):
    got = fusion.median_rank(spark.createDataFrame(rows, SCHEMA), "g", "item", weights or WEIGHTS).collect()
    return {(r["g"], r["item"]): (r["median_rank"], r["mean_rank"], r["position"]) for r in got}


def test_against_brute_force(spark):
    rng = random.Random(1)
    pick = lambda *x: rng.choice(x)
    rows = [(pick("p", "q", "hot", "hot", None, ""), rng.randint(0, 60), pick(None, float("nan"), 1.0, -2.5, rng.gauss(0, 1)), rng.random(), pick(None, 0.0, -0.0, 1e9), float(rng.randint(0, 5))) for _ in range(400)]
    rows += rows[:30] + [("one", 1, None, None, None, None), ("two", None, 1.0, 1.0, 1.0, 1.0), ("two", 2, 1.0, 1.0, 1.0, 1.0)]
    got, want = run(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == (pytest.approx(want[k][0]), pytest.approx(want[k][1]), want[k][2]), k


def test_no_score_decides_by_its_range(spark):
    rows = [("g", i, float(i), float(i) * 1e-6, float(10 - i), float(i)) for i in range(10)]
    rows[0] = ("g", 0, 0.0, 0.0, 1e12, 0.0)
    got = run(spark, rows)
    assert got["g", 9][2] == 1 and got["g", 0][2] > 5


def test_weights(spark):
    rows = [("g", 1, 2.0, 0.0, 0.0, 0.0), ("g", 2, 1.0, 1.0, 1.0, 1.0)]
    assert run(spark, rows)["g", 2][2] == 1
    assert run(spark, rows, {"a": 9.0, "b": 1.0})["g", 1][2] == 1
    with pytest.raises(ValueError):
        run(spark, rows, {"a": 0.0})


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fusion.median_rank(empty, "g", "item", WEIGHTS).count() == 0
    more = spark.createDataFrame([("g", 1, 1.0, 1.0, 1.0, 1.0)], SCHEMA).withColumn("rank", F.lit(0)).withColumn("score", F.lit("x")).withColumn("value", F.lit(0)).withColumn("gk", F.lit(1))
    assert [tuple(r) for r in fusion.median_rank(more, "g", "item", WEIGHTS).collect()] == [("g", 1, 1.0, 1.0, 1)]


def test_votes_are_the_newest(spark):
    scored = spark.createDataFrame([(1, 5, 0.1, 0.2, 3), (1, 6, 0.1, None, None)], "query_id bigint, doc_id bigint, score double, pagerank double, numviews bigint")
    answers = spark.createDataFrame([(5, 1, 9, "2015-01-01"), (5, 2, 4, "2015-02-01"), (6, 3, 7, "2015-01-01"), (6, 4, None, "2015-03-01")], "doc_id bigint, knowledge_id bigint, vote int, crawled_at string")
    got = {r["doc_id"]: r["vote"] for r in fusion.result_scores(scored, answers).collect()}
    assert got == {5: 4, 6: None}
