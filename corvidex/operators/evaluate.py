"""Quality of ranked runs against judgments, for all queries in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.functions.words import GAINS

CUTS = (1, 5, 10)


def gain(grade: Column) -> Column:
    """The gain of a grade of relevance; 0 for grades without one."""
    return reduce(lambda c, g: c.when(grade == g, GAINS[g]), list(GAINS)[1:], F.when(grade == "Perfect", GAINS["Perfect"])).otherwise(0.0)


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query, rank, gain, rel): the run with its judgments; documents without one have gain 0.

    ``run``: query, rank (from 1), doc_id. ``qrels``: query, doc_id, grade, one
    row a pair. Queries without any judgment are left out. rel is 1 above gain 1.
    """
    known = qrels.select("query").distinct()
    rows = run.join(known, "query", "left_semi").join(qrels, ["query", "doc_id"], "left").select("query", "rank", F.coalesce(gain(F.col("grade")), F.lit(0.0)).alias("gain"))
    return rows.withColumn("rel", F.when(F.col("gain") > 1, 1).otherwise(0))


def _runs(rows: DataFrame) -> DataFrame:
    """(query, run, hits): each query's run by rank as one array, as long as a result list, and the ranks of its relevant documents."""
    runs = rows.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "gain", "rel"))).alias("run"))
    return runs.withColumn("hits", F.transform(F.filter("run", lambda x: x["rel"] == 1), lambda x: x["rank"]))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _precisions() -> Column:
    """The precision at each relevant document."""
    return F.transform("hits", lambda r, i: (i + 1) / r)


def _precision_recall_f(alpha: float) -> list[Column]:
    found = F.size("hits").cast("double")
    out: dict[str, Column] = {}
    for k in CUTS:
        hits = F.size(F.filter("hits", lambda r: r <= k)).cast("double")  # noqa: B023
        p, r = hits / F.lit(float(k)), F.when(found > 0, hits / found).otherwise(0.0)
        out[f"p_{k}"], out[f"r_{k}"] = p, r
        out[f"f_{k}"] = F.when((p == 0) | (r == 0), 0.0).otherwise(1 / (alpha / p + (1 - alpha) / r))
    return [out[f"{m}_{k}"].alias(f"{m}_{k}") for m in "prf" for k in CUTS]


def _at_recall(level: Column) -> Column:
    k = F.floor(F.size("hits") * level / 10).cast("int")
    return F.when(k > 0, F.get(_precisions(), k - 1)).otherwise(0.0)


def _average_precision() -> Column:
    return F.when(F.size("hits") > 0, _sum(_precisions()) / F.size("hits")).otherwise(0.0)


def _ndcg(k: int) -> Column:
    top = F.filter("run", lambda x: x["rank"] <= k)
    dcg = _sum(F.transform(top, lambda x: x["gain"] / F.log2(x["rank"] + 1.0)))
    best = F.reverse(F.array_sort(F.transform(top, lambda x: x["gain"])))
    ideal = _sum(F.transform(best, lambda g, i: g / F.log2(i + 2.0)))
    return F.when(ideal > 0, dcg / ideal).otherwise(0.0).alias(f"ndcg_{k}")


def _reciprocal_rank() -> Column:
    return F.coalesce(1.0 / F.get("hits", F.lit(0)), F.lit(0.0))


def precision_recall_f(rows: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(query, p_k, r_k, f_k for k of CUTS). Recall is of the relevant documents in the run; 0 without any."""
    return _runs(rows).select("query", *_precision_recall_f(alpha))


def precision_at_recall(rows: DataFrame) -> DataFrame:
    """(query, level, precision) for recall 0, 0.1 .. 1: the precision where the k-th relevant document stands.

    k is the level times the relevant documents of the run, rounded down; where k
    is 0 the precision is 0.
    """
    levels = _runs(rows).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(10))))
    return levels.select("query", "level", _at_recall(F.col("level")).alias("precision"))


def average_precision(rows: DataFrame) -> DataFrame:
    """(query, ap): mean of the precisions at the relevant documents of the run; 0 without any."""
    return _runs(rows).select("query", _average_precision().alias("ap"))


def ndcg(rows: DataFrame) -> DataFrame:
    """(query, ndcg_k): discounted gain over that of the same K documents in the best order; 0 without any gain."""
    return _runs(rows).select("query", *map(_ndcg, CUTS))


def reciprocal_rank(rows: DataFrame) -> DataFrame:
    """(query, rr): one over the rank of the first relevant document; 0 without any."""
    return _runs(rows).select("query", _reciprocal_rank().alias("rr"))


def metrics(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """A row of all 25 metrics per query from one grouping; runs shorter than a cut count as if filled up with documents of no gain."""
    curve = [_at_recall(F.lit(i)).alias(f"pr_{i}") for i in range(11)]
    return _runs(judged(run, qrels)).select("query", *_precision_recall_f(0.5), *curve, _average_precision().alias("ap"), *map(_ndcg, CUTS), _reciprocal_rank().alias("rr"))
