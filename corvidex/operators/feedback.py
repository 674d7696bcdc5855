"""Pseudo-relevance feedback and the likeness of feedback distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvidex.functions.query import Query
from corvidex.functions.words import EXPANSION_STOP_WORDS
from corvidex.operators.index import Index
from corvidex.operators.rank import page, ranker


def expansion_terms(index: Index, query: Query, name: str = "favorite", num_docs: int = 10, num_terms: int = 5, include_query: bool = True) -> DataFrame:
    """(term, prob): the most frequent terms of the best documents, most probable first; probabilities sum to 1.

    Stop words are left out, the query's own terms too unless ``include_query``.
    Ties go by term. No matching document gives no rows.
    """
    best = page(ranker(name)(index, query), num_docs).select("doc_id")
    left_out = sorted(EXPANSION_STOP_WORDS | (set() if include_query else set(query.terms)))
    counts = index.by_document().join(F.broadcast(best), "doc_id", "left_semi").where(~F.col("term").isin(left_out)).groupBy("term").agg(F.sum("tf").alias("tf"))
    top = counts.orderBy(F.desc("tf"), F.asc("term")).limit(num_terms)
    # a handful of rows: their sum needs one partition
    return top.select("term", (F.col("tf") / F.sum("tf").over(Window.partitionBy(F.lit(1)))).alias("prob"))


def clean_runs(prf: DataFrame) -> DataFrame:
    """(run_id, term, prob): each (run_id, pos_in_run) once, terms trimmed and lower-cased, equal terms of a run added."""
    once = prf.groupBy("run_id", "pos_in_run").agg(F.max(F.struct("c0", "c1")).alias("r"))
    rows = once.select("run_id", F.lower(F.btrim("r.c0", F.lit(" \t\r\n"))).alias("term"), F.col("r.c1").alias("prob")).where(F.col("term") != "")
    return rows.groupBy("run_id", "term").agg(F.sum("prob").alias("prob"))


def bhattacharyya(left: DataFrame, right: DataFrame) -> DataFrame:
    """(q1, q2, coefficient): sum of sqrt(p * q) over shared terms, of each pair of different runs.

    ``left`` and ``right``: run_id, term, prob. Products are added up per task
    before the shuffle by pair.
    """
    a = left.select(F.col("run_id").alias("q1"), "term", F.col("prob").alias("p"))
    b = right.select(F.col("run_id").alias("q2"), "term", F.col("prob").alias("q"))
    return a.join(b, "term").where(F.col("q1") != F.col("q2")).groupBy("q1", "q2").agg(F.sum(F.sqrt(F.col("p") * F.col("q"))).alias("coefficient"))


def most_alike(left: DataFrame, right: DataFrame, top: int = 10) -> DataFrame:
    """(q1, q2, coefficient, place): the ``top`` runs of ``right`` most like each run of ``left``, ties by q2.

    The matrix of ``bhattacharyya`` has as many rows as pairs; this has ``top`` a
    run, and pairs are cut in each task before the shuffle by run.
    """
    w = Window.partitionBy("q1").orderBy(F.round("coefficient", 9).desc(), F.asc("q2"))
    return bhattacharyya(left, right).withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= top)


def one_to_one(first: DataFrame, second: DataFrame, name: str) -> DataFrame:
    """The rows of both by ``name``; the job fails if a name is missing from one of them."""
    marked = first.withColumn("in_first", F.lit(True)).join(second.withColumn("in_second", F.lit(True)), name, "full")
    whole = F.col("in_first").isNotNull() & F.col("in_second").isNotNull()
    checked = F.when(whole, True).otherwise(F.raise_error(F.concat(F.col(name).cast("string"), F.lit(" is not in both tables"))).cast("boolean"))
    return marked.where(checked).drop("in_first", "in_second")


def spearman(values: DataFrame, name: str, first: str, second: str) -> DataFrame:
    """(n, rho): Pearson's coefficient over the ordinal ranks of two columns; 0 if one doesn't vary.

    Ranks are 1..n by descending value, ties by name. Ranks over a whole table
    are taken in range partitions with offsets, never in one task.
    """
    from corvidex.operators.ranks import ordinal_rank

    one = ordinal_rank(values, [F.desc(first), F.asc(name)], "r1")
    both = ordinal_rank(one, [F.desc(second), F.asc(name)], "r2")
    return both.agg(F.count("*").alias("n"), F.coalesce(F.nanvl(F.corr(F.col("r1").cast("double"), F.col("r2").cast("double")), F.lit(0.0)), F.lit(0.0)).alias("rho"))
