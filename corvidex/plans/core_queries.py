"""Core queries that belong to the data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvidex.operators.skew import dominant_terms, occurrence_counts
from corvidex.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominant_terms(occurrence_counts(table(spark, sf_dir, "postings")))


def p2_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrence_counts(table(spark, sf_dir, "postings")).drop("heavy")


QUERIES = {"p2_found": p2_found, "p2_term_counts": p2_term_counts}

_OCC = """
WITH occ AS (
  SELECT DISTINCT lower(trim(term, E' \\t\\r\\n')) AS term, doc_id, pos
  FROM postings WHERE trim(term, E' \\t\\r\\n') <> ''
)"""

SQL = {
    "p2_found": _OCC
    + " SELECT term FROM occ GROUP BY term HAVING count(*) * 50 >= (SELECT count(*) FROM occ)",
    "p2_term_counts": _OCC
    + " SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS docs FROM occ GROUP BY term",
}
