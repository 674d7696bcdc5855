"""Questions and answers: the table behind the answer box, and the gate that opens it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.functions.query import original_terms
from corvidex.operators.index import Index, build


def qa_index(rows: DataFrame) -> Index:
    """An index of questions. ``rows``: doc_id, title, question, answer, vote, num_views, page_rank.

    The text of a question is its title and body; null votes and views are 0,
    null ranks too.
    """
    docs = rows.select(
        "doc_id",
        "title",
        "answer",
        *(c for c in ("url", "file_path") if c in rows.columns),
        F.coalesce(F.col("vote").cast("bigint"), F.lit(0)).alias("vote"),
        F.coalesce(F.col("num_views").cast("bigint"), F.lit(0)).alias("num_views"),
        F.coalesce(F.nanvl(F.col("page_rank").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("page_rank"),
        F.concat_ws(" ", "title", "question").alias("text"),
    )
    return build(docs)


def opens_gate(raw: str, tags: DataFrame) -> DataFrame:
    """(tag): the tags among the words of a query; the gate is open if there is one."""
    return tags.where(F.col("tag").isin(original_terms(raw))).select("tag")


def newest(rows: DataFrame) -> DataFrame:
    """One row per knowledge_id of the knowledge table, whatever the number of deliveries."""
    return rows.groupBy("knowledge_id").agg(*(F.max_by(c, "crawled_at").alias(c) for c in ("doc_id", "title", "url", "filePath", "knowledge", "pagerank", "numviews", "vote")))
