"""Results as text, JSON and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_line(score: str = "score") -> Column:
    """``doc_id title score PR:x NV:y`` with a tab after each."""
    return F.concat(F.concat_ws("\t", F.col("doc_id").cast("string"), F.coalesce("title", F.lit("")), F.col(score).cast("string"), F.concat(F.lit("PR:"), F.col("page_rank").cast("string")), F.concat(F.lit("NV:"), F.col("num_views").cast("string"))), F.lit("\t"))


def knowledge_text(score: str = "score") -> Column:
    """The lines of a best answer: its numbers, then the answer."""
    head = F.concat_ws("\t", F.col("doc_id").cast("string"), F.coalesce("title", F.lit("")), F.col(score).cast("string"), F.concat(F.lit("Vote:"), F.col("vote").cast("string")), F.concat(F.lit("PR:"), F.col("page_rank").cast("string")), F.concat(F.lit("NV:"), F.col("num_views").cast("string")))
    return F.concat(head, F.lit("\t\n"), F.coalesce("answer", F.lit("")), F.lit("\n"))


def json_object(score: str = "score") -> Column:
    """A result as JSON; title and snippet are URL-encoded."""
    return F.to_json(
        F.struct(
            F.col("doc_id").alias("id"),
            F.url_encode(F.coalesce("title", F.lit(""))).alias("title"),
            F.coalesce("url", F.lit("")).alias("url"),
            F.coalesce("file_path", F.lit("")).alias("filePath"),
            F.col(score).alias("score"),
            F.col("page_rank").alias("pagerank"),
            F.col("num_views").alias("numviews"),
            F.url_encode(F.coalesce("snippet", F.lit(""))).alias("snippet"),
        )
    )


def knowledge_json(score: str = "score") -> Column:
    """A best answer as JSON; title and answer are URL-encoded."""
    return F.to_json(
        F.struct(
            F.col("doc_id").alias("id"),
            F.url_encode(F.coalesce("title", F.lit(""))).alias("title"),
            F.coalesce("url", F.lit("")).alias("url"),
            F.coalesce("file_path", F.lit("")).alias("filePath"),
            F.url_encode(F.coalesce("answer", F.lit(""))).alias("knowledge"),
            F.col(score).alias("score"),
            F.col("page_rank").alias("pagerank"),
            F.col("num_views").alias("numviews"),
            F.col("vote"),
        )
    )


def write_links(links: DataFrame, path: str) -> None:
    """The link graph: (src, dsts ARRAY) of each page with links, targets once each and sorted, replacing what is there.

    A page's targets are one array, as many as the page holds links.
    """
    links.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("dsts")).write.mode("overwrite").parquet(path)


def write_scores(rows: DataFrame, path: str) -> None:
    """Page ranks or view counts, replacing what is there."""
    rows.write.mode("overwrite").parquet(path)


def write_similarity(pairs: DataFrame, path: str) -> None:
    """q1, q2, coefficient as tab-separated text."""
    pairs.select("q1", "q2", "coefficient").write.mode("overwrite").csv(path, sep="\t", header=False)


def write_metrics(rows: DataFrame, path: str) -> None:
    """The metrics of each query, tab-separated, in their fixed order."""
    rows.write.mode("overwrite").csv(path, sep="\t", header=False)
