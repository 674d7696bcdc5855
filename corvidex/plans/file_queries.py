"""Round trips through the engine's files: written from the test tables to the shared folder, and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.operators import evaluate as ev
from corvidex.operators import feedback as fb
from corvidex.operators import mining
from corvidex.plans import inputs, retrieval_queries
from corvidex.plans.retrieval_sql import SQL as RETRIEVAL_SQL
from corvidex.plans.retrieval_sql import RUN
from corvidex.session import scratch, table
from corvidex.sources import readers, writers

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}


def query(f: Q) -> Q:
    QUERIES[f.__name__] = f
    return f


def _lines(rows: DataFrame, *columns: Column) -> DataFrame:
    """Lines of tab-separated values; what would end a value within it is a blank."""
    clean = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\t\r\n]+", " ")
    return rows.select(F.concat_ws("\t", *map(clean, columns)).alias("value"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scored_document").groupBy("result_id").agg(*(F.max(c).alias(c) for c in ("title", "url", "numviews"))).select("title", "url", "numviews")


@query
def file_tsv_corpus(spark: SparkSession, d: str) -> DataFrame:
    """A corpus of title, body and views in one file format; views may be missing."""
    at = scratch(spark, "corpus")
    _lines(_results(spark, d), F.col("title"), F.col("url"), F.col("numviews")).write.mode("overwrite").text(at)
    return readers.tsv_corpus(spark, at)


@query
def file_tsv_documents(spark: SparkSession, d: str) -> DataFrame:
    """A corpus of title and body."""
    at = scratch(spark, "documents")
    _lines(_results(spark, d), F.col("title"), F.col("url")).write.mode("overwrite").text(at)
    return readers.tsv_documents(spark, at)


@query
def file_judgments(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "judgments")
    _lines(inputs.qrels(spark, d), F.col("query"), F.col("doc_id"), F.col("grade")).write.mode("overwrite").text(at)
    return readers.judgments(spark, at)


@query
def file_run(spark: SparkSession, d: str) -> DataFrame:
    """Ranked results, whose ranks are the order of lines."""
    at = scratch(spark, "run")
    ordered = inputs.run(spark, d).repartition("query").sortWithinPartitions("query", "rank")
    _lines(ordered, F.col("query"), F.col("doc_id"), F.lit("title"), F.lit(0.5)).write.mode("overwrite").text(at)
    return readers.run(spark, at)


@query
def file_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metrics of each query, written and read as text."""
    rows = ev.metrics(inputs.run(spark, d), inputs.qrels(spark, d))
    at = scratch(spark, "metrics")
    writers.write_metrics(rows, at)
    read = spark.read.csv(at, sep="\t", schema=", ".join(f"{c} {t}" for c, t in rows.dtypes))
    return read.select("query", *(F.round(c, 6).alias(c) for c in rows.columns if c != "query"))


@query
def file_tags(spark: SparkSession, d: str) -> DataFrame:
    """The words of the log as a list of tags."""
    at = scratch(spark, "tags")
    table(spark, d, "search_query").select(F.explode(F.split(F.concat("query", F.lit(" ")), " ")).alias("value")).write.mode("overwrite").text(at)
    return readers.tags(spark, at)


@query
def file_page_rank(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "ranks")
    writers.write_scores(inputs.page_rank(spark, d), at)
    return readers.scores(spark, at).select("name", F.round("pr", 6).alias("pr"))


@query
def file_link_graph(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "links")
    names, pages = retrieval_queries.part_pages(spark, d)
    writers.write_links(mining.resolve(mining.links(pages), names), at)
    return readers.links(spark, at)


@query
def file_similarity(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "similarity")
    runs = fb.clean_runs(table(spark, d, "prf"))
    writers.write_similarity(fb.most_alike(runs.where(F.col("run_id") % 20 == 0), runs), at)
    return spark.read.csv(at, sep="\t", schema="q1 bigint, q2 bigint, coefficient double").withColumn("coefficient", F.round("coefficient", 6))


_ONCE = """WITH once AS (SELECT regexp_replace(coalesce(max(title), ''), '[\\t\\r\\n]+', ' ', 'g') AS t, regexp_replace(coalesce(max(url), ''), '[\\t\\r\\n]+', ' ', 'g') AS u, max(numviews) AS n
 FROM scored_document GROUP BY result_id)"""

SQL = {
    "file_tsv_corpus": f"{_ONCE} SELECT nullif(t, '') AS title, nullif(u, '') AS body, coalesce(n, 0)::INT AS num_views FROM once",
    "file_tsv_documents": f"{_ONCE} SELECT nullif(t, '') AS title, concat_ws(' ', nullif(t, ''), nullif(u, '')) AS text FROM once",
    "file_judgments": f"""{RUN} SELECT query::VARCHAR AS query, doc_id, CASE WHEN vote >= 40 THEN 'Perfect' WHEN vote >= 20 THEN 'Excellent' WHEN vote >= 8 THEN 'Good' WHEN vote >= 0 THEN 'Fair' ELSE 'Bad' END AS grade
 FROM run JOIN votes USING (doc_id)""",
    "file_run": f"{RUN} SELECT query::VARCHAR AS query, rank, doc_id FROM run",
    "file_metrics": RETRIEVAL_SQL["eval_metrics"],
    "file_tags": """SELECT DISTINCT lower(trim(w, E' \\t\\r\\n')) AS tag FROM (SELECT unnest(string_split(query, ' ')) AS w FROM search_query) WHERE trim(w, E' \\t\\r\\n') <> ''""",
    "file_page_rank": RETRIEVAL_SQL["page_rank"],
    "file_link_graph": RETRIEVAL_SQL["redirect_resolve"],
    "file_similarity": "SELECT q1, q2, coefficient FROM (" + RETRIEVAL_SQL["prf_similarity"] + ")",
}
