"""The index of a collection: postings and the statistics derived from them.

Tables are plain DataFrames. ``write`` lays postings out sorted by term, so that
a query's terms prune row groups, and term-document counts apart from positions,
so that only phrase queries read positions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.functions.query import Query
from corvidex.functions.text import plain_tokens, positions, raw_tokens
from corvidex.session import durable

TABLES = ("postings", "term_doc", "term_stats", "doc_stats", "doc_terms", "totals")
#: What is kept of a document beside its words.
FEATURES = ("title", "url", "file_path", "name", "vote", "answer", "page_rank", "num_views")


@dataclass
class Index:
    """postings(term, doc_id, pos), term_doc(term, doc_id, tf), term_stats(term, df, ctf), doc_stats(doc_id, length, ...).

    A written index also has ``forward``, the rows of term_doc laid out by
    document, and ``totals``, its scalars.
    """

    postings: DataFrame
    term_doc: DataFrame
    term_stats: DataFrame
    doc_stats: DataFrame
    forward: DataFrame | None = None
    totals: DataFrame | None = None

    def scalars(self) -> DataFrame:
        """One row: num_docs, total_terms."""
        if self.totals is not None:
            return self.totals
        return self.doc_stats.agg(F.count("*").alias("num_docs"), F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("total_terms"))

    def stats_of(self, terms: list[str]) -> DataFrame:
        return self.term_stats.where(F.col("term").isin(terms))

    def restricted(self, query: Query) -> Index:
        """The index of the query's terms alone, written once.

        A ranker reads the terms' rows several times (to match, to count, to
        score); this way the collection is read once, or twice with phrases,
        and only rows of the query's terms are shuffled.
        """
        terms = query.unique()
        wanted = F.col("term").isin(terms) if terms else F.lit(False)
        term_doc = durable(self.term_doc.where(wanted))
        stats = term_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))
        return Index(durable(self.postings.where(wanted)) if query.phrases else self.postings, term_doc, stats, self.doc_stats, self.forward, self.totals)

    def doc_terms(self, doc_id: int) -> DataFrame:
        """(term, tf) of one document; empty where there is none."""
        return self.by_document().where(F.col("doc_id") == doc_id).select("term", "tf")

    def by_document(self) -> DataFrame:
        """The rows of term_doc to be looked up by document."""
        return self.term_doc if self.forward is None else self.forward

    def doc(self, doc_id: int) -> DataFrame:
        return self.doc_stats.where(F.col("doc_id") == doc_id)

    def vocabulary(self) -> DataFrame:
        return self.term_stats.select("term")

    def has_term(self, term: str) -> DataFrame:
        return self.term_stats.where(F.col("term") == term).select("term")


def build(docs: DataFrame, doc: str = "doc_id", text: str = "text", page_rank: DataFrame | None = None, num_views: DataFrame | None = None, key: str = "name") -> Index:
    """An index of ``docs``; every document has a row in doc_stats, even without words.

    Columns of FEATURES are kept in doc_stats if there.
    ``page_rank`` (name, pr) and ``num_views`` (name, views) are joined on
    ``key``; absent values are 0. An empty table gives empty tables.
    """
    postings = positions(docs, doc, text)
    term_doc = postings.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    term_stats = term_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))
    lengths = docs.select(F.col(doc).alias("doc_id"), *(c for c in FEATURES if c in docs.columns), length_of(F.col(text)).alias("length"))
    if page_rank is not None:
        lengths = lengths.join(page_rank.select(F.col("name").alias(key), F.col("pr").alias("page_rank")), key, "left").withColumn("page_rank", F.coalesce("page_rank", F.lit(0.0)))
    if num_views is not None:
        lengths = lengths.join(num_views.select(F.col("name").alias(key), F.col("views").alias("num_views")), key, "left").withColumn("num_views", F.coalesce("num_views", F.lit(0)))
    return Index(postings, term_doc, term_stats, lengths)


def length_of(text: Column) -> Column:
    """Kept words of a text; 0 for null."""
    return F.coalesce(F.size(raw_tokens(text)), F.lit(0)).cast("bigint")


def full_scan_documents(rows: DataFrame) -> DataFrame:
    """(doc_id, title, title_tokens, body_tokens, num_views) of rows with doc_id, title, body, num_views: words as they stand."""
    return rows.select("doc_id", "title", plain_tokens(F.col("title")).alias("title_tokens"), plain_tokens(F.col("body")).alias("body_tokens"), "num_views")


def write(index: Index, path: str, partitions: int | None = None) -> None:
    """The tables as Parquet under ``path``, replacing what is there.

    The text is read once, for the postings; everything else is made from what is
    already written. Postings are spread by term and document and sorted, so that
    a term prunes row groups and a frequent one fills no file alone (ranges would
    need a pass over the text of their own). Counts are range-partitioned by term,
    and a second time by document.
    """
    spark = index.postings.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def put(rows: DataFrame, name: str, *order: str, ranged: bool = True) -> DataFrame:
        spread = rows.repartitionByRange(n, *order[:2]) if ranged else rows.repartition(n, *order[:2])
        spread.sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    postings = put(index.postings, "postings", "term", "doc_id", "pos", ranged=False)
    term_doc = put(postings.groupBy("term", "doc_id").agg(F.count("*").alias("tf")), "term_doc", "term", "doc_id")
    put(term_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf")), "term_stats", "term")
    put(term_doc, "doc_terms", "doc_id", "term")
    # every kept word is a posting, so lengths are counts; documents without words have none
    lengths = term_doc.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    stats = index.doc_stats.drop("length").join(lengths, "doc_id", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    stats = put(stats, "doc_stats", "doc_id")
    Index(postings, term_doc, term_doc, stats).scalars().write.mode("overwrite").parquet(f"{path}/totals")


def load(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in TABLES))
