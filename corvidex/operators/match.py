"""Which documents match a query: all terms, phrases, any title word."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvidex.functions.query import Query
from corvidex.operators.index import Index


def all_terms(index: Index, query: Query) -> DataFrame:
    """(doc_id) of documents that hold every term of the query; none for a query without terms.

    One pass over the terms' rows and one aggregation, whatever the number of terms.
    """
    terms = query.unique()
    hits = index.term_doc.where(F.col("term").isin(terms) if terms else F.lit(False))
    return hits.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(terms)).select("doc_id")


def phrase(index: Index, words: list[str]) -> DataFrame:
    """(doc_id) of documents with ``words`` at consecutive positions.

    Each occurrence of the i-th word votes for the position the phrase would
    start at; starts that get all votes are phrases. No self-join.
    """
    slots = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(words)))
    votes = index.postings.where(F.col("term").isin(sorted(set(words)))).select("doc_id", "pos", F.explode(F.filter(slots, lambda s: s["w"] == F.col("term"))).alias("s"))
    starts = votes.groupBy("doc_id", (F.col("pos") - F.col("s.i")).alias("start")).agg(F.count("*").alias("n"))
    return starts.where(F.col("n") == len(words)).select("doc_id").distinct()


def matches(index: Index, query: Query) -> DataFrame:
    """(doc_id) of documents with all terms and all phrases of the query."""
    return reduce(lambda d, p: d.join(phrase(index, p), "doc_id", "left_semi"), query.phrases, all_terms(index, query))


def any_title_word(docs: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, hit) of documents with ``title_tokens``; hit if any title word is one of ``words``, as they stand."""
    return docs.select("doc_id", F.coalesce(F.arrays_overlap("title_tokens", F.array(*map(F.lit, words)).cast("array<string>")), F.lit(False)).alias("hit"))


def same_content(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` whose content is that of a row of ``known``, told by its MD5; null texts match none."""
    return docs.join(known.select(F.md5(text).alias("md5_")).distinct(), F.md5(docs[text]) == F.col("md5_"), "left_semi")


def distinct_contents(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row, n: the number of different contents."""
    return docs.agg(F.count_distinct(F.md5(text)).alias("n"))


def matches_batch(term_doc: DataFrame, stats: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, term, tf, qtf, n_terms) of documents that may hold every term of a query, for many queries.

    ``queries``: query_id, term, qtf, one row per distinct term; ``stats``: term,
    df. A query's documents are looked for by its rarest term, and only those are
    looked up for its other terms; a document that holds them all has n_terms
    rows. Queries with a term that no document holds have no rows.
    """
    known = queries.join(stats.select("term", "df"), "term", "left")
    each = known.groupBy("query_id").agg(
        F.count("*").alias("n_terms"),
        F.count("df").alias("n_known"),
        F.min_by("term", F.struct("df", "term")).alias("term"),
    )
    rarest = each.where(F.col("n_known") == F.col("n_terms")).select("query_id", "term", "n_terms")
    found = rarest.join(term_doc.select("term", "doc_id"), "term").select("query_id", "n_terms", "doc_id")
    wanted = found.join(queries.select("query_id", "term", "qtf"), "query_id")
    return wanted.join(term_doc, ["term", "doc_id"]).select("query_id", "doc_id", "term", "tf", "qtf", "n_terms")


def phrases_batch(index: Index, found: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, doc_id) of ``found`` that hold all phrases of the query, for many queries.

    ``phrases``: query_id, words, each phrase of a query once; queries without
    phrases have no rows. Words vote for starts as in ``phrase``, once for equal
    phrases of several queries and only in documents that are asked for.
    """
    asked = phrases.withColumn("n_phrases", F.count("*").over(Window.partitionBy("query_id")))
    wanted = asked.join(found.select("query_id", "doc_id"), "query_id")
    slots = phrases.select("words").distinct().select("words", F.posexplode("words").alias("i", "term"))
    votes = index.postings.join(slots, "term").join(wanted.select("words", "doc_id"), ["words", "doc_id"], "left_semi")
    starts = votes.groupBy("words", "doc_id", (F.col("pos") - F.col("i")).alias("start")).agg(F.count("*").alias("n"))
    held = starts.where(F.col("n") == F.size("words")).select("words", "doc_id").distinct()
    whole = wanted.join(held, ["words", "doc_id"]).groupBy("query_id", "doc_id").agg(F.count("*").alias("n"), F.max("n_phrases").alias("n_phrases"))
    return whole.where(F.col("n") == F.col("n_phrases")).select("query_id", "doc_id")
