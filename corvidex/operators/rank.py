"""Rankers over an index, chosen by name, and their pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvidex.functions.query import Query
from corvidex.functions.text import positions
from corvidex.functions.words import KNOWLEDGE_WEIGHTS, QUERY_STOP_WORDS, WEIGHTS
from corvidex.operators import blocks
from corvidex.operators.index import Index
from corvidex.operators.match import any_title_word, matches, matches_batch, phrases_batch
from corvidex.session import durable, ship

#: Share of the collection's language model in the smoothed one.
LAMBDA = 0.5
#: Digits to which scores are told apart.
DIGITS = 9
#: Different queries of a log that a task looks up at once.
LOG_PART = 100_000


def best_first() -> tuple[Column, Column]:
    """The order of results: by score, then by document."""
    return F.round("score", DIGITS).desc(), F.asc("doc_id")


def smoothed(tf: Column, length: Column, ctf: Column, total: Column, lam: float = LAMBDA) -> Column:
    """log2 of the probability of a term in a document, smoothed with the collection."""
    return F.log2((1 - lam) * tf / length + lam * ctf / total)


def query_terms(index: Index, query: Query) -> DataFrame:
    """(term, qtf) of a query, repeats counted."""
    spark = index.term_doc.sparkSession
    return spark.createDataFrame(sorted(query.counts().items()) or [("", 0)], "term string, qtf bigint").where(F.lit(bool(query.tokens)))


def query_likelihood(index: Index, query: Query) -> DataFrame:
    """(doc_id, score) of the documents that match, by query likelihood; zero scores and empty documents dropped."""
    index = index.restricted(query)
    hits = matches(index, query)
    terms = F.broadcast(query_terms(index, query))  # a query's terms
    stats = F.broadcast(index.term_stats)  # a row per query term
    rows = index.term_doc.join(terms, "term").join(hits, "doc_id", "left_semi").join(stats, "term")
    rows = rows.join(index.doc_stats.select("doc_id", "length"), "doc_id").crossJoin(F.broadcast(index.scalars()))
    scored = rows.where(F.col("length") > 0).groupBy("doc_id").agg(F.sum(F.col("qtf") * smoothed(F.col("tf"), F.col("length"), F.col("ctf"), F.col("total_terms"))).alias("score"))
    return scored.where(F.col("score") != 0)


def _log_views(views: Column) -> Column:
    return F.log2(views + 1.0)


def comprehensive(index: Index, query: Query) -> DataFrame:
    """Query likelihood, PageRank and views, weighted; doc_stats needs page_rank and num_views."""
    rows = query_likelihood(index, query).join(index.doc_stats.select("doc_id", "page_rank", "num_views"), "doc_id")
    score = WEIGHTS["ql"] * F.col("score") + WEIGHTS["pagerank"] * F.sqrt(F.col("page_rank") + 1.0) + WEIGHTS["views"] * _log_views(F.col("num_views"))
    return rows.select("doc_id", score.alias("score")).where(F.col("score") != 0)


def tf_idf_weights(index: Index) -> DataFrame:
    """(term, doc_id, w): (log2 tf + 1) * log2(N / df) of every term of every document."""
    rows = index.term_doc.join(index.term_stats.select("term", "df"), "term").crossJoin(F.broadcast(index.scalars().select("num_docs")))
    return rows.select("term", "doc_id", ((F.log2("tf") + 1) * F.log2(F.col("num_docs") / F.col("df"))).alias("w"))


def cosine(index: Index, query: Query) -> DataFrame:
    """Cosine of tf-idf vectors of the query and the documents that match; documents without a norm dropped."""
    mine = index.restricted(query)
    terms, stats = F.broadcast(query_terms(index, query)), F.broadcast(mine.term_stats)  # a row per query term
    wq = terms.join(stats, "term").crossJoin(F.broadcast(index.scalars().select("num_docs"))).select("term", ((F.log2("qtf") + 1) * F.log2(F.col("num_docs") / F.col("df"))).alias("wq"))
    norm_q = wq.agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("nq"))
    hits = durable(matches(mine, query))
    # norms need all terms of a matching document, so the documents are cut down first
    weights = tf_idf_weights(Index(index.postings, index.by_document().join(hits, "doc_id", "left_semi"), index.term_stats, index.doc_stats, totals=index.totals))
    rows = weights.join(F.broadcast(wq), "term", "left").groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nd"), F.sum(F.col("w") * F.col("wq")).alias("dot"))
    rows = rows.crossJoin(F.broadcast(norm_q)).where((F.col("nd") > 0) & (F.col("nq") > 0))
    return rows.select("doc_id", (F.col("dot") / (F.col("nd") * F.col("nq"))).alias("score")).where(F.col("score") != 0)


def conjunctive(index: Index, query: Query) -> DataFrame:
    """1 for every document that matches."""
    return matches(index.restricted(query), query).select("doc_id", F.lit(1.0).alias("score"))


def num_view(index: Index, query: Query) -> DataFrame:
    """log2(views + 1) of the documents that match; zero scores dropped."""
    rows = matches(index.restricted(query), query).join(index.doc_stats.select("doc_id", "num_views"), "doc_id")
    return rows.select("doc_id", _log_views(F.col("num_views")).alias("score")).where(F.col("score") != 0)


def full_scan(docs: DataFrame, words: list[str]) -> DataFrame:
    """1 if a title word is a word of the query, else 0; zero rows are kept. ``docs``: doc_id, title_tokens."""
    return any_title_word(docs, words).select("doc_id", F.when(F.col("hit"), 1.0).otherwise(0.0).alias("score"))


RANKERS: dict[str, Callable[[Index, Query], DataFrame]] = {
    "favorite": query_likelihood,
    "ql": query_likelihood,
    "comprehensive": comprehensive,
    "cosine": cosine,
    "conjunctive": conjunctive,
    "numview": num_view,
}


def ranker(name: str | None) -> Callable[[Index, Query], DataFrame]:
    """The ranker of a name; ValueError for names without one."""
    found = RANKERS.get((name or "none").lower())
    if found is None:
        raise ValueError(f"no ranker {name!r}; there are {', '.join(RANKERS)} and full_scan")
    return found


def page(scored: DataFrame, num: int = 10, number: int = 1) -> DataFrame:
    """Page ``number`` (from 1) of ``num`` rows, best first, ties by doc_id; past the end there is none.

    Scores that agree to nine digits are ties: sums of doubles depend on their
    order in the last digits, and a page must not.
    """
    if num < 1 or number < 1:
        raise ValueError("num and page start at 1")
    return scored.orderBy(*best_first()).offset(num * (number - 1)).limit(num)


def knowledge_score(index: Index, query: Query, name: str = "favorite") -> DataFrame:
    """(doc_id, score) of questions by the rankers that look up knowledge; a table without rows for the others."""
    scored = query_likelihood(index, query)
    if name in ("favorite", "ql"):
        return scored
    if name == "comprehensive":
        w = KNOWLEDGE_WEIGHTS
        rows = scored.join(index.doc_stats.select("doc_id", "page_rank", "num_views", "vote"), "doc_id")
        vote = F.when(F.col("vote") >= 0, F.log2(F.col("vote") + 1.0)).otherwise(0.0)
        score = w["ql"] * F.col("score") + w["pagerank"] * F.sqrt(F.col("page_rank") + 1.0) + w["views"] * _log_views(F.col("num_views")) + w["vote"] * vote
        return rows.select("doc_id", score.alias("score")).where(F.col("score") != 0)
    return scored.where(F.lit(False))


def best_answer(index: Index, query: Query, name: str = "favorite") -> DataFrame:
    """The best question with its answer, or no row."""
    best = page(knowledge_score(index, query, name), 1)
    columns = [c for c in ("title", "url", "file_path", "answer", "vote", "page_rank", "num_views") if c in index.doc_stats.columns]
    return index.doc_stats.join(F.broadcast(best), "doc_id").select("doc_id", "score", *columns)  # one row


def _lists(queries: DataFrame, top: int, phrases: DataFrame | None, tops: DataFrame | None) -> DataFrame:
    """(query_id, one) and, with ``tops``, top: ``one`` stands for all queries with the same terms and phrases. Written once."""
    lists = queries.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("term", "qtf")))).alias("asked"))
    if phrases is not None:
        said = phrases.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_set("words"))).alias("said"))
        lists = lists.join(said, "query_id", "left").select("query_id", F.concat_ws(" ", "asked", "said").alias("asked"))
    if tops is not None:
        lists = lists.join(tops.select("query_id", "top"), "query_id", "left").withColumn("top", F.coalesce("top", F.lit(top)))
    return durable(lists.withColumn("one", F.min("query_id").over(Window.partitionBy("asked"))))


def query_likelihood_batch(index: Index, queries: DataFrame, top: int = 10, phrases: DataFrame | None = None, tops: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of the ``top`` documents of many queries in one job.

    ``queries``: query_id, term, qtf. ``phrases``: query_id, words; a document
    must hold each of a query's phrases. ``tops``: query_id, top, instead of
    ``top`` where it isn't null. Queries with the same terms and phrases are
    ranked once and their result is given to each. Top rows are cut in each task
    before the shuffle by query.
    """
    lists = _lists(queries, top, phrases, tops)
    ones = lists.where(F.col("query_id") == F.col("one")).select("query_id")
    single = durable(queries.join(ones, "query_id", "left_semi").select("query_id", "term", "qtf"))
    # rows of the queries' terms only, written once: they are matched, counted and scored
    term_doc = durable(index.term_doc.join(single.select("term").distinct(), "term", "left_semi"))
    stats = durable(term_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf")))
    rows = matches_batch(term_doc, stats, single).join(stats.select("term", "ctf"), "term").join(index.doc_stats.select("doc_id", "length"), "doc_id").crossJoin(F.broadcast(index.scalars()))
    scored = rows.groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * smoothed(F.col("tf"), F.col("length"), F.col("ctf"), F.col("total_terms"))).alias("score"), F.count("*").alias("held"), F.max("n_terms").alias("n_terms"))
    scored = scored.where((F.col("held") == F.col("n_terms")) & (F.col("score") != 0))
    if phrases is not None:
        said = durable(phrases.join(ones, "query_id", "left_semi").select("query_id", "words").distinct())
        scored = durable(scored)
        free = scored.join(said.select("query_id").distinct(), "query_id", "left_anti")
        scored = free.unionByName(scored.join(phrases_batch(index, scored, said), ["query_id", "doc_id"], "left_semi"))
    # the largest bound is a number of the plan, so that rows are cut before the shuffle
    most = top if tops is None else lists.agg(F.max("top")).first()[0] or 0
    w = Window.partitionBy("query_id").orderBy(*best_first())
    best = scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= most)
    out = lists.join(best.select(F.col("query_id").alias("one"), "doc_id", "score", "rank"), "one")
    return (out if tops is None else out.where(F.col("rank") <= F.col("top"))).select("query_id", "doc_id", "score", "rank")


def query_likelihood_log(docs: DataFrame, queries: DataFrame, phrases: DataFrame, tops: DataFrame, top: int = 10) -> DataFrame:
    """``query_likelihood_batch`` of documents without an index (doc_id, text), for a log of many queries over many documents.

    The collection is read once, into blocks (``operators.blocks``) with the
    log's terms and phrases, of which every task gets the list; each block is
    searched for all queries at once. What a pair of a query and a document costs
    is a look-up in an array, not a row of a join.
    """
    import numpy as np

    queries = queries.where("query_id IS NOT NULL").groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf"))
    lists = _lists(queries, top, phrases, tops)
    each = lists.groupBy("one").agg(F.max("top").alias("most")).withColumnRenamed("one", "query_id")
    single = durable(queries.join(each, "query_id"))
    said = durable(phrases.join(each.select("query_id"), "query_id", "left_semi").distinct())
    terms = [r["term"] for r in single.select("term").distinct().collect()]
    made = blocks.build(docs, sorted(terms), sorted(r["words"] for r in said.select("words").distinct().collect()))
    share = (LAMBDA * F.col("ctf") / F.col("total_terms")).alias("c")
    words = single.join(blocks.counts(made).select("term", share), "term", "left").select("query_id", "most", "c", "term", "qtf")
    spoken = said.join(each, "query_id").select("query_id", "most", F.lit(0.0).alias("c"), F.array_join("words", " ").alias("term"), F.lit(0).cast("bigint").alias("qtf"))
    # phrases come first, then the rarest term; a query with a term that no document holds is left out
    asked = words.unionByName(spoken).groupBy("query_id", "most").agg(F.sort_array(F.collect_list(F.struct("c", "term", "qtf"))).alias("items"), F.bool_and(F.col("c").isNotNull()).alias("known"))
    parts = max(1, -(-each.count() // LOG_PART))
    asked = asked.where("known").groupBy(F.pmod(F.hash("query_id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("query_id", F.col("most").cast("bigint").alias("most"), "items")).alias("asked")).coalesce(parts)

    def weight(tf, length, c):
        return np.log2((1 - LAMBDA) * tf / length + c)

    w = Window.partitionBy("query_id").orderBy(*best_first())
    ranked = blocks.best(made, asked, weight, DIGITS).withColumn("rank", F.row_number().over(w).cast("bigint")).withColumnRenamed("query_id", "one")
    return lists.join(ranked, "one").where(F.col("rank") <= F.col("top")).select("query_id", "doc_id", "score", "rank")


def batch_terms(queries: DataFrame, query_id: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, term, qtf) of a table of queries read as plain words; stop words dropped, null queries without terms."""
    words = positions(queries.select(F.col(query_id).alias("doc_id"), F.replace(F.col(text), F.lit('"'), F.lit(" ")).alias("text")))
    return words.where(~F.col("term").isin(*sorted(QUERY_STOP_WORDS))).groupBy(F.col("doc_id").alias("query_id"), "term").agg(F.count("*").alias("qtf"))


def batch_parsed(queries: DataFrame, query_id: str = "query_id", text: str = "query") -> tuple[DataFrame, DataFrame]:
    """(query_id, term, qtf) and (query_id, words) of a table of queries, read by ``parse_query``: the terms, and the phrases."""
    rows = queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["query_id"]

    def run(batches):
        import pyarrow as pa

        from corvidex.functions.query import parse_query

        for b in batches:
            parsed = [parse_query(t) for t in b.column("text").to_pylist()]
            terms = pa.array([list(q.counts().items()) for q in parsed], pa.map_(pa.string(), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("query_id"), terms, pa.array([q.phrases for q in parsed], pa.list_(pa.list_(pa.string())))], ["query_id", "terms", "phrases"])

    ship(queries.sparkSession)
    # written once: terms and phrases are read apart
    parsed = durable(rows.mapInArrow(run, f"query_id {kind}, terms map<string, bigint>, phrases array<array<string>>"))
    return parsed.select("query_id", F.explode("terms").alias("term", "qtf")), parsed.select("query_id", F.explode("phrases").alias("words"))
