"""Queries of the text preparation operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.llm import boilerplate, fusion, markup, ngrams, packing, residue, tokens
from corvidex.session import table


def _marked_up(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, str, str]]:
    """(tbl, table, identifier, field) of the tables whose texts hold markup."""
    return [("knowledge", table(spark, sf_dir, "knowledge"), "knowledge_id", "knowledge"), ("scored_document", table(spark, sf_dir, "scored_document"), "result_id", "snippet")]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _marked_up(spark, sf_dir)
    model = markup.fit(markup.training_texts([(df, key, text) for _, df, key, text in parts]))
    found = [markup.structures(df, key, text, model).select(F.lit(tbl).alias("tbl"), F.col(key).alias("rec_id"), "kind") for tbl, df, key, text in parts]
    return found[0].unionAll(found[1])


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _marked_up(spark, sf_dir)
    model = markup.fit(markup.training_texts([(df, key, text) for _, df, key, text in parts]))
    out = [markup.cleaned(df, key, text, model).select(F.lit(tbl).alias("tbl"), F.col(key).alias("rec_id"), "text") for tbl, df, key, text in parts]
    return out[0].unionAll(out[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = ngrams.title_and_expansion_terms(table(spark, sf_dir, "scored_document"), table(spark, sf_dir, "prf"))
    return ngrams.marked_terms(lists).where("mark IS NOT NULL").select("field", F.col("gram")[0].alias("term"), "mark")


def p3_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = ngrams.title_and_expansion_terms(table(spark, sf_dir, "scored_document"), table(spark, sf_dir, "prf"))
    return ngrams.marked_terms(lists, longest=3).select("field", F.array_join("gram", " ").alias("gram"), F.size("gram").cast("bigint").alias("n"), "total", "records", "mark")


def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fusion.result_scores(table(spark, sf_dir, "scored_document"), table(spark, sf_dir, "knowledge"))
    return fusion.median_rank(items, "query_id", "doc_id", {"score": 1.0, "pagerank": 1.0, "numviews": 1.0, "vote": 1.0})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_ranking(spark, sf_dir).where("position <= 3").select("query_id", "doc_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.frame_lines(table(spark, sf_dir, "scored_document"))


def p5_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_body(table(spark, sf_dir, "scored_document"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_spec"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.detect(table(spark, sf_dir, "documents")).where("residue").select("doc_id")


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.exclude(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "text")


QUERIES = {
    "p1_found": p1_found,
    "p1_clean": p1_clean,
    "p3_found": p3_found,
    "p3_ngram_counts": p3_ngram_counts,
    "p4_found": p4_found,
    "p4_ranking": p4_ranking,
    "p5_found": p5_found,
    "p5_body": p5_body,
    "p6_ids": p6_ids,
    "p7_packed": p7_packed,
    "p8_found": p8_found,
    "p8_kept": p8_kept,
}

_LISTS = r"""
WITH lists AS (
  SELECT 'title' AS field, result_id AS record,
         regexp_extract_all(lower(max(title)), '[\p{L}\p{Nd}]+') AS terms
  FROM scored_document WHERE title IS NOT NULL GROUP BY result_id
  UNION ALL
  SELECT 'c0', run_id, CASE WHEN coalesce(trim(max(c0), E' \t\r\n'), '') <> '' THEN [lower(trim(max(c0), E' \t\r\n'))] ELSE [] END
  FROM prf GROUP BY run_id, pos_in_run
), sizes AS (SELECT field, count(DISTINCT record) AS all_records FROM lists GROUP BY field)
"""

_RANKS = """
WITH one AS (
  SELECT query_id, doc_id, max(score) AS s0, max(CASE WHEN NOT isnan(pagerank) THEN pagerank END) AS s1, max(numviews)::DOUBLE AS s2
  FROM scored_document GROUP BY query_id, doc_id
), votes AS (
  SELECT doc_id, vote FROM (
    SELECT doc_id, vote, row_number() OVER (PARTITION BY doc_id ORDER BY crawled_at DESC, knowledge_id DESC) AS k FROM knowledge)
  WHERE k = 1
), ranks AS (
  SELECT o.query_id, o.doc_id, unnest([s0, s1, s2, vote::DOUBLE]) AS value, unnest([0, 1, 2, 3]) AS score
  FROM one o LEFT JOIN votes v ON o.doc_id = v.doc_id
), ranked AS (
  SELECT query_id, doc_id,
    CASE WHEN value IS NULL THEN count(*) OVER (PARTITION BY query_id, score) + 1.0::DOUBLE
         ELSE rank() OVER (PARTITION BY query_id, score ORDER BY value DESC NULLS LAST)
              + (count(*) OVER (PARTITION BY query_id, score, value) - 1) / 2.0::DOUBLE END AS r
  FROM ranks
), fused AS (
  SELECT query_id, doc_id, median(r) AS median_rank, avg(r) AS mean_rank FROM ranked GROUP BY query_id, doc_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY median_rank, mean_rank, doc_id) AS position FROM fused
)
"""

SQL = {
    "p3_found": _LISTS
    + """, counts AS (SELECT field, term, count(DISTINCT record) AS records FROM (SELECT field, record, unnest(terms) AS term FROM lists) GROUP BY field, term),
    marked AS (SELECT field, term, CASE WHEN records * 10 > all_records THEN 'common' WHEN records <= 2 THEN 'rare' END AS mark FROM counts JOIN sizes USING (field))
    SELECT field, term, mark FROM marked WHERE mark IS NOT NULL""",
    "p3_ngram_counts": _LISTS
    + """, grams AS (
      SELECT field, record, array_to_string(terms[i : i + k - 1], ' ') AS gram, k AS n
      FROM (SELECT field, record, terms, unnest(range(1, len(terms) + 1)) AS i FROM lists), (SELECT unnest([1, 2, 3]) AS k)
      WHERE i + k - 1 <= len(terms)),
    counts AS (SELECT field, gram, n, count(*) AS total, count(DISTINCT record) AS records FROM grams GROUP BY field, gram, n)
    SELECT field, gram, n::BIGINT AS n, total, records,
      CASE WHEN records * 10 > all_records THEN 'common' WHEN records <= 2 THEN 'rare' END AS mark
    FROM counts JOIN sizes USING (field)""",
    "p4_found": _RANKS + "SELECT query_id, doc_id FROM placed WHERE position <= 3",
    "p4_ranking": _RANKS + "SELECT query_id, doc_id, median_rank, mean_rank, position FROM placed",
}
