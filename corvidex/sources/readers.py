"""Readers of the file formats the engine takes in. All scans are distributed; only option files are read on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.functions import html_tree
from corvidex.session import ship


def html_pages(spark: SparkSession, paths: str | list[str], skip_html_suffix: bool = True) -> DataFrame:
    """(name, path_prefix, html): every file, named by its file name; hidden ones left out, and *.html unless told otherwise."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*$", "").alias("path_prefix"), F.col("value").alias("html"))
    files = files.where(~F.col("name").startswith("."))
    return files.where(~F.col("name").endswith(".html")) if skip_html_suffix else files


def html_documents(pages: DataFrame, base_url: str = "") -> DataFrame:
    """(name, title, text, url) of pages with name and html; all elements and entities are read by a parser. Null pages have empty texts."""
    return _parsed(pages, "title string, text string", lambda p: (p.title(), p.text())).withColumn("url", F.concat(F.lit(base_url), F.col("name")))


def qa_pages(pages: DataFrame) -> DataFrame:
    """(name, title, question, answer, vote, num_views) of question pages with name and html.

    Question and answer are the whole first and second element of class
    post-text, whatever elements they hold; vote is the first of class
    vote-count-post, views the first word of the fourth of class label-key;
    numbers that can't be read are 0. Absent elements give the empty text.
    """
    classes = ("post-text", "vote-count-post", "label-key")

    def read(p: html_tree.Page) -> tuple:
        return p.title(), p.of_class("post-text", 0), p.of_class("post-text", 1), p.of_class("vote-count-post", 0), p.of_class("label-key", 3).split(" ")[0]

    rows = _parsed(pages, "title string, question string, answer string, v string, n string", read, classes)
    number = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    return rows.select("name", "title", "question", "answer", number("v").alias("vote"), number("n").alias("num_views"))


def _parsed(pages: DataFrame, schema: str, read: Callable, classes: tuple[str, ...] = ()) -> DataFrame:
    """(name, ...) of every page, parsed in Arrow batches; ``read`` takes a parsed page to a row of ``schema``."""
    ship(pages.sparkSession)
    names = ["name", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read(html_tree.parse(h, classes)) for h in b.column("html").to_pylist()]
            columns = zip(*rows) if rows else [[] for _ in names[1:]]
            yield pa.RecordBatch.from_arrays([b.column("name"), *(pa.array(c, pa.string()) for c in columns)], names=names)

    return pages.select("name", "html").mapInArrow(run, f"name {dict(pages.dtypes)['name']}, {schema}")


def tsv_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(title, body, num_views) of a file of three tab-separated columns; the third may be missing (0)."""
    rows = spark.read.csv(path, sep="\t", quote="", schema="title string, body string, num_views string")
    return rows.select("title", "body", F.coalesce(F.col("num_views").try_cast("int"), F.lit(0)).alias("num_views"))


def tsv_documents(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of a file of tab-separated title and body: the text is both, with a blank between."""
    rows = tsv_corpus(spark, path)
    return rows.select("title", F.concat_ws(" ", "title", "body").alias("text"))


def scores(spark: SparkSession, path: str) -> DataFrame:
    """A written table of page ranks (name, pr) or view counts (name, views)."""
    return spark.read.parquet(path)


def links(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a written link graph."""
    return spark.read.parquet(path).select("src", F.explode("dsts").alias("dst"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of an access log."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def judgments(spark: SparkSession, path: str) -> DataFrame:
    """(query, doc_id, grade) of a file query, document, grade; of repeated pairs the last line of its file counts."""
    rows = spark.read.csv(path, sep="\t", quote="", schema="query string, doc_id bigint, grade string").withColumn("at", F.monotonically_increasing_id())
    return rows.groupBy("query", "doc_id").agg(F.max_by("grade", "at").alias("grade"))


def run(spark: SparkSession, path: str) -> DataFrame:
    """(query, rank, doc_id) of a file query, document, title, relevance in rank order."""
    from pyspark.sql.window import Window

    rows = spark.read.csv(path, sep="\t", quote="", schema="query string, doc_id bigint, title string, rel double").withColumn("at", F.monotonically_increasing_id())
    return rows.select("query", F.row_number().over(Window.partitionBy("query").orderBy("at")).cast("bigint").alias("rank"), "doc_id")


def feedback_runs(spark: SparkSession, manifest: str, base: str = "") -> DataFrame:
    """(run_id, term, prob) of the files a manifest of lines ``query:path`` names; run_id is the query."""
    files = [r["value"].split(":", 1) for r in spark.read.text(manifest).collect() if ":" in r["value"]]  # a list of files
    if not files:
        return spark.createDataFrame([], "run_id string, term string, prob double")
    names = spark.createDataFrame([(q, p.strip().rsplit("/", 1)[-1]) for q, p in files], "run_id string, file string")
    rows = spark.read.csv([base + p.strip() for _, p in files], sep="\t", quote="", schema="term string, prob double").withColumn("file", F.col("_metadata.file_name"))
    return rows.join(F.broadcast(names), "file").select("run_id", "term", "prob")


def tags(spark: SparkSession, path: str) -> DataFrame:
    """(tag): trimmed, lower-cased, distinct."""
    return spark.read.text(path).select(F.lower(F.btrim("value", F.lit(" \t\r\n"))).alias("tag")).where("tag <> ''").distinct()


@dataclass(frozen=True)
class Options:
    """Settings of an engine, from a file of lines ``key: value``."""

    values: dict[str, str] = field(default_factory=dict)

    def __getitem__(self, key: str) -> str:
        return self.values[key]


def options(path: str, mandatory: tuple[str, ...] = ()) -> Options:
    """``key: value`` lines; the first colon splits; blank lines and those with # are skipped; ValueError for what is missing."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            if line.strip() and not line.lstrip().startswith("#") and ":" in line:
                key, value = line.split(":", 1)
                out[key.strip()] = value.strip()
    missing = [k for k in mandatory if k not in out]
    if missing:
        raise ValueError(f"{path}: no {', '.join(missing)}")
    return Options(out)
