"""Link graph, PageRank and view counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.session import durable

# Fixed value: the pattern of a link whose target is a simple name.
LINK = r'<[a|A].*?href="([^ /#]*)".*?>'
#: Rounds after which the lineage of a long iteration is cut.
CUT_EVERY = 8


def links(pages: DataFrame, name: str = "name", html: str = "html", pattern: str = LINK) -> DataFrame:
    """(src, dst): every link of a page to a simple name, found line by line, repeats kept."""
    lines = pages.select(F.col(name).alias("src"), F.explode(F.split(html, r"\r\n|\r|\n")).alias("line"))
    return lines.select("src", F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(1))).alias("dst"))


def redirects(names: DataFrame) -> DataFrame:
    """(name, target): names X for which X.html is a name too."""
    return names.select("name", F.concat("name", F.lit(".html")).alias("target")).join(names.select(F.col("name").alias("target")), "target", "left_semi").select("name", "target")


def nodes(names: DataFrame) -> DataFrame:
    """(name) of the pages of the graph: not hidden, not a redirect."""
    visible = names.where(~F.col("name").startswith(".")).select("name").distinct()
    return visible.join(redirects(visible), "name", "left_anti")


def resolve(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst) with redirected targets replaced, one hop; distinct, and only links between pages of the graph."""
    moved = redirects(names.select("name").distinct())
    pages = nodes(names)
    out = pairs.join(moved.select(F.col("name").alias("dst"), "target"), "dst", "left").select("src", F.coalesce("target", "dst").alias("dst"))
    return out.distinct().join(pages.select(F.col("name").alias("src")), "src", "left_semi").join(pages.select(F.col("name").alias("dst")), "dst", "left_semi")


def page_rank(pages: DataFrame, edges: DataFrame, iterations: int = 2, lam: float = 0.1) -> DataFrame:
    """(name, pr) after ``iterations`` rounds from 1: pr' = (1 - lam) * sum of pr / outdegree over links in + lam.

    ``edges`` (src, dst) count once each, links of a page to itself included. What
    pages without links hold is not given away, so ranks need not sum to 1. A
    link to a name that is no page counts in the outdegree and gives nobody
    anything. The co-partitioned edges are shared by all rounds; lineage is cut
    every few rounds through files.
    """
    edges = edges.select("src", "dst").distinct()
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    edges = edges.join(degree, "src")
    if iterations > 2:  # read in every round
        edges = durable(edges)
    ranks = pages.select("name").distinct().withColumn("pr", F.lit(1.0))
    for i in range(1, iterations + 1):
        given = edges.join(ranks.withColumnRenamed("name", "src"), "src").groupBy(F.col("dst").alias("name")).agg(F.sum(F.col("pr") / F.col("degree")).alias("given"))
        ranks = ranks.select("name").join(given, "name", "left").select("name", ((1 - lam) * F.coalesce("given", F.lit(0.0)) + lam).alias("pr"))
        if i % CUT_EVERY == 0 and i < iterations:
            ranks = durable(ranks)
    return ranks


def log_fields(line: Column) -> Column:
    """The fields of a line of a log: split at single blanks, blanks at the end dropped first."""
    return F.split(F.rtrim(line), " ")


def num_views(lines: DataFrame, names: DataFrame, line: str = "line") -> DataFrame:
    """(name, views) of all pages: the summed counts of the log lines ``lang article views``.

    Lines without exactly three fields, with counts that are no number, or for
    articles that are no page are skipped; views of a redirect go to its target;
    pages without lines have 0.
    """
    parts = lines.select(log_fields(F.col(line)).alias("f")).where(F.size("f") == 3)
    counts = parts.select(F.col("f")[1].alias("name"), F.expr("try_cast(f[2] AS INT)").alias("n")).where(F.col("n").isNotNull()).groupBy("name").agg(F.sum("n").alias("n"))
    moved = redirects(names.select("name").distinct())
    counts = counts.join(moved, "name", "left").groupBy(F.coalesce("target", "name").alias("name")).agg(F.sum("n").alias("views"))
    return nodes(names).join(counts, "name", "left").select("name", F.coalesce("views", F.lit(0)).alias("views"))
