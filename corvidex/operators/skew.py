"""Per-key results where a few keys hold most of the records.

``occurrence_counts`` finds the heavy keys with a bounded sketch, takes their
rows out by a broadcast join and spreads those over (key, document, position). The
light keys take the ordinary shuffle, by key and document: a key just below the
threshold, which is a share and grows with the rows, is still spread over its
documents, and only one partial count a task and key is gathered by key. The two
halves are disjoint and are put together by a union.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.session import durable

#: Characters that count as blanks around a key.
BLANKS = " \t\r\n"
#: Keys with at least this share of the rows are treated as heavy; at most 1 / HEAVY_SHARE keys can be.
HEAVY_SHARE = 0.002
#: Counters of the frequent-items sketch. Its error is about 3.5 / counters of the rows, far below HEAVY_SHARE.
SKETCH_COUNTERS = 8192


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE, counters: int = SKETCH_COUNTERS) -> DataFrame:
    """Keys of ``df`` with an estimated share of at least ``share`` of the rows.

    One pass, a sketch per partition, merged; null keys are left out. The sketch
    names at most ``1 / share`` keys, so the result has a proven bound whatever
    the size of ``df``. An empty table gives no keys. A key just under the
    threshold may be named or not; that changes where its rows are processed,
    never the counts.
    """
    most = int(1 / share) + 1
    sketch = df.where(F.col(key).isNotNull()).agg(
        F.count("*").alias("n"),
        F.expr(f"approx_top_k(`{key}`, {most}, {counters})").alias("top"),
    )
    return (
        sketch.select("n", F.explode("top").alias("t"))
        .where(F.col("t.count") >= F.col("n") * F.lit(share))
        .select(F.col("t.item").alias(key))
    )


def occurrence_counts(
    postings: DataFrame,
    term: str = "term",
    doc: str = "doc_id",
    pos: str = "pos",
    share: float = HEAVY_SHARE,
) -> DataFrame:
    """(term, occurrences, docs, heavy) of every term, without skewed tasks.

    Terms are trimmed of blanks and lower-cased; null and blank ones are
    dropped. Each (term, doc, pos) counts once, however often and from however
    many parts it was delivered. Null documents or positions count as one value
    of their own for occurrences, and a null document is not a document. Other
    columns, whatever their names, are not read. An empty table gives no rows.
    """
    key = F.lower(F.btrim(F.col(f"`{term}`"), F.lit(BLANKS)))
    rows = postings.select(key.alias("term"), F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{pos}`").alias("pos")).where(F.col("term") != "")
    # written once: both halves read these few names, and both must see the same ones
    heavy = durable(heavy_keys(rows.select("term"), "term", share))

    # Heavy keys: at most 1/share names, so the broadcast is bounded. Their rows
    # are spread by (term, doc, pos); what reaches the last shuffle is one
    # partial row per task and term.
    hot = (
        rows.join(F.broadcast(heavy), "term", "left_semi")
        .groupBy("term", "doc_id", "pos")
        .agg(F.lit(1).alias("one"))
        .groupBy("term", "doc_id")
        .agg(F.count("*").alias("tf"))
        .groupBy("term")
        .agg(F.sum("tf").alias("occurrences"), F.count("doc_id").alias("docs"))
        .withColumn("heavy", F.lit(True))
    )
    # Light keys: one shuffle by key and document serves the next two groupings;
    # the last one gets partial sums.
    cold = (
        rows.join(F.broadcast(heavy), "term", "left_anti")
        .repartition("term", "doc_id")
        .groupBy("term", "doc_id", "pos")
        .agg(F.lit(1).alias("one"))
        .groupBy("term", "doc_id")
        .agg(F.count("*").alias("tf"))
        .groupBy("term")
        .agg(F.sum("tf").alias("occurrences"), F.count("doc_id").alias("docs"))
        .withColumn("heavy", F.lit(False))
    )
    return hot.unionByName(cold)


def dominant_terms(counts: DataFrame, share: float = 0.02) -> DataFrame:
    """Terms of ``occurrence_counts`` with at least ``share`` of all occurrences.

    ``counts`` has one row per term and is written once, as it is read for the
    total and for the choice; the total is a one-row aggregate.
    """
    counts = durable(counts)
    total = counts.agg(F.sum("occurrences").alias("total"))
    # shares are compared as whole numbers, so that a term of exactly the share counts
    exact = Fraction(str(share))
    at_least = F.col("occurrences") * exact.denominator >= F.col("total") * exact.numerator
    return counts.crossJoin(F.broadcast(total)).where(at_least).select("term")
