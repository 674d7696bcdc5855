"""How often every term or n-gram occurs, and in how many records.

Suffix sorting: every position of a token list gives the suffix that starts
there, cut to the longest n-gram wanted. Suffixes are routed by their first
term, sorted in reverse lexicographic order, and read once with a stack that
holds the current path of terms; a term leaves the stack when no later suffix
can begin with its path, and then its count and record set are final and flow
into the term below. One sort gives the counts of n-grams of every length.

A first term may be most of the collection, so the route is the first term and
a bucket of the record: record sets of different buckets are disjoint, so the
partial results, one row per n-gram and bucket, simply add up. Rows of equal
suffixes come sorted by record, so that records of single terms are counted by
their changes; only prefixes that longer n-grams flow into keep record sets, and
the number of buckets grows with the rows, so that a set stays small.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.session import ship

#: Rows of lists a bucket gets on average; no record set within it is larger.
BUCKET_RECORDS = 200_000
#: Characters trimmed around a value.
BLANKS = " \t\r\n"


def words(text: Column) -> Column:
    """The lower-cased maximal runs of Unicode letters and digits; null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))


def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``stacked`` for suffixes of one term: nothing flows together, so records are counted by their changes."""
    names = ["field", "gram", "total", "records"]
    where: tuple | None = None
    total = records = 0
    last: object = None
    for batch in batches:
        out: list[tuple] = []
        for field, bucket, suffix, record in zip(*(batch.column(c).to_pylist() for c in ("field", "bucket", "suffix", "record"))):
            key = (field, bucket, suffix[0])
            if key != where:
                if where is not None:
                    out.append((where[0], [where[2]], total, records))
                where, total, records, last = key, 0, 0, _NONE
            total += 1
            records += last is _NONE or record != last
            last = record
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ((),) * 4, _KINDS)], names=names)
    if where is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((where[0], [where[2]], total, records), _KINDS)], names=names)


_NONE = object()
_KINDS = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64()]


def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all prefixes of suffixes that come sorted by field, bucket and descending suffix."""
    names = ["field", "gram", "total", "records"]
    out: list[tuple] = []
    where: tuple = (None, None)
    path: list[str] = []
    totals: list[int] = []
    records: list[set] = []

    def pop(to: int) -> None:
        while len(path) > to:
            out.append((where[0], path.copy(), totals[-1], len(records[-1])))
            path.pop()
            total, own = totals.pop(), records.pop()
            if path:
                totals[-1] += total
                if len(own) > len(records[-1]):
                    own, records[-1] = records[-1], own
                records[-1] |= own

    def flush() -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], names=names)
            out.clear()

    for batch in batches:
        for field, bucket, suffix, record in zip(*(batch.column(c).to_pylist() for c in ("field", "bucket", "suffix", "record"))):
            if (field, bucket) != where:
                pop(0)
                where = (field, bucket)
            if suffix != path:
                same = 0
                for a, b in zip(path, suffix):
                    if a != b:
                        break
                    same += 1
                pop(same)
                for term in suffix[same:]:
                    path.append(term)
                    totals.append(0)
                    records.append(set())
            totals[-1] += 1
            records[-1].add(record)
        if len(out) >= 8192:
            yield from flush()
    pop(0)
    yield from flush()


def ngram_counts(lists: DataFrame, longest: int = 1, buckets: int | None = None) -> DataFrame:
    """(field, gram ARRAY<STRING>, total, records) of every n-gram of up to ``longest`` terms.

    ``lists``: field STRING, record (any type), terms ARRAY<STRING>; a record may
    have several rows, and n-grams don't run across rows. total counts every
    occurrence, records the distinct records, a null record among them as one.
    Null and empty lists have no n-grams; null terms within a list are skipped
    before positions are taken. An empty table gives no rows.
    """
    spark = lists.sparkSession
    if longest < 1:
        raise ValueError("longest must be at least 1")
    ship(spark)
    if not buckets:
        buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), lists.count() // BUCKET_RECORDS if longest > 1 else 0)
    terms = F.filter("terms", lambda t: t.isNotNull())
    suffixes = (
        lists.select("field", "record", terms.alias("terms"))
        .where(F.size("terms") > 0)
        .select("field", "record", F.explode(F.transform("terms", lambda t, i: F.slice("terms", i + 1, longest))).alias("suffix"))
        .withColumn("bucket", F.pmod(F.xxhash64("record"), F.lit(buckets)).cast("int"))
    )
    routed = suffixes.repartition("field", F.col("suffix")[0], "bucket").sortWithinPartitions("field", "bucket", F.desc("suffix"), "record")
    partial = routed.mapInArrow(single if longest == 1 else stacked, "field string, gram array<string>, total bigint, records bigint")
    return partial.groupBy("field", "gram").agg(F.sum("total").alias("total"), F.sum("records").alias("records"))


def title_and_expansion_terms(scored: DataFrame, prf: DataFrame) -> DataFrame:
    """The lists (field, record, terms) of the titles of results and of the terms of feedback runs.

    Each result_id and each (run_id, pos_in_run) counts once, whatever its number
    of deliveries. ``title``: the words of the title; null titles are no records.
    ``c0``: the value trimmed of blanks and lower-cased as one term; a run is a
    record even if all its values are null or empty. Records are written with
    their field, so that the id spaces stay apart.
    """
    titles = (
        scored.groupBy("result_id")
        .agg(F.max("title").alias("title"))
        .where(F.col("title").isNotNull())
        .select(F.lit("title").alias("field"), F.col("result_id").cast("bigint").alias("record"), words(F.col("title")).alias("terms"))
    )
    value = F.lower(F.btrim("c0", F.lit(BLANKS)))
    expansions = (
        prf.groupBy("run_id", "pos_in_run")
        .agg(F.max("c0").alias("c0"))
        .select(F.lit("c0").alias("field"), F.col("run_id").cast("bigint").alias("record"), F.when(value != "", F.array(value)).otherwise(F.array().cast("array<string>")).alias("terms"))
    )
    return titles.unionByName(expansions)


def marked_terms(lists: DataFrame, longest: int = 1, common_share: float = 0.1, rare_records: int = 2) -> DataFrame:
    """``ngram_counts`` with mark: ``common``, ``rare`` or null.

    ``common`` for more than ``common_share`` of the field's records, else
    ``rare`` for at most ``rare_records`` of them.
    """
    sizes = lists.groupBy("field").agg(F.count_distinct("record").alias("all_records"))
    counts = ngram_counts(lists, longest)
    share = Fraction(str(common_share))  # compared as whole numbers
    mark = F.when(F.col("records") * share.denominator > F.col("all_records") * share.numerator, "common").when(F.col("records") <= rare_records, "rare")
    # one row per field: as many as the caller names, a handful
    return counts.join(F.broadcast(sizes), "field").select("field", "gram", "total", "records", mark.alias("mark"))
