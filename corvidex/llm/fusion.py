"""One ranking from several scores on unlike scales, by median rank.

Only ranks enter: within a group every item gets its rank in each score, and
items are ordered by the weighted median of their ranks, then by the mean rank,
then by identifier. Ranks are found without gathering a group anywhere: equal
values are counted together, the distinct values are range-partitioned, ranks
are taken within a part and moved by the counts of the parts before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvidex.session import durable


#: Share of all rows from which on a value's rank is broadcast.
HOT_SHARE = 1e-3


def sums_before(df: DataFrame, group: list[str], order: list[Column], weight: Column, name: str) -> DataFrame:
    """``df`` with column ``name``: the sum of ``weight`` over the rows of the group that come earlier.

    ``order`` must tell the rows of a group apart. A group of any size is spread
    over range partitions; what is gathered per group is one row a partition.
    """
    ranged = df.repartitionByRange(*(F.col(f"`{g}`") for g in group), *order)
    ranged = durable(ranged.withColumn("w_", weight.cast("bigint")).withColumn("part_", F.spark_partition_id()))
    parts = ranged.groupBy(*group, "part_").agg(F.sum("w_").alias("n_"))
    earlier = Window.partitionBy(*group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*group, "part_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("offset_"))
    inner = Window.partitionBy(*group, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("local_", F.coalesce(F.sum("w_").over(inner), F.lit(0)))
    return local.join(parts, [*group, "part_"]).withColumn(name, F.col("local_") + F.col("offset_")).drop("w_", "part_", "local_", "offset_")


def weighted_median(ranks: list[Column], weights: list[float]) -> Column:
    """The rank at which half of the weight is reached; the mean of two ranks where it is reached between them."""
    k, half = len(ranks), sum(weights) / 2
    pairs = F.array_sort(F.array(*(F.struct(r.cast("double").alias("r"), F.lit(float(w)).alias("w")) for r, w in zip(ranks, weights))))
    reached = F.transform(
        F.sequence(F.lit(1), F.lit(k)),
        lambda i: F.struct(
            F.element_at(pairs, i)["r"].alias("r"),
            F.aggregate(F.slice(pairs, 1, i), F.lit(0.0), lambda a, x: a + x["w"]).alias("c"),
        ),
    )
    eps = 1e-9 * max(1.0, half)
    low = F.filter(reached, lambda x: x["c"] >= half - eps)[0]["r"]
    high = F.get(F.filter(reached, lambda x: x["c"] > half + eps), F.lit(0))["r"]
    return (low + F.coalesce(high, low)) / 2


def median_rank(items: DataFrame, group: str, item: str, scores: dict[str, float]) -> DataFrame:
    """(group, item, median_rank, mean_rank, position) of every item, best first from position 1.

    ``scores`` names the score columns and their weights; high values are good.
    Equal values share the mean of their ranks. A missing score (null or NaN)
    gives no credit: its rank is one below the last. An item named twice in a
    group counts once, with its highest score each. Null groups form a group,
    null items are an item. Other columns are not read. An empty table gives no
    rows; a group of one item gives position 1.
    """
    names = list(scores)
    if not names or any(w < 0 for w in scores.values()) or not sum(scores.values()):
        raise ValueError("at least one score with a positive weight is needed")
    clean = [F.max(F.when(~F.isnan(F.col(f"`{n}`").cast("double")), F.col(f"`{n}`").cast("double"))).alias(f"s{i}") for i, n in enumerate(names)]
    one = items.groupBy(F.col(f"`{group}`").alias("g"), F.col(f"`{item}`").alias("item")).agg(*clean)
    entries = F.array(*(F.struct(F.lit(i).alias("score"), F.col(f"s{i}").isNull().alias("missing"), F.coalesce(f"s{i}", F.lit(0.0)).alias("value")) for i in range(len(names))))
    # a null group takes part in joins through its own flag
    long = one.select(F.coalesce(F.col("g").cast("string"), F.lit("")).alias("gk"), F.col("g").isNull().alias("gn"), "g", "item", F.explode(entries).alias("e")).select("gk", "gn", "g", "item", "e.*")
    key = ["gk", "gn", "score"]
    values = long.groupBy(*key, "missing", "value").agg(F.count("*").alias("n"))
    order = [F.asc("missing"), F.desc("value")]
    values = sums_before(values, key, order, F.col("n"), "before").withColumn(
        "rank", F.when(F.col("missing"), F.col("before") + F.col("n") + 1.0).otherwise(F.col("before") + (F.col("n") + 1) / 2.0)
    )
    ranked = _with_ranks(long, values.select(*key, "missing", "value", "n", "rank"), [*key, "missing", "value"])
    wide = ranked.groupBy("gk", "gn", "g", "item").agg(*(F.max(F.when(F.col("score") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(names))))
    ranks, weights = [F.col(f"r{i}") for i in range(len(names))], list(scores.values())
    mean = reduce(lambda a, b: a + b, (r * F.lit(float(w)) for r, w in zip(ranks, weights))) / F.lit(float(sum(weights)))
    fused = wide.select("gk", "gn", "g", "item", weighted_median(ranks, weights).alias("median_rank"), mean.alias("mean_rank"))
    placed = sums_before(fused, ["gk", "gn"], [F.asc("median_rank"), F.asc("mean_rank"), F.asc("item")], F.lit(1), "earlier")
    return placed.select(F.col("g").alias(group), F.col("item").alias(item), "median_rank", "mean_rank", (F.col("earlier") + 1).alias("position"))


def _with_ranks(long: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """``long`` with the rank of each row's value.

    A value may be that of most rows of a group (a missing score, a zero). Values
    with at least HOT_SHARE of all rows are at most 1 / HOT_SHARE and are
    broadcast; their rows are then spread by item through the join by value, in
    which they find nothing.
    """
    values = durable(values)
    rows = values.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(values.where(F.col("n") >= F.lit(max(1.0, rows * HOT_SHARE))).select(*keys, F.col("rank").alias("hot_rank")))
    spread = F.when(F.col("hot_rank").isNotNull(), 1 + F.pmod(F.xxhash64("item"), F.lit(1 << 16))).otherwise(F.lit(0))
    marked = long.join(hot, keys, "left").withColumn("spread_", spread)
    return marked.join(values.select(*keys, "rank").withColumn("spread_", F.lit(0).cast("bigint")), [*keys, "spread_"], "left").withColumn("rank", F.coalesce("hot_rank", "rank")).drop("hot_rank", "spread_")


def result_scores(scored: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, pagerank, numviews, vote): each result counted once, vote of the newest answer.

    Answers of one doc_id are told apart by crawled_at, then knowledge_id; a null
    vote of the newest is a missing vote. Null doc_ids get no vote.
    """
    votes = knowledge.groupBy("doc_id").agg(F.max_by("vote", F.struct("crawled_at", "knowledge_id")).alias("vote"))
    return scored.select("query_id", "doc_id", "score", "pagerank", "numviews").join(votes, "doc_id", "left").select("query_id", "doc_id", "score", "pagerank", "numviews", "vote")
