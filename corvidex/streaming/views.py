"""View counts of a log that keeps growing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvidex.operators.mining import log_fields


def streaming_views(lines: DataFrame, line: str = "line") -> DataFrame:
    """(name, views) of a stream of log lines, a running sum per article; state is one row per article."""
    parts = lines.select(log_fields(F.col(line)).alias("f")).where(F.size("f") == 3)
    return parts.select(F.col("f")[1].alias("name"), F.expr("try_cast(f[2] AS INT)").alias("n")).where(F.col("n").isNotNull()).groupBy("name").agg(F.sum("n").alias("views"))


def windowed_views(events: DataFrame, time: str = "ts", name: str = "name", amount: str = "n", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, name, views) per time window; rows later than ``late`` are dropped and their windows closed."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), name).agg(F.sum(amount).alias("views"))


def start(views: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the counts under ``path``: every batch adds a folder with the names it changed; nothing is replaced, so readers always find a table.

    A batch that is run again after a failure writes the same folder again.
    """

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return views.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """(name, views): the newest count of each name under ``path``."""
    return spark.read.parquet(path).groupBy("name").agg(F.max_by("views", "batch").alias("views"))
