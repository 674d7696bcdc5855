"""Fitted models kept in the shared folder, so that one fitted once is the same for every later table."""

from __future__ import annotations

import pickle
from typing import Any

from pyspark.sql import SparkSession

from corvidex.session import ship


def save(spark: SparkSession, model: Any, path: str) -> None:
    """Writes a model of ``markup``, ``boilerplate`` or ``residue`` to ``path``, replacing what is there."""
    data = bytearray(pickle.dumps(model))
    spark.createDataFrame([(type(model).__name__, data)], "kind string, model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Any:
    """The model at ``path``, with the report of its fitting. Only read what was written by ``save``: it is unpickled."""
    ship(spark)
    return pickle.loads(spark.read.parquet(path).first()["model"])
