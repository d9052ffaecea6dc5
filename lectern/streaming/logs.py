"""Metric logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.operators.monitor import monitor_stream

SCHEMA = "run long, epoch long, value double"


def best_so_far(spark: SparkSession, path: str, min_delta: float, patience: int) -> DataFrame:
    """Each run's state as JSON lines arrive in path; write it in update mode."""
    return monitor_stream(spark.readStream.schema(SCHEMA).json(path), min_delta, patience)


NAMED = "run long, metric string, epoch long, value double"


def best_by_metric(spark: SparkSession, path: str, min_delta: float, patience: int) -> DataFrame:
    """The same for logs of several named metrics: a state for each run and metric."""
    return monitor_stream(spark.readStream.schema(NAMED).json(path), min_delta, patience, ("run", "metric"))
