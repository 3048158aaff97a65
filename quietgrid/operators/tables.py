"""Tables made durable between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.scratch import scratch


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """The table, written once as Parquet and read back, so that a lost executor costs no step before it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
