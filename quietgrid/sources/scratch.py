"""A folder that the driver and all executors share, for tables that are written to be read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the session's shared folder; a folder of this machine only for a local master, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="shared-"))
    return f"{context._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
