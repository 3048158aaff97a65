"""Helpers for Spark jobs of the text operators: durable intermediate tables and connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SPREAD = 64


def shared_folder(spark: SparkSession) -> str:
    """The session's folder for checkpoints.  A folder of this machine is set only where none is named and the master is local, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """The frame cut from its lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(rows: DataFrame, whole: DataFrame, keys: list[str], by: str, parts: int = SPREAD) -> DataFrame:
    """Each row with the one row that ``whole`` has for its key.

    The rows of a key are dealt to ``parts`` parts by the hash of ``by``, and the key's one row is sent to each
    part that occurs, so a hot key is many tasks' work.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    held = dealt.select(*keys, "_part").distinct().join(whole.hint("merge"), keys)
    return dealt.join(held.hint("merge"), [*keys, "_part"]).drop("_part")


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) reaches.

    Alternates large-star and small-star steps until the edges no longer change.  A step takes the
    minimum of each neighbourhood by a combining aggregate and joins it back in parts, so no neighbourhood,
    a component's centre included, is gathered in one task; each step is made durable.
    """
    now = durable(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u goes to u's least neighbour
        large = spread_join(both.where("v > u"), least, ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
        small = spread_join(large, low, ["u"], "v").select(F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("e"))
        now = durable(small.select("e.u", "e.v").where("u != v").distinct())
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(after) == state:
            ends = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(ends).distinct()
        state = tuple(after)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
