"""Places in an order over a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def running_sum(df: DataFrame, by: list[str], key: str, value: str, name: str, seed: int = 0) -> DataFrame:
    """Rows with ``name``: the sum of ``value`` over the rows of the group ``by`` that come before, in the seeded order of ``key``.

    Rows of a group are dealt to buckets by the key's hash; sums run inside a bucket, and the sums of the
    buckets before, ``BUCKETS`` of a group at most, are joined.
    """
    placed = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(BUCKETS)).cast("int"))
    sums = placed.groupBy(*by, "_bucket").agg(F.sum(value).alias("_all"))
    before = lambda v, w: F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    sums = sums.withColumn("_offset", before("_all", Window.partitionBy(*by).orderBy("_bucket"))).drop("_all")
    inside = placed.withColumn(name, before(value, Window.partitionBy(*by, "_bucket").orderBy(F.xxhash64(F.lit(seed + 1), key), key)))
    return inside.join(sums.hint("merge"), [*by, "_bucket"]).withColumn(name, F.col(name) + F.col("_offset")).drop("_bucket", "_offset")


def seeded_place(df: DataFrame, key: str, seed: int, name: str, by: list[str] | None = None) -> DataFrame:
    """Rows with ``name``: their place from 0 in the order of md5(seed|key), then of the key, in their group ``by``.

    The first digits of the digest deal the rows to buckets that keep the order; places inside a bucket and the
    sizes of the buckets before add up, so no group is one task's work.
    """
    by = by or []
    drawn = df.withColumn("_draw", F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary")))
    drawn = drawn.withColumn("_bucket", F.conv(F.substring("_draw", 1, 3), 16, 10).cast("int"))
    sizes = drawn.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*by, "_bucket", before.alias("_before"))  # 4096 rows of a group at most
    inside = drawn.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_draw", key)) - 1)
    return inside.join(sizes.hint("merge"), [*by, "_bucket"]).withColumn(name, (F.col("_at") + F.col("_before")).cast("long")).drop("_draw", "_bucket", "_at", "_before")
