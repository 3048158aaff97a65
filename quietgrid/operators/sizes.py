"""How a small authored table is joined: broadcast only where its size has been checked."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 100_000


def is_small(df: DataFrame, most: int = MOST_ROWS) -> bool:
    return df.limit(most + 1).count() <= most


def near(small: bool) -> Callable[[DataFrame], DataFrame]:
    """The join hint for tables whose size follows from one that has been checked."""
    return F.broadcast if small else lambda df: df.hint("merge")


def sized(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """The table with a broadcast hint if it has ``most`` rows at the most, else with that of a merge join."""
    return near(is_small(df, most))(df)


PIECE = 500_000  # rows that one task sorts, about


def pieces(df: DataFrame, n: int, rows: int = PIECE) -> int:
    """How many partitions ``n`` rows of a table ask for; no fewer than the session's."""
    return max(math.ceil(n / rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, *keys: str, rows: int = PIECE, count: int | None = None) -> DataFrame:
    """The table dealt by keys to as many partitions as its rows ask for, so that what one task holds does not grow with them; a table of few rows stays as it is.

    ``count``: its rows, where they are known or bounded without a pass over it.
    """
    n = math.ceil((df.count() if count is None else count) / rows)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
