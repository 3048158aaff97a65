"""Pareto fronts: the rows that no other row of their request beats, at most as high everywhere and lower somewhere.

Requests of at most ``SMALL`` rows are joined with themselves, in as many partitions as their rows ask for.

Of larger ones only distinct vectors are compared.  They are sorted in ranges of request and place on a curve that keeps near vectors
together; the requests within one batch of rows are settled side by side.  The vectors of larger requests form blocks.
A block's own front is found first, then fronts are merged ``FAN`` at a time, in as many rounds as they keep shrinking.
What is left in several blocks is compared by pairs of blocks, and only those whose corner points allow it: a block can
beat one in another only if its least corner is at most the other's greatest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import pieces, sized
from .tables import durable

FAN = 16
BLOCK = 4096
SMALL = 64  # rows of a request that are compared side by side with others


def front(v: np.ndarray) -> np.ndarray:
    """Positions, in order, of the distinct vectors that none of the others beats.

    A vector can only be beaten by one before it in the order of all its numbers, so chunks in that order meet the front so far.
    """
    order = np.lexsort([*v.T[::-1], v.sum(axis=1)])
    kept = np.zeros(0, dtype=np.int64)
    for i in range(0, len(order), 128):
        new = order[i : i + 128]
        for j in range(0, len(kept), 4096):
            held = v[kept[j : j + 4096]]
            new = new[~(held[:, None, :] <= v[new][None, :, :]).all(axis=2).any(axis=0)]
        own = (v[new][:, None, :] <= v[new][None, :, :]).all(axis=2)
        np.fill_diagonal(own, False)
        kept = np.concatenate([kept, new[~own.any(axis=0)]])
    return np.sort(kept)


def _beaten(v: np.ndarray, by: np.ndarray) -> np.ndarray:
    out = np.zeros(len(v), dtype=bool)
    for i in range(0, len(by), 256):
        left = np.flatnonzero(~out)
        at_most = (by[i : i + 256, None, :] <= v[left][None, :, :]).all(axis=2)
        less = (by[i : i + 256, None, :] < v[left][None, :, :]).any(axis=2)
        out[left[(at_most & less).any(axis=0)]] = True
    return out


def _matrix(columns: list[pa.Array]) -> np.ndarray:
    """The vectors as rows; NaN is the greatest number, as it is in Spark."""
    v = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], axis=1) if len(columns[0]) else np.zeros((0, len(columns)))
    return np.where(np.isnan(v), np.inf, np.minimum(v, np.finfo(float).max)) if np.isnan(v).any() else v


def _fronts(v: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of the fronts of consecutive groups of vectors."""
    sizes = np.diff(starts)
    small = np.repeat(sizes <= SMALL, sizes)
    group = np.repeat(np.arange(len(sizes)), sizes)
    beaten = np.zeros(len(v), dtype=bool)
    for lag in range(1, int(sizes[sizes <= SMALL].max(initial=0))):
        at = np.flatnonzero((group[lag:] == group[:-lag]) & small[lag:])
        a, b = v[at], v[at + lag]
        beaten[at + lag] |= (a <= b).all(axis=1)
        beaten[at] |= (b <= a).all(axis=1)
    for k in np.flatnonzero(sizes > SMALL):
        own = slice(starts[k], starts[k + 1])
        keep = np.zeros(sizes[k], dtype=bool)
        keep[front(v[own])] = True
        beaten[own] = ~keep
    return np.flatnonzero(~beaten)


def _curve(df: DataFrame, request: str, attrs: list[str]) -> Column:
    """A place on a Z-curve by the attributes' order of size; nearness is a help, not a need."""
    bits = max(1, 60 // len(attrs))
    spans = [F.least(F.greatest(F.log1p(F.abs(F.col(a).cast("double"))) * 4, F.lit(0)), F.lit(2**min(bits, 8) - 1)).cast("long") for a in attrs]
    out = F.lit(0).cast("long")
    for b in reversed(range(min(bits, 8))):
        for x in spans:
            out = F.call_function("shiftleft", out, F.lit(1)).bitwiseOR(F.call_function("shiftright", x, F.lit(b)).bitwiseAND(F.lit(1).cast("long")))
    return out


def _first_pass(vectors: DataFrame, request: str, attrs: list[str]) -> DataFrame:
    """The fronts of whole requests (``block`` null), and the own fronts of the blocks of others."""
    kinds = dict(vectors.dtypes)
    names = [request, *attrs, "part", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(x for x in batches if x.num_rows):
            code = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])), len(code))
            v = _matrix(batch.columns[1:])
            kept = _fronts(v, starts)
            # the first and the last request of a batch may have rows in others
            block = np.full(len(code), -1)
            block[starts[-2] :] = 2 * number + 1
            block[: starts[1]] = 2 * number
            own = block[kept]
            places = [pa.array(np.full(len(kept), part), pa.int32(), mask=own < 0), pa.array(own, pa.int32(), mask=own < 0)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(kept)) for c in batch.columns), *places], names)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (request, *attrs)) + ", part int, block int"
    return vectors.mapInArrow(run, schema)


def _merged(rows: DataFrame, request: str, attrs: list[str], fan: int) -> DataFrame:
    """Blocks of a request merged ``fan`` at a time to their common front."""
    kinds = dict(rows.dtypes)
    names = [request, *attrs, "node"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        columns = [table[c].combine_chunks() for c in names]
        kept = pa.array(front(_matrix(columns[1:-1])))
        above = pa.compute.divide(columns[-1], fan)
        yield pa.RecordBatch.from_arrays([*(c.take(kept) for c in columns[:-1]), above.take(kept)], names)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return rows.select(*names).groupBy(request, F.expr(f"node div {fan}")).applyInArrow(merge, schema)


def _by_corners(rows: DataFrame, request: str, attrs: list[str]) -> DataFrame:
    """The rows that no row of another block of their request beats."""
    key = F.coalesce(F.concat(F.lit("="), F.col(request).cast("string")), F.lit("")).alias("_key")
    rows = durable(rows.select("*", key), "blocks")
    corners = rows.groupBy("_key", "node").agg(F.array(*[F.min(a).cast("double") for a in attrs]).alias("low"), F.array(*[F.max(a).cast("double") for a in attrs]).alias("high"))
    left, right = (corners.select("_key", F.col("node").alias(n), F.col(c).alias(f"_{c}")) for n, c in (("by", "low"), ("node", "high")))
    meet = F.forall(F.zip_with("_low", "_high", lambda x, y: x <= y), lambda ok: ok)
    pairs = durable(left.join(right.hint("shuffle_hash"), "_key").where((F.col("by") != F.col("node")) & meet).select("_key", "by", "node"), "pairs")
    kinds = dict(rows.dtypes)
    names = ["_key", *attrs]

    def compare(own: pa.Table, other: pa.Table) -> pa.Table:
        columns, others = [own[a].combine_chunks() for a in attrs], [other[f"_o{i}"].combine_chunks() for i in range(len(attrs))]
        if not len(own) or not len(other):
            return own.select(names).slice(0, 0)
        return own.select(names).filter(pa.array(_beaten(_matrix(columns), _matrix(others))))

    own = rows.join(pairs.hint("shuffle_hash"), ["_key", "node"]).select("_key", "node", "by", *attrs)
    held = rows.select(F.col("_key").alias("_ok"), F.col("node").alias("_ob"), *[F.col(a).alias(f"_o{i}") for i, a in enumerate(attrs)])
    asked = pairs.select(F.col("_key").alias("_pk"), F.col("by").alias("_pb"), F.col("node").alias("_pn"))
    other = held.join(asked.hint("shuffle_hash"), (F.col("_ok") == F.col("_pk")) & (F.col("_ob") == F.col("_pb"))).drop("_pk", "_pb")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    beaten = own.groupBy("_key", "node", "by").cogroup(other.groupBy("_ok", "_pn", "_ob")).applyInArrow(compare, schema)
    gone = beaten.distinct().select(F.col("_key").alias("_gk"), *[F.col(a).alias(f"_g{i}") for i, a in enumerate(attrs)]).hint("merge")
    same = reduce(lambda x, y: x & y, [F.col(a) == F.col(f"_g{i}") for i, a in enumerate(attrs)], F.col("_key") == F.col("_gk"))
    return rows.join(gone, same, "left_anti").select(request, *attrs)


def _side_by_side(df: DataFrame, request: str, attrs: list[str], rows: int) -> DataFrame:
    """Rows of ``df``, whose requests have few rows each and are not null, that no other row of their request beats."""
    n = pieces(df, rows)
    others = df.select(F.col(request).alias("_r"), *[F.col(a).alias(f"_a{i}") for i, a in enumerate(attrs)])
    pairs = [(F.col(f"_a{i}"), df[a]) for i, a in enumerate(attrs)]
    beats = reduce(lambda x, y: x & y, [o <= a for o, a in pairs]) & reduce(lambda x, y: x | y, [o < a for o, a in pairs])
    return df.repartition(n, request).join(others.repartition(n, "_r").hint("merge"), (df[request] == F.col("_r")) & beats, "left_anti")


def pareto_front(df: DataFrame, request: str, attrs: list[str], fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """Rows of ``df`` that no other row of their request beats on ``attrs``; a row with a null among them is beaten and beats none."""
    known = reduce(lambda x, y: x & y, [F.col(a).isNotNull() for a in attrs])
    df = df.where(known)
    sizes = df.groupBy(request).agg(F.count("*").alias("n"))
    large = F.col(request).isNull() | (F.col("n") > SMALL)
    found = sizes.agg(F.sum("n"), F.count_if(large)).first()
    if not found[1]:
        return _side_by_side(df, request, attrs, found[0] or 0)
    apart = sized(sizes.where(large).select(F.col(request).alias("_large")))
    same = df[request].eqNullSafe(F.col("_large"))
    few = _side_by_side(df.join(apart, same, "left_anti"), request, attrs, found[0])
    return few.unionByName(_in_blocks(df.join(apart, same, "left_semi"), request, attrs, fan, block))


def _in_blocks(df: DataFrame, request: str, attrs: list[str], fan: int, block: int) -> DataFrame:
    """The same for rows without nulls and requests of any size."""
    vectors = df.select(request, *attrs).distinct()
    place = _curve(vectors, request, attrs)
    ordered = vectors.repartitionByRange(F.col(request), place).sortWithinPartitions(F.col(request), place)
    first = durable(_first_pass(ordered, request, attrs), "fronts")
    best = first.where("block is null").select(request, *attrs)
    rest = first.where("block is not null")
    most = rest.agg(F.max("block"), F.count("*")).first()
    if most[1]:
        width, count = most[0] + 1, most[1]
        rest = rest.select(request, *attrs, (F.col("part").cast("long") * width + F.col("block")).alias("node"))
        while True:
            rest = durable(_merged(rest, request, attrs, fan), "fronts")
            held = rest.groupBy(request, "node").agg(F.count("*").alias("n")).agg(F.max("node"), F.max("n"), F.sum("n")).first()
            if not held[0]:  # one block for each request
                best = best.unionByName(rest.select(request, *attrs))
                break
            if held[1] > block and held[2] > count / 2:  # fronts have stopped to shrink
                best = best.unionByName(_by_corners(rest, request, attrs))
                break
            count = held[2]
    named = best.select(F.col(request).alias("_r"), *[F.col(a).alias(f"_a{i}") for i, a in enumerate(attrs)])
    same = df[request].eqNullSafe(F.col("_r"))
    for i, a in enumerate(attrs):
        same = same & (df[a] == F.col(f"_a{i}"))
    return df.join(named.hint("merge"), same, "left_semi")
