"""Removal of every byte under a string of ``LENGTH`` bytes that also starts anywhere else in the corpus.

Each window of LENGTH bytes has an anchor: the position of its smallest hash of ``ANCHOR`` bytes, the first
of equals.  The anchor depends on the window's bytes alone, so equal windows have equal anchor strings at
equal offsets, and only windows whose anchor string occurs twice or more can repeat.  The windows of one
anchor are consecutive and make up a unit, the stretch of text they cover:

1. a unit that occurs twice or more has repeats only;
2. an anchor with one unit needs nothing further;
3. the distinct units of the other anchors are dealt to shards by their anchor.  A shard sorts the suffixes
   of its units by Larsson-Sadakane refinement, takes the common prefixes of neighbours by Kasai's
   algorithm, and a window repeats where one of its neighbours shares LENGTH bytes with it.

An anchor with very many units is cut over several shards; each passes on one row for every distinct
window of such units, and the shards' windows are merged by binary search over their sorted hashes.

Texts are UTF-8 bytes; null and empty texts have none.  Matches never cross documents; overlapping ones
count; equal rows are documents of their own; ids may repeat and be null.  Empty tables give empty results;
other columns are not read.  Units are told apart by the 64-bit hashes of their anchor and of all their bytes
together, documents by a 64-bit hash of id and text and the text's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jobs import durable
from .text import BASE, GRAM_BASE, U64, chunks, mix, powers, prefix_hash, range_hash, texts_of

LENGTH = 200
ANCHOR = 48
SHARD_UNITS = 4096
MERGED = 1_000_000  # windows of a group of the merge, about


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The suffixes in order.

    Larsson-Sadakane: the suffixes are sorted by eight bytes; then each group that is not yet settled is
    sorted by the ranks of the suffixes h bytes further on, and h doubles.
    """
    n = len(data)
    key = eight_bytes(data)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if n else np.zeros(0, dtype=bool)
    place = np.arange(n)
    rank = np.full(n + 1, -1, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0)) if n else 0
    h = 8
    while h < n:
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(open_):
            break
        s = order[open_]
        pair = rank[s] * (n + 2) + rank[np.minimum(s + h, n)] + 1
        by = np.argsort(pair, kind="stable")
        s, pair = s[by], pair[by]
        order[open_] = s
        new[open_] = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[s] = np.maximum.accumulate(np.where(new, place, 0))[open_]
        h *= 2
    return order


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number, zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(U64)
    out = np.zeros(len(data), dtype=U64)
    for j in range(8):
        out |= padded[j : j + len(data)] << U64(56 - 8 * j)
    return out


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Length up to ``most`` that the suffix at each position shares with the one before it in ``order``.

    Kasai: going one byte on loses one byte of the shared length at most (so the order must be complete).  The stretches [start, end) of
    the text are walked side by side.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    key = np.concatenate([eight_bytes(data), np.zeros(most + 9, dtype=U64)])
    text = np.concatenate([data.astype(np.int16), np.full(most + 9, -1, dtype=np.int16)])
    out, shared = np.zeros(n, dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
    for j in range(int((ends - starts).max()) if len(starts) else 0):
        live = np.flatnonzero(starts + j < ends)
        i = starts[live] + j
        p = before[i]
        length = np.where(p < 0, 0, np.maximum(shared[live] - 1, 0))
        for array, step in ((key, 8), (text, 1)):
            todo = np.flatnonzero((p >= 0) & (length + step <= most))
            while len(todo):
                to = np.maximum(i[todo], p[todo]) + length[todo] + step <= n
                same = to & (array[i[todo] + length[todo]] == array[p[todo] + length[todo]])
                todo = todo[same]
                length[todo] += step
                todo = todo[length[todo] + step <= most]
        shared[live] = length
        out[i] = length
    return out


def repeated_starts(segments: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over the segments joined by a byte that UTF-8 never has: which positions start a string of ``length``
    bytes that starts at another position too; which position leads its class of equal strings; the starts
    of the segments; and the joined bytes."""
    data = np.frombuffer(b"\xff".join(segments) + b"\xff", dtype=np.uint8)
    sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    order = suffix_array(data)
    prefixes = common_prefixes(data, order, starts, starts + sizes, length)
    with_before = prefixes[order] >= length
    again = np.zeros(len(data), dtype=bool)
    again[order] = with_before | np.append(with_before[1:], False)
    lead = np.zeros(len(data), dtype=bool)
    lead[order] = ~with_before
    return again, lead, starts, data


def units(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, unit hash, first window, number of windows) of the units of the texts."""
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    if len(data) < length:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    with np.errstate(over="ignore"):
        sums = prefix_hash(data.astype(U64) + U64(1), BASE)
        n = len(data) - anchor + 1
        h = mix((sums[anchor:] - sums[:-anchor]) * powers(BASE, n)[1])
    bits = max(1, int(n - 1).bit_length())
    low = (h & ~U64((1 << bits) - 1)) | np.arange(n, dtype=U64)  # the position settles ties: the first wins
    span, width = length - anchor + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: -(span - width)], low[span - width :])
    row = np.searchsorted(at, np.arange(len(low)), side="right") - 1
    fits = np.arange(len(low)) + length <= at[row] + sizes[row]
    window = np.flatnonzero(fits)
    place = (low[window] & U64((1 << bits) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(window) else window
    first, count, place = window[new], np.diff(np.append(new, len(window))), place[new]
    more = prefix_hash(data.astype(U64) + U64(7), GRAM_BASE)
    whole = range_hash(more, first, first + count - 1 + length, GRAM_BASE) ^ mix((place - first).astype(U64), 5)
    row = row[first]
    return row, h[place].view(np.int64), whole.view(np.int64), first - at[row], count


DOC = ["doc", "size"]  # what tells documents apart; equal rows share it and hold the same units


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, size, id, text): a hash of id and text, and the bytes of the text."""
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("int")
    return docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("doc"), size.alias("size"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def _anchors(docs: DataFrame, id_col: str, text_col: str, keys_only: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_of, sizes, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), texts_of(batch.column(2))
            for a, b in chunks(texts):
                row, key, whole, first, count = units(texts[a:b])
                if keys_only:
                    key, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])
                else:
                    arrays = [key, whole, docs_of[a + row], sizes[a + row], first.astype(np.int32), count.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["key", "whole", *DOC, "first", "count"])

    kind = "key long, n long" if keys_only else "key long, whole long, doc long, size int, first int, count int"
    return _keyed(docs, id_col, text_col).select(*DOC, "text").mapInArrow(run, kind)


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_units: int = SHARD_UNITS) -> DataFrame:
    """(doc, size, ranges): for each distinct document, its distinct byte ranges [a, b) whose windows all repeat; they may overlap."""
    twice = durable(_anchors(docs, id_col, text_col, True).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"))
    shared = durable(_anchors(docs, id_col, text_col, False).join(twice.hint("merge"), "key"))
    unit = shared.groupBy("key", "whole").agg(F.count("*").alias("n"), F.min(F.struct(*DOC, "first", "count")).alias("at"))
    unit = durable(unit.select("key", "whole", "n", "at.*"))
    many = unit.groupBy("key").agg(F.count("*").alias("n_units")).where("n_units > 1")
    cuts = F.ceil(F.col("n_units") / F.lit(shard_units)).cast("int")
    open_ = durable(unit.join(many.hint("merge"), "key").select("key", "n", *DOC, "first", "count", cuts.alias("cuts"), F.pmod("whole", cuts).cast("int").alias("cut")))
    shards = max(1, -(-open_.count() // shard_units))

    settled = shared.join(unit.where("n > 1").select("key", "whole").hint("merge"), ["key", "whole"])
    settled = settled.select(*DOC, F.col("first").alias("a"), (F.col("first") + F.col("count") - 1 + LENGTH).alias("b"))

    # the texts of the units that shards compare
    wanted = open_.groupBy(*DOC).agg(F.collect_list(F.struct("first", "count", "key", "n", "cuts", "cut")).alias("units"))
    kinds = {"shard": pa.int64(), "cut": pa.int32(), "split": pa.bool_(), "doc": pa.int64(), "size": pa.int32(), "first": pa.int32(), "count": pa.int32(), "n": pa.int64(), "segment": pa.binary()}

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: set[tuple[int, int]] = set()
            out: list[tuple] = []
            for doc, size, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                if (doc, size) not in done:  # equal rows hold the same units
                    done.add((doc, size))
                    for u in own:
                        segment = text[u["first"] : u["first"] + u["count"] - 1 + LENGTH]
                        shard = u["key"] % shards if u["cuts"] == 1 else u["key"]
                        out.append((shard, u["cut"], u["cuts"] > 1, doc, size, u["first"], u["count"], u["n"], segment))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds.values())], list(kinds))

    texts = _keyed(docs, id_col, text_col).select(*DOC, "text")
    pieces = texts.join(wanted.hint("merge"), DOC).mapInArrow(cut_out, "shard long, cut int, split boolean, doc long, size int, first int, count int, n long, segment binary")
    pieces = pieces.dropDuplicates(["shard", "cut", *DOC, "first"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        again, lead, starts, data = repeated_starts(pdf["segment"].tolist())
        split = bool(pdf["split"].iloc[0])
        count = pdf["count"].to_numpy()
        seg = np.repeat(np.arange(len(pdf)), count)
        off = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
        at = starts[seg] + off
        alone = pdf["n"].to_numpy()[seg] == 1
        doc, size, a = pdf["doc"].to_numpy()[seg], pdf["size"].to_numpy()[seg], pdf["first"].to_numpy()[seg] + off
        hit = again[at] & alone
        # consecutive windows of a unit make one range
        edge = hit & ~np.concatenate([[False], hit[:-1] & (seg[1:] == seg[:-1])])
        stop = hit & ~np.concatenate([hit[1:] & (seg[1:] == seg[:-1]), [False]])
        out = pd.DataFrame({"doc": doc[edge], "size": size[edge], "a": a[edge], "b": a[stop] + LENGTH})
        if split:
            on = ~again[at] | lead[at]
            with np.errstate(over="ignore"):
                h = range_hash(prefix_hash(data.astype(U64) + U64(1), BASE), at[on], at[on] + LENGTH, BASE).view(np.int64)
            passed = {"doc": doc[on], "size": size[on], "a": a[on], "b": a[on] + LENGTH, "window": pd.array(h, dtype="Int64"), "alone": pd.array((alone & ~again[at])[on], dtype="boolean")}
            out = pd.concat([out, pd.DataFrame(passed)])
        return out.reindex(columns=[*DOC, "a", "b", "window", "alone"])

    compared = durable(pieces.groupBy("shard", "cut").applyInPandas(compare, "doc long, size int, a int, b int, window long, alone boolean"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        windows = np.sort(pdf["window"].to_numpy(np.int64))
        ask = pdf[pdf["alone"].astype(bool)]
        w = ask["window"].to_numpy(np.int64)
        held = np.searchsorted(windows, w, "right") - np.searchsorted(windows, w, "left")
        return ask.loc[held > 1, [*DOC, "a", "b"]]

    lots = max(1, -(-compared.where("window is not null").count() // MERGED))  # so that no group grows with the corpus
    across = compared.where("window is not null").groupBy(F.pmod("window", F.lit(lots)).alias("lot")).applyInPandas(merge, "doc long, size int, a int, b int")
    ranges = settled.unionByName(compared.where("window is null").select(*DOC, "a", "b")).unionByName(across)
    # rows of one id and text share their ranges, which are gathered once, however often the row occurs
    return ranges.groupBy(*DOC).agg(F.collect_set(F.struct("a", "b")).alias("ranges"))


def remove_ranges(text: bytes, ranges: list[dict] | None) -> tuple[bytes, int, int]:
    """The text without the ranges, the bytes removed and the maximal removed runs."""
    if not ranges:
        return text, 0, 0
    kept, at, removed, spans, end = [], 0, 0, 0, -1
    for a, b in sorted((r["a"], r["b"]) for r in ranges):
        if a > end:
            spans += 1
        kept.append(text[at:a])
        removed += max(0, b - max(a, at))
        at = end = max(at, b)
    return b"".join([*kept, text[at:]]), removed, spans


def suffix_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    ranges = repeated_ranges(docs, id_col, text_col)
    texts = _keyed(docs, id_col, text_col)
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            out = [remove_ranges(*x) for x in zip(texts, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in out], pa.string())], schema.names)

    return texts.join(ranges.hint("merge"), DOC, "left").select("id", "text", "ranges").mapInArrow(run, schema)
