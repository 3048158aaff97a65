"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters, digits and non-ASCII bytes of the text in lower case, so case, punctuation and
line breaks do not hide a passage.  Documents and benchmark items are joined on the hashes of ``seed``
consecutive tokens.  A pair whose shared seeds cover too few of the item's tokens cannot reach the
threshold and is left; for the others greedy string tiling marks the longest common runs of unmarked
tokens, longest first, found by running Karp-Rabin hashes of shrinking length and confirmed token by
token.  Tiles may stand in any order, so reordered passages are caught.  Coverage is the share of the
item's tokens under tiles of ``seed`` tokens or more.

The benchmark is a stated query set: its seeds are looked up in blocks of bounded size, each against all
documents, so a benchmark of any size takes as many passes as it has blocks.

Null and empty texts and items match nothing.  An item of fewer than ``seed`` tokens matches the documents
that are nothing but it.  Signs of punctuation outside ASCII part tokens, and a Chinese, Japanese or Korean
sign is a token of its own.  Repeated items are reported each, repeated documents too; ids may be of any type.
Empty tables give empty results; ``drop_contaminated`` passes all columns on, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .text import U64, chunks, prefix_hash, range_hash, words

SEED_TOKENS = 5
COVERAGE = 0.7
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 32 << 20

BREAKS = np.ones(256, dtype=bool)
BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
RUN_BASE = 0xA24BAED4963EE407


def tile(item: np.ndarray, doc: np.ndarray, least: int = SEED_TOKENS) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, length) of two token arrays, longest first.

    Ties go to the earliest start in the item, then in the document.
    """
    free_i, free_d = np.ones(len(item), dtype=bool), np.ones(len(doc), dtype=bool)
    sums_i, sums_d = prefix_hash(item, RUN_BASE), prefix_hash(doc, RUN_BASE)
    tiles, length = [], min(len(item), len(doc))

    def runs(free: np.ndarray, n: int) -> np.ndarray:
        taken = np.concatenate([[0], np.cumsum(~free)])
        return np.flatnonzero(taken[n:] == taken[:-n]) if len(free) >= n else np.zeros(0, dtype=np.int64)

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at_i, at_d = runs(free_i, n), runs(free_d, n)
        h_i, h_d = (range_hash(s, at, at + n, RUN_BASE) for s, at in ((sums_i, at_i), (sums_d, at_d)))
        return at_i, h_i, at_d, h_d

    while length >= least:
        # the longest length with a common run of free tokens: if n has one, so has every smaller length
        low, high = least - 1, length
        while low < high:
            n = (low + high + 1) // 2
            _, h_i, _, h_d = common(n)
            low, high = (n, high) if np.isin(h_i, h_d).any() else (low, n - 1)
        length = low
        if length < least:
            break
        at_i, h_i, at_d, h_d = common(length)
        order = np.argsort(h_d, kind="stable")
        h_d, at_d = h_d[order], at_d[order]
        before = len(tiles)
        for p, h in zip(at_i.tolist(), h_i, strict=True):
            if not free_i[p : p + length].all():
                continue
            for q in at_d[np.searchsorted(h_d, h, "left") : np.searchsorted(h_d, h, "right")].tolist():
                if free_d[q : q + length].all() and np.array_equal(item[p : p + length], doc[q : q + length]):
                    free_i[p : p + length] = free_d[q : q + length] = False
                    tiles.append((p, q, length))
                    break
        if len(tiles) == before:
            length -= 1
    return tiles


PARTING = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
SINGLE = re.compile("([\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af])")


def lowered(text: str | None) -> bytes:
    """The text in lower case, with spaces where signs outside ASCII part tokens."""
    text = (text or "").lower()
    if not text.isascii():
        text = SINGLE.sub(r" \1 ", PARTING.sub(" ", text))
    return text.encode()


def _lower(column: pa.Array) -> list[bytes]:
    return [lowered(x) for x in column.to_pylist()]


class Seeds:
    """The seeds of some benchmark items, sorted by hash."""

    def __init__(self, ids: list, texts: list[bytes], least: int):
        w = words(texts, BREAKS)
        h = w.hashes()
        at, grams = w.grams(h, least)
        order = np.argsort(grams, kind="stable")
        self.ids = ids
        self.items = [h[a:b] for a, b in zip(w.firsts[:-1], w.firsts[1:], strict=True)]
        self.grams, self.item = grams[order], w.rows[at][order]
        self.place = (at - w.firsts[w.rows[at]])[order]
        self.short: dict[bytes, list[int]] = {}  # items too short for a seed, by all of their tokens
        for i, own in enumerate(self.items):
            if 0 < len(own) < least:
                self.short.setdefault(own.tobytes(), []).append(i)
        self.few = np.zeros(1 << 20, dtype=bool)  # a first look by 20 bits of the hash
        self.few[(self.grams >> U64(44)).astype(np.int64)] = True

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Which of the hashes are seeds."""
        maybe = np.flatnonzero(self.few[(grams >> U64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.grams, grams[maybe]), max(len(self.grams) - 1, 0))
        return maybe[self.grams[at] == grams[maybe]] if len(self.grams) else maybe[:0]


def _near(tokens: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """The tokens under the seeds that start at ``at``; a sign of no item stands where others were left out.

    A tile is made of shared seeds, so no tile is lost or joined to another.
    """
    place = np.unique((at[:, None] + np.arange(least)).ravel())
    cuts = np.flatnonzero(np.diff(place) > 1) + 1
    return np.insert(tokens[place], cuts, U64(0))


def _pairs(texts: list[bytes], seeds: Seeds, least: int, coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, item tokens, covered tokens, tiles) of the pairs at the coverage or above."""
    for a, b in chunks(texts):
        w = words(texts[a:b], BREAKS)
        h = w.hashes()
        at, grams = w.grams(h, least)
        hits = seeds.of(grams)
        if seeds.short:
            for r in np.flatnonzero((np.diff(w.firsts) > 0) & (np.diff(w.firsts) < least)).tolist():
                own = h[w.firsts[r] : w.firsts[r + 1]]
                for i in seeds.short.get(own.tobytes(), ()):
                    yield a + r, i, len(own), len(own), 1
        for r in np.unique(w.rows[at[hits]]).tolist():
            mine = hits[np.searchsorted(w.rows[at[hits]], r, "left") : np.searchsorted(w.rows[at[hits]], r, "right")]
            own = np.unique(grams[mine])
            left, right = np.searchsorted(seeds.grams, own, "left"), np.searchsorted(seeds.grams, own, "right")
            found = np.concatenate([np.arange(x, y) for x, y in zip(left, right, strict=True)])
            for i in np.unique(seeds.item[found]).tolist():
                item = seeds.items[i]
                shared = np.zeros(len(item) + least, dtype=bool)
                for k in range(least):
                    shared[seeds.place[found[seeds.item[found] == i]] + k] = True
                if shared.sum() < coverage * len(item):
                    continue
                tiles = tile(item, _near(h, at[mine[np.isin(grams[mine], seeds.grams[found[seeds.item[found] == i]])]], least), least)
                covered = sum(x[2] for x in tiles)
                if covered >= coverage * len(item):
                    yield a + r, i, len(item), covered, len(tiles)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, least: int) -> Iterator[Seeds]:
    """The benchmark, a stated query set, in blocks of bounded size; a block is broadcast until its result is made."""
    ids, texts, total = [], [], 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        ids.append(row[0])
        texts.append(lowered(row[1]))
        total += len(texts[-1])
        if len(ids) >= BLOCK_ITEMS or total >= BLOCK_BYTES:
            yield Seeds(ids, texts, least)
            ids, texts, total = [], [], 0
    if ids:
        yield Seeds(ids, texts, least)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, least: int = SEED_TOKENS, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, item_tokens, covered_tokens, n_tiles, coverage) of each document and item at the coverage or above."""
    schema = T.StructType([docs.schema[id_col], benchmark.schema[item_col], *(T.StructField(n, T.LongType()) for n in ("item_tokens", "covered_tokens", "n_tiles"))])
    kind = to_arrow_type(benchmark.schema[item_col].dataType)

    def against(seeds: Seeds) -> DataFrame:
        block = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(_pairs(_lower(batch.column(1)), block.value, least, coverage))
                rows = pa.array([x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([block.value.ids[x[1]] for x in found], kind), *(pa.array([x[k] for x in found], pa.int64()) for k in (2, 3, 4))], schema.names)

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    parts = [against(x) for x in _blocks(benchmark, item_col, item_text, least)]
    out = reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], schema)
    return out.withColumn("coverage", F.col("covered_tokens") / F.col("item_tokens"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = SEED_TOKENS, coverage: float = COVERAGE, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that hold no benchmark item at the coverage or above."""
    for seeds in _blocks(benchmark, item_col, item_text, least):
        block = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = {x[0] for x in _pairs(_lower(batch.column(batch.schema.get_field_index(text_col))), block.value, least, coverage)}
                yield batch.filter(pa.array([i not in found for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
