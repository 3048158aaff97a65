"""Ranked lexical search the other way round: the items are indexed, and the documents stream through the index.

A term is a maximal run of letters, digits and signs outside ASCII, with A-Z in lower case.  The items, a stated query
set, come in blocks of bounded size.  For each block the job reads the documents twice: first it counts, for the
block's terms, the documents that hold them, and the documents and terms in all; then it sends each batch of documents
through the block's inverted index (term to items and how often each holds it), adds up the scores of a few documents
against all items of the block in one array, and keeps for each item a heap of the k best.  A task hands on its heaps
once, at its end; heaps are merged in two steps, first within groups of tasks, then for each item.

A block's index is broadcast: at most ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` of text (one longer item is a block of
its own), whatever the corpus and however many items there are.  It is let go once the block's result is written to
the shared folder, so only one block is held at a time.

A document's score is the sum, over the item's terms with repeats, of w * ((1000000000*tf) div (1000*tf + 8*m)), as
integers of 64 bits: w is floor(1000 * ln((2N+2) / (2df+1))), m is 25 + (75*n*N) div L.  Words are looked up by a hash
of 64 bits and confirmed byte by byte.

Null texts have no terms and count in no statistic; items without terms have no results.  Each row is a document or an
item of its own, repeated rows and null ids included; equal scores go by ascending id, null first, and rows of one id
and one score are interchangeable.  Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jobs import durable
from .text import U64, Words, chunks, texts_of, words

BLOCK_ITEMS = 4_096
BLOCK_BYTES = 8 << 20
CELLS = 1 << 21  # of the array of scores of some documents against all items of a block
HEAP_GROUPS = 32  # groups of tasks whose heaps are merged first

BREAKS = np.ones(256, dtype=bool)  # bytes that part terms
BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


@dataclass
class Index:
    """The inverted index of a block of items: its terms by hash, and the items that hold each, with how often."""

    ids: list
    keys: np.ndarray  # hashes of the terms, ascending
    text: np.ndarray  # the terms' bytes, one after the other
    cuts: np.ndarray  # where each term starts in text, and the end
    posts: np.ndarray  # where each term's items start, and the end
    items: np.ndarray
    often: np.ndarray
    few: np.ndarray  # a first look by 20 bits of the hash

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words of a batch are terms of the block, and which."""
        hashes = w.hashes()
        maybe = np.flatnonzero(self.few[(hashes >> U64(44)).astype(np.int64)])
        if not len(self.keys) or not len(maybe):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        size = w.ends[maybe] - w.starts[maybe]
        same = (self.keys[at] == hashes[maybe]) & (np.diff(self.cuts)[at] == size)
        word, term, size = maybe[same], at[same], size[same]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differs = w.data[np.repeat(w.starts[word], size) + step] != self.text[np.repeat(self.cuts[term], size) + step]
        wrong = np.unique(np.repeat(np.arange(len(word)), size)[differs])
        return np.delete(word, wrong), np.delete(term, wrong)


def build_index(ids: list, texts: list[bytes]) -> Index:
    w = words(texts, BREAKS)
    held = Counter()
    number: dict[bytes, int] = {}
    for row, a, b in zip(w.rows.tolist(), w.starts.tolist(), w.ends.tolist(), strict=True):
        held[number.setdefault(w.data[a:b].tobytes(), len(number)), row] += 1
    hashes = words([b" ".join(number)], BREAKS).hashes() if number else np.zeros(0, dtype=U64)
    order = np.argsort(hashes, kind="stable")
    place = np.argsort(order)
    terms = list(number)
    posts = sorted((int(place[t]), item, n) for (t, item), n in held.items())
    term, items, often = (np.array([x[k] for x in posts], dtype=np.int64) for k in range(3))
    few = np.zeros(1 << 20, dtype=bool)
    few[(hashes >> U64(44)).astype(np.int64)] = True
    sizes = np.array([len(terms[t]) for t in order], dtype=np.int64)
    return Index(
        ids, hashes[order], np.frombuffer(b"".join(terms[t] for t in order), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)]),
        np.searchsorted(term, np.arange(len(terms) + 1)), items, often, few,
    )


def _blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[Index]:
    """The items in blocks of bounded size, read one after the other."""
    ids, texts, total = [], [], 0
    for row in items.select(id_col, text_col).toLocalIterator():
        text = (row[1] or "").encode()
        if ids and (len(ids) >= most or total + len(text) > BLOCK_BYTES):
            yield build_index(ids, texts)
            ids, texts, total = [], [], 0
        ids.append(row[0])
        texts.append(text)
        total += len(text)
    if ids:
        yield build_index(ids, texts)


def _distinct(w: Words, index: Index, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences) of the block's terms in a batch of documents."""
    word, term = index.find(w)
    key, tf = np.unique(w.rows[word] * np.int64(max(len(index.keys), 1)) + term, return_counts=True)
    return key // max(len(index.keys), 1), key % max(len(index.keys), 1), tf


def corpus_statistics(docs: DataFrame, block, n_terms: int, text_col: str) -> tuple[int, int, np.ndarray]:
    """N, L, and the documents that hold each term of the block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, df, filled, all_terms = block.value, np.zeros(n_terms, dtype=np.int64), 0, 0
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in chunks(texts):
                w = words(texts[a:b], BREAKS)
                filled += int(np.count_nonzero(np.diff(w.firsts)))
                all_terms += len(w.starts)
                df += np.bincount(_distinct(w, index, b - a)[1], minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[filled, all_terms], df[some]]))], ["term", "n"])

    found = docs.select(text_col).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a term of the block
    n = {r.term: r.n for r in found}
    return n.get(-2, 0), n.get(-1, 0), np.array([n.get(t, 0) for t in range(n_terms)], dtype=np.int64)


def contributions(w: Words, index: Index, weights: np.ndarray, n_filled: int, n_terms: int, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, w * tf part) of each term of the block that a document holds."""
    doc, term, tf = _distinct(w, index, n_docs)
    m = 25 + 75 * np.diff(w.firsts).astype(np.int64) * n_filled // max(n_terms, 1)
    return doc, term, weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))


def scores(doc: np.ndarray, term: np.ndarray, part: np.ndarray, index: Index, n_docs: int) -> np.ndarray:
    """The scores of some documents against all items of the block."""
    out = np.zeros(n_docs * len(index.ids), dtype=np.int64)
    spread = np.diff(index.posts)[term]
    at = np.repeat(index.posts[term] - np.cumsum(spread) + spread, spread) + np.arange(spread.sum())
    np.add.at(out, np.repeat(doc, spread) * len(index.ids) + index.items[at], np.repeat(part, spread) * index.often[at])
    return out.reshape(n_docs, len(index.ids))


def _best(heap: pa.Table, k: int) -> tuple[pa.Table, np.ndarray]:
    """The k best of each item, in order, and the place of each among its item's."""
    heap = heap.take(pa.compute.sort_indices(heap, [("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
    item = heap["item"].to_numpy()
    first = np.searchsorted(item, item, side="left")
    place = np.arange(len(item)) - first
    return heap.filter(pa.array(place < k)), place[place < k]


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item, rank, id, score) of the k best documents of each item with a score above 0."""
    if k < 1:
        raise ValueError("k is 1 or more")
    spark, id_type, item_type = docs.sparkSession, docs.schema[id_col].dataType, items.schema[item_col].dataType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", id_type), T.StructField("score", T.LongType()), T.StructField("lot", T.IntegerType())])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = [item_col, "rank", id_col, "score"]

    def ranked(index: Index) -> DataFrame:
        block = spark.sparkContext.broadcast(index)
        n_filled, n_terms, df = corpus_statistics(rows, block, len(index.keys), "text")
        weights = spark.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * n_filled + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64))

        def heaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, least, heap = block.value, None, None
            for batch in batches:
                texts = texts_of(batch.column(1))
                for a, b in chunks(texts):
                    w = words(texts[a:b], BREAKS)
                    doc, term, part = contributions(w, own, weights.value, n_filled, n_terms, b - a)
                    step = max(1, CELLS // len(own.ids))
                    for lo in range(0, b - a, step):
                        hi = min(b - a, lo + step)
                        x, y = np.searchsorted(doc, [lo, hi])
                        found = scores(doc[x:y] - lo, term[x:y], part[x:y], own, hi - lo)
                        least = np.ones(len(own.ids), dtype=np.int64) if least is None else least
                        at, item = np.nonzero(found >= least)
                        if not len(at):
                            continue
                        new = pa.table({"item": pa.array(item, pa.int32()), "id": batch.column(0).take(pa.array(a + lo + at)), "score": pa.array(found[at, item])})
                        heap, place = _best(pa.concat_tables([heap, new]) if heap is not None else new, k)
                        full = place == k - 1
                        least[heap["item"].to_numpy()[full]] = heap["score"].to_numpy()[full]
            if heap is not None:
                lot = pa.array(np.full(len(heap), TaskContext.get().partitionId() % HEAP_GROUPS), pa.int32())
                yield from heap.append_column("lot", lot).combine_chunks().to_batches()

        some = rows.mapInArrow(heaps, schema)
        for keys in (["item", "lot"], ["item"]):
            some = some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("id")))).where(F.col("rank") <= k)
        named = spark.createDataFrame(list(enumerate(index.ids)), T.StructType([schema["item"], T.StructField("named", item_type)]))
        out = durable(some.join(F.broadcast(named), "item").select(F.col("named").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
        block.destroy()
        weights.destroy()
        return out

    parts = [ranked(x) for x in _blocks(items, item_col, item_text, block_items)]
    empty = T.StructType([T.StructField(n, t) for n, t in zip(names, (item_type, T.IntegerType(), id_type, T.LongType()), strict=True)])
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], empty)
