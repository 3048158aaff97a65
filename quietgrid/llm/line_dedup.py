"""Line deduplication: lines whose key stands in many documents are dropped from every document.

A line's key is the line with ASCII white space stripped at both ends and A-Z made lower case.  Keys are
hashed to 128 bits.  Their document counts are combined on the map side, then summed by a shuffle.  All
distinct hashes go to shards of bounded size; each shard holds a minimal perfect hash that indexes an array
of 64-bit fingerprints and an array of counts.  Documents send the hashes of their lines to the shards and
get back those that are frequent; no lines are joined.

How many probes a shard gets is known from the counts, so a shard that gets many (one that holds a line of
very many documents) is copied to as many salts as it takes for each to see ``PROBES`` hashes or so.  A batch of
documents sends each distinct row once, to salts that also depend on the partition it is read in, so neither a hot
line nor a hot row (equal ids and texts, null ids included) makes a group that grows with the corpus.  A batch sends
one row to each shard and salt it asks, never more than it has lines.

Null and empty texts are one empty line and stay as they are; empty keys never count.  Each row is a
document of its own, repeated rows included; empty tables give empty results; other columns, whatever their
names, pass through ``drop_frequent_lines`` unchanged.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jobs import durable
from .perfect_hash import PerfectHash, build
from .text import texts_of

SHARD_KEYS = 200_000
MOST_SHARDS = 1 << 20  # beyond 2e11 distinct lines shards grow instead, so the table of salts stays at 8 MB
PROBES = 1_000_000  # of a group


SHARD_SCHEMA = "shard int, sizes array<long>, bits binary, prints binary, counts binary, twins binary"
FOUND = "frequent lines found"  # a name that no column of ours has; only its place, the last, is used


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def _digest(line: bytes) -> bytes:
    key = line_key(line)
    return xxhash.xxh3_128_digest(key) if key else b""


def _row_key(id_col: str, text_col: str) -> Column:
    """Equal rows share it, and what holds for one of them holds for the others."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))


def line_document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h1, h2, n): the 128-bit hash of each line key and the number of documents that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for text in texts_of(batch.column(0)):
                seen.update({_digest(x) for x in text.split(b"\n")})
            seen.pop(b"", None)
            h = np.frombuffer(b"".join(seen), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(list(seen.values()), pa.int64())], ["h1", "h2", "n"])

    parts = docs.select(text_col).mapInArrow(count, "h1 long, h2 long, n long")
    return parts.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def build_shards(counts: DataFrame, n_shards: int) -> DataFrame:
    """(shard, sizes, bits, prints, counts, twins): the perfect hash of each shard and its arrays.

    Of keys that share their first 64 bits one is hashed; the others stand in ``twins`` as triples (h1, h2, n).
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        again = pdf["h1"].duplicated()
        twins = pdf.loc[again, ["h1", "h2", "n"]].to_numpy(np.int64).tobytes()
        h1, h2, most = pdf["h1"].to_numpy(np.int64)[~again], pdf["h2"].to_numpy(np.int64)[~again], pdf["n"].to_numpy(np.int64)[~again]
        sizes, bits = build(h1.view(np.uint64))
        at = PerfectHash(sizes, bits).index(h1.view(np.uint64))
        prints, n = np.empty_like(h2), np.empty(len(h2), dtype=np.uint32)
        prints[at], n[at] = h2, np.minimum(most, 2**32 - 1)
        row = {"shard": int(pdf["shard"].iloc[0]), "sizes": sizes, "bits": bits, "prints": prints.tobytes(), "counts": n.tobytes(), "twins": twins}
        return pd.DataFrame({k: [v] for k, v in row.items()})

    sharded = counts.withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("int"))
    return sharded.groupBy("shard").applyInPandas(one, SHARD_SCHEMA)


def _is_frequent(shard: pd.Series, h: np.ndarray, min_docs: int) -> np.ndarray:
    """Which of the hashes (rows of two words) the shard knows in at least ``min_docs`` documents."""
    index = PerfectHash([int(x) for x in shard["sizes"]], shard["bits"])
    prints, n = np.frombuffer(shard["prints"], dtype=np.int64), np.frombuffer(shard["counts"], dtype=np.uint32)
    at = index.index(h[:, 0].copy().view(np.uint64))
    hit = (at >= 0) & (prints[at] == h[:, 1]) & (n[at] >= min_docs)
    for h1, h2, often in np.frombuffer(shard["twins"], dtype=np.int64).reshape(-1, 3):
        if often >= min_docs:
            hit |= (h[:, 0] == h1) & (h[:, 1] == h2)
    return hit


def frequent_lines(docs: DataFrame, min_docs: int, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS, probes: int = PROBES) -> DataFrame:
    """(row_key, found): for each document with frequent lines, the hashes of those lines, one after the other."""
    counts = durable(line_document_counts(docs, text_col))
    n_shards = min(MOST_SHARDS, max(1, -(-counts.count() // shard_keys)))
    loads = counts.groupBy(F.pmod("h1", F.lit(n_shards)).cast("int").alias("shard")).agg(F.sum("n").alias("load")).collect()  # MOST_SHARDS rows at most
    salts = np.ones(n_shards, dtype=np.int64)
    for r in loads:
        salts[r.shard] = -(-r.load // probes)
    cuts = docs.sparkSession.sparkContext.broadcast(salts)
    shards = build_shards(counts, n_shards)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each shard and salt that a batch of documents asks, each distinct document asked for once."""
        here = TaskContext.get().partitionId()
        for batch in batches:
            texts = dict(zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True))
            keys = list(texts)
            digests = [b"".join(sorted({_digest(x) for x in text.split(b"\n")})) for text in texts.values()]
            h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            doc = np.repeat(np.arange(len(keys)), [len(x) // 16 for x in digests])
            of, deal = h[:, 0] % n_shards, np.array([int(k[:15], 16) for k in keys], dtype=np.int64)
            salt = (deal[doc] + here) % cuts.value[of]
            order = np.lexsort((doc, salt, of))
            h, doc, of, salt = h[order], doc[order], of[order], salt[order]
            first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (salt[1:] != salt[:-1])])) if len(of) else np.zeros(0, dtype=np.int64)
            own = [np.unique(x, return_counts=True) for x in np.split(doc, first[1:])] if len(of) else []
            columns = [
                pa.array(of[first], pa.int32()),
                pa.array(salt[first], pa.int32()),
                pa.array([[keys[i] for i in x] for x, _ in own], pa.list_(pa.string())),
                pa.array([n.tolist() for _, n in own], pa.list_(pa.int32())),
                pa.array([x.tobytes() for x in np.split(h, first[1:])] if len(of) else [], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "salt", "row_keys", "sizes", "packed"])

    def copies(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.itertuples(index=False):
                for s in range(int(cuts.value[row.shard])):
                    yield pd.DataFrame([(*row, s)], columns=[*pdf.columns, "salt"])

    def probe(sent: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        keys, found = [], []
        if len(arrays) and len(sent):
            h = np.frombuffer(b"".join(sent["packed"]), dtype=np.int64).reshape(-1, 2)
            hit = _is_frequent(arrays.iloc[0], h, min_docs)
            row_keys, sizes = np.concatenate(sent["row_keys"].to_list()), np.concatenate(sent["sizes"].to_list())
            row = np.repeat(np.arange(len(row_keys)), sizes)[hit]
            rows, first = np.unique(row, return_index=True)
            keys = row_keys[rows]
            found = [x.tobytes() for x in np.split(h[hit], first[1:])] if len(rows) else []
        return pd.DataFrame({"row_key": pd.Series(keys, dtype="object"), "found": pd.Series(found, dtype="object")})

    sent = docs.select(_row_key(id_col, text_col).alias("row_key"), text_col).mapInArrow(send, "shard int, salt int, row_keys array<string>, sizes array<int>, packed binary")
    arrays = shards.mapInPandas(copies, f"{SHARD_SCHEMA}, salt int")
    hits = sent.groupBy("shard", "salt").cogroup(arrays.groupBy("shard", "salt")).applyInPandas(probe, "row_key string, found binary")
    return hits.groupBy("row_key").agg(F.collect_set("found").alias("found"))


def _with_found(docs: DataFrame, min_docs: int, id_col: str, text_col: str, columns: list[str], **how: int) -> DataFrame:
    """The columns, in order, and last the hashes of the row's frequent lines."""
    hits = frequent_lines(docs, min_docs, id_col, text_col, **how).hint("merge")
    rows = docs.select(F.struct(*columns).alias("row"), _row_key(id_col, text_col).alias("row_key"))
    joined = rows.join(hits, "row_key", "left").select(*[F.col("row").getField(c).alias(c) for c in columns], F.col("found").alias(FOUND))
    return joined


def _keep(text: bytes, found: list[bytes] | None) -> tuple[bytes, int, int]:
    """The text without its frequent lines, its number of lines, and how many were dropped."""
    lines = text.split(b"\n")
    if not found:
        return text, len(lines), 0
    gone = {x[i : i + 16] for x in found for i in range(0, len(x), 16)}
    kept = [x for x in lines if _digest(x) not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def line_dedup_report(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) of each row."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_keep(*x) for x in zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[1] for x in kept], pa.int64()), pa.array([x[2] for x in kept], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in kept], pa.string())], [id_col, "n_lines", "n_dropped", "kept_sha256"])

    found = _with_found(docs, min_docs, id_col, text_col, [id_col, text_col], **how)
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, t) for n, t in (("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("kept_sha256", T.StringType())))])
    return found.mapInArrow(report, schema)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows with the frequent lines taken out of the text; ``chars_col``, where it exists, is counted anew."""
    chars_col = chars_col if chars_col in docs.columns else None

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            nulls = batch.column(at).is_null().to_pylist()
            texts = [None if null else _keep(text, found)[0].decode("utf-8", "replace") for text, found, null in zip(texts_of(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist(), nulls, strict=True)]
            arrays = list(batch.columns[:-1])
            arrays[at] = pa.array(texts, pa.string())
            if chars_col:
                k = batch.schema.get_field_index(chars_col)
                arrays[k] = pa.array([n if x is None else len(x) for x, n in zip(texts, arrays[k].to_pylist(), strict=True)], arrays[k].type)
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names[:-1])

    return _with_found(docs, min_docs, id_col, text_col, docs.columns).mapInArrow(drop, docs.schema)
