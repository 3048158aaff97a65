"""SimHash near-duplicates: fingerprints of word shingles, linked by exact comparison of tiles.

A fingerprint bit is 1 where more than half of the shingles' hashes have it set.  Distinct fingerprints
are put into cells by the population counts of their parts (and by a band of the document's size where a
least similarity is asked for: documents whose sizes differ by more cannot reach it).  Two fingerprints
within the radius have part counts that differ by no more than the radius in all, so pairs of cells
further apart are skipped.  Cells are cut into tiles of bounded size; each pair of tiles that is left is
compared in full with numpy exclusive-or and bit counts.  A task passes on a spanning forest of the links
it found, which joins the same fingerprints without emitting every pair of a large group.

Null and empty texts have the zero fingerprint and are linked like any other; a text with fewer words
than a shingle is one shingle.  Rows with the same fingerprint share a component.  Ids may be of any type
that has an order, may repeat and may be null; empty tables give empty results, and other columns, whatever
their names, are not read.  A text is hashed as a whole, in memory that is proportional to its length.

For near copies (``drop_near_duplicates``) the same tiles find candidates, whose shingle sets are then
compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import components, durable, spread_join
from .text import U64, chunks, mix, prefix_hash, range_hash, texts_of, words

TILE = 4096
BLOCK = 256
TILE_SHINGLES = 1 << 21  # of the texts of a tile, about
SIZE_STEP = 1.25  # sizes of two documents at a similarity of 0.8 differ by this factor at most


def majority(hashes: np.ndarray) -> np.ndarray:
    """The majority of each bit over the rows of an (n, k) array of 64-bit hashes, as k words."""
    ones = np.zeros(64 * hashes.shape[1], dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[i : i + (1 << 14)])
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(U64)


def xxh64_fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit fingerprint by XXH64 with seed 42 over the shingles' UTF-8, words joined by one space."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    n = min(shingle, len(found))
    starts = np.concatenate([[0], ends[: len(found) - n] + 1]).tolist()
    h64 = xxhash.xxh64_intdigest
    hashes = np.array([h64(joined[a:b], 42) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)], dtype=U64)
    return int(majority(hashes[:, None])[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of each row as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([xxh64_fingerprint(x, shingle) for x in texts_of(batch.column(1))], dtype=U64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def shingle_sets(texts: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """The distinct shingles' hashes of each text, sorted; a text with fewer words is one shingle, one without words none."""
    for a, b in chunks(texts):
        w = words(texts[a:b])
        h = w.hashes()
        at, grams = w.grams(h, shingle)
        first = np.searchsorted(w.rows[at] if len(at) else np.zeros(0, dtype=np.int64), np.arange(b - a + 1))
        whole = prefix_hash(h, 0xD6E8FEB86659FD93)
        for r in range(b - a):
            i, j = w.firsts[r], w.firsts[r + 1]
            yield np.unique(grams[first[r] : first[r + 1]] if j - i >= shingle else range_hash(whole, np.array([i]), np.array([j]), 0xD6E8FEB86659FD93) if j > i else grams[:0])


def set_key(own: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets of shingles apart."""
    with np.errstate(over="ignore"):
        sums = np.array([mix(own, seed).sum(dtype=U64) + U64(len(own)) for seed in (31, 33)])
        return tuple(mix(sums, 32).view(np.int64).tolist())


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, n_words: int = 4) -> DataFrame:
    """(id, text_key, fp, size, k1, k2) of each row.

    The 128-bit key of its text, a fingerprint of ``n_words`` x 64 bits over its distinct shingles as binary,
    their number, and the key of their set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, keys = [], [], []
            for own in shingle_sets(texts_of(batch.column(2)), shingle):
                sizes.append(len(own))
                keys.append(set_key(own))
                fps.append(majority(np.stack([mix(own, 11 + k) for k in range(n_words)], axis=1)).tobytes() if len(own) else bytes(8 * n_words))
            k1, k2 = (pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))
            arrays = [batch.column(0), batch.column(1), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), k1, k2]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "text_key", "fp", "size", "k1", "k2"])

    keyed = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return keyed.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, text_key binary, fp binary, size long, k1 long, k2 long")


def text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))


def _deal(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links (a[i], b[i])."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _close(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs within the radius, block by block."""
    xs, ys = [], []
    for i in range(0, len(left), BLOCK):
        part = left[i : i + BLOCK]
        apart = np.bitwise_count(part[:, None, 0] ^ right[None, :, 0]).astype(np.uint16)
        for k in range(1, left.shape[1]):
            apart += np.bitwise_count(part[:, None, k] ^ right[None, :, k])
        x, y = np.nonzero(apart <= radius)
        xs.append(x + i)
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


def _tile_pairs(nodes: DataFrame, radius: int, n_words: int, parts: int, step: int, by_size: bool, tile: int) -> DataFrame:
    """(c1, u1, c2, u2, n1, f1, s1, n2, f2, s2): the pairs of tiles that can hold links."""
    whole = 64 * n_words
    each = whole // parts
    base = each // step + 1

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, whole // 8)
            counts = np.unpackbits(fps, axis=1).reshape(len(fps), parts, each).sum(axis=2, dtype=np.int64) // step
            sizes = np.maximum(np.array(batch.column(2).to_pylist(), dtype=np.float64), 1)
            key = (np.floor(np.log(sizes) / np.log(SIZE_STEP) + 1e-9) if by_size else np.zeros(len(sizes))).astype(np.int64)
            for k in range(parts):
                key = key * base + counts[:, k]
            deal = mix(np.array(batch.column(0).to_pylist(), dtype=np.int64).view(U64), 3).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key), pa.array(deal)], ["node", "fp", "size", "cell", "deal"])

    placed = nodes.select("node", "fp", "size").mapInArrow(cells, "node long, fp binary, size long, cell long, deal long")
    held = durable(placed.groupBy("cell").agg(F.ceil(F.greatest(F.count("*") / F.lit(tile // 2), F.sum("size") / F.lit(TILE_SHINGLES))).cast("int").alias("cuts")))
    dealt = spread_join(placed, held, ["cell"], "deal").withColumn("cut", F.pmod("deal", "cuts").cast("int"))
    tiles = dealt.groupBy("cell", "cut").agg(F.collect_list(F.struct("node", "fp", "size")).alias("t"))
    tiles = durable(tiles.select("cell", "cut", F.transform("t", lambda x: x.node).alias("n"), F.transform("t", lambda x: x.fp).alias("f"), F.transform("t", lambda x: x.size).alias("s")))

    # the cells that can hold a partner: population counts apart by the radius at most, size bands by one;
    # of each two cells the one with the smaller key looks for the other
    far = -(-radius // step)
    moves = set()
    for move in product((-1, 0, 1) if by_size else (0,), *[range(-far, far + 1)] * parts):
        if sum(max(0, (abs(x) - 1) * step + 1) for x in move[1:]) <= radius:
            key = 0
            for x in move:
                key = key * base + x
            if key >= 0:
                moves.add(key)
    near = held.withColumn("move", F.explode(F.array(*[F.lit(x).cast("long") for x in sorted(moves)])))
    near = near.select(F.col("cell").alias("c1"), F.col("cuts").alias("k1"), (F.col("cell") + F.col("move")).alias("c2"))
    near = near.join(held.select(F.col("cell").alias("c2"), F.col("cuts").alias("k2")).hint("shuffle_hash"), "c2")
    cut = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    near = near.withColumn("u1", cut("k1")).withColumn("u2", cut("k2")).where("c1 < c2 or u1 <= u2").select("c1", "u1", "c2", "u2")
    side = lambda i: tiles.select(F.col("cell").alias(f"c{i}"), F.col("cut").alias(f"u{i}"), F.col("n").alias(f"n{i}"), F.col("f").alias(f"f{i}"), F.col("s").alias(f"s{i}")).hint("shuffle_hash")
    return near.join(side(1), ["c1", "u1"]).join(side(2), ["c2", "u2"]).select("c1", "u1", "c2", "u2", "n1", "f1", "s1", "n2", "f2", "s2")


def fingerprint_links(nodes: DataFrame, radius: int, n_words: int = 1, parts: int = 4, step: int = 1, tile: int = TILE) -> DataFrame:
    """(a, b): links that join the same nodes as all pairs of fingerprints within the radius do.

    ``nodes``: (node long, fp binary, size long), durable.  A cell is the population counts of ``parts``
    parts of the fingerprint, in steps of ``step``.
    """
    pairs = _tile_pairs(nodes, radius, n_words, parts, step, False, tile).select("n1", "f1", "n2", "f2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            col = [batch.column(k) for k in range(4)]
            for i in range(batch.num_rows):
                n1, n2 = (col[k].slice(i, 1).flatten().to_numpy() for k in (0, 2))
                f1, f2 = (np.frombuffer(b"".join(col[k][i].as_py()), dtype=U64).reshape(-1, n_words) for k in (1, 3))
                x, y = _close(f1, f2, radius)
                apart = n1[x] != n2[y]
                xs.append(n1[x[apart]])
                ys.append(n2[y[apart]])
                if sum(map(len, xs)) > 1 << 20:
                    kept = np.array(_forest(np.concatenate(xs), np.concatenate(ys)), dtype=np.int64).reshape(-1, 2)
                    xs, ys = [kept[:, 0]], [kept[:, 1]]
            kept = np.array(_forest(np.concatenate(xs), np.concatenate(ys)), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def _near(n1: np.ndarray, f1: np.ndarray, s1: np.ndarray, n2: np.ndarray, f2: np.ndarray, s2: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the candidates: fingerprints within the radius, sizes that allow a similarity of 0.8; some rows at a time."""
    for i in range(0, len(n1), BLOCK):
        x, y = _close(f1[i : i + BLOCK], f2, radius)
        x += i
        fits = (4 * np.maximum(s1[x], s2[y]) <= 5 * np.minimum(s1[x], s2[y])) & (n1[x] != n2[y])
        yield x[fits], y[fits]


@dataclass
class _Side:
    """The nodes of a tile with their fingerprints, sizes and shingle sets, the sets one after the other."""

    nodes: np.ndarray
    fps: np.ndarray
    sizes: np.ndarray
    grams: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(held: dict[int, tuple[bytes, int, np.ndarray]], n_words: int) -> _Side:
        fps = np.frombuffer(b"".join(v[0] for v in held.values()), dtype=U64).reshape(-1, n_words)
        sizes = np.array([len(v[2]) for v in held.values()], dtype=np.int64)
        grams = np.concatenate([v[2] for v in held.values()]) if held else np.zeros(0, dtype=U64)
        return _Side(np.array(list(held), dtype=np.int64), fps, sizes, grams, np.cumsum(sizes) - sizes)


def _verified(left: _Side, right: _Side, radius: int) -> tuple[list[int], list[int]]:
    """Links of exact similarity 0.8 or more between two tiles.

    A row of the left tile meets all its candidates at once: the shared shingles are counted by marking the
    row's shingles and adding up the marks under each candidate.  Candidates that links found before have
    joined to the row are left out; they add nothing to the groups.
    """
    all_nodes, back = np.unique(np.concatenate([left.nodes, right.nodes]), return_inverse=True)
    i1, i2 = back[: len(left.nodes)], back[len(left.nodes) :]
    _, number = np.unique(np.concatenate([left.grams, right.grams]), return_inverse=True)
    own, other = number[: len(left.grams)], number[len(left.grams) :]
    marked = np.zeros(int(number.max(initial=-1)) + 1, dtype=np.int64)
    group = np.arange(len(all_nodes))
    a, b = [], []
    for xs, ys in _near(left.nodes, left.fps, left.sizes, right.nodes, right.fps, right.sizes, radius):
        rows, first = np.unique(xs, return_index=True)
        for x, y in zip(rows.tolist(), np.split(ys, first[1:]), strict=True):
            y = y[group[i2[y]] != group[i1[x]]]
            if not len(y):
                continue
            mine = own[left.starts[x] : left.starts[x] + left.sizes[x]]
            marked[mine] = 1
            if 4 * right.sizes[y].sum() < len(other):
                both = np.array([marked[other[s : s + n]].sum() for s, n in zip(right.starts[y].tolist(), right.sizes[y].tolist(), strict=True)])
            else:
                both = np.add.reduceat(marked[other], right.starts)[y]
            marked[mine] = 0
            y = y[5 * both >= 4 * (left.sizes[x] + right.sizes[y] - both)]
            joined, at = np.unique(group[i2[y]], return_index=True)
            if len(joined):
                a += [int(left.nodes[x])] * len(at)
                b += right.nodes[y[at]].tolist()
                group[np.isin(group, np.append(joined, group[i1[x]]))] = group[i1[x]]
    return a, b


def similar_links(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], radius: int, n_words: int, tile: int = TILE) -> DataFrame:
    """(a, b): links that join the same nodes as all candidates with a Jaccard similarity of 0.8 or more do.

    ``sets`` gives (node, grams) of some nodes.  A pair of tiles names its nodes that have a candidate, never
    the pairs; their sets are joined to it, and it compares its candidates exactly, but for those that
    links found before have joined.
    """
    keys = ["c1", "u1", "c2", "u2"]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = [batch.column(k) for k in range(10)]
            for i in range(batch.num_rows):
                n1, s1, n2, s2 = (col[k].slice(i, 1).flatten().to_numpy() for k in (4, 6, 7, 9))
                b1, b2 = (col[k][i].as_py() for k in (5, 8))
                f1, f2 = (np.frombuffer(b"".join(b), dtype=U64).reshape(-1, n_words) for b in (b1, b2))
                has1, has2 = np.zeros(len(n1), dtype=bool), np.zeros(len(n2), dtype=bool)
                for x, y in _near(n1, f1, s1, n2, f2, s2, radius):
                    has1[x] = has2[y] = True
                for side, n, f, s, has in ((1, n1, b1, s1, has1), (2, n2, b2, s2, has2)):
                    at = np.flatnonzero(has)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([*(pa.array([col[k][i].as_py()] * len(at), col[k].type) for k in range(4)), pa.array([side] * len(at), pa.int32()), pa.array(n[at]), pa.array([f[j] for j in at], pa.binary()), pa.array(s[at])], [*keys, "side", "node", "fp", "size"])

    def verify(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, dict[int, tuple[bytes, int, np.ndarray]]] = {1: {}, 2: {}}
        for batch in batches:
            for side, node, fp, size, grams in zip(*(batch.column(c).to_pylist() for c in ("side", "node", "fp", "size", "grams")), strict=True):
                got[side][node] = fp, size, np.frombuffer(grams, dtype=U64)
        left, right = (_Side.of(g, n_words) for g in (got[1], got[2]))
        a, b = _verified(left, right, radius)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    pairs = _tile_pairs(nodes, radius, n_words, 1, radius + 1, True, tile)
    named = durable(pairs.mapInArrow(name, "c1 long, u1 int, c2 long, u2 int, side int, node long, fp binary, size long"))
    held = named.join(sets(named.select("node").distinct()).hint("merge"), "node")
    return held.groupBy(*keys).applyInArrow(verify, "a long, b long")


def simhash_components(docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hexadecimal digits, component_id) of each row.

    The component is the smallest id that links reach, null if none of those rows has an id.
    """
    fps = durable(fingerprints(docs, id_col, text_col, shingle))
    nodes = durable(fps.groupBy("fp").agg(F.min("id").alias("id")).withColumn("node", F.monotonically_increasing_id()))
    bits = nodes.select("node", F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp"), F.lit(0).cast("long").alias("size"))
    of = _least_ids(nodes, components(fingerprint_links(bits, radius))).select("fp", F.col("least").alias("component_id"))
    out = spread_join(fps.withColumn("deal", _deal("id")), of, ["fp"], "deal")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _least_ids(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes with ``least``: the smallest id of their component."""
    of = durable(nodes.join(found.hint("shuffle_hash"), "node", "left").withColumn("component", F.coalesce("component", "node")))
    return spread_join(of, of.groupBy("component").agg(F.min("id").alias("least")), ["component"], "node")


RADIUS = 64


def near_duplicate_rows(docs: DataFrame, radius: int = RADIUS, shingle: int = 5, n_words: int = 4, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """(id, text_key, keeper): for each row the smallest id of its group of near copies, itself included.

    Links are pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.  Fingerprints
    only find candidates: at 0.8 about 39 of 256 bits differ (deviation 6; about 48 in texts of five
    shingles), in unrelated texts 128 (deviation 8).  Rows without an id link texts but are no keepers.
    """
    fps = durable(wide_fingerprints(docs, id_col, text_col, shingle, n_words))
    some = fps.where("size > 0").groupBy("k1", "k2")
    one = F.min(F.struct(_deal("id").alias("deal"), "text_key")).alias("one")  # a row that holds the text
    nodes = some.agg(F.min("id").alias("id"), one, F.first("fp").alias("fp"), F.first("size").alias("size"))
    nodes = durable(nodes.select("k1", "k2", "id", "one.*", "fp", "size").withColumn("node", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                own = next(shingle_sets([text], shingle))
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["node", "grams"])

    def sets(wanted: DataFrame) -> DataFrame:
        held = nodes.join(wanted.hint("merge"), "node", "left_semi").select("node", "deal", "text_key")
        texts = docs.select(_deal(id_col).alias("deal"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
        texts = texts.join(held.hint("merge"), ["deal", "text_key"]).groupBy("node").agg(F.first("text").alias("text"))
        return texts.mapInArrow(run, "node long, grams binary")

    of = _least_ids(nodes, components(similar_links(nodes, sets, radius, n_words, tile)))
    rows = fps.select("id", "text_key", "k1", "k2", _deal("id").alias("deal")).where("size > 0")
    return spread_join(rows, of.select("k1", "k2", F.col("least").alias("keeper")), ["k1", "k2"], "deal").select("id", "text_key", "keeper")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id.

    Rows without an id and texts without words (null, empty, white space) stay.  Ids may repeat: rows of one
    id and different texts are different documents, rows of one id and one text stay or go together.
    """
    rows = near_duplicate_rows(docs, id_col=id_col, text_col=text_col, **how)
    gone = rows.where("id != keeper").select(F.col("id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct().hint("merge")
    same = (docs[id_col] == gone["_gone_id"]) & (text_key(text_col) == gone["_gone_key"])
    return docs.join(gone, same, "left_anti")
