"""Encoding of texts to the pieces of a compiled model, each with its byte span in the original text, and decoding.

A text is normalised through the model's compiled character map: at each place the longest key that the map's
double-array trie holds is replaced, and every byte of the result remembers the original byte it came from.
White space becomes the piece mark.  The result falls into chunks at each mark that follows another sign; no piece
crosses such a place, so chunks are merged one by one, best score first and the leftmost of equals, and remembered.
A sign that no piece holds is spelled in byte pieces.  The lengths of the pieces, summed up, are places of the
normalised text, which the alignment projects to the original bytes: [start, end) of each piece.

Models are byte-pair models with byte fallback and without user-defined or unused pieces; others are refused.  Their
file is a parameter, read by the driver and sent to the workers (half a megabyte, whatever the corpus).

Null and empty texts have the begin and end ids alone and decode to an empty text.  Texts of any length are whole; one
text is one task's work.  Rows are independent: repeated rows are encoded each, there are no ties, empty tables give
empty results, and columns of any name pass through ``encode`` (the new ones must be new).
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import chunks, texts_of

# The mark of white space, the numbers of the fields and kinds of a model file
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3

CHUNK_BYTES = 4 << 20  # of texts in one batch of results
REMEMBERED = 200_000  # chunks whose pieces a worker remembers, and as many before them
LONGEST = 64  # signs of a remembered chunk
NO_PIECE = float("inf")

codecs.register_error("a sign a byte", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message in wire format."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 2: -1, 5: 4}[key & 7]
            size = number() if size < 0 else size
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 keys, and the texts that replace them."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4 if blob else 0).tolist()
        self.texts = blob[4 + size :]
        self.starts = np.zeros(256, dtype=bool)  # first bytes of keys
        if self.units:
            root = self._next(0)
            self.starts[[b for b in range(1, 256) if root ^ b < len(self.units) and self.units[root ^ b] & 0x800000FF == b]] = True

    def _next(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """The length of the longest key at a place, and the text that replaces it."""
        node, found = self._next(0), None
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(self.units) or self.units[node] & 0x800000FF != text[k]:
                break
            leaf = self.units[node] >> 8 & 1
            node = self._next(node)
            if leaf:
                found = k + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Model:
    """A model file's pieces and rules."""

    def __init__(self, data: bytes):
        pieces, trainer, rules = [], {}, {}
        for number, value in _fields(data):
            if number == PIECES:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif number == TRAINER:
                trainer = dict(_fields(value))
            elif number == NORMALIZER:
                rules = dict(_fields(value))
        kinds = np.array([kind for _, _, kind in pieces])
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or np.isin(kinds, (USER, UNUSED)).any():
            raise ValueError("only byte-pair models with byte fallback and without user-defined or unused pieces are read")
        self.ids = {piece: k for k, (piece, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.values = {piece: -score for piece, score, kind in pieces if kind == NORMAL}  # the least is joined first
        self.bytes = {int(piece[3:5], 16): k for k, (piece, _, kind) in enumerate(pieces) if kind == BYTE}
        named = {piece: k for k, (piece, _, kind) in enumerate(pieces) if kind == CONTROL}
        self.bos, self.eos = named["<s>"], named["</s>"]
        self.surfaces = [self._surface(*x, trainer.get(44, " ⁇ ".encode())) for x in pieces]
        self.normal = kinds == NORMAL
        self.map = CharacterMap(rules.get(2, b""))
        self.dummy, self.squeeze, self.escape, self.suffix = (bool(x) for x in (rules.get(3, 1), rules.get(4, 1), rules.get(5, 1), trainer.get(24, 0)))
        mark = MARK if self.escape else " "
        apart = not any(re.search(f"[^{mark}]{mark}", piece) for piece in self.ids)
        self.chunks = re.compile(f"{mark}*[^{mark}]+|{mark}+" if apart else "(?s:.+)")
        self.packed = {piece: struct.pack("<I", k) for piece, k in self.ids.items()}
        self.spelled = {byte: struct.pack("<I", k) for byte, k in self.bytes.items()}
        self.widths = np.array([len(piece.encode()) if kind == NORMAL else 0 for piece, _, kind in pieces], dtype=np.int64)
        self.byte_of = np.zeros(len(pieces), dtype=np.uint8)
        self.byte_of[list(self.bytes.values())] = list(self.bytes)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _surface(piece: str, score: float, kind: int, unknown: bytes) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return {CONTROL: b"", UNKNOWN: unknown}.get(kind, piece.replace(MARK, " ").encode())

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the original place.

        The bytes of an unchanged sign share the place of its first byte, those of a replacement that of its key.
        """
        data = np.frombuffer(text, dtype=np.uint8)
        place = np.arange(len(data))
        place = np.maximum.accumulate(np.where(data & 0xC0 != 0x80, place, 0)) if len(data) else place
        inner = np.zeros(len(data), dtype=bool)  # of a replacement, after a byte that is not a space
        if self.map.units:
            data, place, inner = self._replaced(text, data, place, inner)
        end = len(text)
        if self.squeeze:
            space = data == 0x20
            kept = ~space | inner | ~np.concatenate([[True], space[:-1]])[: len(data)]
            data, place = data[kept], place[kept]
            solid = np.flatnonzero(data != 0x20)
            last = int(solid[-1]) + 1 if len(solid) else 0
            end = int(place[last]) if last < len(data) else end
            data, place = data[:last], place[:last]
        if not len(data):
            return b"", np.array([end])
        mark = [0x20] if self.dummy else []
        first = place[:1] if self.dummy else place[:0]
        if self.suffix:
            data, place = np.concatenate([data, mark]).astype(np.uint8), np.concatenate([place, [end] * len(mark)])
        else:
            data, place = np.concatenate([mark, data]).astype(np.uint8), np.concatenate([first, place])
        if self.escape:
            place = np.repeat(place, np.where(data == 0x20, len(MARK.encode()), 1))
            return data.tobytes().replace(b" ", MARK.encode()), np.append(place, end)
        return data.tobytes(), np.append(place, end)

    def _replaced(self, text: bytes, data: np.ndarray, place: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, places and inner bytes after the longest keys are replaced, from left to right."""
        parts, at = [], 0
        for k in np.flatnonzero(self.map.starts[data] & (place == np.arange(len(data)))).tolist():
            found = self.map.longest(text, k) if k >= at else None
            if found:
                new = np.frombuffer(found[1], dtype=np.uint8)
                seen = np.maximum.accumulate(new != 0x20) if len(new) else new.astype(bool)
                parts += [(data[at:k], place[at:k], inner[at:k]), (new, np.full(len(new), k), seen)]
                at = k + found[0]
        parts.append((data[at:], place[at:], inner[at:]))
        return tuple(np.concatenate([x[k] for x in parts]) for k in range(3))

    def _merged(self, chunk: str) -> list[str]:
        """The chunk in pieces: the adjacent pair with the best score is joined first, the leftmost of equals."""
        if len(chunk) <= LONGEST:
            return self._merged_short(chunk)
        part, after, before = list(chunk), list(range(1, len(chunk) + 1)), list(range(-1, len(chunk) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < len(part):
                both = part[left] + part[right]
                if both in self.ids:
                    heapq.heappush(heap, (self.values[both], left, right, both))

        for k in range(len(part) - 1):
            offer(k, k + 1)
        while heap:
            _, left, right, both = heapq.heappop(heap)
            if part[left] and part[right] and after[left] == right and part[left] + part[right] == both:
                part[left], part[right] = both, ""
                after[left] = after[right]
                if after[left] < len(part):
                    before[after[left]] = left
                offer(before[left], left)
                offer(left, after[left])
        return [x for x in part if x]

    def _merged_short(self, chunk: str) -> list[str]:
        """The same by a look at all pairs in each step, which is quicker where they are few."""
        part, value = list(chunk), self.values.get
        values = [value(a + b, NO_PIECE) for a, b in zip(part, part[1:], strict=False)]
        while values and (best := min(values)) < NO_PIECE:
            k = values.index(best)
            part[k] += part.pop(k + 1)
            del values[k]
            if k < len(values):
                values[k] = value(part[k] + part[k + 1], NO_PIECE)
            if k:
                values[k - 1] = value(part[k - 1] + part[k], NO_PIECE)
        return part

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a chunk's pieces as packed numbers; a sign of no piece is spelled in bytes."""
        packed = self.packed
        return b"".join([packed.get(x) or b"".join([self.spelled[c] for c in x.encode()]) for x in self._merged(chunk)])

    def _sizes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the normalised text under each id; of the byte pieces that spell a sign, the last has them all."""
        sizes = self.widths[ids]
        spelled = np.flatnonzero(sizes == 0)
        if len(spelled):
            value = self.byte_of[ids[spelled]]
            lead = value & 0xC0 != 0x80
            first = np.flatnonzero(lead)
            sizes[spelled[np.append(first[1:], len(spelled)) - 1]] = np.diff(np.append(first, len(spelled)))
        return sizes

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends), with the begin and end ids, which span nothing."""
        normal, place = self.normalise(text)
        found, memory = [], self.memory
        for chunk in self.chunks.findall(normal.decode()):
            own = memory.get(chunk)
            if own is None:
                own = self.older.get(chunk) or self._chunk(chunk)
                if len(chunk) <= LONGEST:
                    if len(memory) >= REMEMBERED:
                        self.older, self.memory = memory, {}
                        memory = self.memory
                    memory[chunk] = own
            found.append(own)
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = self._sizes(ids)
        ends = np.cumsum(sizes)
        starts, ends = place[ends - sizes], place[ends]
        edge = lambda x, first, last: np.concatenate([[first], x, [last]]).astype(np.int32)
        return edge(ids, self.bos, self.eos), edge(starts, 0, len(text)), edge(ends, 0, len(text))

    def decode(self, ids: list[int]) -> str:
        """The text that the ids spell; the mark that the first piece begins with is left out."""
        parts = [self.surfaces[k] for k in ids]
        if self.dummy and not self.suffix:
            for k, own in enumerate(ids):
                if self.normal[own] and parts[k][:1] == b" ":
                    parts[k] = parts[k][1:]
                    if not self.squeeze:
                        break
                if parts[k]:
                    break
        return b"".join(parts).decode("utf-8", "a sign a byte")


_MODELS: dict[str, Model] = {}


def _model(data: bytes) -> Model:
    """The model, read once by each worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = Model(data)
    return _MODELS[key]


def read_model(path: str) -> bytes:
    """The bytes of a model file in the driver's reach; they travel to the workers with the job."""
    return Path(path).read_bytes()


ENCODED = "ids array<int>, starts array<int>, ends array<int>"


def encode(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """The rows with ``ids``, and the ``starts`` and ``ends`` of their byte spans in the text, begin and end ids included."""
    new = T._parse_datatype_string(ENCODED)
    schema = T.StructType([*docs.schema.fields, *new.fields])
    at = docs.columns.index(text_col)
    Model(model)  # refuses other models at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model)
        for batch in batches:
            texts = texts_of(batch.column(at))
            for a, b in chunks(texts, CHUNK_BYTES):
                found = [own.encode(x) for x in texts[a:b]]
                cuts = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([x[k] for x in found]))) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *lists], schema.names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """The rows with the text that their ids spell; null ids spell an empty text."""
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model)
        for batch in batches:
            texts = [own.decode(batch.column(at)[i].as_py() or []) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def encoding_report(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_spanned, ids_sha256, decoded_sha256): all ids, the bytes of the text under spans, and digests.

    The ids are digested as unsigned 32-bit integers, least byte first.
    """
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType),
        *(T.StructField(x, T.LongType()) for x in ("n_tokens", "n_spanned")),
        *(T.StructField(x, T.StringType()) for x in ("ids_sha256", "decoded_sha256")),
    ])

    def of(own: Model, text: bytes) -> tuple[int, int, str, str]:
        ids, starts, ends = own.encode(text)
        decoded = own.decode(ids.tolist()).encode()
        return len(ids), int((ends - starts).sum()), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model)
        for batch in batches:
            found = [of(own, x) for x in texts_of(batch.column(1))]
            columns = [pa.array([x[k] for x in found], pa.int64() if k < 2 else pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
