"""Array kernels shared by the text operators; they run inside Spark tasks on one Arrow batch at a time.

A word is a maximal run of bytes outside ``0x20`` and ``0x09-0x0D``.  Word and n-gram hashes are
polynomial hashes modulo 2**64 taken from prefix sums, so one pass over the bytes serves every n-gram
length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E6C63D0876A9A35  # odd, so it has an inverse modulo 2**64
GRAM_BASE = 0xD6E8FEB86659FD93
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i in 0..n-1."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up, down = (np.full(size, x, dtype=U64) for x in (base, pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            have = _POWERS[base] = np.cumprod(up), np.cumprod(down)
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer; different seeds give independent hashes."""
    with np.errstate(over="ignore"):
        x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """``out[i]`` sums ``values[j] * base**j`` over j < i."""
    out = np.zeros(len(values) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum(values.astype(U64, copy=False) * powers(base, len(values))[0], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Mixed hash of each range [start, end) of the sequence that ``prefix`` sums up."""
    with np.errstate(over="ignore"):
        h = (prefix[ends] - prefix[starts]) * powers(base, max(len(prefix), 1))[1][starts]
        return mix(h + (ends - starts).astype(U64) * U64(0x2545F4914F6CDD1D))


def texts_of(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > most:
            yield start, i
            start, total = i, 0
        total += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


@dataclass
class Words:
    """The words of some texts: byte ranges in ``data``, the row of each, and the first word of each row."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    firsts: np.ndarray
    texts: np.ndarray  # start of each text in data, and the end of the last plus one

    def hashes(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            prefix = prefix_hash(self.data.astype(U64) + U64(1), BASE)
        return range_hash(prefix, self.starts, self.ends, BASE)

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of n words that stays in one row."""
        if len(hashes) < n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
        at = np.flatnonzero(self.rows[n - 1 :] == self.rows[: len(self.rows) - n + 1])
        return at, range_hash(prefix_hash(hashes, GRAM_BASE), at, at + n, GRAM_BASE)


def words(texts: list[bytes], breaks: np.ndarray = SPACE, lower: bool = True) -> Words:
    """``breaks``: which bytes part words; ``lower``: make A-Z lower case first."""
    joined = b" ".join(texts)
    data = np.frombuffer(joined.lower() if lower else joined, dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    at = np.concatenate([[0], np.cumsum(lengths + 1)])
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~breaks[data]
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    rows = np.searchsorted(at, starts, side="right") - 1
    return Words(data, starts, ends, rows, np.searchsorted(rows, np.arange(len(texts) + 1)), at)


def group_counts(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each position, how often its (row, key) occurs; equal keys of different rows are apart."""
    with np.errstate(over="ignore"):
        _, back, counts = np.unique(mix(keys + rows.astype(U64) * U64(0xC2B2AE3D27D4EB4F), 7), return_inverse=True, return_counts=True)
    return counts[back]
