"""A minimal perfect hash over 64-bit keys, built level by level in numpy.

At each level a key that alone falls on its bit settles there; the others go to the next, smaller level.
The rank of a key's bit among all set bits is its index, so n keys get the indexes 0..n-1.
"""

from __future__ import annotations

import numpy as np

from .text import mix


def build(keys: np.ndarray, spread: float = 1.5, most_levels: int = 64) -> tuple[list[int], bytes]:
    """Sizes of the levels, and their bits one after the other.  The keys must be distinct."""
    sizes, bits = [], []
    for level in range(most_levels):
        if not len(keys):
            return sizes, np.packbits(np.concatenate(bits) if bits else np.zeros(0, dtype=bool)).tobytes()
        size = max(64, int(spread * len(keys)))
        at = (mix(keys, level + 1) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        keys = keys[~alone[at]]
    raise ValueError(f"{len(keys)} keys are equal or did not settle")


class PerfectHash:
    """Looks keys up; a key that was not among those of ``build`` gets -1 or any index."""

    def __init__(self, sizes: list[int], packed: bytes):
        bits = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=int(sum(sizes))).astype(bool)
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate([[0], np.cumsum(bits)])

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        left, offset = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = (mix(keys[left], level + 1) % np.uint64(size)).astype(np.int64) + offset
            here = self.bits[at]
            out[left[here]] = self.rank[at[here]]
            left = left[~here]
            offset += size
        return out
