"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Rolling hashes of several n-gram lengths are taken in numpy over whole batches of texts; an n-gram that
stands twice or more in a text marks its words, and the measure is the share of the text's word
characters under such marks.  Words are compared as they are.  Null and empty texts have no words.

Each row is judged by itself: repeated rows have equal results, ids may repeat and be null, there are no ties, empty
tables give empty results, and other columns, whatever their names, are not read.  Texts of any length are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .text import Words, chunks, group_counts, texts_of, words

GRAMS = (2, 5, 10)
#: Most share of word characters under duplicated n-grams of each length, and in repeated lines.
LIMITS = {2: 0.95, 5: 0.20, 10: 0.15}
LINE_LIMIT = 0.30
SYMBOL_LIMIT = 0.10  # symbols for each word character

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[*b"#*$%&|<>"]] = True


def _sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[firsts[1:]] - total[firsts[:-1]]


def repeated_words(w: Words, hashes: np.ndarray, n: int) -> np.ndarray:
    """Which words stand in a run of n words that the same text holds twice or more."""
    at, grams = w.grams(hashes, n)
    again = at[group_counts(w.rows[at], grams) > 1]
    edge = np.zeros(len(w.starts) + n + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + n, -1)
    return np.cumsum(edge)[: len(w.starts)] > 0


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and the bytes of their words."""
    lines = text.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0, 0
    seen: set[bytes] = set()
    n = size = 0
    for line in lines:
        if line in seen:
            found = line.split()
            n += bool(found)
            size += sum(map(len, found))
        seen.add(line)
    return n, size


def measures(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts and shares of each text."""
    parts = []
    for a, b in chunks(texts):
        w = words(texts[a:b], lower=False)
        h = w.hashes()
        points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        chars = points[w.ends] - points[w.starts]
        symbols = np.concatenate([[0], np.cumsum(SYMBOLS[w.data])])
        lines = [duplicate_lines(x) for x in texts[a:b]]
        out = {
            "n_words": np.diff(w.firsts),
            "word_chars": _sums(chars, w.firsts),
            "n_symbols": symbols[w.texts[1:] - 1] - symbols[w.texts[:-1]],
            "n_dup_lines": np.array([x[0] for x in lines], dtype=np.int64),
        }
        whole = np.maximum(1, out["word_chars"])
        size = np.maximum(1, _sums(w.ends - w.starts, w.firsts))
        out["dup_line_share"] = np.array([x[1] for x in lines]) / size
        for n in GRAMS:
            marked = repeated_words(w, h, n)
            out[f"dup_{n}gram_share"] = _sums(np.where(marked, chars, 0), w.firsts) / whole
            if n == 5:
                out["n_repeat_words"] = _sums(marked.astype(np.int64), w.firsts)
        parts.append(out)
    names = parts[0].keys() if parts else ()
    return {k: np.concatenate([p[k] for p in parts]) for k in names}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("dup_line_share", *(f"dup_{n}gram_share" for n in GRAMS))


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept): too short or too repetitive by words; and within every limit."""
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    kept = ~failed & (m["dup_line_share"] <= LINE_LIMIT) & (m["n_symbols"] <= SYMBOL_LIMIT * m["word_chars"])
    for n, limit in LIMITS.items():
        kept &= m[f"dup_{n}gram_share"] <= limit
    return failed, kept


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, shares of duplicated characters, base_failed and kept of each row."""
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, T.LongType()) for n in COUNTS), *(T.StructField(n, T.DoubleType()) for n in SHARES), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = measures(texts_of(batch.column(1)))
            failed, kept = verdict(m)
            arrays = [pa.array(m[n].astype(np.int64)) for n in COUNTS] + [pa.array(m[n].astype(float)) for n in SHARES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, pa.array(failed), pa.array(kept)], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
