"""Quality by weak labels: overlapping heuristics, expectation-maximisation, and a hashed linear scorer.

Each labeller calls a document good, bad, or abstains.  The vote patterns of all documents are counted (at
most 3**labellers rows); expectation-maximisation over these counts estimates the share of good documents
and each labeller's accuracy on either kind, and gives every pattern a posterior.  The posteriors of a
bounded sample of documents (those with the smallest hashes) train a logistic scorer on hashed features:
word shapes and binned measures.  No labels table is read.

Null and empty texts have no words: they are short, and every other labeller abstains.  Equal texts have equal
scores; each row counts and is scored, repeated rows and null ids included; empty tables give empty results,
and columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .repetition import measures
from .text import U64, chunks, mix, texts_of, words

SAMPLE = 4000
BITS = 12
FALSE_ALARM = 0.01  # most share of good documents that a labeller may call bad
BAD, ABSTAIN, GOOD = 0, 1, 2
LABELLERS = ("length", "symbols", "repeated_words", "repeated_grams", "repeated_lines", "capitals", "marks", "variety")

UPPER = np.zeros(256, dtype=bool)
UPPER[0x41:0x5B] = True
LOWER = np.zeros(256, dtype=bool)
LOWER[0x61:0x7B] = True
CLASS = np.zeros(256, dtype=np.int64)  # of a byte: other letter 0, lower 1, upper 2, digit 3, sentence mark 4, other mark 5
CLASS[0x21:0x80] = 5
CLASS[0x30:0x3A] = 3
CLASS[LOWER], CLASS[UPPER] = 1, 2
CLASS[[*b".,;:!?'\"-()"]] = 4


@dataclass
class Measured:
    """Measures of some texts, and their words' shapes."""

    values: np.ndarray  # (texts, measures)
    rows: np.ndarray
    shapes: np.ndarray


def _measure(texts: list[bytes]) -> Measured:
    m = measures(texts)
    w = words(texts, lower=False)
    size = np.maximum(1, m["n_words"])
    ones = lambda mask: np.bincount(w.rows[mask], minlength=len(texts))
    capitals = np.concatenate([[0], np.cumsum(UPPER[w.data])])
    smalls = np.concatenate([[0], np.cumsum(LOWER[w.data])])
    n_upper, n_lower = capitals[w.ends] - capitals[w.starts], smalls[w.ends] - smalls[w.starts]
    shouted = ones((n_upper > 0) & (n_lower == 0) & (w.ends - w.starts > 1))
    last = w.data[w.ends - 1] if len(w.ends) else w.data[:0]
    marked = ones((CLASS[last] == 5) | ((last == 0x21) & (w.ends - w.starts > 1)))
    h = w.hashes()
    with np.errstate(over="ignore"):
        _, one = np.unique(mix(h + w.rows.astype(U64) * U64(0xC2B2AE3D27D4EB4F), 7), return_index=True)
    distinct = np.bincount(w.rows[one], minlength=len(texts))
    values = np.stack([np.log2(m["n_words"] + 1), m["n_symbols"] / np.maximum(1, m["word_chars"]), m["n_repeat_words"] / size, m["dup_2gram_share"], m["dup_line_share"], shouted / size, marked / size, distinct / np.maximum(1.0, size**0.9)], axis=1)
    length = np.minimum(w.ends - w.starts, 15)
    first = CLASS[w.data[w.starts]] if len(w.starts) else length
    shape = ((first * 6 + CLASS[last]) * 16 + length) * 2 + (n_upper > 1)
    return Measured(values, w.rows, shape)


#: (bad from, good up to) of a measure; between them a labeller abstains.
CUTS = {1: (0.08, 0.03), 2: (0.20, 0.08), 3: (0.95, 0.80), 4: (0.30, 0.10), 5: (0.40, 0.15), 6: (0.30, 0.10)}


def votes(values: np.ndarray) -> np.ndarray:
    """(texts, labellers) of BAD, ABSTAIN, GOOD."""
    n_words = np.round(2 ** values[:, 0]) - 1
    out = np.full((len(values), len(LABELLERS)), ABSTAIN)
    out[n_words < 2, 0] = BAD
    out[n_words >= 20, 0] = GOOD
    some = n_words >= 2
    for k, (bad, good) in CUTS.items():
        out[some & (values[:, k] <= good), k] = GOOD
        out[some & (values[:, k] >= bad), k] = BAD
    many = n_words >= 20
    out[many & (values[:, 7] <= 0.35), 7] = BAD
    out[many & (values[:, 7] >= 0.6), 7] = GOOD
    return out


def em(patterns: np.ndarray, counts: np.ndarray, steps: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good, P(vote | kind) as (kind, labeller, vote), posterior of good by pattern).

    Starts from the majority of the votes; labellers are independent given the kind.
    """
    lean = (patterns == GOOD).sum(axis=1) - 2.0 * (patterns == BAD).sum(axis=1)
    post = np.clip(1 / (1 + np.exp(-lean)), 0.01, 0.99)
    share, given = 0.5, np.zeros((2, patterns.shape[1], 3))
    for _ in range(steps):
        total = max(counts.sum(), 1e-9)
        share = float(np.clip((counts * post).sum() / total, 0.01, 0.99))
        for kind, p in enumerate((1 - post, post)):
            for v in range(3):
                given[kind, :, v] = ((patterns == v) * (counts * p)[:, None]).sum(axis=0) + 0.5
        given /= given.sum(axis=2, keepdims=True)
        # a labeller's call of bad is trusted to be rare among good documents, whatever it is that it looks for
        given[1, :, BAD] = np.minimum(given[1, :, BAD], FALSE_ALARM)
        given[0, :, BAD] = np.maximum(given[0, :, BAD], 10 * FALSE_ALARM)
        given /= given.sum(axis=2, keepdims=True)
        at = np.arange(patterns.shape[1])[None, :]
        logs = [np.log(given[k, at, patterns]).sum(axis=1) for k in (0, 1)]
        post = 1 / (1 + np.exp(np.clip(logs[0] + np.log(1 - share) - logs[1] - np.log(share), -50, 50)))
    return share, given, post


def hashed(found: Measured) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the features of each text."""
    n, k = found.values.shape
    size = 1 << BITS
    bins = np.clip(np.floor(found.values * np.where(np.arange(k) == 0, 1, 20)), 0, 20).astype(np.int64)
    measure = (mix((np.arange(k) * 64 + bins).astype(U64), 21) % U64(size)).astype(np.int64)
    key, times = np.unique(found.rows * size + (mix(found.shapes.astype(U64), 22) % U64(size)).astype(np.int64), return_counts=True)
    row = key // size
    length = np.maximum(1, np.bincount(found.rows, minlength=n))
    return np.concatenate([np.repeat(np.arange(n), k), row]), np.concatenate([measure.ravel(), key % size]), np.concatenate([np.ones(n * k), times / length[row] * 4])


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    posterior: dict[int, float]  # by vote pattern

    def scores(self, found: Measured) -> np.ndarray:
        row, feature, value = hashed(found)
        z = np.bincount(row, weights=self.weights[feature] * value, minlength=len(found.values)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def code(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(v.shape[1])).sum(axis=1)


def _found(texts: list[bytes]) -> Iterator[tuple[int, int, Measured]]:
    for a, b in chunks(texts):
        yield a, b, _measure(texts[a:b])


def train_quality(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [code(votes(m.values)) for _, _, m in _found(texts_of(batch.column(0)))]
            if codes:
                pattern, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n)], ["pattern", "n"])

    rows = docs.select(text_col).mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # 3**8 rows at most
    pattern = np.array([r.pattern for r in rows], dtype=np.int64)
    each = pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    _, _, post = em(each, np.array([r.n for r in rows], dtype=float))
    posterior = dict(zip(pattern.tolist(), post.tolist(), strict=True))

    def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, m in _found(texts_of(batch.column(0))):
                row, feature, value = hashed(m)
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(1, b - a))
                yield pa.RecordBatch.from_arrays([pa.array(code(votes(m.values))), pa.array([x.tolist() for x in np.split(feature[order].astype(np.int32), cut)], pa.list_(pa.int32())), pa.array([x.tolist() for x in np.split(value[order], cut)], pa.list_(pa.float64()))], ["pattern", "f", "v"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))  # whatever other columns are called
    chosen = own.select("id").where("id is not null").orderBy(F.xxhash64("id"), "id").limit(sample).distinct()
    taken = own.join(F.broadcast(chosen), "id").select("text").mapInArrow(feature_rows, "pattern long, f array<int>, v array<double>").limit(sample).collect()
    weights, bias = fit([np.array(r.f) for r in taken], [np.array(r.v) for r in taken], np.array([posterior[r.pattern] for r in taken]))
    return QualityModel(weights, bias, posterior)


def fit(features: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, steps: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by gradient steps with momentum."""
    w, bias = np.zeros(1 << BITS), 0.0
    if not len(target):
        return w, bias
    row = np.repeat(np.arange(len(target)), [len(x) for x in features])
    f, v = np.concatenate(features), np.concatenate(values)
    speed, push = np.zeros_like(w), 0.0
    for _ in range(steps):
        z = np.bincount(row, weights=w[f] * v, minlength=len(target)) + bias
        off = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        speed = 0.9 * speed + np.bincount(f, weights=off[row] * v, minlength=len(w)) / len(target) + ridge * w
        push = 0.9 * push + off.mean()
        w, bias = w - rate * speed, bias - rate * push
    return w, bias


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, weak_label: posterior of good by the votes, score, kept) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[id_col], T.StructField("weak_label", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, m in _found(texts_of(batch.column(1))):
                score = shared.value.scores(m)
                weak = [shared.value.posterior.get(int(c), 0.5) for c in code(votes(m.values))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(weak, pa.float64()), pa.array(score), pa.array(score >= 0.5)], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
