"""Toxicity by a weighted finite-state pattern grammar over clauses.

Tokens are mapped to classes: insult, threat, target, negation, reported speech, other.  Four small
transducers read the classes of a clause (what was said, at whom, whether it is negated, whether it is
somebody else's words) and are composed into one machine; the state a clause ends in says what pattern it
matched.  A document's features are the summed lexical weights of its clauses by pattern, and a logistic
model on them gives the score, so a negated or reported insult need not count as a plain one.

The insult lexicon is learned: words and word beginnings that stand in toxic documents of the labelled
sample far more often than chance allows; common insults in four languages are known from the start.
Training reads at most ``sample`` labelled rows, those with the smallest hash of their id.  Scores use
nothing but the text: null and empty texts have the score of a text without any match, equal texts have equal
scores, and each row is scored, repeated rows and null ids included.  A document labelled more than once is
toxic if one label says so.  Without labels of both kinds the known words and PRIOR stand alone.  Empty tables
give empty results; ``drop_toxic`` passes all columns on, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import BASE, U64, Words, chunks, prefix_hash, range_hash, texts_of, words

SAMPLE = 20_000
STEMS = (4, 5, 6, 7, 8)  # beginnings of words, in bytes
LEAST_WEIGHT = 2.5  # natural log odds
SURPRISE = 14.0  # log likelihood ratio against the base rate; chance gives about e**14 features one such

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
KNOWN_INSULTS = "idiot idiots moron morons scum loser losers stupid worthless pathetic disgusting trash clown imbecile dimwit dumbass bastard asshole idiota imbécil estúpido estúpida basura imbécile crétin connard salaud stupide dummkopf trottel abschaum arschloch blödmann".split()
KNOWN_THREATS = "kill hurt destroy shoot stab strangle burn beat murder töten umbringen zerstören tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your you're youre u he she they them him her people du dich dein ihr euch sie tu toi vous ton votre il elle ils tú ti usted ustedes ellos ella".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't without nicht kein keine nie ne pas jamais sans nunca sin jamás".split()
REPORTS = "said says say told wrote writes called calls claimed quoted reported sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()

CLAUSE = re.compile(rb"[.!?;\n]+")
TOKEN_BREAKS = np.ones(256, dtype=bool)
TOKEN_BREAKS[[0x27, *range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
TOKEN = re.compile(rb"[0-9A-Za-z'\x80-\xff]+")


@dataclass(frozen=True)
class Transducer:
    """Moves from (state, class) to a state; a class without a move stays."""

    moves: dict[tuple[int, int], int]
    states: int

    def step(self, state: int, symbol: int) -> int:
        return self.moves.get((state, symbol), state)


def _negation() -> Transducer:
    """A negation holds for the three tokens after it; an insult or threat under it is negated for good."""
    moves = {}
    for state in range(4):
        moves |= {(state, NEGATION): 3, (state, OTHER): max(0, state - 1), (state, TARGET): max(0, state - 1)}
        if state:
            moves |= {(state, INSULT): 4, (state, THREAT): 4}
    return Transducer(moves, 5)


WHAT = Transducer({(0, INSULT): 1, (0, THREAT): 2, (2, INSULT): 1}, 3)
AT = Transducer({(0, TARGET): 1}, 2)
NEGATED = _negation()
REPORTED = Transducer({(0, REPORT): 1, (1, INSULT): 2, (1, THREAT): 2}, 3)
PATTERNS = ("insult", "insult_at", "threat_at", "negated", "reported")


def compose(parts: tuple[Transducer, ...] = (WHAT, AT, NEGATED, REPORTED)) -> tuple[np.ndarray, np.ndarray]:
    """The composed machine: next state by (state, class), and the pattern of each state, -1 if none."""
    states = list(product(*(range(p.states) for p in parts)))
    number = {s: i for i, s in enumerate(states)}
    table = np.array([[number[tuple(p.step(x, c) for p, x in zip(parts, s, strict=True))] for c in range(6)] for s in states])

    def pattern(what: int, at: int, negated: int, reported: int) -> int:
        if not what or what == 2 and not at:
            return -1
        return 4 if reported == 2 else 3 if negated == 4 else 2 if what == 2 else 1 if at else 0

    return table, np.array([pattern(*s) for s in states])


TABLE, ENDS = compose()


def _hash_of(tokens: list[bytes]) -> np.ndarray:
    """Hashes of tokens as ``Words.hashes`` has them."""
    out = np.zeros(len(tokens), dtype=U64)
    for i, t in enumerate(tokens):
        data = np.frombuffer(t, dtype=np.uint8).astype(U64)
        with np.errstate(over="ignore"):
            out[i] = range_hash(prefix_hash(data + U64(1), BASE), np.array([0]), np.array([len(t)]), BASE)[0]
    return out


@dataclass
class Lexicon:
    """Weights of words and word beginnings."""

    full: dict[bytes, float]
    stems: dict[bytes, float]
    classes: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.classes = {w.encode(): c for c, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, KNOWN_THREATS)) for w in ws}
        keys = [*self.full, *(k.encode() for k in KNOWN_THREATS)]
        self.hash_full = np.sort(_hash_of(keys)) if keys else np.zeros(0, dtype=U64)
        self.hash_stems = np.sort(_hash_of(list(self.stems))) if self.stems else np.zeros(0, dtype=U64)
        self.lengths = sorted({len(x) for x in self.stems})

    def rows_to_read(self, w: Words) -> np.ndarray:
        """Rows that hold a word or beginning of the lexicon."""
        with np.errstate(over="ignore"):
            sums = prefix_hash(w.data.astype(U64) + U64(1), BASE)
        hit = _among(range_hash(sums, w.starts, w.ends, BASE), self.hash_full)
        for n in self.lengths:
            long = np.flatnonzero(w.ends - w.starts >= n)
            hit[long] |= _among(range_hash(sums, w.starts[long], w.starts[long] + n, BASE), self.hash_stems)
        return np.unique(w.rows[hit])

    def weigh(self, token: bytes) -> float:
        best = self.full.get(token, 0.0)
        for n in self.lengths:
            if len(token) >= n:
                best = max(best, self.stems.get(token[:n], 0.0))
        return best

    def features(self, text: bytes) -> list[float]:
        """Summed weights of the clauses of each pattern, the number of lexical tokens, and the length among which they stand, all as logarithms."""
        sums, hits, length = [0.0] * len(PATTERNS), 0, 0
        for clause in CLAUSE.split(text.lower()):
            state, weight = 0, 0.0
            for token in TOKEN.findall(clause):
                w = self.weigh(token)
                length += 1
                hits += w > 0
                c = self.classes.get(token, OTHER)
                if w and c in (OTHER, THREAT):
                    c = INSULT
                if c == THREAT:
                    w = 2.0
                if c in (INSULT, THREAT):
                    weight += w
                state = TABLE[state, c]
            if weight and ENDS[state] >= 0:
                sums[ENDS[state]] += weight
        return [*map(math.log1p, sums), math.log1p(hits), math.log1p(length) if any(sums) else 0.0]


def _among(h: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(h), dtype=bool)
    few = np.zeros(1 << 16, dtype=bool)
    few[(sorted_keys >> U64(48)).astype(np.int64)] = True
    out = few[(h >> U64(48)).astype(np.int64)]
    at = np.flatnonzero(out)
    out[at] = sorted_keys[np.minimum(np.searchsorted(sorted_keys, h[at]), len(sorted_keys) - 1)] == h[at]
    return out


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray  # bias, then one for each feature

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.weights[0])
        for a, b in chunks(texts):
            for r in self.lexicon.rows_to_read(words(texts[a:b], TOKEN_BREAKS)).tolist():
                out[a + r] += float(np.dot(self.weights[1:], self.lexicon.features(texts[a + r])))
        return 1 / (1 + np.exp(-out))


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; an id that is null counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % by


HELD = 50_000  # features


def _candidates(train: DataFrame) -> DataFrame:
    """(feature, whole, toxic, clean): documents of either label that hold a word, or a word with a beginning."""

    def counted(seen: dict[int, Counter]) -> pa.RecordBatch:
        keys = list(seen[0].keys() | seen[1].keys())
        columns = [pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.bool_()), *(pa.array([seen[x][k] for k in keys], pa.int64()) for x in (1, 0))]
        return pa.RecordBatch.from_arrays(columns, ["feature", "whole", "toxic", "clean"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                tokens = set(TOKEN.findall(text.lower()))
                own = {(t, True) for t in tokens}
                for n in STEMS:
                    own |= {(t[:n], False) for t in tokens if len(t) > n}
                seen[label].update(own)
                if len(seen[0]) + len(seen[1]) >= HELD:  # what a task holds at once; Spark adds the parts up
                    yield counted(seen)
                    seen = {0: Counter(), 1: Counter()}
        yield counted(seen)

    parts = train.select("text", "toxic").mapInArrow(count, "feature binary, whole boolean, toxic long, clean long")
    return parts.groupBy("feature", "whole").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train_toxicity(docs: DataFrame, labels: DataFrame, train_rows: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learns from the labelled rows for which ``train_rows`` holds, ``sample`` of them at most."""
    chosen = labels.where(train_rows & F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # a bounded table
    totals = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    full = {w.encode(): 4.0 for w in KNOWN_INSULTS}
    stems: dict[bytes, float] = {}
    if n1 and n0:
        rate, n = n1 / (n1 + n0), F.col("toxic") + F.col("clean")
        p = F.col("toxic") / n
        surprise = F.col("toxic") * F.log(p / rate) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - p) / (1 - rate))).otherwise(0.0)
        weight = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
        counted = _candidates(train).where("toxic >= 3").withColumn("weight", weight).withColumn("surprise", surprise)
        for r in counted.where((F.col("weight") >= LEAST_WEIGHT) & (F.col("surprise") >= SURPRISE)).collect():  # bounded by the sample's words
            (full if r.whole else stems)[bytes(r.feature)] = float(r.weight)
    lexicon = Lexicon(full, stems)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([lexicon.features(x) for x in texts_of(batch.column(0))], pa.list_(pa.float64()))], ["toxic", "x"])

    rows = train.select("text", "toxic").mapInArrow(featurise, "toxic int, x array<double>").collect() if n1 and n0 else []  # bounded by sample
    return ToxicityModel(lexicon, fit_logistic(np.array([r.x for r in rows]).reshape(-1, len(PATTERNS) + 2), np.array([r.toxic for r in rows], dtype=float)))


PRIOR = np.array([-4.0, 2.0, 2.5, 2.5, 0.2, 0.2, 0.5, 0.0])  # bias, patterns, tokens, length


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Newton steps for a logistic model drawn to PRIOR, so patterns that training lacks keep sensible weights."""
    w, full = PRIOR.copy(), np.hstack([np.ones((len(x), 1)), x])
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        grad = full.T @ (p - y) + ridge * (w - PRIOR)
        hess = (full * (p * (1 - p))[:, None]).T @ full + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return w


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(texts_of(batch.column(batch.schema.get_field_index(text_col))))
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
