"""Language-model scoring by a hidden Markov model over word symbols.

A token's hash gives its symbol, one of ``SYMBOLS``; the end of a text has a symbol of its own.  A latent
state emits symbols, and a symbol emits its words by their smoothed share of the symbol's tokens, so the
model is a distribution over words of any vocabulary: P(word | state) = P(symbol | state) P(word | symbol).

Token counts are combined in each batch and summed by a shuffle.  Baum-Welch runs over whole texts: a forward
pass keeps the state at the start of every ``PIECE`` tokens, and the pieces are then taken backwards, so
memory is bounded and no transition is lost.  Each partition adds up its expected counts in arrays of fixed
size, which are summed in two levels.  The states start from seeded emissions; the first steps read a share of the
training texts (by the text's hash, a share that is the same at every size), the last steps read all of them.
Scores use the scaled forward recursion over each whole text.

The counts of the ``HEAD`` most frequent tokens are broadcast as arrays of that size; rarer tokens of the
texts are joined to their counts by a shuffle.  Null and empty texts are one end token.  Rows are texts of
their own, repeated rows and null ids included, known by their place in the scan: the input must be a table or
another scan that gives the same rows again when a task is run again.  Empty tables give empty results; other
columns are not read.  A very long text takes one step of the recursion a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jobs import durable
from .text import U64, chunks, texts_of, words

BITS = 15
SYMBOLS = 1 << BITS
STATES = 8
PIECE = 256
HEAD = 1 << 18
#: Sixteenths of the training texts that the steps of Baum-Welch read, one after the other.
SHARES = (1, 1, 1, 1, 2, 2, 4, 8, 16, 16)
SMOOTH = 0.1
END = np.uint64(0x45A1D7C3B2E9F06B)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, ends included, and the first token of each text."""
    w = words(texts)
    firsts = w.firsts + np.arange(len(texts) + 1)
    out = np.full(len(w.starts) + len(texts), END, dtype=U64)
    out[np.arange(len(w.starts)) + w.rows] = w.hashes()
    return out, firsts


def symbols(hashes: np.ndarray) -> np.ndarray:
    return np.where(hashes == END, SYMBOLS, (hashes >> U64(64 - BITS)).astype(np.int64))


@dataclass
class Hmm:
    start: np.ndarray  # (K,)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (SYMBOLS + 1, K)


@dataclass
class Counts:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def zero(k: int = STATES) -> Counts:
        return Counts(np.zeros(k), np.zeros((k, k)), np.zeros((SYMBOLS + 1, k)))

    def model(self, smooth: float = 0.05) -> Hmm:
        emit = self.emit + smooth * (self.emit.sum(axis=1, keepdims=True) + 1e-3) / self.emit.shape[1] + 1e-6
        return Hmm((self.start + 1) / (self.start + 1).sum(), (self.move + 1) / (self.move + 1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.start, self.move.ravel(), self.emit.ravel()])

    @staticmethod
    def of(flat: np.ndarray, k: int = STATES) -> Counts:
        return Counts(flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k :].reshape(-1, k))


def expect(model: Hmm, syms: np.ndarray, firsts: np.ndarray, into: Counts, at_once: int = 2048) -> None:
    """Adds the expected counts of the texts; states and emissions are held in single precision, sums in double."""
    k, sizes = len(model.start), np.diff(firsts)
    start, move, emit = (x.astype(np.float32) for x in (model.start, model.move, model.emit))
    back_move, ones = np.ascontiguousarray(move.T), np.ones(k, dtype=np.float32)
    order = np.argsort(-sizes, kind="stable")  # longest first
    for i in range(0, len(order), at_once):
        a, n = firsts[:-1][order[i : i + at_once]], sizes[order[i : i + at_once]]
        steps = int(n[0])
        alive = np.searchsorted(-n, -np.arange(steps), side="left")  # texts longer than t

        def forward(before: np.ndarray | None, seen: np.ndarray) -> np.ndarray:
            x = (start if before is None else before[: len(seen)] @ move) * seen
            x /= (x @ ones)[:, None]
            return x

        def emitted(t: int, a: np.ndarray = a, alive: np.ndarray = alive) -> np.ndarray:
            return emit.take(syms[a[: alive[t]] + t], axis=0)

        # the state before each piece but the first
        entry: list[np.ndarray | None] = [None]
        now = None
        for t in range((steps - 1) // PIECE * PIECE):
            now = forward(now, emitted(t))
            if t % PIECE == PIECE - 1:
                entry.append(now)
        beta = np.ones((0, k), dtype=np.float32)
        for p in range(len(entry) - 1, -1, -1):
            t0, t1 = p * PIECE, min(steps, (p + 1) * PIECE)
            alpha = np.zeros((t1 - t0, alive[t0], k), dtype=np.float32)
            seen = []  # what the piece emits, for both ways
            for t in range(t0, t1):
                seen.append(emitted(t))
                alpha[t - t0, : alive[t]] = forward(entry[p] if t == t0 else alpha[t - 1 - t0], seen[-1])
            beta = np.concatenate([beta, np.ones((alive[t0] - len(beta), k), dtype=np.float32)])
            for t in range(t1 - 1, t0 - 1, -1):
                m = alive[t]
                gamma = alpha[t - t0, :m] * beta[:m]
                gamma /= (gamma @ ones)[:, None]
                alpha[t - t0, :m] = gamma
                if t:
                    before = (entry[p] if t == t0 else alpha[t - 1 - t0])[:m]
                    weighted = seen[t - t0]
                    weighted *= beta[:m]
                    back = weighted @ back_move
                    joint = before / np.maximum((before * back) @ ones, np.float32(1e-35))[:, None]
                    into.move += model.move * (joint.T @ weighted)
                    back /= (back @ ones)[:, None]
                    beta[:m] = back
            if p == 0:
                into.start += alpha[0].sum(axis=0, dtype=np.float64)
            for t in range(t0, t1, 16):
                m, most = alive[t], min(t + 16, t1)
                live = np.arange(m)[None, :] < alive[t:most, None]
                s = syms[np.minimum(a[None, :m] + np.arange(t, most)[:, None], len(syms) - 1)][live]
                g = alpha[t - t0 : most - t0, :m][live]
                for j in range(k):
                    into.emit[:, j] += np.bincount(s, weights=g[:, j], minlength=SYMBOLS + 1)


def likelihood(model: Hmm, syms: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Natural log probability of the symbols of each text, by the scaled forward recursion over whole texts."""
    n = np.diff(firsts)
    order = np.argsort(-n, kind="stable")
    a, n = firsts[:-1][order], n[order]
    out = np.zeros(len(order))
    alpha = np.zeros((len(order), len(model.start)))
    alive = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    for t, m in enumerate(alive):
        x = (model.start if t == 0 else alpha[:m] @ model.move) * model.emit[syms[a[:m] + t]]
        scale = x.sum(axis=1)
        out[:m] += np.log(scale)
        alpha[:m] = x / scale[:, None]
    back = np.zeros(len(order))
    back[order] = out
    return back


def token_counts(train: DataFrame, text_col: str) -> DataFrame:
    """(h, n): the count of each distinct token by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[np.ndarray] = []
            size = 0
            texts = texts_of(batch.column(0))
            for i, (a, b) in enumerate(spans := list(chunks(texts, 1 << 21))):
                held.append(tokens(texts[a:b])[0])
                size += len(held[-1])
                if size > 4_000_000 or i == len(spans) - 1:
                    h, n = np.unique(np.concatenate(held), return_counts=True)
                    held, size = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return train.select(text_col).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def baum_welch(train: DataFrame, text_col: str, model: Hmm) -> Counts:
    """Expected counts over all training texts; every partition adds up its own, groups of partitions next."""
    shared = train.sparkSession.sparkContext.broadcast(model)
    cut = 64  # parts of the arrays, so that no task sums whole arrays of many partitions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, any_rows = Counts.zero(), False
        for batch in batches:
            texts = texts_of(batch.column(0))
            syms, sizes = [np.zeros(0, dtype=np.uint16)], [np.zeros(0, dtype=np.int64)]
            for a, b in chunks(texts, 1 << 20):
                h, firsts = tokens(texts[a:b])
                syms.append(symbols(h).astype(np.uint16))
                sizes.append(np.diff(firsts))
                any_rows = True
            expect(shared.value, np.concatenate(syms), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64), into)
        if any_rows:
            parts = np.array_split(into.flat().astype(np.float32), cut)
            p = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(cut), pa.int32()), pa.array([p % 32] * cut, pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "lot", "sums"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("sums").to_pylist():
                total = np.frombuffer(x, dtype=np.float32).astype(np.float64) + (0 if total is None else total)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["part", "sums"])

    parts = train.select(text_col).mapInArrow(run, "part int, lot int, sums binary")
    parts = parts.groupBy("part", "lot").applyInArrow(add, "part int, sums binary").groupBy("part").applyInArrow(add, "part int, sums binary")
    rows = {r.part: np.frombuffer(bytes(r.sums), dtype=np.float32).astype(np.float64) for r in parts.collect()}  # arrays of fixed size
    return Counts.of(np.concatenate([rows[i] for i in range(cut)])) if rows else Counts.zero()


def first_model(counts: np.ndarray, seed: int = 7) -> Hmm:
    """Sticky states with emissions scattered about the symbols' shares."""
    rng = np.random.default_rng(seed)
    emit = (counts[:, None] + 1e-3) * rng.gamma(2.0, 0.5, size=(SYMBOLS + 1, STATES))
    move = np.full((STATES, STATES), 0.02 / (STATES - 1)) + np.eye(STATES) * (0.98 - 0.02 / (STATES - 1))
    return Hmm(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))


def score_texts(docs: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    ``train_rows`` tells which rows are learned from.
    """
    spark = docs.sparkSession
    train = docs.where(train_rows)
    counts = durable(token_counts(train, text_col))
    shift = F.when(F.col("h") == F.lit(int(END.view(np.int64))), F.lit(SYMBOLS)).otherwise(F.shiftrightunsigned("h", 64 - BITS).cast("int"))
    by_symbol = counts.groupBy(shift.alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # one row a symbol
    n_of, v_of = np.zeros(SYMBOLS + 1), np.zeros(SYMBOLS + 1)
    for r in by_symbol:
        n_of[r.s], v_of[r.s] = r.n, r.v
    total, vocabulary = int(n_of.sum()), int(v_of.sum())
    # the head: every token from the least count that HEAD tokens at most reach
    bins = counts.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("b")).agg(F.count("*").alias("v"), F.min("n").alias("least")).orderBy(F.desc("b")).collect()
    room, least = HEAD, None
    for r in bins:
        room -= r.v
        if room < 0:
            break
        least = r.least
    head = counts.where(F.col("n") >= least if least is not None else F.lit(False)).toPandas()  # HEAD rows at most
    head_h, head_n = head["h"].to_numpy(np.int64).view(U64), head["n"].to_numpy(np.int64)
    order = np.argsort(head_h)
    head_h, head_n = head_h[order], head_n[order]

    model = first_model(n_of / max(1, total))
    sixteenth = F.pmod(F.xxhash64(F.lit(1), F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(16))
    for share in SHARES:
        found = baum_welch(train.where(sixteenth < share) if share < 16 else train, text_col, model)
        model = found.model() if found.start.sum() else model

    within = np.log10(n_of + SMOOTH * (v_of + 1))
    base = float(np.log10(total + SMOOTH * (vocabulary + 1)))
    shared = spark.sparkContext.broadcast((model, within, head_h, head_n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, within, head_h, head_n = shared.value
        row, p = 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            texts, keys = texts_of(batch.column(2)), p + row + np.arange(n)
            row += n
            known_of, logs_of, syms, sizes = np.zeros(n, dtype=np.int64), np.zeros(n), [], []
            for a, b in chunks(texts, 1 << 20):
                h, firsts = tokens(texts[a:b])
                rows = np.repeat(np.arange(a, b), np.diff(firsts))
                at = np.minimum(np.searchsorted(head_h, h), max(0, len(head_h) - 1))
                known = head_h[at] == h if len(head_h) else np.zeros(len(h), dtype=bool)
                known_of += np.bincount(rows, weights=known, minlength=n).astype(np.int64)
                if len(head_h):
                    logs_of += np.bincount(rows, weights=np.where(known, np.log10(head_n[at] + SMOOTH), 0.0), minlength=n)
                syms.append(symbols(h).astype(np.uint16))
                sizes.append(np.diff(firsts))
                rare = np.flatnonzero(~known)
                rare = rare[np.lexsort((h[rare], rows[rare]))]
                if len(rare):
                    new = np.flatnonzero(np.concatenate([[True], (h[rare][1:] != h[rare][:-1]) | (rows[rare][1:] != rows[rare][:-1])]))
                    times = np.diff(np.append(new, len(rare))).astype(np.int64)
                    blank = [pa.nulls(len(new), t) for t in (batch.column(0).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[rows[rare[new]]]), pa.array(h[rare[new]].view(np.int64)), pa.array(times), *blank], names)
            if n:
                every = np.concatenate(syms).astype(np.int64)
                firsts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                inner = np.add.reduceat(within[every], firsts[:-1])  # every text has its end token
                hmm = likelihood(model, every, firsts) / np.log(10) - inner
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(keys), pa.array(np.zeros(n, dtype=np.int64)), batch.column(0), batch.column(1), pa.array(np.diff(firsts)), pa.array(known_of), pa.array(logs_of), pa.array(hmm)], names)

    names = ["row", "h", "times", "id", "held_out", "n_tokens", "known", "logs", "hmm"]
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("h", T.LongType()), T.StructField("times", T.LongType()), T.StructField("id", kind), T.StructField("held_out", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "known")), *(T.StructField(n, T.DoubleType()) for n in ("logs", "hmm"))])
    looked = docs.select(F.col(id_col).alias("id"), (~train_rows).alias("held_out"), text_col).mapInArrow(run, schema)
    joined = looked.join(counts.withColumnRenamed("n", "c").hint("merge"), "h", "left")
    c = F.when(F.col("times") > 0, F.coalesce("c", F.lit(0)))
    summed = joined.groupBy("row").agg(
        F.max("id").alias("id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.sum(F.coalesce("known", F.lit(0))) + F.sum(F.when(c > 0, F.col("times")).otherwise(0))).alias("n_known"),
        (F.sum(F.coalesce("logs", F.lit(0.0))) + F.sum(F.coalesce(F.col("times") * F.log10(c + F.lit(SMOOTH)), F.lit(0.0)))).alias("logs"),
        F.max("hmm").alias("hmm"),
    )
    return summed.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(base)).alias("base_score"), (F.col("logs") + F.col("hmm")).alias("score"))
