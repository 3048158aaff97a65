"""Repair of the structure of conversations: the cheapest edits after which the roles alternate.

The rows of a conversation, by turn, are kept (cost 0), given the role user or assistant (3) or deleted (4, required of
blank and repeated rows); rows of empty text and either role may be inserted anywhere (3); a truncated row that stays
costs 3 more.  Afterwards the initials of the roles read ``(s?(ua)+)?``.  Of the cheapest sequences of edits the one
whose initials (D, I, K, R) come first in ASCII is taken.

What has been said so far matters in four ways only: nothing, system, user or assistant last.  An element (a row, or a
run of rows) is a table of costs from each state to each, with the order of its best edits among those from one state.
Edits to different states after the same rows differ before either ends, as only the edit of a row ends them, so the
order of two is settled by what comes first.  Hirschberg's method finds the states between the elements: forward costs
from the left and backward costs from the right meet in the middle, the crossing with the least edits of the cheapest
ones is chosen, and both halves are solved alike, in space that is linear in the rows.

Spark sorts the rows by conversation and turn in ranges, so a conversation of any length lies in consecutive slices of
bounded size.  A conversation within one slice is solved there.  The slices of the others become elements; elements are
joined ``FAN`` at a time up to one for each conversation, and on the way back down the method above gives each slice
the states at its ends, in as many rounds as the logarithm of the slices.  Equal rows are counted before the sort, so
they make no hot key.  Only a digest over a whole conversation is computed in order, as a stream with nothing but its
state held.

A null conversation id is a conversation of its own.  Null roles and texts are one space; null turns come first.  Rows
of one turn go by role and text.  A role that begins with none of s, u and a (or is empty) cannot be kept.  Empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .jobs import durable, shuffle_partitions

SLICE_ROWS = 1_000
SLICE_BYTES = 4 << 20
FAN = 64
NEVER = 1 << 40
FURTHER, BLANK = 1, 2

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
SAID = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
AFTER = {EMPTY: {SYSTEM, USER}, SYSTEM: {USER}, USER: {ASSISTANT}, ASSISTANT: {USER}}
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # of user and assistant, the one that may come
TAIL = {EMPTY: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}  # insertions that end a conversation
KEEP, RENAME, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3

Element = tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, ...], ...]]  # costs and ranks, by state before and after


def _ranks(keys: list) -> tuple[int, ...]:
    order = sorted(set(keys))
    return tuple(order.index(x) for x in keys)


@lru_cache(maxsize=None)
def row_edits(kind: str) -> tuple[tuple[tuple[int, str], ...], ...]:
    """By state before and after, the cost and initials of the best edits of one row, insertions before it included.

    ``kind``: the initial of the role ("-": none that can be kept), and whether the row must go (x), is truncated (t) or sound (.).
    """
    out = []
    for p in STATES:
        best: list[tuple[int, str]] = [(NEVER, "")] * 4
        state = p
        for n in range(3):  # a third insertion leads where the first did
            base, more = n * INSERT, CUT_OFF if kind[1] == "t" else 0
            ways = [(base + DELETE, "I" * n + "D", state)]
            if kind[1] != "x":
                ways.append((base + RENAME + more, "I" * n + "R", NEXT[state]))
                said = SAID.get(kind[0])
                if said in AFTER[state]:
                    ways.append((base + KEEP + more, "I" * n + "K", said))
            for cost, edits, q in ways:
                best[q] = min(best[q], (cost, edits))
            state = NEXT[state]
        out.append(tuple(best))
    return tuple(out)


@lru_cache(maxsize=None)
def row_element(kind: str) -> Element:
    table = row_edits(kind)
    return tuple(tuple(c for c, _ in r) for r in table), tuple(_ranks([e for _, e in r]) for r in table)


def forward(elements: list[Element], entry: int) -> tuple[list[int], list[int]]:
    """Costs of the states after the elements, and the order of the least edits that lead to them."""
    cost, rank = [NEVER] * 4, [0] * 4
    cost[entry] = 0
    for costs, ranks in elements:
        best = [min((cost[p] + costs[p][q], rank[p], ranks[p][q]) for p in STATES) for q in STATES]
        cost = [min(x[0], NEVER) for x in best]
        rank = _ranks([x[1:] for x in best])
    return cost, list(rank)


def backward(elements: list[Element], ends: list[int]) -> list[int]:
    """Costs from each state before the elements to the end, of which ``ends`` has the costs that follow."""
    for costs, _ in reversed(elements):
        ends = [min(costs[p][q] + ends[q] for q in STATES) for p in STATES]
    return ends


def crossings(elements: list[Element], entry: int, ends: list[int]) -> list[int]:
    """The state after each element on the cheapest way from ``entry``, the one with the least edits of equals."""
    if not elements:
        return []
    middle = (len(elements) + 1) // 2
    left, right = elements[:middle], elements[middle:]
    (cost, rank), rest = forward(left, entry), backward(right, ends)
    state = min(STATES, key=lambda q: (cost[q] + rest[q], rank[q]))
    only = [0 if q == state else NEVER for q in STATES]
    before = [state] if len(left) == 1 else crossings(left, entry, only)
    return before + crossings(right, state, ends)


def joined(elements: list[Element]) -> Element:
    """A run of elements as one."""
    both = [forward(elements, p) for p in STATES]
    return tuple(tuple(c) for c, _ in both), tuple(tuple(r) for _, r in both)


END = [INSERT * TAIL[q] for q in STATES]

SPACES = " \t\n\x0b\x0c\r"


def fault(text: str) -> str:
    """b: blank, t: truncated, or nothing."""
    own = text.rstrip(SPACES)
    return "b" if not own else "" if own[-1] in ".!?" else "t"


def kind_of(role: str, flaw: str) -> str:
    return (role[:1] if role[:1] in SAID else "-") + ("x" if flaw in ("b", "d") else flaw or ".")


def repaired(roles: list[str], texts: list[str], states: list[int], kinds: list[str], entry: int, last: bool) -> list[tuple[str, str, str]]:
    """(edit, role, text) in order; deleted rows have their own role and text."""
    out, at = [], entry
    names = {USER: "user", ASSISTANT: "assistant"}
    for role, text, kind, to in zip(roles, texts, kinds, states, strict=True):
        for edit in row_edits(kind)[at][to][1]:
            if edit in "IR":
                at = NEXT[at]
                out.append((edit, names[at], text if edit == "R" else ""))
            else:
                at = SAID[role[0]] if edit == "K" else at
                out.append((edit, role, text))
    for _ in range(TAIL[at] if last else 0):
        at = NEXT[at]
        out.append(("I", names[at], ""))
    return out


@lru_cache(maxsize=1 << 16)
def _short(kinds: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(crossings([row_element(k) for k in kinds], EMPTY, END))


# --- Spark

ROWS = "turns array<long>, roles array<string>, texts array<string>, copies array<int>"
STATS = "rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, n_turns long"
PLACE = "part int, slice int, run int"


def _counted(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """(conv, turn, role, text, n): the distinct rows with their number; a conversation of no rows has one of null role."""
    n = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    some = n > 0
    own = rows.select(
        F.col(conv).alias("conv"),
        F.when(some, F.col(turn).cast("long")).alias("turn"),
        F.when(some, F.coalesce(F.col(role).cast("string"), F.lit(" "))).alias("role"),
        F.when(some, F.coalesce(F.col(text).cast("string"), F.lit(" "))).alias("text"),
        F.when(some, n).otherwise(0).alias("n"),
    )
    return own.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))


def slices(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(conv, part, slice, run, open, turns, roles, texts, copies): consecutive rows of a conversation, in order.

    ``part`` and ``slice`` number the slices in the order of conversations and turns, ``run`` those of a conversation
    within a part; ``open``: the conversation may have other slices.  ``copies`` is 0, or for a further copy of a row
    FURTHER or (of a blank one) BLANK, and its text is left out.
    """
    keys = ["conv", "turn", "role", "text"]
    counted = _counted(rows, conv_col, turn_col, role_col, text_col, copies_col)
    ordered = counted.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    schema = T.StructType([T.StructField("conv", rows.schema[conv_col].dataType), *T._parse_datatype_string(f"{PLACE}, open boolean, {ROWS}").fields])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, run, size = TaskContext.get().partitionId(), 0, 0, 0
        now: object = None
        begun, first = False, True  # the first conversation of a part may have begun in the one before
        held: list[tuple] = []
        out: list[tuple] = []
        waiting = 0  # bytes and rows in out, about

        def close(is_open: bool) -> None:
            nonlocal number, run, size, waiting
            out.append((now, part, number, run, is_open, *([x[k] for x in held] for k in range(4))))
            waiting += size + 100 * len(held)
            number, run, size = number + 1, run + 1, 0
            held.clear()

        def ready() -> pa.RecordBatch:
            nonlocal waiting
            batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(arrow.types)], schema=arrow)
            out.clear()
            waiting = 0
            return batch

        for batch in batches:
            for conv, turn, role, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != now:
                    if begun:
                        close(first or run > 0)
                        first = False
                    now, begun, run = conv, True, 0
                for copy in range(n):
                    if len(held) >= slice_rows or size >= SLICE_BYTES:
                        close(True)
                        if waiting >= SLICE_BYTES:
                            yield ready()
                    held.append((turn, role, None if copy else text, (FURTHER if text.strip(SPACES) else BLANK) if copy else 0))
                    size += 0 if copy else len(text)
                if waiting >= SLICE_BYTES:
                    yield ready()
        if begun:
            close(True)
            yield ready()

    return ordered.mapInArrow(cut, schema)


def _first_seen(own: DataFrame) -> DataFrame:
    """(part, slice, repeats): of open slices, the rows whose role and text stand earlier in their conversation."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            convs, parts, numbers, roles, texts, copies = batch.columns
            rows = [
                (i, k, xxhash.xxh3_128_digest(f"{role}\0{text}"))
                for i, own in enumerate(zip(roles.to_pylist(), texts.to_pylist(), copies.to_pylist(), strict=True))
                for k, (role, text, copy) in enumerate(zip(*own, strict=True))
                if not copy
            ]
            at = pa.array([x[0] for x in rows], pa.int64())
            columns = [convs.take(at), parts.take(at), numbers.take(at), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "part", "slice", "row", "digest"])

    seen = own.select("key", "part", "slice", "roles", "texts", "copies").mapInArrow(digests, "key string, part int, slice int, row int, digest binary")
    place = F.struct("part", "slice", "row")
    first = seen.groupBy("key", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = seen.join(first.hint("merge"), ["key", "digest"]).where(place > F.col("first"))
    return again.groupBy("part", "slice").agg(F.collect_set("row").alias("repeats"))  # a slice's rows at most


def _examined(turns: list, roles: list[str], texts: list, copies: list[int], repeats: set[int] | None) -> tuple[list[str], tuple]:
    """The kinds of a slice's rows, and its STATS."""
    seen: set[tuple[str, str]] = set()
    flaws = []
    for k, (role, text, copy) in enumerate(zip(roles, texts, copies, strict=True)):
        flaw = ("", "d", "b")[copy] or fault(text)
        if flaw != "b" and ((role, text) in seen if repeats is None else k in repeats):
            flaw = "d"
        if not copy:
            seen.add((role, text))
        flaws.append(flaw)
    initials = [r[:1] for r in roles]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    known = [t for t in turns if t is not None]
    ends = (initials[0], initials[-1]) if roles else (None, None)
    stats = (len(roles), *(flaws.count(x) for x in "bdt"), illegal, *ends, *((min(known), max(known)) if known else (None, None)), len(set(known)))
    return [kind_of(r, f) for r, f in zip(roles, flaws, strict=True)], stats


def _elements(own: DataFrame) -> DataFrame:
    """(key, node, part, slice, element): each open slice as one element of its conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["turns", "roles", "texts", "copies", "repeats"]).to_pylist()
            kinds = [_examined(r["turns"], r["roles"], r["texts"], r["copies"], set(r["repeats"] or ()))[0] for r in rows]
            flat = [[x for table in joined([row_element(k) for k in own]) for line in table for x in line] for own in kinds]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(flat, pa.list_(pa.int64()))], ["key", "node", "part", "slice", "element"])

    some = own.select("key", "node", "part", "slice", "turns", "roles", "texts", "copies", "repeats")
    return some.mapInArrow(run, "key string, node long, part int, slice int, element array<long>")


def _element(flat: list[int]) -> Element:
    table = [tuple(int(x) for x in flat[4 * k : 4 * k + 4]) for k in range(8)]
    return tuple(table[:4]), tuple(table[4:])


def _states(own: DataFrame, fan: int) -> DataFrame:
    """(part, slice, entry, exit): the states at the ends of each open slice; exit is -1 at the end of a conversation."""
    levels = [durable(_elements(own))]
    top = levels[0].agg(F.max("node")).first()[0] or 0
    while top >= fan:
        def up(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node")
            flat = [x for table in joined([_element(x) for x in pdf["element"]]) for line in table for x in line]
            return pd.DataFrame({"key": [pdf["key"].iloc[0]], "node": [int(pdf["node"].iloc[0]) // fan], "element": [flat]})

        below = levels[-1].select("key", "node", "element")
        levels.append(durable(below.groupBy("key", F.expr(f"node div {fan}")).applyInPandas(up, "key string, node long, element array<long>")))
        top //= fan

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        entry, last = int(pdf["entry"].iloc[0]), int(pdf["exit"].iloc[0])
        ends = END if last < 0 else [0 if q == last else NEVER for q in STATES]
        after = crossings([_element(x) for x in pdf["element"]], entry, ends)
        pdf["entry"], pdf["exit"] = [entry, *after[:-1]], [*after[:-1], last]
        return pdf.drop(columns="element")

    states = levels[-1].select("key").distinct().select("key", F.lit(0).cast("long").alias("above"), F.lit(EMPTY).alias("entry"), F.lit(-1).alias("exit"))
    for k, level in reversed(list(enumerate(levels))):
        held = level.withColumn("above", F.expr(f"node div {fan}")).join(states.hint("merge"), ["key", "above"])
        columns = [c for c in level.columns if c != "element"] + ["above", "entry", "exit"]
        kinds = {"key": "string", "node": "long", "above": "long"}
        states = held.select(*columns, "element").groupBy("key", "above").applyInPandas(down, ", ".join(f"{c} {kinds.get(c, 'int')}" for c in columns))
        if k:
            states = durable(states.select("key", F.col("node").alias("above"), "entry", "exit"))
    return states.select("part", "slice", "entry", "exit")


def _solved(own: DataFrame, is_open: bool) -> DataFrame:
    """(conv, part, slice, edits, new_roles, new_texts, cost and STATS) of each slice."""
    schema = T.StructType([own.schema["conv"], *T._parse_datatype_string(f"part int, slice int, edits string, new_roles array<string>, new_texts array<string>, cost long, {STATS}").fields])
    arrow = to_arrow_schema(schema)

    def solve(r: dict) -> tuple:
        kinds, stats = _examined(r["turns"], r["roles"], r["texts"], r["copies"], set(r["repeats"] or ()) if is_open else None)
        entry, end = (r["entry"], r["exit"]) if is_open else (EMPTY, -1)
        if not is_open and len(kinds) <= 16:
            states = list(_short(tuple(kinds)))
        else:
            states = crossings([row_element(k) for k in kinds], entry, END if end < 0 else [0 if q == end else NEVER for q in STATES])
        steps = zip(kinds, [entry, *states], states, strict=False)
        cost = sum(row_edits(k)[p][q][0] for k, p, q in steps) + (END[(states or [entry])[-1]] if end < 0 else 0)
        edits = repaired(r["roles"], r["texts"], states, kinds, entry, end < 0)
        return (r["conv"], r["part"], r["slice"], "".join(x[0] for x in edits), [x[1] for x in edits], [x[2] for x in edits], cost, *stats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [solve(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(arrow.types)], schema=arrow)

    used = ["conv", "part", "slice", "turns", "roles", "texts", "copies", *(["repeats", "entry", "exit"] if is_open else [])]
    return own.select(*used, *([] if is_open else [F.lit(None).cast("array<int>").alias("repeats")])).mapInArrow(run, schema)


def _solutions(rows: DataFrame, columns: dict, slice_rows: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """The solved slices that are a whole conversation, and those of conversations in several."""
    cut = durable(slices(rows, **columns, slice_rows=slice_rows))
    some = cut.where("open")
    width, most = 1, some.agg(F.max("run")).first()[0] or 0
    while width <= most:
        width *= fan
    key = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    some = some.withColumn("key", key).withColumn("node", F.col("part").cast("long") * width + F.col("run"))
    some = some.join(_first_seen(some).hint("merge"), ["part", "slice"], "left")
    some = some.join(_states(some, fan).hint("merge"), ["part", "slice"])
    return _solved(cut.where("NOT open"), False), _solved(some, True)


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, slice_rows: int = SLICE_ROWS, fan: int = FAN) -> DataFrame:
    """(conversation, part, slice, place, edit, role, text): every row of the repaired conversations, in that order.

    ``edit`` is K, R, I, or D for a deleted row, which has its own role and text (null for a further copy of a row).
    ``copies_col``: how often each row stands (0: not at all).
    """
    columns = {"conv_col": conv_col, "turn_col": turn_col, "role_col": role_col, "text_col": text_col, "copies_col": copies_col}
    whole, parts = _solutions(rows, columns, slice_rows, fan)
    each = F.posexplode(F.arrays_zip(F.split("edits", "").alias("edit"), F.col("new_roles").alias("role"), F.col("new_texts").alias("text"))).alias("place", "x")
    both = whole.unionAll(parts).where("edits <> ''").select(F.col("conv").alias(conv_col), "part", "slice", each)
    return both.select(conv_col, "part", "slice", "place", "x.edit", F.col("x.role").alias(role_col), F.col("x.text").alias(text_col))


class _Tally:
    """The report of one conversation, slice by slice."""

    def __init__(self, conv: object):
        self.conv, self.sha, self.any, self.edits, self.cost = conv, hashlib.sha256(), False, [], 0
        self.counts, self.last, self.low, self.high = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "n_turns"), 0), None, None, None

    def add(self, r: dict) -> None:
        for name in self.counts:
            self.counts[name] += r[name]
        if r["rows"]:
            self.counts["illegal"] += self.last is not None and self.last + r["first"] not in ("su", "ua", "au")
            self.last = r["last"]
        if r["low"] is not None:
            self.counts["n_turns"] -= self.high == r["low"]  # a turn that two slices share
            self.low, self.high = r["low"] if self.low is None else self.low, r["high"]
        self.cost += r["cost"]
        self.edits.append(r["edits"])
        for edit, role, text in zip(r["edits"], r["new_roles"], r["new_texts"], strict=True):
            if edit != "D":
                self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
                self.any = True

    def row(self) -> tuple:
        c = self.counts
        gaps = 0 if self.low is None else self.high - self.low + 1 - c["n_turns"]
        return self.conv, gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], self.cost, "".join(self.edits), self.sha.hexdigest()


def repair_report(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, slice_rows: int = SLICE_ROWS, fan: int = FAN) -> DataFrame:
    """(conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation."""
    columns = {"conv_col": conv_col, "turn_col": turn_col, "role_col": role_col, "text_col": text_col, "copies_col": copies_col}
    whole, parts = _solutions(rows, columns, slice_rows, fan)
    counts = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    schema = T.StructType([T.StructField(conv_col, rows.schema[conv_col].dataType), *T._parse_datatype_string(counts).fields])
    arrow = to_arrow_schema(schema)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if now is None or r["conv"] != now.conv:
                    done += [now.row()] if now else []
                    now = _Tally(r["conv"])
                now.add(r)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate(arrow.types)], schema=arrow)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(now.row(), arrow.types, strict=True)], schema=arrow)

    # a digest of a whole conversation is one stream: its slices meet in order, one at a time
    streamed = parts.repartition("conv").sortWithinPartitions("conv", "part", "slice").mapInArrow(tally, schema)
    return whole.mapInArrow(tally, schema).unionAll(streamed)


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with seeded faults: (conversation, turn, role, text, copies), nulls of role and text as one space.

    By crc32 of ``conversation:turn`` modulo 20: 0 has no copy left, 1 an empty text, 2 no signs of a sentence's end,
    3 two copies, 4 the role user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    return conversations.select(
        conv_col,
        turn_col,
        F.when(what == 4, F.lit("user")).otherwise(said(role_col)).alias(role_col),
        F.when(what == 1, F.lit("")).when(what == 2, F.regexp_replace(said(text_col), "[.!?]", "")).otherwise(said(text_col)).alias(text_col),
        F.when(what == 0, 0).when(what == 3, 2).otherwise(1).alias("copies"),
    )
