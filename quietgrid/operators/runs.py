"""Experiment runs: merging, filtering, deduplication, coverage, exposure, timing."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import PIECE, sized
from .tables import durable

FAILED_DECISIONS = ("error", "no_candidates", "no_compromise", "invalid_or_no_pipeline", "llm_error")
SHARED_DECISIONS = ("select_pipeline", "selected", "accept", "accepted")


def filled(*names: str) -> Column:
    """How many of the columns hold something."""
    out = F.lit(0)
    for n in names:
        out = out + (F.col(n).isNotNull() & (F.col(n).cast("string") != "")).cast("int")
    return out


def merge_run_rows(df: DataFrame, key: list[str], fields: list[str], path: str, order: str) -> DataFrame:
    """One row a key: the most complete row (3 more points for a path) wins, later ones on ties; its gaps are filled from the others in that order."""
    score = filled(*fields) + 3 * filled(path)
    rank = Window.partitionBy(*key).orderBy(F.desc(score), F.desc(order))
    w = rank.rowsBetween(0, Window.unboundedFollowing)
    best = df.withColumn("_r", F.row_number().over(rank)).withColumns({f: F.first(F.when(F.col(f).cast("string") != "", F.col(f)), ignorenulls=True).over(w) for f in [*fields, path]})
    return best.where("_r = 1").drop("_r")


def merge_nonempty(df: DataFrame, key: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """(key, fields): the last value of each field that is not empty."""
    return df.groupBy(*key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), F.struct(*order))).alias(f) for f in fields])


def latest_results(df: DataFrame, key: list[str], own: str, mtime: list[str]) -> DataFrame:
    """The newest row of a key; rows of the own directory come first."""
    r = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(own), *[F.desc(m) for m in mtime]))
    return df.withColumn("_r", r).where("_r = 1").drop("_r")


def filter_run_rows(df: DataFrame, tasks: list[str] | None = None, methods: list[str] | None = None) -> DataFrame:
    """Rows with a usable decision, of the tasks and methods asked for."""
    df = df.where(~F.coalesce(F.col("decision"), F.lit("")).isin(*FAILED_DECISIONS))
    if tasks:
        df = df.where(F.col("task").isin(*tasks))
    return df.where(F.col("method").isin(*methods)) if methods else df


def is_shared_output(decision: Column) -> Column:
    return F.lower(F.trim(F.coalesce(decision, F.lit("")))).isin(*SHARED_DECISIONS)


def normalize_method(df: DataFrame, method: str, ablation: str) -> DataFrame:
    """Adds method_id (``ablation:x`` for ablations) and method_kind."""
    is_ablation = F.col(ablation).isNotNull() & (F.col(ablation) != "")
    return df.withColumns({"method_id": F.when(is_ablation, F.concat(F.lit("ablation:"), ablation)).otherwise(F.col(method)), "method_kind": F.when(is_ablation, "ablation").otherwise("baseline")})


def ablation_diff(df: DataFrame, key: str, method: str, full: str, signature: list[str]) -> DataFrame:
    """Ablation rows whose signature differs from that of the full method; those without a full row stay."""
    sig = F.struct(*signature)
    base = df.where(F.col(method) == full).groupBy(key).agg(F.min(sig).alias("_full"))
    out = df.where(F.col(method) != full).join(base, key, "left")
    return out.where(F.col("_full").isNull() | ~sig.eqNullSafe(F.col("_full"))).drop("_full")


def dedupe_plan(df: DataFrame, key: list[str], run: str) -> DataFrame:
    """(key, n, first_run, duplicates): runs that do the same work."""
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.min(run).alias("first_run")).withColumn("duplicates", F.col("n") - 1)


def reuse_plan(selected: DataFrame, done: DataFrame, key: list[str], order: str) -> DataFrame:
    """Selected rows with the first earlier result of the same key; rows without one are pending."""
    first = done.groupBy(*key).agg(F.min_by("result", order).alias("reused"))
    return selected.join(first, key, "left").withColumn("pending", F.col("reused").isNull())


def enrich_runs(df: DataFrame, vec: Column, output_type: str, decision: str) -> DataFrame:
    """Adds flags and counts: selected, raw_like, media, semantic, ordinal sum, high, medium and above, unknown."""
    n = lambda f: F.size(F.filter(F.map_values(vec), f))
    media = F.col(output_type).rlike("^(image|video|audio)/")
    return df.withColumns({"selected": is_shared_output(F.col(decision)), "media": media, "raw_like": F.col(output_type).endswith("x-raw"), "semantic": ~media, "ordinal_sum": F.aggregate(F.map_values(vec), F.lit(0), lambda a, x: a + x), "n_high": n(lambda x: x == 3), "n_medium_up": n(lambda x: x >= 2), "n_unknown": n(lambda x: x == 4)})


def decision_coverage(df: DataFrame, by: list[str], candidates: str) -> DataFrame:
    """(by, rows, selected, rate, decisions, mean_candidates)."""
    each = df.groupBy(*by, "decision").agg(F.count("*").alias("n"), F.sum(candidates).alias("s"), F.count(candidates).alias("k"))
    return each.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum(F.when(is_shared_output(F.col("decision")), F.col("n")).otherwise(0)).alias("selected"), F.array_sort(F.collect_list(F.struct("decision", "n"))).alias("decisions"), F.try_divide(F.sum("s"), F.sum("k")).alias("mean_candidates")).withColumn("rate", F.col("selected") / F.col("rows"))


def residual_exposure(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, attr, mean_level, share_medium, share_high)."""
    return long.groupBy(*by, "attr").agg(F.avg("level").alias("mean_level"), F.avg((F.col("level") >= 2).cast("double")).alias("share_medium"), F.avg((F.col("level") >= 3).cast("double")).alias("share_high"))


def supports_semantic(df: DataFrame, allowed: DataFrame, task: str, output: str) -> DataFrame:
    """Rows whose task can be scored from their output's type or schema; ``allowed`` lists (task, output)."""
    return df.join(sized(allowed.select(task, output).distinct()), [task, output], "left_semi")


def output_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n): how often each output type and schema occurs."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def operator_usage(df: DataFrame, operators: str) -> DataFrame:
    """(operator, n): how often each operator of the rows' lists occurs."""
    return df.select(F.explode(operators).alias("operator")).groupBy("operator").agg(F.count("*").alias("n"))


def rejections(df: DataFrame, decision: str) -> DataFrame:
    """The runs that ended without a selection."""
    return df.where(F.col(decision) == "no_compromise")


def timing_by_trace(df: DataFrame, by: list[str], ms: str) -> DataFrame:
    """(by, n, mean) of the times of each trace and method."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(ms).alias("mean"))


def timing_summary(df: DataFrame, by: list[str], stages: list[str], warmup: str) -> DataFrame:
    """(by, stage, mean, median, p95, low, high) of stage times, warm-ups left out."""
    long = df.where(~F.col(warmup)).unpivot(by, stages, "stage", "ms")
    # both percentiles are read from one count of the values
    made = long.groupBy(*by, "stage").agg(F.avg("ms").alias("mean"), F.percentile("ms", [0.5, 0.95]).alias("at"), F.min("ms").alias("low"), F.max("ms").alias("high"))
    return made.select(*by, "stage", "mean", F.col("at")[0].alias("median"), F.col("at")[1].alias("p95"), "low", "high")


def runtime_rows(df: DataFrame, total: str, downstream: str) -> DataFrame:
    return df.withColumn("preprocessing", F.when(F.col(total).isNotNull() & F.col(downstream).isNotNull(), F.greatest(F.lit(0.0), F.col(total) - F.col(downstream))))


def decision_switches(df: DataFrame, by: list[str], order: list[str], signature: list[str], piece: int = PIECE) -> DataFrame:
    """Rows with ``switched``: whether the signature differs from the phase before.

    The rows are cut into ranges of trace and order, so a trace of any length is pieces; only the first row of a
    piece asks for the last signature of the piece before.
    """
    n = math.ceil(df.count() / piece)
    w = Window.partitionBy("_piece", *by).orderBy(*order)
    last = F.struct(*signature)
    cut = durable(df.repartitionByRange(max(n, 1), *by, *order).withColumn("_piece", F.spark_partition_id()), "pieces")
    inner = cut.repartitionByRange(max(n, 1), "_piece").withColumns({"_before": F.lag(last).over(w), "_end": F.lead(F.lit(True)).over(w).isNull()})
    inner = durable(inner, "phases")
    ends = inner.where("_end").select(*by, "_piece", last.alias("_last"))
    held = ends.withColumn("_held", F.lag("_last").over(Window.partitionBy(*by).orderBy("_piece"))).where("_held is not null")
    held = held.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("_piece").alias("_p"), "_held")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)], F.col("_piece") == F.col("_p"))
    first = inner.where("_before is null").join(held.hint("merge"), same, "left").withColumn("_before", F.col("_held"))
    rows = inner.where("_before is not null").unionByName(first.select(*inner.columns))
    return rows.withColumn("switched", F.col("_before").isNotNull() & ~last.eqNullSafe(F.col("_before"))).select(*df.columns, "switched")


def trace_summary(df: DataFrame, by: list[str], order: list[str], signature: list[str]) -> DataFrame:
    """(by, phases, selects, no_compromise, errors, switches)."""
    s = decision_switches(df.select(*dict.fromkeys([*by, *order, *signature, "decision"])), by, order, signature)
    return s.groupBy(*by).agg(F.count("*").alias("phases"), F.count_if(is_shared_output(F.col("decision"))).alias("selects"), F.count_if(F.col("decision") == "no_compromise").alias("no_compromise"), F.count_if(F.col("decision") == "error").alias("errors"), F.count_if("switched").alias("switches"))


def context_coverage(contexts: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """(key, runs, in_contexts): run counts of contexts, and ids that stand on one side only."""
    n = runs.groupBy(key).agg(F.count("*").alias("runs"))
    return contexts.select(key).distinct().withColumn("in_contexts", F.lit(True)).join(n, key, "full_outer").select(key, F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("in_contexts", F.lit(False)).alias("in_contexts"))


def two_sided_coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, in_a, in_b) of the keys of two tables."""
    return a.select(key).distinct().withColumn("in_a", F.lit(True)).join(b.select(key).distinct().withColumn("in_b", F.lit(True)), key, "full_outer").fillna(False, ["in_a", "in_b"])


def mark_duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("duplicate", F.count("*").over(Window.partitionBy(key)) > 1)


def validate_contracts(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    """(key, missing, duplicate): required fields that are empty, and ids that stand twice."""
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f)) for f in required]))
    return mark_duplicates(df, key).select(key, missing.alias("missing"), "duplicate")


def union_runs(sources: dict[str, DataFrame]) -> DataFrame:
    """All run rows with their source; columns that a source lacks are null."""
    out = None
    for name, df in sources.items():
        part = df.withColumn("run_source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def new_schemas(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.subtract(previous)


def run_report(df: DataFrame, status: str, task: str, fingerprint: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_if(F.col(status) == "ok").alias("ok"), F.count_if(F.col(status) != "ok").alias("errors"), F.countDistinct(task).alias("tasks"), F.countDistinct(fingerprint).alias("fingerprints"))


def score_runs(runs: DataFrame, preds: DataFrame, key: str) -> DataFrame:
    """Runs with their share of right predictions, or the reason why they were skipped."""
    scores = preds.groupBy(key).agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("accuracy"))
    out = runs.join(scores, key, "left")
    reason = F.when(F.col("status") != "ok", F.concat(F.lit("status:"), "status")).when(F.col("accuracy").isNull(), "no_predictions")
    return out.withColumn("skipped", reason).withColumn("accuracy", F.when(F.col("skipped").isNull(), F.col("accuracy")))
