"""Choosing a pipeline for each request: matching, bounds, ranking, the Pareto front.

Candidates have a request, an id, a disclosure vector (MAP<STRING, INT>), costs and priorities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import caps, risk
from . import skyline
from .sizes import dealt, sized
from .tables import durable


def first_per(df: DataFrame, key: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place") <= k)


def residual_failures(vec: Column, bounds: Column, hard: Column, allowed_high: Column, order: str = "selector") -> Column:
    """Attributes whose level is above the bound (no bound allows all).

    ``selector``: attributes allowed to be high are skipped before hard ones are tested; ``planner``: hard
    ones are tested first.
    """
    over = lambda a: F.coalesce(vec[a], F.lit(0)) > F.coalesce(bounds[a], F.lit(4))
    out = []
    for a in risk.ATTRIBUTES:
        is_hard = F.array_contains(hard, a) & (F.coalesce(vec[a], F.lit(0)) > 0)
        skip = F.array_contains(allowed_high, a)
        fails = (F.when(skip, False).otherwise(is_hard | over(a))) if order == "selector" else (is_hard | F.when(skip, False).otherwise(over(a)))
        out.append(F.when(fails, F.lit(a)))
    return F.array_compact(F.array(*out))


def selection_input(candidates: DataFrame, verdicts: DataFrame, probes: DataFrame) -> DataFrame:
    """Candidates with their verdict and the residual of the last probe report, else their own."""
    last = probes.groupBy("candidate").agg(F.max_by("probed", "report").alias("probed"))
    return candidates.join(verdicts, "candidate", "left").join(last, "candidate", "left").withColumn("residual", F.greatest(F.coalesce("probed", F.lit(0)), F.col("declared")))


def pareto_front(df: DataFrame, request: str, key: str, attrs: list[str], block: int = skyline.BLOCK) -> DataFrame:
    """Rows that no other row of their request beats: at most as high everywhere and lower somewhere."""
    return skyline.pareto_front(df, request, attrs, block=block)


def ranking_order(method: str) -> list[Column]:
    """Sort order of candidates with columns risk, lex (array), margin, latency, cost, priority, utility, position; equals stay as they came (``position``)."""
    up, down = F.asc, F.desc
    by_risk = [up("risk"), up("lex"), down("margin"), up("latency"), up("cost"), up("priority")]
    by_utility = [up("priority"), down("margin"), up("latency"), up("cost"), up("risk")]
    orders = {
        "weighted": by_risk,
        "pareto_then_weighted": [up("risk"), down("margin"), up("latency"), up("cost"), up("priority")],
        "utility_aware_weighted": [up("priority"), down("utility"), up("risk"), up("lex"), down("margin"), up("latency"), up("cost")],
        "utility_only": by_utility,
        "no_least_revealing": by_utility,
        "utility_first": by_utility,
        "latency_first": [up("latency"), up("cost"), up("priority"), up("risk")],
        "lexicographic": [up("lex"), down("margin"), up("latency"), up("cost"), up("priority")],
        "first_feasible": [],
    }
    return [*orders.get({"utility_aware": "utility_aware_weighted"}.get(method, method), by_risk), up("position")]


METHODS = ("weighted", "pareto_then_weighted", "utility_aware_weighted", "utility_only", "no_least_revealing", "utility_first", "latency_first", "lexicographic", "first_feasible")


def select_pipeline(df: DataFrame, request: str, method: str = "weighted", levels: list[str] | None = None) -> DataFrame:
    """The best feasible candidate of each request; ``levels`` names the columns of the vector's levels, where the table has them beside ``vec``."""
    df = df.where("feasible")
    if method == "pareto_then_weighted":
        names = levels or [f"_{a}" for a in risk.ATTRIBUTES]
        held = df if levels else df.withColumns({f"_{a}": F.col("vec")[a] for a in risk.ATTRIBUTES})
        df = pareto_front(held, request, "candidate", names).select(*df.columns)
    return first_per(df, [request], ranking_order(method)).drop("place")


# Other names of the selector's ablation modes.
ABLATIONS = {
    "no_ci": "no_ci_filter", "skip_ci": "no_ci_filter", "no_residual": "no_residual_bounds", "no_privacy": "utility_only", "utility": "utility_only", "first": "first_feasible",
    "no_context_weights": "uniform_risk_weights", "no_context_specific_weights": "uniform_risk_weights", "no_probes": "metadata_only", "no_probe_residuals": "metadata_only",
}


def ablation_modes(modes: str | list[str] | None) -> list[str]:
    """The modes by their own names, each once; ``full`` is none."""
    given = [modes] if isinstance(modes, str) else list(modes or [])
    named = {ABLATIONS.get(m, m) for m in (str(x).strip().lower() for x in given)}
    return sorted(named - {"", "full"})


def default_method(configured: Column, policy: Column, model: Column, family: Column, flexible: Column) -> Column:
    """The method that a request asks for: the configured one, its policy's, by utility if it takes several outputs, else weighted."""
    several = (model == "multi_representation_utility_contract") | (family == "flexible_multi_output_app_request") | flexible
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(configured), some(policy), F.when(F.coalesce(several, F.lit(False)), "utility_aware_weighted"), F.lit("weighted"))


def ablated(df: DataFrame, modes: list[str]) -> DataFrame:
    """Candidates with ``feasible`` and ``risk`` under the modes.

    ``df``: ci_ok, bounds_ok and declared_bounds_ok (bounds by the probed and by the declared vector), vec and declared
    (vectors), weights (MAP).
    """
    on = set(modes)
    declared = "metadata_only" in on
    ci = F.lit(True) if on & {"no_ci_filter", "utility_only"} else F.col("ci_ok")
    bounds = F.lit(True) if on & {"no_residual_bounds", "utility_only"} else F.col("declared_bounds_ok" if declared else "bounds_ok")
    weights = None if "uniform_risk_weights" in on else F.col("weights")
    vec = F.col("declared" if declared else "vec")
    return df.withColumns({"feasible": ci & bounds, "vec": vec, "risk": risk.risk_score(vec, weights), "lex": risk.lex_key(vec)})


def select_by_request(df: DataFrame, request: str, method: str = "method", modes: list[str] | None = None) -> DataFrame:
    """The best feasible candidate of each request by the request's own method, which some ablation modes replace; a method of another name is weighted."""
    for mode in ("utility_only", "no_least_revealing", "first_feasible", "latency_first"):
        if mode in (modes or []):
            return select_pipeline(df, request, mode).withColumn(method, F.lit(mode))
    named = F.when(F.col(method) == "utility_aware", "utility_aware_weighted").when(F.col(method).isin(*METHODS), F.col(method)).otherwise("weighted")
    out = None
    for m in METHODS:
        part = select_pipeline(df.where(named == m), request, m)
        out = part if out is None else out.unionByName(part)
    return out


def pipeline_cost(operators: Column) -> Column:
    """Sources and publishing cost 0.1 each, adapters and drops 0.25, other operators 1."""
    one = lambda o: F.when(o.isin("op.source", "op.route_publish"), 0.1).when(o.isin("op.schema_adapter", "op.drop_discard"), 0.25).otherwise(1.0)
    return F.aggregate(operators, F.lit(0.0), lambda acc, o: acc + one(o))


# Tiers and roles of outputs.
TIERS = {"high": 5, "medium_high": 4, "medium": 3, "low_medium": 2, "low": 1, "very_low": 0, "very_low_payload_high_semantic": 1, "low_payload_high_semantic": 1}
ROLES = {"fixed_downstream_input": 4.0, "fixed_downstream_input_with_hub_or_app_pose_extractor": 3.5, "format_preserving_redaction": 3.5, "reusable_perceptual_primitive": 3.0, "aggregate_primitive": 2.0, "coarse_event_primitive": 1.5, "coarse_noise_primitive": 1.5, "aggregate_summary": 1.0, "final_task_decision_boundary": 0.5}


def symbolic_utility(priority: Column, role: Column, tier: Column) -> Column:
    lookup = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.greatest(F.lit(0.0), 10.0 - F.coalesce(priority.cast("double"), F.lit(999.0))) + F.coalesce(lookup(ROLES)[role], F.lit(2.0)) + 0.15 * F.coalesce(lookup(TIERS)[tier], F.lit(2))


def utility_margin(has_capability: Column, quality: Column) -> Column:
    return F.when(has_capability, 1.0).otherwise(0.0) + F.when(quality == "validated", 1.0).when(quality == "requires_runtime_or_benchmark_validation", 0.25).otherwise(0.0)


def quality_status(requirements: Column) -> Column:
    return F.when(F.exists(F.map_values(requirements), lambda v: v.isNotNull()), "requires_runtime_or_benchmark_validation").otherwise("no_requirement")


# Terms that the last boundary can add, so that no operator need have made them.
CONTRACT_ONLY = ("purpose_limited", "limited_retention", "authorized_personnel_only", "recipient_limited", "access_controlled")


def match_accepted(states: DataFrame, accepted: DataFrame, request: str) -> DataFrame:
    """The best accepted output of each state.

    Scores: type and schema equal (0), type (1), schema (2), a type that the goal takes too (10).  The output's
    properties must have the accepted scalars, the request's checkpoint must have one of the values that each
    condition names, and the required terms, but for CONTRACT_ONLY, must be among the state's.  Ties: more required
    terms, priority (999 if none), position.

    ``states``: state, s_type, s_schema, terms, properties MAP, checkpoint MAP<STRING, ARRAY> (lower case).
    ``accepted``: a_type, a_schema, required, wanted MAP, conditions MAP<STRING, ARRAY>, priority, position.
    """
    pairs = states.join(accepted.hint("merge"), request)
    required = F.array_except("required", F.array(*map(F.lit, CONTRACT_ONLY)))
    scalars = F.forall(F.map_entries(F.coalesce("wanted", F.create_map().cast("map<string,string>"))), lambda e: F.coalesce(F.col("properties")[e["key"]] == e["value"], F.lit(False)))
    held = F.forall(F.map_entries(F.coalesce("conditions", F.create_map().cast("map<string,array<string>>"))), lambda e: F.coalesce(F.arrays_overlap(F.col("checkpoint")[e["key"]], e["value"]), F.lit(False)))
    score = caps.goal_score(F.col("s_type"), F.col("s_schema"), F.col("a_type"), F.col("a_schema"))
    pairs = pairs.withColumn("score", score).withColumn("n_terms", F.size(required)).where(F.col("score").isNotNull() & scalars & held & (F.size(F.array_except(required, F.col("terms"))) == 0))
    return first_per(pairs, [request, "state"], [F.asc("score"), F.desc("n_terms"), F.asc(F.coalesce("priority", F.lit(999))), F.asc("position")]).drop("place")


def _inferred(key: Column) -> Column:
    """An output's property: as declared, else what its type, components and transforms tell (``type``, ``properties``, ``components``, ``terms``)."""
    any_of = lambda column, *xs: F.arrays_overlap(F.coalesce(column, F.array().cast("array<string>")), F.array(*map(F.lit, xs)))
    truth = lambda c: F.when(c, "true").otherwise("false")
    kind, parts, terms = F.col("s_type"), F.col("components"), F.col("terms")
    redacted = any_of(parts, "image/x-redacted", "video/x-redacted") | any_of(terms, "face_blurred", "identity_removed", "visible_text_removed", "screen_content_removed", "body_blurred")
    filtered = any_of(parts, "audio/x-filtered") | F.coalesce(kind == "audio/x-filtered", F.lit(False)) | any_of(terms, "speech_content_removed", "speech_content_minimized")
    joint = F.coalesce(kind == "application/x-youhome-av-sample", F.lit(False)) | F.coalesce(F.col("properties")["av_synchronized"] == "true", F.lit(False))
    told = F.when(key == "youhome_av_compatible", truth(joint)).when(key.isin("visual_redacted", "redacted"), truth(redacted)).when(key.isin("speech_content_removed", "audio_filtered"), truth(filtered))
    return F.when(F.map_contains_key("properties", key), F.col("properties")[key]).otherwise(told)


def match_accepted_policy(states: DataFrame, accepted: DataFrame, rejected: DataFrame, request: str) -> DataFrame:
    """The accepted output that describes each state best; an explicitly rejected type or schema, taken exactly, voids all.

    An accepted output is asked only where its conditions hold for the state's checkpoint, none of its ``forbidden``
    transformations is among the state's terms, and its scalars are the output's properties (declared or inferred;
    ``true`` and ``false`` ask for a property that is set or not).  ``fit`` is 3 for an equal type with no other schema,
    2 for an equal schema, 1 for a type that the goal takes.  Ties: more properties, priority (999 if none), position.

    Columns as for ``match_accepted``; ``components`` of states and ``forbidden`` of accepted outputs may be absent.
    """
    strings = "array<string>"
    if "components" not in states.columns:
        states = states.withColumn("components", F.array().cast(strings))
    if "forbidden" not in accepted.columns:
        accepted = accepted.withColumn("forbidden", F.array().cast(strings))
    states = states.withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))
    by_type = states.join(rejected.where("r_type is not null").select(request, F.col("r_type").alias("s_type")).hint("merge"), [request, "s_type"], "left_anti")
    allowed = by_type.join(rejected.where("r_schema is not null").select(request, F.col("r_schema").alias("s_schema")).hint("merge"), [request, "s_schema"], "left_anti")
    pairs = allowed.join(accepted.hint("merge"), request)
    wanted = F.coalesce("wanted", F.create_map().cast("map<string,string>"))
    is_set = lambda c: F.coalesce(~c.isin("", "false", "0"), F.lit(False))
    meets = lambda e: F.when(e["value"].isin("true", "false"), is_set(_inferred(e["key"])) == (e["value"] == "true")).otherwise(F.coalesce(_inferred(e["key"]) == e["value"], F.lit(False)))
    held = F.forall(F.map_entries(F.coalesce("conditions", F.create_map().cast("map<string,array<string>>"))), lambda e: F.coalesce(F.arrays_overlap(F.col("checkpoint")[e["key"]], e["value"]), F.lit(False)))
    spared = ~F.arrays_overlap(F.coalesce("forbidden", F.array().cast(strings)), F.coalesce("terms", F.array().cast(strings)))
    pairs = pairs.where(F.forall(F.map_entries(wanted), meets) & held & spared)
    o, g = caps.canon_type(F.col("s_type")), caps.canon_type(F.col("a_type"))
    up, goal = (F.coalesce(x, F.lit("")) for x in ("s_schema", "a_schema"))
    same_schema = (up != "") & (up == goal)
    takes = (g == "") | (g == "*") | ((o != "") & ((o == g) | caps.in_pairs(o, g, caps.type_pairs())))
    fit = F.when((o != "") & (o == g) & ((up == "") | (goal == "") | same_schema), 3).when(same_schema, 2).when(takes & ((F.coalesce("a_type", F.lit("")) != "")), 1)
    pairs = pairs.withColumn("fit", fit).withColumn("n_wanted", F.size(wanted)).where("fit is not null")
    order = [F.desc("fit"), F.desc("n_wanted"), F.asc(F.coalesce("priority", F.lit(999))), F.asc("position")]
    return first_per(pairs, [request, "state"], order).drop("place", "n_wanted")


def order_candidates(df: DataFrame, request: str) -> DataFrame:
    """Candidates once each, with their place by residual, priority and number of operators."""
    once = first_per(df, [request, "candidate"], [F.asc("residual"), F.asc("priority"), F.asc("n_ops")]).drop("place")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(request).orderBy("residual", "priority", "n_ops", "candidate")))


def selection_sensitivity(df: DataFrame, request: str) -> DataFrame:
    """(request, chosen, by_sum, by_high, changed): whether the plain sum or the fewest high levels choose another; requests with two or more."""
    agg = df.groupBy(request).agg(F.count("*").alias("n"), F.min_by("candidate", F.struct("risk", "candidate")).alias("chosen"), F.min_by("candidate", F.struct("plain", "candidate")).alias("by_sum"), F.min_by("candidate", F.struct("n_high", "plain", "candidate")).alias("by_high"))
    return agg.where("n >= 2").withColumn("changed", (F.col("chosen") != F.col("by_sum")) | (F.col("chosen") != F.col("by_high")))


def diverse_shortlist(df: DataFrame, request: str, k: int) -> DataFrame:
    """k candidates of each request: the best of each output bucket, then by residual.

    The k of the least residual are there, so no other rule is ever asked; of a bucket its first k are enough.
    """
    bucket = F.row_number().over(Window.partitionBy(request, "bucket").orderBy("residual", "candidate"))
    held = dealt(df, request).withColumn("_b", bucket).where(F.col("_b") <= k)
    return first_per(held, [request], [F.col("_b") > 1, F.asc("residual"), F.asc("candidate")], k).drop("_b")


def allowed_sources(has: Column, allowed: Column, forbidden: Column) -> Column:
    """Whether a source's contents may be used: forbidden content first; an audio-video container needs av or both parts; otherwise only with an allow-list that names it, or none."""
    av = F.array_contains(has, "av") & ~(F.array_contains(allowed, "av") | (F.array_contains(allowed, "visual") & F.array_contains(allowed, "audio")))
    return F.when(F.arrays_overlap(has, forbidden), False).when(F.size(allowed) == 0, True).when(F.array_contains(has, "av"), ~av).otherwise(F.arrays_overlap(has, allowed))


def expand_paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, path): operator chains along edges (a, b) of up to ``depth`` operators, none twice.

    The chains of each length are written once and only they are prolonged.
    """
    edges = edges.select("a", "b")
    level = durable(starts.select("start", F.array("start").alias("path"), F.col("start").alias("a")), "paths")
    out = level
    for _ in range(depth - 1):
        grown = level.join(edges.hint("merge"), "a").where(~F.array_contains("path", F.col("b")))
        level = durable(grown.select("start", F.array_append("path", F.col("b")).alias("path"), F.col("b").alias("a")), "paths")
        out = out.unionByName(level)
    return out.select("start", "path")


def expand_steps(steps: DataFrame, starts: DataFrame, depth: int = 7) -> DataFrame:
    """(start, path, type, schema): chains of operators along steps (``caps.compatible_steps``) from the outputs ``starts`` (op, type, schema).

    A chain goes on from the output that its last operator has made, so an operator with several outputs is several
    chains; no operator stands in a chain twice, the schema adapter included.  ``type`` and ``schema`` are those of the
    chain's output.  The steps are written once, and so are the chains of each length, of which only those are prolonged.
    """
    output = lambda *cs: F.xxhash64(*[F.coalesce(F.col(x), F.lit("")) for x in cs])
    steps = durable(steps.withColumn("at", output("a", "a_type", "a_schema")), "steps")
    first = starts.select(F.col("op").alias("start"), F.array("op").alias("path"), "type", "schema", output("op", "type", "schema").alias("at")).distinct()
    level = durable(first, "chains")
    out = level
    for _ in range(depth - 1):
        grown = level.select("start", "path", "at").join(steps.hint("merge"), "at").where(~F.array_contains("path", F.col("b")))
        grown = grown.select("start", F.array_append("path", F.col("b")).alias("path"), F.col("b_type").alias("type"), F.col("b_schema").alias("schema"), output("b", "b_type", "b_schema").alias("at"))
        level = durable(grown.distinct(), "chains")
        out = out.unionByName(level)
    return out.drop("at")


def overlay_context(requests: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Each scenario on its task's request: ids suffixed, the scenario's fields replace the request's, tags appended once."""
    r, s = requests.alias("r"), scenarios.alias("s")
    return r.join(s, "task").select(F.concat_ws("__", "r.request", "s.scenario").alias("request"), "task", F.coalesce("s.space", "r.space").alias("space"), F.coalesce("s.purpose", "r.purpose").alias("purpose"), F.coalesce("s.principle", F.lit("assumed")).alias("principle"), F.array_union("r.tags", "s.tags").alias("tags"))


def run_matrix(scenarios: DataFrame, methods: DataFrame) -> DataFrame:
    """Every scenario with every method; methods are a short list of names."""
    return scenarios.crossJoin(sized(methods))


def no_compromise(rejected: DataFrame, request: str, k: int = 10) -> DataFrame:
    """(request, n, reasons, primary, closest) of requests whose candidates all failed: counts by reason, the commonest, the k closest by risk."""
    by = rejected.groupBy(request, "reason").agg(F.count("*").alias("n"))
    reasons = by.groupBy(request).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("reason", "n"))).alias("reasons"), F.min_by("reason", F.struct(-F.col("n"), F.col("reason"))).alias("primary"))
    near = first_per(rejected, [request], [F.asc("risk"), F.asc("n_failures"), F.asc("candidate")], k)
    return reasons.join(near.groupBy(request).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "candidate"))), lambda x: x["candidate"]).alias("closest")), request)
