"""Ordinal disclosure levels, vectors of them over attributes, and their scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The levels in order, the attributes, and their weights.
LEVELS = ("none", "low", "medium", "high", "unknown")
ATTRIBUTES = ("identity", "face", "body_shape", "clothing", "gait", "speech_content", "speaker_identity", "activity", "location", "trajectory", "co_presence", "visible_text", "aggregate_presence")
PLANNER_WEIGHTS = {"identity": 3, "face": 2, "speech_content": 3, "speaker_identity": 3, "trajectory": 2, "visible_text": 2}
DEFAULT_WEIGHTS = {"identity": 5.0, "face": 4.0, "body_shape": 2.0, "clothing": 2.0, "gait": 3.0, "speech_content": 5.0, "speaker_identity": 5.0, "activity": 2.0, "location": 2.0, "trajectory": 4.0, "co_presence": 3.0, "visible_text": 4.0, "aggregate_presence": 1.0}
LEX_ORDER = ("identity", "speech_content", "speaker_identity", "face", "visible_text", "trajectory", "gait", "body_shape", "clothing", "co_presence", "activity", "location", "aggregate_presence")


def level_name(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), level + 1)


def level_of(name: Column) -> Column:
    """Ordinal of an exact level name, else null."""
    return F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), name), F.lit(0)) - 1


def _phrase(text: Column) -> Column:
    s = F.lower(F.trim(text))
    has = lambda x: s.contains(x)
    return (
        F.when(text.isNull(), "unknown").when(s.isin(*LEVELS), s)
        .when(has("unknown"), "unknown").when(has("high"), "high").when(has("medium"), "medium").when(has("low"), "low")
        .when(has("none") | has("removed") | has("absent"), "none").otherwise("unknown")
    )


def norm_risk(col: Column, variant: str = "planner") -> Column:
    """Level name of a phrase or a number.

    ``planner``: numbers by ceiling, phrases by the worst level they name, null unknown.  ``rules``: the
    same without numbers.  ``analytics``: numbers rounded half-even, the worst of listed parts, null stays.
    """
    if variant == "rules":
        return _phrase(col)
    number = col.cast("string").try_cast("double")
    if variant == "planner":
        by_number = F.when(number <= 0, "none").when(number <= 1, "low").when(number <= 2, "medium").when(number <= 3, "high").otherwise("unknown")
        return F.when(number.isNotNull(), by_number).otherwise(_phrase(col.cast("string")))
    whole = F.bround(number, 0).cast("int")
    parts = F.filter(F.split(F.lower(F.trim(col.cast("string"))), r"[/,;| ]+"), lambda p: p.isin(*LEVELS))
    worst = level_name(F.array_max(F.transform(parts, level_of)).cast("int"))
    return F.when(number.isNotNull(), F.when(whole.between(0, 4), level_name(whole)).otherwise("unknown")).when(F.trim(col.cast("string")) == "", None).when(col.isNotNull(), F.coalesce(worst, F.lit("unknown")))


def risk_max(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def risk_min(a: Column, b: Column) -> Column:
    return F.least(a, b)


def risk_dec(level: Column, steps: int = 1) -> Column:
    return F.greatest(F.lit(0), level - steps)


def reduce_risk(level: Column, rule: Column) -> Column:
    """A level after a reduction rule in words; the order of the tests matters."""
    s = F.lower(rule)
    has = lambda *xs: reduce(lambda a, b: a | b, [s.contains(x) for x in xs])
    return (
        F.when(has("to_none") & has("or_low", "or low"), 1).when(has("to_none"), 0).when(has("to_low"), 1)
        .when(has("by_1_or_2"), risk_dec(level)).when(has("by_2"), risk_dec(level, 2))
        .when(has("by_1", "downsampling", "minimization", "generalization", "aggregation", "if_text_regions_excluded"), risk_dec(level))
        .when(has("depends", "may"), level).otherwise(risk_dec(level))
    )


def vector(levels: dict[str, Column]) -> Column:
    """Map attribute -> level; attributes that are not given are none."""
    return F.create_map(*[x for a in ATTRIBUTES for x in (F.lit(a), F.coalesce(levels.get(a, F.lit(0)), F.lit(0)).cast("int"))])


def weight_map(weights: dict[str, float], default: float = 1.0) -> Column:
    return F.create_map(*[x for a in ATTRIBUTES for x in (F.lit(a), F.lit(float(weights.get(a, default))))])


def risk_score(vec: Column, weights: Column | None = None) -> Column:
    """Weighted sum of levels; without weights the plain sum.  A missing level counts as unknown."""
    w = (lambda k: F.coalesce(weights[k], F.lit(1.0))) if weights is not None else (lambda k: F.lit(1.0))
    levels = F.map_values(vec)  # of a vector as ``vector`` makes it, which is summed up without a lambda
    known = reduce(lambda acc, i: acc + w(F.lit(ATTRIBUTES[i])) * F.coalesce(F.get(levels, F.lit(i)), F.lit(4)), range(len(ATTRIBUTES)), F.lit(0.0))
    other = F.aggregate(F.map_entries(vec), F.lit(0.0), lambda acc, e: acc + w(e["key"]) * F.coalesce(e["value"], F.lit(4)))
    return F.when(F.map_keys(vec) == F.array(*map(F.lit, ATTRIBUTES)), known).otherwise(other)


def levels_score(levels: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """``risk_score`` of a vector whose levels are columns; no map is built."""
    return reduce(lambda acc, a: acc + F.lit(float((weights or {}).get(a, 1.0))) * F.coalesce(levels[a], F.lit(4)), ATTRIBUTES, F.lit(0.0))


def lex_key(vec: Column, order: tuple[str, ...] = LEX_ORDER) -> Column:
    return F.array(*[F.coalesce(vec[a], F.lit(0)) for a in order])


RESETS = ("drop_unmentioned", "remove_all_for_this_branch")


def apply_effects(vec: Column, effects: Column) -> Column:
    """Folds operators' effects over a vector.

    An effect is struct<policy string, set map<string,string>, remove array<string>, reduce map<string,string>,
    add map<string,string>>; drop_unmentioned and remove_all_for_this_branch first reset every level.
    """

    def one(acc: Column, e: Column) -> Column:
        reset = e["policy"].isin(*RESETS)

        def level(k: Column, v: Column) -> Column:
            v = F.when(reset, F.lit(0)).otherwise(v)
            v = F.coalesce(F.when(e["set"][k].isNotNull(), level_of(norm_risk(e["set"][k])).cast("int")), v)
            v = F.when(F.array_contains(e["remove"], k), F.lit(0)).otherwise(v)
            v = F.when(e["reduce"][k].isNotNull(), reduce_risk(v, e["reduce"][k])).otherwise(v)
            return F.when(e["add"][k] == "may_increase", F.greatest(v, F.lit(2))).otherwise(v)

        return F.transform_values(acc, level)

    return F.aggregate(effects, vec, one)


def _authored(effect: dict, attribute: str, v: Column) -> Column:
    """The level ``v`` of an attribute after an authored effect: only what the effect says of it becomes part of the plan."""
    said = {k: (effect.get(k) or {}).get(attribute) for k in ("set", "reduce", "add")}
    if effect.get("policy") in RESETS:
        v = F.lit(0)
    if said["set"] is not None:
        v = F.coalesce(level_of(norm_risk(F.lit(said["set"]))).cast("int"), v)
    if attribute in (effect.get("remove") or ()):
        v = F.lit(0)
    if said["reduce"] is not None:
        v = reduce_risk(v, F.lit(said["reduce"]))
    return F.greatest(v, F.lit(2)) if said["add"] == "may_increase" else v


def apply_authored_effects(df: DataFrame, levels: dict[str, str], operators: list[list[tuple[Column, dict]]]) -> DataFrame:
    """``apply_effects`` where the vector's levels are columns (attribute -> column) and effects are authored: a projection an operator, without maps and lambdas.

    An operator is a list of (condition, effect as a dict of the struct's fields); the first condition that holds tells its
    effect, and without one nothing changes.  Conditions must not depend on the levels.
    """
    for effects in operators:
        after = {}
        for a, c in levels.items():
            v = F.col(c)
            for condition, effect in reversed(effects):
                v = F.when(condition, _authored(effect, a, F.col(c))).otherwise(v)
            after[c] = v.cast("int")
        df = df.withColumns(after)
    return df


# Weights that purposes set, in order, and the groups that add one.
PURPOSE_WEIGHTS = (
    (("energy_management", "comfort_automation", "occupancy_estimation"), {"identity": 7.0, "face": 6.0, "speech_content": 7.0, "speaker_identity": 7.0, "trajectory": 6.0, "visible_text": 5.0, "aggregate_presence": 0.5, "activity": 1.5, "location": 1.5}),
    (("safety_monitoring", "fall_detection", "elder_care"), {"identity": 6.0, "face": 5.0, "speech_content": 6.0, "speaker_identity": 6.0, "visible_text": 5.0, "activity": 1.5, "gait": 2.5, "body_shape": 2.0}),
    (("security_monitoring", "intrusion_detection", "incident_investigation"), {"identity": 4.0, "face": 3.5, "activity": 1.5, "location": 1.5, "trajectory": 4.0, "speech_content": 6.0, "visible_text": 4.0}),
)
SOCIAL_TAGS = ("guests_present", "bystanders_present", "weak_preference_channel")
SOCIAL_ATTRIBUTES = ("identity", "face", "speech_content", "speaker_identity", "trajectory", "co_presence", "visible_text")
PRIVATE_CONTEXTS = ("home", "private_home", "short_term_rental", "hospital_or_clinic", "school_or_classroom")
PRIVATE_ATTRIBUTES = ("identity", "speech_content", "speaker_identity", "visible_text")


def context_weights(purposes: Column, contexts: Column, social: Column, uniform: bool = False) -> Column:
    """Map of weights of a request: purposes overwrite in order, then tags and private contexts add one."""
    if uniform:
        return weight_map({}, 1.0)
    overlap = lambda col, xs: F.coalesce(F.arrays_overlap(col, F.array(*map(F.lit, xs))), F.lit(False))
    out = []
    for a in ATTRIBUTES:
        w = F.lit(DEFAULT_WEIGHTS[a])
        for names, values in PURPOSE_WEIGHTS:
            if a in values:
                w = F.when(overlap(purposes, names), values[a]).otherwise(w)
        if a in SOCIAL_ATTRIBUTES:
            w = w + F.when(overlap(social, SOCIAL_TAGS), 1.0).otherwise(0.0)
        if a in PRIVATE_ATTRIBUTES:
            w = w + F.when(overlap(contexts, PRIVATE_CONTEXTS), 1.0).otherwise(0.0)
        out += [F.lit(a), w]
    return F.create_map(*out)
