"""Information flows against rules: matching, verdicts, required and forbidden terms.

Flows are wide rows of ``ARRAY<STRING>`` columns; a nested field is named by its dotted path.  Rules are two
tables: ``effects`` (rule_id, action, stages, tags) and ``conditions`` (rule_id, part, field, op, terms).
``part`` is ``match``, ``unless`` or ``require``; ``op`` is ``anyOf``, ``allOf``, ``noneOf``, or ``present`` and
``absent`` without terms.  ``read_rules`` makes both from authored documents.

``compile_rules`` writes two durable tables once.  The index has, for each field and term, the bits it sets: one for
each condition it meets (for each term of an ``allOf``), and one for each rule that need not be looked at unless this
term is there.  A flow's terms meet the index by an equi-join, its bits are united in one shuffle by flow, and the rules
whose own bit is set are tested against the flow's words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import near, sized
from .tables import durable

STAGES = ("raw_input", "intermediate_representation", "output_to_application", "retained_artifact")
EMPTY = "array<string>"
SOME = "\u0000some"  # stands in every field that is not empty
REQUIRING = ("REQUIRE_CONDITION", "REQUIRE_TRANSFORMATION", "ALLOW_IF")


def listed(text: Column) -> Column:
    """A JSON text as a list of texts; a scalar is a list of one."""
    return F.when(text.startswith("["), F.from_json(text, EMPTY)).otherwise(F.array(text))


def document_conditions(documents: DataFrame, depth: int = 3) -> DataFrame:
    """(rule_id, part, field, op, terms) of JSON objects {field: condition}, rows (rule_id, part, op, json).

    A condition is a list or scalar (by ``op``), an object with one of the three operators, or an object of
    conditions on nested fields.  In ``unless`` true and false ask for a field that is there or not.
    """
    as_map = lambda c: F.from_json(c, "map<string,string>")
    operator = lambda m: F.when(F.map_contains_key(m, "anyOf"), "anyOf").when(F.map_contains_key(m, "allOf"), "allOf").when(F.map_contains_key(m, "noneOf"), "noneOf")
    level = documents.select("rule_id", "part", "op", F.explode(as_map(F.col("json"))).alias("field", "c"))
    for _ in range(depth - 1):
        m = as_map(F.col("c"))
        nested = F.col("c").startswith("{") & operator(m).isNull()
        inner = F.transform(F.map_entries(m), lambda e: F.struct(F.concat_ws(".", "field", e["key"]).alias("field"), e["value"].alias("c")))
        each = F.explode(F.when(nested, inner).otherwise(F.array(F.struct("field", "c")))).alias("e")
        level = level.select("rule_id", "part", "op", each).select("rule_id", "part", "op", "e.*")
    m = as_map(F.col("c"))
    given = F.when(F.col("c").startswith("{"), operator(m))
    flag = (F.col("part") == "unless") & F.col("c").isin("true", "false")
    ops = F.when(flag, F.when(F.col("c") == "true", "present").otherwise("absent")).otherwise(F.coalesce(given, F.col("op")))
    terms = F.when(flag, F.array().cast(EMPTY)).when(given.isNotNull(), listed(m[given])).otherwise(listed(F.col("c")))
    return level.select("rule_id", "part", "field", ops.alias("op"), terms.alias("terms"))


def read_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conditions, effects) of authored rules; template rules are left out.

    ``rules``: rule_id, action, match, unless, required, forbidden (JSON objects as texts), transformations,
    stages, tags (arrays), source_type.
    """
    real = rules.where(~F.coalesce(F.col("source_type") == "created_template", F.lit(False)) & ~F.col("rule_id").startswith("template_"))
    asks = F.col("action").isin("REQUIRE_CONDITION", "ALLOW_IF")
    part = lambda name, op, json: F.struct(F.lit(name).alias("part"), F.lit(op).alias("op"), json.alias("json"))
    done = F.when((F.col("action") == "REQUIRE_TRANSFORMATION") & (F.size("transformations") > 0), F.to_json(F.create_map(F.lit("_done"), F.col("transformations"))))
    parts = F.array(
        part("match", "anyOf", F.col("match")), part("unless", "anyOf", F.col("unless")), part("require", "allOf", F.when(asks, F.col("required"))),
        part("require", "noneOf", F.when(asks, F.col("forbidden"))), part("require", "allOf", done),
    )
    conditions = document_conditions(real.select("rule_id", F.inline(parts)))
    empty = F.array().cast(EMPTY)
    effects = real.select("rule_id", "action", F.coalesce("stages", empty).alias("stages"), F.coalesce("tags", empty).alias("tags"))
    return conditions, effects


CHUNK = 2048  # conditions that one pass over the flows holds as bits, about
EVERY = ""  # the field of a term that every flow has


@dataclass
class RuleIndex:
    """Compiled rules: ``terms`` (chunk, field, term, bits) and ``rules`` (chunk, number, rule_id and tests), both durable.

    ``chunks``: (chunk, group, words of conditions, words of rules), a row a chunk.
    """

    terms: DataFrame
    rules: DataFrame
    chunks: list[tuple[int, int, int, int]]
    small: bool


PARTS = ("match", "unless", "require")


def compile_rules(rules: DataFrame, conditions: DataFrame, chunk: int = CHUNK) -> RuleIndex:
    """The index of the rules (rule_id, group); rules of different groups never share a chunk.

    Rules are authored, so their tables are one partition each: numbering and grouping them moves nothing.
    """
    rules, conditions = rules.coalesce(1), conditions.coalesce(1)
    op = F.when(F.col("op") == "present", "anyOf").when(F.col("op") == "absent", "noneOf").otherwise(F.col("op"))
    terms = F.when(F.col("op").isin("present", "absent"), F.array(F.lit(SOME))).otherwise(F.array_distinct("terms"))
    c = conditions.select("rule_id", "part", "field", op.alias("op"), terms.alias("terms")).where((F.col("op") == "anyOf") | (F.size("terms") > 0))
    # an atom is one bit: a condition that one of its terms meets, or one term of those that must all be there
    atom = lambda ts: F.struct("part", (F.col("op") == "noneOf").alias("bad"), "field", ts.alias("terms"))
    atoms = F.when(F.col("op") == "allOf", F.transform("terms", lambda t: atom(F.array(t)))).otherwise(F.array(atom(F.col("terms"))))
    by = c.groupBy("rule_id").agg(F.array_distinct(F.flatten(F.collect_list(atoms))).alias("atoms"))
    by = rules.select("rule_id", "group").distinct().join(by.hint("shuffle_hash"), "rule_id", "left")
    by = by.withColumn("atoms", F.coalesce("atoms", F.array().cast(dict(by.dtypes)["atoms"])))
    # the authored rules in order; a chunk's numbers start at 0
    before = F.coalesce(F.sum(F.size("atoms")).over(Window.partitionBy("group").orderBy("rule_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = by.withColumn("part_of", F.floor(before / chunk).cast("int"))
    by = by.withColumn("chunk", F.dense_rank().over(Window.orderBy("group", "part_of")) - 1)
    own = Window.partitionBy("chunk").orderBy("rule_id")
    by = by.withColumn("number", F.row_number().over(own) - 1)
    by = by.withColumn("start", F.coalesce(F.sum(F.size("atoms")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    place = lambda n: F.struct(F.floor(n / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(n, F.lit(64)).cast("int")).alias("mask"))
    numbered = F.transform("atoms", lambda a, i: F.struct(a["part"].alias("part"), a["bad"].alias("bad"), a["field"].alias("field"), a["terms"].alias("terms"), place(F.col("start") + i).alias("at")))
    by = durable(by.select("chunk", "group", "number", "rule_id", "start", numbered.alias("atoms")), "rules")
    test = lambda p, bad: F.transform(F.filter("atoms", lambda a: (a["part"] == p) & (a["bad"] == F.lit(bad))), lambda a: a["at"])
    tests = [test(p, bad).alias(f"{'none' if bad else 'all'}_{p}") for p in PARTS for bad in (False, True)]
    table = by.select("chunk", "number", "rule_id", *tests, F.exists("atoms", lambda a: a["part"] == "unless").alias("has_unless"))
    # bits below 0 are those of rules: a rule is looked at where its first match condition is met, or everywhere
    first = F.get(F.filter("atoms", lambda a: (a["part"] == "match") & ~a["bad"]), F.lit(0))
    rule = place(F.col("number"))
    looked = F.struct(F.coalesce(first["field"], F.lit(EVERY)).alias("field"), F.coalesce(first["terms"], F.array(F.lit(EVERY))).alias("terms"), (-1 - rule["word"]).alias("word"), rule["mask"].alias("mask"))
    met = F.transform("atoms", lambda a: F.struct(a["field"].alias("field"), a["terms"].alias("terms"), a["at"]["word"].alias("word"), a["at"]["mask"].alias("mask")))
    bits = by.select("chunk", F.inline(F.array_append(met, looked))).select("chunk", "field", F.explode("terms").alias("term"), "word", "mask")
    bits = bits.groupBy("chunk", "field", "term", "word").agg(F.bit_or("mask").alias("mask"))
    index = durable(bits.groupBy("chunk", "field", "term").agg(F.collect_list(F.struct("word", "mask")).alias("bits")), "index")
    held = by.groupBy("chunk", "group").agg(F.max(F.col("start") + F.size("atoms")).alias("bits"), F.count("*").alias("n")).orderBy("chunk").collect()
    chunks = [(r.chunk, r.group, -(-r.bits // 64), -(-r.n // 64)) for r in held]
    return RuleIndex(index, table, chunks, sum(r.bits + r.n for r in held) <= 100_000)


def flow_terms(flows: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(key, field, term): the terms of each field of a flow; a field that is not empty has the term SOME too, and a flow the term EVERY."""
    held = lambda c: F.coalesce(c, F.array().cast(EMPTY))
    field = lambda n, ts: F.struct(F.lit(n).alias("field"), ts.alias("terms"))
    each = [field(n, F.when(F.size(held(c)) > 0, F.array_append(held(c), SOME)).otherwise(held(c))) for n, c in fields.items()]
    return flows.select(key, F.explode(F.array(field(EVERY, F.array(F.lit(EVERY))), *each)).alias("x")).select(key, "x.field", F.explode("x.terms").alias("term"))


def _holds(words: Column, part: str) -> Column:
    bit = lambda a: F.get(words, a["word"]).bitwiseAND(a["mask"]) != 0
    return F.forall(f"all_{part}", bit) & ~F.exists(f"none_{part}", bit)


def rule_states(terms: DataFrame, index: RuleIndex, key: str, group: int) -> DataFrame:
    """(key, rule_id, applies, met): the flows whose ``match`` conditions all hold, whether the rule applies to
    them (not all of its ``unless`` conditions hold, if it has any), and whether all ``require`` conditions hold.

    ``terms``: (key, field, term) of the flows, each flow with the term EVERY of the field EVERY; repeated rows do no harm.
    """
    out = None
    for chunk, own, n_words, n_rules in index.chunks:
        if own != group:
            continue
        # the sizes of both tables follow from the authored rules, which have been counted
        put = near(index.small)
        bits = terms.join(put(index.terms.where(F.col("chunk") == chunk).drop("chunk")), ["field", "term"]).select(key, F.inline("bits"))
        word = lambda k: F.coalesce(F.bit_or(F.when(F.col("word") == k, F.col("mask"))), F.lit(0).cast("long"))
        held = [word(k).alias(f"w{k}") for k in range(n_words)] + [word(-1 - k).alias(f"r{k}") for k in range(n_rules)]
        flows = bits.groupBy(key).agg(*held)
        words = F.array(*[F.col(f"w{k}") for k in range(n_words)]) if n_words else F.array(F.lit(0).cast("long"))
        of = lambda k: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftright", F.col(f"r{k}"), b).bitwiseAND(F.lit(1).cast("long")) != 0), lambda b: b + 64 * k)
        numbers = F.flatten(F.array(*[F.when(F.col(f"r{k}") == 0, F.array().cast("array<int>")).otherwise(of(k)) for k in range(n_rules)]))
        flows = flows.select(key, words.alias("words"), F.explode(numbers).alias("number"))
        each = flows.join(put(index.rules.where(F.col("chunk") == chunk)), "number").where(_holds(F.col("words"), "match"))
        spared = F.col("has_unless") & _holds(F.col("words"), "unless")
        part = each.select(key, "rule_id", (~spared).alias("applies"), _holds(F.col("words"), "require").alias("met"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = terms.select(key, F.lit("").alias("rule_id"), F.lit(False).alias("applies"), F.lit(False).alias("met")).limit(0)
    return out


def _columns(fields: list[str]) -> dict[str, Column]:
    return {f: F.col(f) for f in fields}


def match_rules(flows: DataFrame, rules: DataFrame, conditions: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, rule_id) of the flows that a rule applies to."""
    index = compile_rules(rules.select("rule_id", F.lit(0).alias("group")), conditions)
    return rule_states(flow_terms(flows, key, _columns(fields)), index, key, 0).where("applies").select(key, "rule_id")


def evaluate_rules(flows: DataFrame, conditions: DataFrame, effects: DataFrame, key: str, fields: list[str], tags: str = "tags", transforms: str = "transforms", principles: str | None = None, stage: str = "stage") -> DataFrame:
    """(key, feasible, failed): the rules that fail for each flow.

    A first pass applies CLASSIFY_AS (``unless`` is not asked there), whose tags the second pass sees.
    DENY_FLOW fails; REQUIRE_CONDITION, REQUIRE_TRANSFORMATION (field ``_done``: transforms and principles) and
    ALLOW_IF fail unless their ``require`` conditions hold; PREFER never fails; any other action counts as a
    failed condition.
    """
    none = F.array().cast(EMPTY)
    group = F.when(F.col("action") == "CLASSIFY_AS", 0).otherwise(1)
    conditions, effects = conditions.coalesce(1), effects.coalesce(1)  # authored
    asked = effects.where("action <> 'PREFER'").select("rule_id", "action", "stages", "tags", group.alias("group"))
    # where a rule applies is one more condition of its match
    stages = F.when(F.size("stages") > 0, F.col("stages")).otherwise(F.array(*map(F.lit, STAGES)))
    staged = asked.where("group = 1").select("rule_id", F.lit("match").alias("part"), F.lit("_stage").alias("field"), F.lit("anyOf").alias("op"), stages.alias("terms"))
    plain = conditions.join(asked.where("group = 0").select("rule_id").hint("shuffle_hash"), "rule_id", "left_semi").where("part = 'match'")
    other = conditions.join(asked.where("group = 1").select("rule_id").hint("shuffle_hash"), "rule_id", "left_semi")
    index = compile_rules(asked, plain.unionByName(other).unionByName(staged))
    done = F.array_union(F.coalesce(F.col(transforms), none), F.coalesce(F.col(principles), none) if principles else none)
    terms = flow_terms(flows, key, _columns(fields) | {"_done": done, "_stage": F.col(stage)})
    if any(own == 0 for _, own, _, _ in index.chunks):
        fired = rule_states(terms, index, key, 0).join(sized(asked.where("group = 0").select("rule_id", "tags")), "rule_id")
        new = fired.select(key, F.lit(tags).alias("field"), F.explode(F.array_append(F.col("tags"), SOME)).alias("term"))
        terms = terms.unionByName(new)
    hits = rule_states(terms, index, key, 1).where("applies").join(sized(asked.where("group = 1").select("rule_id", "action")), "rule_id")
    failed = hits.where(~(F.col("action").isin(*REQUIRING) & F.col("met"))).groupBy(key).agg(F.array_sort(F.collect_list("rule_id")).alias("failed"))
    return flows.select(key).join(failed.hint("merge"), key, "left").select(key, F.col("failed").isNull().alias("feasible"), F.coalesce("failed", none).alias("failed"))


def rule_failures(verdicts: DataFrame, effects: DataFrame) -> DataFrame:
    """(rule_id, action, n): how often each rule failed."""
    n = verdicts.select(F.explode("failed").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"))
    return n.join(sized(effects.select("rule_id", "action")), "rule_id")


def top_failed_rules(failures: DataFrame, k: int = 20) -> DataFrame:
    """(rule_id, n): the k rules that failed most often, of equals the smallest ids (failures: one row a failure)."""
    return failures.groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id").limit(k)


def best_verdict(verdicts: DataFrame, request: str, candidate: str, residual: str, n_attributes: str) -> DataFrame:
    """(request, best): the candidate of the least residual, then of the fewest attributes, then of the smallest id."""
    return verdicts.groupBy(request).agg(F.min_by(candidate, F.struct(residual, n_attributes, candidate)).alias("best"))


def ci_decision(failed: Column, stage_failures: Column, mode: str = "full") -> Column:
    """Decision text by mode: all rules, none of the hard ones, or the stages taken together."""
    bad = {"full": F.size(failed) > 0, "no_hard_rules": F.lit(False), "no_staged_flows": F.size(failed) > F.coalesce(stage_failures, F.lit(0))}[mode]
    return F.when(bad, "infeasible").otherwise("feasible")


def check_terms(have: Column, required: Column, forbidden: Column) -> Column:
    """struct(missing, present): required terms, where ``a OR b`` needs one of them and ``none`` an empty list, and forbidden ones that are there."""
    missing = F.filter(required, lambda r: ~(F.arrays_overlap(F.split(r, " OR "), have) | (F.array_contains(F.split(r, " OR "), "none") & (F.size(have) == 0))))
    return F.struct(missing.alias("missing"), F.array_sort(F.array_intersect(have, forbidden)).alias("present"))
