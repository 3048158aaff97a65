"""Compiled rules against a plain reading of them, in one chunk of bits and in many."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quietgrid.operators import rules


def holds(condition, flow):
    _, _, field, op, terms = condition
    have = set(flow[field] or [])
    return {"anyOf": bool(have & set(terms)), "allOf": set(terms) <= have, "noneOf": not have & set(terms), "present": bool(have), "absent": not have}[op]


def test_rules_equal_a_plain_reading(spark):
    rng = random.Random(3)
    words, fields = [f"t{i}" for i in range(9)], ["a", "b", "c.d"]
    some = lambda n: [rng.choice(words) for _ in range(rng.randint(0, n))]
    flows = [(i, {f: some(5) if rng.random() < 0.9 else None for f in fields}) for i in range(120)]
    conditions = []
    for r in range(60):
        for part in rng.choices(["match", "unless", "require"], k=rng.randint(0, 5)):
            op = rng.choice(["anyOf", "allOf", "noneOf", "present", "absent"])
            conditions.append((f"r{r}", part, rng.choice(fields), op, [] if op in ("present", "absent") else some(3)))
    conditions += [conditions[0], ("r1", "match", "a", "allOf", [f"t{i}" for i in range(9)] * 20)]
    want = set()
    for i, flow in flows:
        for r in range(60):
            own = [c for c in conditions if c[0] == f"r{r}"]
            part = lambda p, own=own: [c for c in own if c[1] == p]
            if all(holds(c, flow) for c in part("match")):
                asked = [c for c in part("unless") if c[3] in ("anyOf", "present", "absent") or c[4]]
                spared = bool(asked) and all(holds(c, flow) for c in asked)
                want.add((i, f"r{r}", not spared, all(holds(c, flow) for c in part("require"))))
    table = spark.createDataFrame([(i, f["a"], f["b"], (f["c.d"],)) for i, f in flows], "flow long, a array<string>, b array<string>, c struct<d: array<string>>").repartition(3)
    c = spark.createDataFrame(conditions, "rule_id string, part string, field string, op string, terms array<string>")
    known = spark.createDataFrame([(f"r{r}",) for r in range(60)], "rule_id string").withColumn("group", F.lit(0))
    terms = rules.flow_terms(table, "flow", {f: F.col(f) for f in fields})
    for chunk in (2048, 40):
        index = rules.compile_rules(known, c, chunk)
        assert (len(index.chunks) > 2) == (chunk == 40)
        assert {tuple(r) for r in rules.rule_states(terms, index, "flow", 0).collect()} == want


def test_one_shuffle_by_flow(spark):
    table = spark.range(100).repartition(3).select(F.col("id").alias("flow"), F.array(F.lit("x")).alias("a"))
    c = spark.createDataFrame([("r", "match", "a", "anyOf", ["x"])], "rule_id string, part string, field string, op string, terms array<string>")
    index = rules.compile_rules(spark.createDataFrame([("r", 0)], "rule_id string, group int"), c)
    found = rules.rule_states(rules.flow_terms(table, "flow", {"a": F.col("a")}), index, "flow", 0)
    assert found.count() == 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
