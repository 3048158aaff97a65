"""Selector defaults, ablations and the policy's match."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietgrid.functions import risk
from quietgrid.operators import select
from quietgrid.plans import registry


def test_ablation_modes():
    assert select.ablation_modes(None) == [] == select.ablation_modes("full")
    assert select.ablation_modes([" No_CI ", "skip_ci", "no_probes", "own"]) == ["metadata_only", "no_ci_filter", "own"]


def test_default_method(spark):
    rows = [("lexicographic", "x", None, None, None), (None, "latency_first", None, None, True), (None, None, "multi_representation_utility_contract", None, None), (None, "", None, None, True), ("", None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, m string, f string, t boolean")
    got = [r[0] for r in df.select(select.default_method(*map(F.col, "abmft"))).collect()]
    assert got == ["lexicographic", "latency_first", "utility_aware_weighted", "utility_aware_weighted", "weighted"]


def test_policy_match(spark):
    s = "request int, state int, s_type string, s_schema string, terms array<string>, properties map<string,string>, checkpoint map<string,array<string>>, components array<string>"
    states = [(1, 1, "video/x-raw", "", ["face_blurred"], {}, {}, None), (1, 2, "audio/x-filtered", "a", None, None, {}, None), (2, 3, "audio/x-filtered", "a", None, {"speech_content_removed": "false"}, {}, []), (3, 4, "audio/x-raw", "", None, {}, {}, None), (4, 5, "own", "s", ["blur"], {}, {"m": ["x"]}, ["image/x-redacted"])]
    a = "request int, a_type string, a_schema string, wanted map<string,string>, conditions map<string,array<string>>, forbidden array<string>, priority int, position int"
    accepted = [
        (1, "video/x-raw", "v", {"redacted": "true"}, None, None, 5, 0), (1, "video/x-raw", "", None, None, None, 1, 1), (1, "audio/x-raw", "", {"audio_filtered": "true"}, None, None, None, 2), (1, "audio/x-filtered", "b", None, None, None, 1, 3),
        (2, "audio/x-filtered", "a", {"speech_content_removed": "true"}, None, None, 1, 0), (2, "*", "", None, None, None, 9, 1), (3, "audio/x-raw", "", None, None, None, 1, 0), (4, "own", "s", None, None, ["blur"], 1, 0), (4, "x", "s", {"visual_redacted": "true"}, {"m": ["x", "y"]}, None, 7, 1), (4, "x", "s", None, {"m": ["z"]}, None, 1, 2),
    ]
    rejected = [(3, "audio/x-raw", None), (4, None, "t")]
    got = select.match_accepted_policy(spark.createDataFrame(states, s), spark.createDataFrame(accepted, a), spark.createDataFrame(rejected, "request int, r_type string, r_schema string"), "request")
    # the more specific of two exact ones; loose where no exact or schema match; a wildcard; a rejection; the schema where a transform is forbidden
    assert {(r.state, r.fit, r.position) for r in got.collect()} == {(1, 3, 0), (2, 1, 2), (3, 1, 1), (5, 2, 1)}


def test_front_of_levels_given_as_columns(spark, capsys):
    """the levels' columns give what the vector gives, and the query builds no map to look levels up in."""
    names = [f"v_{a}" for a in risk.ATTRIBUTES]
    rows = spark.range(300).select((F.col("id") % 60).alias("request"), F.col("id").alias("candidate"), *[(F.xxhash64("id", F.lit(i)) % 4).cast("int").alias(n) for i, n in enumerate(names)])
    rows = rows.withColumns({"vec": risk.vector({a: F.col(f"v_{a}") for a in risk.ATTRIBUTES}), "feasible": F.col("candidate") % 7 > 0, "position": F.col("candidate")})
    rows = rows.withColumns({"risk": risk.risk_score(F.col("vec")), **{k: F.lit(0) for k in ("margin", "latency", "cost", "priority")}})
    one, other = (select.select_pipeline(rows, "request", "pareto_then_weighted", levels) for levels in (None, names))
    assert one.columns == other.columns == rows.columns
    got, want = ({(r.request, r.candidate) for r in x.collect()} for x in (one, other))
    assert got == want and len(want) == 60
    registry.queries()["K01_select_pareto_then_weighted"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "map(" not in plan and "LeftAnti" in plan
