"""What the third review found: repeated keys, ties, and rules that the SQL stated otherwise."""

from __future__ import annotations

from collections import Counter
from datetime import datetime

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_queries import plain

from quietgrid.functions import caps, risk
from quietgrid.operators import flows, runs, select, sizes, survey
from quietgrid.plans import registry
from quietgrid.sources import scans

LINE = {"l_orderkey": 1, "l_partkey": 5, "l_suppkey": 7, "l_linenumber": 1, "l_quantity": 10.0, "l_extendedprice": 9.5, "l_discount": 0.02, "l_tax": 0.01, "l_returnflag": "A", "l_linestatus": "F", "l_shipdate": datetime(1998, 1, 2)}


def agrees(spark, folder, name, **tables):
    """The rows of a query, which its SQL gives too, over tables of a few rows."""
    folder.mkdir()
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for table, rows in tables.items():
        made = pa.Table.from_pylist(rows)  # noqa: F841 (DuckDB reads it by name)
        con.sql(f"COPY (SELECT * FROM made) TO '{folder}/{table}.parquet'")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    df = registry.queries()[name](spark, str(folder))
    got = Counter(tuple(plain(r[c]) for c in df.columns) for r in df.collect())
    assert got == Counter(tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall())
    return got


def both_orders(spark, folder, name, rows):
    """The same rows forwards and backwards give the same result."""
    found = [agrees(spark, folder / str(i), name, lineitem=[LINE | r for r in rs]) for i, rs in enumerate((rows, rows[::-1]))]
    assert found[0] == found[1]
    return found[0]


def test_alike_capabilities_are_classes(spark):
    up = spark.createDataFrame([(i, "video/x-raw", "s1") for i in range(40)], "up_id long, up_type string, up_schema string")
    down = spark.createDataFrame([(100 + i, "video/x-raw", None) for i in range(30)] + [(7, "application/x-event", "s2"), (8, "*", "s2")], "down_id long, down_type string, down_schema string")
    members_up, members_down, fits = caps.compatible_classes(up, down)
    assert {tuple(r) for r in fits.collect()} == {(0, 100), (0, 8)}
    assert {r.up_class for r in members_up.collect()} == {0} and members_up.count() == 40
    assert dict(map(tuple, members_down.collect())) == {**{100 + i: 100 for i in range(30)}, 7: 7, 8: 8}
    assert caps.compatible_caps(up, down).count() == 40 * 31


@pytest.mark.parametrize("name", ["A42_rule_failures", "F11_evaluate_rules", "J03_match_rules"])
def test_lines_of_one_flow_are_its_first(spark, tmp_path, name):
    twice = [{"l_returnflag": "R", "l_linestatus": "F", "l_tax": 0.05}, {"l_returnflag": "A", "l_linestatus": "O"}, {"l_returnflag": "A", "l_linestatus": "O", "l_tax": 0.07, "l_discount": 0.06}]
    assert both_orders(spark, tmp_path, name, twice)


def test_box_of_shares_is_scaled(spark, tmp_path):
    shares = {"l_quantity": 1.0, "l_suppkey": 60, "l_partkey": 90}
    assert dict(agrees(spark, tmp_path / "t", "F27_norm_box", lineitem=[LINE | shares])) == {(1, 1, 90, 63, 47, 64, 48, 1): 1}


def test_boxes_of_equal_area_and_corner(spark, tmp_path):
    same = [{"l_suppkey": 7, "l_quantity": 24.0, "l_partkey": 13}, {"l_suppkey": 7, "l_quantity": 39.0, "l_partkey": 8}]  # 24 x 13, 39 x 8
    assert list(both_orders(spark, tmp_path, "P17_crop_plan", same)) == [(1, 4.6, 33.4)]


def test_first_of_ordered_rows_is_asked_for(spark):
    sql = registry.oracle_sql()["W12_merge_run_rows"]
    con = duckdb.connect()
    con.sql("CREATE VIEW lineitem AS SELECT * FROM read_parquet('/root/testdata/sf0.1/lineitem.parquet')")
    # the most complete of six rows; an order of the subquery alone did not bind first()
    assert con.sql(f"SELECT candidates, note, path FROM ({sql}) WHERE scenario = 61487").fetchall() == [(19369, "t1", "p19369")]
    assert sql.count("first(") == sql.count(" ORDER BY score DESC") == 3


def test_seconds_are_cut_not_rounded(spark, tmp_path):
    at = [datetime(2024, 1, 1, 3, 46, 28, 999_864), datetime(2024, 1, 1, 3, 46, 28, 1), datetime(2024, 1, 1, 3, 59, 59, 999_900)]
    rows = [{"event_id": i, "ts": ts, "user_id": 1, "event_type": "view", "value": 50.0, "props": "{}"} for i, ts in enumerate(at)]
    got = dict(agrees(spark, tmp_path / "t", "X01_apply_stages", events=rows))
    assert ("op.multimodal_primitive_fuser", 2) in got and ("op.aggregate_generalize", 1) in got


def test_presence_xml_is_read_by_elements(spark, tmp_path, capsys):
    frames = "".join(f'<frame number="{i}"><a><person x="1"/></a></frame>' for i in range(50))
    (tmp_path / "A.xml").write_text(f'<d><track label="&#9;Person "><box frame="60" outside="no"/><track label="car"><box frame="61"/></track></track>{frames}<frame num="70"><frame id="71"><bbox/></frame></frame></d>')
    (tmp_path / "B.xml").write_text(f'<d><image id="007"><s><points label="HUMAN" points="{"1.5,2.5;" * 50}"/></s></image><image id="8"><points label="human" outside="true"/></image><img name="x.jpg"/><img id="9"><object>cup</object></img></d>')
    df = scans.read_presence_xml(spark, str(tmp_path))
    got = {(r.sample, r.frame): r.present for r in df.collect()}
    assert got == {**{("A", i): 1 for i in range(50)}, ("A", 60): 1, ("A", 61): 0, ("A", 70): 1, ("A", 71): 1, ("B", 7): 1, ("B", 8): 0, ("B", 9): 1}
    df.explain()
    assert "xml" in (plan := capsys.readouterr().out).lower() and "FileScan text" not in plan


def test_shortlist_asks_for_two_orders_only(spark, capsys):
    rows = [(1, i, "a" if i < 4 else "b", float(i), 0.0) for i in range(6)]
    out = select.diverse_shortlist(spark.createDataFrame(rows, "request int, candidate int, bucket string, residual double, utility double"), "request", 3)
    out.explain()
    assert capsys.readouterr().out.count("- Window [") == 2
    assert {r.candidate for r in out.collect()} == {0, 4, 1}


def test_rows_ask_for_partitions(spark):
    df = spark.range(40)
    assert sizes.dealt(df, "id", rows=4).rdd.getNumPartitions() == 10 and sizes.dealt(df, "id") is df


def test_flows_are_joined_without_their_vectors(spark, capsys):
    cand = spark.createDataFrame([(1, 10, {"identity": 2, "location": 0, "activity": 1}, "video/x-raw", "")], "request int, candidate int, vec map<string,int>, output_type string, output_schema string")
    req = spark.createDataFrame([(1, ["home"])], "request int, recipient array<string>")
    out = flows.build_flows(cand, req, req.where("false"), "request", ["recipient"])
    assert [tuple(map(str, r)) for r in out.select("recipient", "inferred", "interpreted", "content").collect()] == [("['home']", "['identity']", "['activity']", "['video_content']")]
    out.explain("extended")
    plan = capsys.readouterr().out.split("Optimized Logical Plan")[1].split("Physical Plan")[0]
    assert "vec" not in plan.split("Join")[0] and "map_filter" not in plan.split("Join")[0]


def test_long_trace_is_pieces(spark):
    rows = [("t", i, "xxyyyxzzx"[i], "select_pipeline") for i in range(9)] + [(None, i, "x", "error") for i in range(3)] + [("u", 0, "y", "error")]
    df = spark.createDataFrame(rows, "task string, phase int, output string, decision string")
    for piece in (1, 2, 5, 100):
        got = runs.decision_switches(df, ["task"], ["phase"], ["output"], piece=piece)
        assert {(r.task, r.phase) for r in got.where("switched").collect()} == {("t", 2), ("t", 5), ("t", 6), ("t", 8)} and got.count() == 13
    assert {(r.task, r.phases, r.switches) for r in runs.trace_summary(df, ["task"], ["phase"], ["output"]).collect()} == {("t", 9, 4), (None, 3, 0), ("u", 1, 0)}


def test_vector_is_summed_as_its_entries(spark):
    v = risk.vector({a: F.lit(i % 5) for i, a in enumerate(risk.ATTRIBUTES)})
    other = F.create_map(F.lit("face"), F.lit(2), F.lit("other"), F.lit(None).cast("int"))
    w = risk.weight_map(risk.DEFAULT_WEIGHTS)
    got = spark.range(1).select(risk.risk_score(v), risk.risk_score(v, w), risk.risk_score(other), risk.risk_score(other, w)).first()
    assert tuple(got) == (sum(i % 5 for i in range(13)), sum(i % 5 * risk.DEFAULT_WEIGHTS[a] for i, a in enumerate(risk.ATTRIBUTES)), 6.0, 12.0)


def test_values_are_counted_once_a_grouping(spark, capsys):
    rows = [("a", "x", 1, 5, 3), ("a", "y", 1, 6, 4), ("b", "x", 1, 5, 5), (None, "x", None, 5, 1), ("a", "x", 2, 7, 2)]
    df = spark.createDataFrame(rows, "method string, variant string, session int, item int, rating int")
    out = survey.rating_summary(df, [["method"], ["variant"], ["method", "variant"]], "rating", "session", "item")
    out.explain()
    # only the mean and the like are of grouping sets; distinct counts expand no row
    assert capsys.readouterr().out.count("- Expand") == 1
    got = {(r.method, r.variant, r.level): (r.participants, r.items) for r in out.collect()}
    assert got == {
        ("a", None, 1): (2, 3), ("b", None, 1): (1, 1), (None, None, 1): (0, 1), (None, "x", 2): (2, 2), (None, "y", 2): (1, 1),
        ("a", "x", 0): (2, 2), ("a", "y", 0): (1, 1), ("b", "x", 0): (1, 1), (None, "x", 0): (0, 1),
    }


def test_percentiles_share_one_count(spark, capsys):
    df = spark.createDataFrame([("a", float(i), i == 0) for i in range(21)], "method string, total double, warm boolean")
    out = runs.timing_summary(df, ["method"], ["total"], "warm")
    assert tuple(out.first()) == ("a", "total", 10.5, 10.5, 19.05, 1.0, 20.0)
    out.explain()
    plan = capsys.readouterr().out
    assert "percentile(ms" in plan and "median(" not in plan


def test_authored_effects_are_those_of_the_fold(spark, capsys):
    """what is known of effects beforehand leaves neither lambdas nor maps in the plan."""
    effects = [
        {"policy": "preserve_unmentioned", "set": {"identity": "high", "gait": "n/a", "face": "medium_to_low"}, "reduce": {"location": "by_1", "face": "to_none_or_low", "identity": "by_2"}},
        {"policy": "drop_unmentioned", "set": {"speech_content": "2"}, "remove": ["face", "location"], "add": {"activity": "may_increase", "gait": "never"}},
        {"add": {"identity": "may_increase", "activity": "may_increase"}, "reduce": {"trajectory": "depends"}},
    ]
    kinds = "policy string, set map<string,string>, remove array<string>, reduce map<string,string>, add map<string,string>"
    kept = [{k: e.get(k) or ([] if k == "remove" else None if k == "policy" else {}) for k in ("policy", "set", "remove", "reduce", "add")} for e in effects]
    struct = spark.createDataFrame([(i, *e.values()) for i, e in enumerate(kept)], f"i int, {kinds}").select("i", F.struct("policy", "set", "remove", "reduce", "add").alias("e"))
    lines = spark.range(40).withColumns({a: (F.xxhash64("id", F.lit(i)) % 5).cast("int") for i, a in enumerate(risk.ATTRIBUTES)}).withColumns({a: F.abs(a) for a in risk.ATTRIBUTES})
    # rows of even id take the first and the third effect, others the second and the third
    authored = risk.apply_authored_effects(lines, {a: a for a in risk.ATTRIBUTES}, [[(F.col("id") % 2 == 0, effects[0]), (F.lit(True), effects[1])], [(F.lit(True), effects[2])]])
    authored.explain()
    plan = capsys.readouterr().out
    assert "lambda" not in plan and "map(" not in plan
    held = {r.i: r.e for r in struct.collect()}
    assert held[1].remove == ["face", "location"]
    pairs = struct.alias("x").join(struct.alias("y"), F.col("y.i") == 2).where("x.i < 2").select(F.col("x.i").alias("i"), F.array("x.e", "y.e").alias("effects"))
    folded = lines.join(F.broadcast(pairs), F.col("id") % 2 == F.col("i")).select("id", risk.apply_effects(risk.vector({a: F.col(a) for a in risk.ATTRIBUTES}), F.col("effects")).alias("v"))
    want = {r.id: r.v for r in folded.collect()}
    assert len(want) == 40 and all(want[r["id"]] == {a: r[a] for a in risk.ATTRIBUTES} for r in authored.collect())
