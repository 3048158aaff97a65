"""Runs are order lines: scenario = order, method = flag and status, decision by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import runs
from .registry import Tables, query
from .risk_queries import LEVELS_SQL, vectors

c = F.col
RUN = """WITH r AS (SELECT l_orderkey AS scenario, l_returnflag || l_linestatus AS method, ['select_pipeline','no_compromise','error','Accepted','review'][1 + l_linenumber % 5] AS decision, ['video/x-raw','application/x-count','image/x-redacted'][1 + l_suppkey % 3] AS output, CASE WHEN l_tax > 0.02 THEN l_partkey END AS candidates, 't' || l_suppkey % 4 AS task, CAST(l_quantity AS BIGINT) AS phase, l_extendedprice AS ms, l_shipdate, l_partkey, l_suppkey, l_linenumber, l_discount, l_tax FROM lineitem)
"""


def rows(t: Tables) -> DataFrame:
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (1 + k % len(xs)).cast("int"))
    return vectors(t.lineitem).select(
        c("l_orderkey").alias("scenario"), F.concat("l_returnflag", "l_linestatus").alias("method"), pick(("select_pipeline", "no_compromise", "error", "Accepted", "review"), c("l_linenumber")).alias("decision"),
        pick(("video/x-raw", "application/x-count", "image/x-redacted"), c("l_suppkey")).alias("output"), F.when(c("l_tax") > 0.02, c("l_partkey")).alias("candidates"), F.concat(F.lit("t"), c("l_suppkey") % 4).alias("task"), c("l_quantity").cast("long").alias("phase"), c("l_extendedprice").alias("ms"), "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax", "vec",
    )


OK = "lower(trim(decision)) IN ('select_pipeline','selected','accept','accepted')"


@query("P05_filter_run_rows", RUN + "SELECT scenario, l_partkey, l_linenumber FROM r WHERE decision NOT IN ('error','no_candidates','no_compromise','invalid_or_no_pipeline','llm_error') AND task IN ('t1','t2') AND method IN ('RF','AO')")
def _(t: Tables) -> DataFrame:
    return runs.filter_run_rows(rows(t), ["t1", "t2"], ["RF", "AO"]).select("scenario", "l_partkey", "l_linenumber")


@query("P06_is_shared_output", RUN + f"SELECT scenario, l_partkey, l_linenumber, {OK} AS shared FROM r")
def _(t: Tables) -> DataFrame:
    return rows(t).select("scenario", "l_partkey", "l_linenumber", runs.is_shared_output(c("decision")).alias("shared"))


@query("P18_normalize_method", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'ablation:' || o_orderpriority ELSE 'm' || o_custkey % 3 END AS method_id, CASE WHEN o_orderstatus = 'F' THEN 'ablation' ELSE 'baseline' END AS method_kind FROM orders")
def _(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.concat(F.lit("m"), c("o_custkey") % 3).alias("m"), F.when(c("o_orderstatus") == "F", c("o_orderpriority")).when(c("o_orderstatus") == "O", "").alias("a"))
    return runs.normalize_method(o, "m", "a").select("o_orderkey", "method_id", "method_kind")


@query("P19_supports_semantic", RUN + "SELECT scenario, l_partkey, l_linenumber FROM r WHERE (task, output) IN (('t0','application/x-count'), ('t1','image/x-redacted'))")
def _(t: Tables) -> DataFrame:
    allowed = t.spark.createDataFrame([("t0", "application/x-count"), ("t1", "image/x-redacted")], "task string, output string")
    return runs.supports_semantic(rows(t), allowed, "task", "output").select("scenario", "l_partkey", "l_linenumber")


@query("P20_selected_only", RUN + f"SELECT scenario, method, count(*) AS n FROM r WHERE {OK} GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return rows(t).where(runs.is_shared_output(c("decision"))).groupBy("scenario", "method").agg(F.count("*").alias("n"))


@query("W12_merge_run_rows", RUN + """, s AS (SELECT *, CASE WHEN candidates IS NULL THEN 0 ELSE 1 END + CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END + CASE WHEN l_linenumber > 4 THEN 3 ELSE 0 END AS score, row_number() OVER (ORDER BY scenario, l_partkey, l_suppkey, l_linenumber, ms) AS seq FROM r)
SELECT scenario, first(candidates ORDER BY score DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC, ms DESC) FILTER (candidates IS NOT NULL) AS candidates, first(d ORDER BY score DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC, ms DESC) FILTER (d IS NOT NULL) AS note, first(p ORDER BY score DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC, ms DESC) FILTER (p IS NOT NULL) AS path FROM (SELECT *, CASE WHEN l_discount > 0.05 THEN task END AS d, CASE WHEN l_linenumber > 4 THEN 'p' || l_partkey END AS p FROM s) GROUP BY scenario""")
def _(t: Tables) -> DataFrame:
    r = rows(t).select("scenario", "candidates", F.when(c("l_discount") > 0.05, c("task")).alias("note"), F.when(c("l_linenumber") > 4, F.concat(F.lit("p"), "l_partkey")).alias("path"), F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "ms").alias("seq"))
    return runs.merge_run_rows(r, ["scenario"], ["candidates", "note"], "path", "seq").select("scenario", "candidates", "note", "path")


@query("W13_merge_nonempty", RUN + "SELECT scenario, max_by(candidates, (l_shipdate, l_partkey, l_suppkey, l_linenumber, ms)) FILTER (candidates IS NOT NULL) AS candidates, max_by(task, (l_shipdate, l_partkey, l_suppkey, l_linenumber, ms)) AS task FROM r GROUP BY scenario")
def _(t: Tables) -> DataFrame:
    return runs.merge_nonempty(rows(t), ["scenario"], ["candidates", "task"], ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "ms"])


@query("W14_latest_results", RUN + "SELECT scenario, method, l_partkey FROM r QUALIFY row_number() OVER (PARTITION BY scenario, method ORDER BY l_discount > 0.05 DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC, ms DESC) = 1")
def _(t: Tables) -> DataFrame:
    r = rows(t).withColumn("own", c("l_discount") > 0.05)
    return runs.latest_results(r, ["scenario", "method"], "own", ["l_shipdate", "l_partkey", "l_suppkey", "ms"]).select("scenario", "method", "l_partkey")


@query("J16_ablation_diff", RUN + ", b AS (SELECT scenario, min((decision, output)) AS f FROM r WHERE method = 'RF' GROUP BY scenario) SELECT scenario, l_partkey, l_linenumber FROM r LEFT JOIN b USING (scenario) WHERE method <> 'RF' AND (f IS NULL OR f <> (decision, output))")
def _(t: Tables) -> DataFrame:
    return runs.ablation_diff(rows(t), "scenario", "method", "RF", ["decision", "output"]).select("scenario", "l_partkey", "l_linenumber")


@query("A49_dedupe_plan", RUN + "SELECT task, decision, output, count(*) AS n, min(scenario) AS first_run, count(*) - 1 AS duplicates FROM r GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return runs.dedupe_plan(rows(t), ["task", "decision", "output"], "scenario")


@query("J15_reuse_plan", RUN + ", d AS (SELECT task, l_suppkey, min_by(l_partkey, (l_shipdate, l_partkey)) AS reused FROM r WHERE method = 'RF' AND l_discount > 0.08 GROUP BY ALL) SELECT scenario, l_partkey, l_linenumber, reused, reused IS NULL AS pending FROM r LEFT JOIN d USING (task, l_suppkey) WHERE method = 'AO'")
def _(t: Tables) -> DataFrame:
    r = rows(t)
    done = r.where("method = 'RF' and l_discount > 0.08").select("task", "l_suppkey", c("l_partkey").alias("result"), F.struct("l_shipdate", "l_partkey").alias("o"))
    return runs.reuse_plan(r.where("method = 'AO'"), done, ["task", "l_suppkey"], "o").select("scenario", "l_partkey", "l_linenumber", "reused", "pending")


_V = [f"({s})" for s in LEVELS_SQL.values()]


@query("F38_enrich_runs", f"""SELECT l_orderkey AS scenario, l_partkey, l_linenumber, l_suppkey % 3 <> 1 AS media, l_suppkey % 3 = 0 AS raw_like, ({' + '.join(_V)})::INT AS ordinal_sum, ({' + '.join(f'CASE WHEN {v} = 3 THEN 1 ELSE 0 END' for v in _V)})::INT AS n_high, ({' + '.join(f'CASE WHEN {v} >= 2 THEN 1 ELSE 0 END' for v in _V)})::INT AS n_medium_up FROM lineitem""")
def _(t: Tables) -> DataFrame:
    return runs.enrich_runs(rows(t), c("vec"), "output", "decision").select("scenario", "l_partkey", "l_linenumber", "media", "raw_like", "ordinal_sum", "n_high", "n_medium_up")


@query("A38_decision_coverage", RUN + f"SELECT task, method, count(*) AS rows, count(*) FILTER ({OK}) AS selected, round(count(*) FILTER ({OK}) / count(*)::DOUBLE, 6) AS rate, round(avg(candidates), 6) AS mean_candidates, count(DISTINCT decision) AS kinds FROM r GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    d = runs.decision_coverage(rows(t), ["task", "method"], "candidates")
    return d.select("task", "method", "rows", "selected", F.round("rate", 6).alias("rate"), F.round("mean_candidates", 6).alias("mean_candidates"), F.size("decisions").cast("long").alias("kinds"))


@query("A39_residual_exposure", "WITH v AS (" + " UNION ALL ".join(f"SELECT l_returnflag AS method, '{a}' AS attr, {s} AS level FROM lineitem" for a, s in LEVELS_SQL.items()) + ") SELECT method, attr, round(avg(level), 6) AS mean_level, round(avg(CASE WHEN level >= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_medium, round(avg(CASE WHEN level >= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_high FROM v GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    long = vectors(t.lineitem).select(c("l_returnflag").alias("method"), F.explode("vec").alias("attr", "level"))
    return runs.residual_exposure(long, ["method"]).select("method", "attr", *[F.round(x, 6).alias(x) for x in ("mean_level", "share_medium", "share_high")])


@query("A40_output_counts", RUN + "SELECT output, task, count(*) AS n FROM r GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return runs.output_counts(rows(t), ["output", "task"])


@query("A41_rejections", RUN + "SELECT scenario, method, decision, l_partkey FROM r WHERE decision = 'no_compromise'")
def _(t: Tables) -> DataFrame:
    return runs.rejections(rows(t), "decision").select("scenario", "method", "decision", "l_partkey")


@query("A44_timing_summary", RUN + ", l AS (SELECT method, 'a' AS stage, ms FROM r WHERE l_linenumber > 1 UNION ALL SELECT method, 'b', ms * l_discount FROM r WHERE l_linenumber > 1) SELECT method, stage, round(avg(ms), 4) AS mean, round(median(ms), 4) AS median, round(quantile_cont(ms, 0.95), 4) AS p95, round(min(ms), 4) AS low, round(max(ms), 4) AS high FROM l GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    r = rows(t).select("method", c("ms").alias("a"), (c("ms") * c("l_discount")).alias("b"), (c("l_linenumber") == 1).alias("warm"))
    return runs.timing_summary(r, ["method"], ["a", "b"], "warm").select("method", "stage", *[F.round(x, 4).alias(x) for x in ("mean", "median", "p95", "low", "high")])


@query("A45_timing_by_trace", RUN + "SELECT task, method, count(*) AS n, round(avg(ms), 4) AS mean FROM r GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return runs.timing_by_trace(rows(t), ["task", "method"], "ms").withColumn("mean", F.round("mean", 4))


@query("A46_runtime_rows", RUN + "SELECT scenario, l_partkey, l_linenumber, round(CASE WHEN candidates IS NOT NULL THEN greatest(0, ms - 20.0::DOUBLE * candidates) END, 4) AS preprocessing FROM r")
def _(t: Tables) -> DataFrame:
    return runs.runtime_rows(rows(t).withColumn("down", 20.0 * c("candidates")), "ms", "down").select("scenario", "l_partkey", "l_linenumber", F.round("preprocessing", 4).alias("preprocessing"))


SW = RUN + ", w AS (SELECT *, CASE WHEN row_number() OVER o = 1 THEN false ELSE (decision, output) IS DISTINCT FROM lag((decision, output)) OVER o END AS switched FROM r WINDOW o AS (PARTITION BY task, method ORDER BY phase, scenario, l_partkey, l_linenumber, ms))\n"
ORDER = ["phase", "scenario", "l_partkey", "l_linenumber", "ms"]


@query("W07_decision_switches", SW + "SELECT task, method, count(*) FILTER (switched) AS switches FROM w GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return runs.decision_switches(rows(t).select("task", "method", *ORDER, "decision", "output"), ["task", "method"], ORDER, ["decision", "output"]).groupBy("task", "method").agg(F.count_if("switched").alias("switches"))


@query("A47_trace_summary", SW + f"SELECT task, method, count(*) AS phases, count(*) FILTER ({OK}) AS selects, count(*) FILTER (decision = 'no_compromise') AS no_compromise, count(*) FILTER (decision = 'error') AS errors, count(*) FILTER (switched) AS switches FROM w GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return runs.trace_summary(rows(t), ["task", "method"], ORDER, ["decision", "output"])


@query("J12_context_coverage", "SELECT coalesce(o_orderkey, l_orderkey) AS scenario, coalesce(n, 0) AS runs, o_orderkey IS NOT NULL AS in_contexts FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 > 0) FULL JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def _(t: Tables) -> DataFrame:
    return runs.context_coverage(t.orders.where("o_orderkey % 3 > 0").select(c("o_orderkey").alias("scenario")), rows(t), "scenario")


@query("J13_vocab_coverage", "SELECT coalesce(a, b) AS term, a IS NOT NULL AS in_a, b IS NOT NULL AS in_b FROM (SELECT DISTINCT p_brand || '-' || p_size AS a FROM part WHERE p_partkey % 2 = 0) FULL JOIN (SELECT DISTINCT p_brand || '-' || p_size AS b FROM part WHERE p_partkey % 2 = 1) ON a = b")
def _(t: Tables) -> DataFrame:
    p = t.part.withColumn("term", F.concat_ws("-", "p_brand", "p_size"))
    return runs.two_sided_coverage(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), "term")


@query("J14_usage_vs_catalog", "SELECT coalesce(a, b) AS op, a IS NOT NULL AS in_a, b IS NOT NULL AS in_b FROM (SELECT DISTINCT l_partkey AS a FROM lineitem) FULL JOIN (SELECT p_partkey AS b FROM part) ON a = b")
def _(t: Tables) -> DataFrame:
    return runs.two_sided_coverage(t.lineitem.select(c("l_partkey").alias("op")), t.part.select(c("p_partkey").alias("op")), "op")


@query("A50_validate_contracts", "SELECT p_name AS id, CASE WHEN p_size % 4 = 0 AND p_type = 'SMALL' THEN 'label,kind' WHEN p_size % 4 = 0 THEN 'label' WHEN p_type = 'SMALL' THEN 'kind' ELSE '' END AS missing, count(*) OVER (PARTITION BY p_name) > 1 AS duplicate FROM part")
def _(t: Tables) -> DataFrame:
    p = t.part.select(c("p_name").alias("id"), F.when(c("p_size") % 4 > 0, c("p_brand")).alias("label"), F.when(c("p_type") != "SMALL", c("p_type")).otherwise("").alias("kind"))
    return runs.validate_contracts(p, "id", ["label", "kind"]).withColumn("missing", F.array_join("missing", ","))


@query("W17_mark_duplicates", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) > 1 AS duplicate FROM customer")
def _(t: Tables) -> DataFrame:
    return runs.mark_duplicates(t.customer.withColumn("k", F.concat_ws("|", "c_nationkey", "c_mktsegment")), "k").select("c_custkey", "duplicate")


@query("U01_union_runs", "SELECT run_source, count(*) AS n, count(extra) AS with_extra FROM (SELECT 'a' AS run_source, o_orderkey, o_custkey AS extra FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'b', o_orderkey, NULL FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    u = runs.union_runs({"a": t.orders.where("o_orderstatus = 'F'").select("o_orderkey", c("o_custkey").alias("extra")), "b": t.orders.where("o_orderstatus <> 'F'").select("o_orderkey")})
    return u.groupBy("run_source").agg(F.count("*").alias("n"), F.count("extra").alias("with_extra"))


@query("U02_new_schemas", "SELECT p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 0 EXCEPT SELECT p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 1")
def _(t: Tables) -> DataFrame:
    schema = ["p_brand", "p_type", "p_size"]
    return runs.new_schemas(t.part.where("p_partkey % 2 = 0").select(*schema), t.part.where("p_partkey % 2 = 1").select(*schema))


@query("A54_run_report", RUN + "SELECT count(*) AS rows, count(*) FILTER (decision = 'review') AS ok, count(*) FILTER (decision <> 'review') AS errors, count(DISTINCT task) AS tasks, count(DISTINCT output || task) AS fingerprints FROM r")
def _(t: Tables) -> DataFrame:
    r = rows(t).withColumn("status", F.when(c("decision") == "review", "ok").otherwise(c("decision"))).withColumn("fp", F.concat("output", "task"))
    return runs.run_report(r, "status", "task", "fp")


@query("A55_score_runs", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'status:P' WHEN a IS NULL THEN 'no_predictions' END AS skipped, CASE WHEN o_orderstatus <> 'P' THEN round(a, 6) END AS accuracy FROM orders LEFT JOIN (SELECT l_orderkey, avg(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' OR l_returnflag <> 'R' AND l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS a FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def _(t: Tables) -> DataFrame:
    r = t.orders.select("o_orderkey", F.when(c("o_orderstatus") == "P", "P").otherwise("ok").alias("status"))
    p = t.lineitem.select(c("l_orderkey").alias("o_orderkey"), (c("l_returnflag") == "R").alias("truth"), (c("l_linestatus") == "O").alias("pred"))
    return runs.score_runs(r, p, "o_orderkey").select("o_orderkey", "skipped", F.round("accuracy", 6).alias("accuracy"))
