"""Sessions are orders and responses their lines; the participant is the customer, the rating 1 + quantity modulo 5."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import survey
from .registry import Tables, query

c = F.col
RS = "WITH s AS (SELECT o_orderkey AS session, o_custkey AS participant, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS completed_at, 1 + o_custkey % 6 AS assigned, CAST(o_totalprice AS BIGINT) AS elapsed_ms FROM orders), r AS (SELECT l_orderkey AS session, l_partkey AS item, 1 + CAST(l_quantity AS BIGINT) % 5 AS rating, l_returnflag AS method, l_linestatus AS variant, CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_tax > 0.02 THEN 1 ELSE 0 END END AS correct, l_linenumber, l_suppkey, l_extendedprice, l_discount FROM lineitem)\n"


def sessions(t: Tables) -> DataFrame:
    return t.orders.select(c("o_orderkey").alias("session"), c("o_custkey").alias("participant"), F.when(c("o_orderstatus") == "F", c("o_orderdate")).alias("completed_at"), (1 + c("o_custkey") % 6).alias("assigned"), F.bround("o_totalprice", 0).cast("long").alias("elapsed_ms"))


def responses(t: Tables) -> DataFrame:
    return t.lineitem.select(c("l_orderkey").alias("session"), c("l_partkey").alias("item"), (1 + c("l_quantity").cast("long") % 5).alias("rating"), c("l_returnflag").alias("method"), c("l_linestatus").alias("variant"), F.when(c("l_linenumber") % 3 == 0, (c("l_tax") > 0.02).cast("int")).alias("correct"), "l_linenumber", "l_suppkey", "l_extendedprice", "l_discount")


ANSWERED = ", a AS (SELECT session, count(*) AS n FROM r GROUP BY 1), x AS (SELECT s.*, coalesce(n, 0) AS answered FROM s LEFT JOIN a USING (session))\n"


@query("P13_completed_sessions", RS + ANSWERED + "SELECT session, 'insights' AS rule FROM x WHERE completed_at IS NOT NULL OR answered >= assigned AND assigned > 0 UNION ALL SELECT session, 'counts' FROM x WHERE completed_at IS NOT NULL OR greatest(answered, 2) >= assigned UNION ALL SELECT session, 'server' FROM x WHERE answered >= assigned")
def _(t: Tables) -> DataFrame:
    x = sessions(t).join(responses(t).groupBy("session").agg(F.count("*").alias("answered")), "session", "left").fillna(0, ["answered"]).withColumn("rows", F.lit(2))
    one = lambda r: survey.completed_sessions(x, r).select("session", F.lit(r).alias("rule"))
    return one("insights").unionAll(one("counts")).unionAll(one("server"))


@query("P07_exclude_flows", "SELECT p_partkey FROM part WHERE NOT (p_type = 'ECONOMY') AND NOT lower(p_name) SIMILAR TO '.*(ring|bolt).*'")
def _(t: Tables) -> DataFrame:
    return survey.exclude_flows(t.part.select("p_partkey", "p_type", "p_name"), {"p_type": "ECONOMY"}, ("ring", "bolt")).select("p_partkey")


@query("P14_scope_items", "SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size < 5 EXCEPT SELECT p_brand FROM part WHERE p_size = 50)")
def _(t: Tables) -> DataFrame:
    return survey.scope_items(t.part, t.part.where("p_size < 5"), t.part.where("p_size = 50"), "p_brand").select("p_partkey")


@query("J11_enrich_responses", "SELECT l_orderkey, l_partkey, l_linenumber, coalesce(CASE WHEN l_tax > 0.04 THEN l_returnflag END, o_orderstatus) AS state FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def _(t: Tables) -> DataFrame:
    r = t.lineitem.select(c("l_orderkey").alias("session"), "l_partkey", "l_linenumber", F.when(c("l_tax") > 0.04, c("l_returnflag")).when(c("l_tax") > 0.02, "").alias("state"))
    return survey.enrich_responses(r, t.orders.select(c("o_orderkey").alias("session"), c("o_orderstatus").alias("state")), "session", ["state"]).withColumnRenamed("session", "l_orderkey")


@query("J22_lookup_context", "WITH k AS (SELECT o_orderkey::VARCHAR AS id, 0 AS o, o_orderstatus AS v FROM orders UNION ALL SELECT (o_custkey + 20000)::VARCHAR, 1, o_orderstatus FROM orders), f AS (SELECT id, min_by(v, (o, v)) AS v FROM k GROUP BY id) SELECT event_id::VARCHAR AS id, v AS state FROM (SELECT event_id * 3 AS event_id FROM events) LEFT JOIN f ON f.id = event_id::VARCHAR")
def _(t: Tables) -> DataFrame:
    contexts = t.orders.select("o_orderkey", (c("o_custkey") + 20000).alias("other"), c("o_orderstatus").alias("state"))
    return survey.lookup_context(t.events.select((c("event_id") * 3).alias("id")), contexts, ["o_orderkey", "other"], "state")


@query("S17_read_survey", "SELECT store || '::' || o_orderkey AS session, o_orderstatus AS state, late FROM (SELECT 'one' AS store, o_orderkey, o_orderstatus, NULL AS late FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'two', o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'F')")
def _(t: Tables) -> DataFrame:
    from ..sources import scans

    o = t.orders.select(c("o_orderkey").alias("session"), c("o_orderstatus").alias("state"), c("o_orderpriority").alias("late"))
    return scans.union_survey({"one": o.where("state = 'F'").drop("late"), "two": o.where("state <> 'F'")}).select("session", "state", "late")


@query("A31_rating_summary", RS + "SELECT method, variant, GROUPING(method, variant)::INT AS level, count(*) AS rows, count(DISTINCT session) AS participants, count(DISTINCT item) AS items, round(avg(rating), 6) AS mean, median(rating)::DOUBLE AS median, round(stddev_samp(rating), 6) AS sd, round(avg(CASE WHEN rating >= 4 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_high FROM r GROUP BY GROUPING SETS ((method), (variant), (method, variant))")
def _(t: Tables) -> DataFrame:
    out = survey.rating_summary(responses(t), [["method"], ["variant"], ["method", "variant"]], "rating", "session", "item")
    return out.withColumns({x: F.round(x, 6) for x in ("mean", "sd", "share_high")})


@query("A32_cluster_bootstrap", RS.replace("WITH ", "WITH RECURSIVE ", 1) + """, c AS (SELECT l_suppkey, sum(rating) AS s, count(rating) AS n FROM r GROUP BY 1), b AS (SELECT *, row_number() OVER (ORDER BY md5('13|' || l_suppkey), l_suppkey) - 1 AS i FROM c),
k AS (SELECT count(*)::BIGINT AS k, greatest(0, least(10, floor(log2(count(*) / 8.0))))::INT AS lv FROM c), w AS (SELECT *, (1 << lv)::BIGINT AS m FROM k),
t(it, lvl, bucket, draws) AS (SELECT it::INT, 0, 0::BIGINT, k FROM k, range(1, 201) x(it) UNION ALL
 SELECT it, lvl + 1, bucket * 2 + side, CASE side WHEN 0 THEN lft ELSE draws - lft END FROM (SELECT it, lvl, bucket, draws, CASE WHEN draws < 64 THEN len(list_filter(range(1, draws + 1), lambda d: (('0x' || substr(md5('13|' || it || '|' || lvl || '|' || bucket || '|' || d), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE < p))::BIGINT
   ELSE least(draws, greatest(0, floor(draws * p + sqrt(-2 * ln((('0x' || substr(md5('13|' || it || '|' || lvl || '|' || bucket || '|a'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)) * cos(2 * pi() * ((('0x' || substr(md5('13|' || it || '|' || lvl || '|' || bucket || '|b'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)) * sqrt(draws * p * (1 - p)) + 0.5)))::BIGINT END AS lft
  FROM (SELECT it, lvl, bucket, draws, (mid - low) / greatest(high - low, 1)::DOUBLE AS p FROM (SELECT it, lvl, bucket, draws, (bucket * wd * k + m - 1) // m AS low, ((bucket * wd + wd // 2) * k + m - 1) // m AS mid, ((bucket + 1) * wd * k + m - 1) // m AS high
   FROM (SELECT t.*, k, m, (1 << (lv - lvl))::BIGINT AS wd FROM t, w WHERE lvl < lv)))), (VALUES (0), (1)) s(side)),
o AS (SELECT i * m // k AS bucket, s, n, row_number() OVER (PARTITION BY i * m // k ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY i * m // k) AS size FROM b, w),
d AS (SELECT it, bucket, unnest(range(1, draws + 1)) AS d FROM t, w WHERE lvl = lv AND draws > 0),
e AS (SELECT d.it, o.s, o.n FROM d JOIN o ON o.bucket = d.bucket AND o.j = ('0x' || substr(md5('13|' || it || '|' || d.bucket || '|' || d), 1, 8))::BIGINT % o.size), y AS (SELECT it, sum(s) / sum(n)::DOUBLE AS m FROM e GROUP BY it)
SELECT round((SELECT sum(s) / sum(n)::DOUBLE FROM c), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM y""")
def _(t: Tables) -> DataFrame:
    out = survey.cluster_bootstrap(responses(t), "l_suppkey", "rating", 200, per_bucket=8)
    return out.withColumns({x: F.round(x, 6) for x in ("mean", "low", "high")})


@query("A33_session_qc", RS + ", a AS (SELECT session, count(*) AS answered, count(correct) AS checks, count(*) FILTER (correct = 0) AS failed FROM r GROUP BY 1) SELECT session, assigned, coalesce(answered, 0) AS answered, coalesce(checks, 0) AS checks, coalesce(failed, 0) AS failed, round((checks - failed) / nullif(checks, 0)::DOUBLE, 6) AS accuracy, round(elapsed_ms / 60000.0::DOUBLE, 6) AS minutes FROM s LEFT JOIN a USING (session)")
def _(t: Tables) -> DataFrame:
    return survey.session_qc(sessions(t), responses(t), "session").withColumns({x: F.round(x, 6) for x in ("accuracy", "minutes")})


@query("A34_participant_counts", RS + "SELECT participant, count(*) AS sessions, count(completed_at) AS completed, round(avg(CASE WHEN completed_at IS NOT NULL THEN elapsed_ms END), 4) AS mean_ms FROM s GROUP BY participant")
def _(t: Tables) -> DataFrame:
    return survey.participant_counts(sessions(t), "participant", "completed_at", "elapsed_ms").withColumn("mean_ms", F.round("mean_ms", 4))


@query("A35_item_summary", RS + "SELECT item, count(*) AS n, count(*) FILTER (rating = 1) AS n1, count(*) FILTER (rating = 2) AS n2, count(*) FILTER (rating = 3) AS n3, count(*) FILTER (rating = 4) AS n4, count(*) FILTER (rating = 5) AS n5, median(rating)::DOUBLE AS median FROM r GROUP BY item")
def _(t: Tables) -> DataFrame:
    return survey.item_summary(responses(t), "item", "rating").drop("mean", "sd")


@query("A36_study_overview", RS + "SELECT (SELECT count(*) FROM s) AS sessions, (SELECT count(DISTINCT participant) FROM s) AS participants, count(*) AS responses, round(100 * avg(correct), 6) AS check_accuracy, count(DISTINCT CASE WHEN correct = 0 THEN session END) AS sessions_failing FROM r")
def _(t: Tables) -> DataFrame:
    return survey.study_overview(sessions(t), responses(t), "participant", "session").withColumn("check_accuracy", F.round("check_accuracy", 6))


@query("A37_comments", "SELECT conv_id, count(*) AS n, string_agg(text, '|' ORDER BY turn, text) AS comments FROM conversations WHERE trim(coalesce(text, '')) <> '' GROUP BY conv_id")
def _(t: Tables) -> DataFrame:
    out = survey.comments_by(t.conversations, "conv_id", "text", ["turn"])
    return out.select("conv_id", F.size("comments").cast("long").alias("n"), F.array_join("comments", "|").alias("comments"))


@query("A48_build_items", "WITH f AS (SELECT l_orderkey, l_returnflag, l_linestatus, min((l_extendedprice, l_linestatus)) AS o FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_returnflag, string_agg(l_linestatus, ',' ORDER BY o) AS methods FROM f GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return survey.build_items(t.lineitem, ["l_orderkey", "l_returnflag"], "l_linestatus", "l_extendedprice").withColumn("methods", F.array_join("methods", ","))


@query("W08_changed_fields", RS + ", w AS (SELECT session, item, l_linenumber, l_extendedprice, method, variant, row_number() OVER o AS n, lag(method) OVER o AS m, lag(variant) OVER o AS v FROM r WINDOW o AS (PARTITION BY session ORDER BY l_linenumber, item, l_suppkey, l_extendedprice)) SELECT session, item, l_linenumber, l_extendedprice, CASE WHEN n = 1 THEN '' ELSE concat_ws(',', CASE WHEN method <> m THEN 'method' END, CASE WHEN variant <> v THEN 'variant' END) END AS changed FROM w")
def _(t: Tables) -> DataFrame:
    w = survey.changed_fields(responses(t), "session", ["l_linenumber", "item", "l_suppkey", "l_extendedprice"], ["method", "variant"])
    return w.select("session", "item", "l_linenumber", "l_extendedprice", F.array_join("changed", ",").alias("changed"))


@query("F40_score_checks", "SELECT o_orderkey, CASE WHEN o_custkey % 4 > 0 THEN CASE WHEN o_custkey % 4 = 1 THEN 1 ELSE 0 END END AS correct FROM orders")
def _(t: Tables) -> DataFrame:
    k = c("o_custkey") % 4
    o = t.orders.select("o_orderkey", F.when(k > 0, "Strongly  Agree.").alias("expected"), F.when(k == 1, " strongly agree").otherwise("agree").alias("answer"))
    return survey.score_checks(o, "expected", "answer").select("o_orderkey", "correct")


@query("F29_privacy_class", "SELECT p_partkey, ['raw_media','redacted_media','text','derived'][1 + p_size % 4] AS class FROM part")
def _(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("video/x-raw", "image/x-redacted", "application/x-visible-text-regions", "application/x-count"))), (1 + c("p_size") % 4).cast("int"))
    return t.part.select("p_partkey", survey.privacy_class(kind).alias("class"))


@query("F36_assign_split", "WITH g AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7|' || c_custkey), c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, CASE WHEN n > 1 AND i = n - 1 THEN 'test' WHEN i / n < 0.7::DOUBLE THEN 'train' WHEN i / n < (0.7::DOUBLE + 0.1::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM g")
def _(t: Tables) -> DataFrame:
    return survey.assign_split(t.customer, "c_custkey", {"train": 0.7, "valid": 0.1, "test": 0.2}, 7, "c_mktsegment")


@query("K10_assign_items")
def _(t: Tables) -> DataFrame:
    items = t.part.select(c("p_partkey").alias("item"), c("p_brand").alias("block"))
    counts = t.lineitem.groupBy(c("l_partkey").alias("item")).agg(F.count("*").alias("used"))
    return survey.assign_items(items, counts, t.customer.select(c("c_custkey").alias("session")), 4, 1)


@query("K10_assign_texts", "SELECT c_custkey AS session, 4 AS n, 4 AS n_texts, 4 AS n_blocks, 4 AS n_places FROM customer")
def _(t: Tables) -> DataFrame:
    """Sizes are the visible texts, and lie in many brands, the blocks."""
    items = t.part.select(c("p_partkey").alias("item"), c("p_brand").alias("block"), (c("p_size") % 40).alias("shown_as"))
    counts = t.lineitem.groupBy(c("l_partkey").alias("item")).agg(F.count("*").alias("used"))
    found = survey.assign_items(items, counts, t.customer.select(c("c_custkey").alias("session")), 4, 1, "shown_as")
    of = found.join(items.hint("merge"), "item").groupBy("session")
    return of.agg(F.count("*").cast("int").alias("n"), F.countDistinct("shown_as").cast("int").alias("n_texts"), F.countDistinct("block").cast("int").alias("n_blocks"), F.countDistinct("place").cast("int").alias("n_places"))


@query("K10_assign_sequential", """WITH p AS (SELECT p_partkey AS item, row_number() OVER (ORDER BY p_brand, p_size, p_partkey) - 1 AS pl, count(*) OVER () AS n FROM part), s AS (SELECT c_custkey AS session, ('0x' || substr(md5('seq|' || c_custkey), 1, 8))::BIGINT % (SELECT max(n) FROM p) AS start, unnest(range(6)) AS place FROM customer)
SELECT session, item, place::INT AS place FROM s JOIN p ON pl = (start + place) % n""")
def _(t: Tables) -> DataFrame:
    items = t.part.select(c("p_partkey").alias("item"), "p_brand", "p_size")
    return survey.assign_sequential(items, t.customer.select(c("c_custkey").alias("session")), 6, ["p_brand", "p_size"])
