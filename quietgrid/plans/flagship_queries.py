"""The flagship: observations are gated, turned into hourly occupancy, probed for what they disclose, bounded and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import observe, probes, select
from .observing_queries import OBS, observations
from .registry import Tables, query

c = F.col


@query("flagship", OBS + """, g AS (SELECT user_id, event_type, date_trunc('hour', ts) AS h, CASE WHEN k % 3 = 0 THEN k % 5 WHEN coalesce(nullif(CASE WHEN k % 4 = 0 THEN k % 2 END, 0), nullif(CASE WHEN k % 6 = 1 THEN k % 2 END, 0), value) >= 0.5 THEN 1 ELSE 0 END AS n FROM o WHERE value > 5),
hh AS (SELECT user_id, event_type, h, max(n) AS n FROM g GROUP BY ALL), p AS (SELECT user_id, event_type, 3 AS presence, CASE WHEN max(n) >= 2 THEN 3 ELSE 1 END AS co, CASE WHEN max(n) > 0 THEN 1 ELSE 0 END AS act, count(*) AS hours FROM hh GROUP BY ALL)
SELECT user_id, event_type, (presence + 3 * co + 4 * act)::DOUBLE AS risk, hours FROM p WHERE co <= 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY presence + 3 * co + 4 * act, hours DESC, event_type) = 1""")
def flagship(t: Tables) -> DataFrame:
    """For each source the stream whose hourly occupancy discloses least."""
    gated = observe.trigger_gate(observations(t), "value > 5")
    hourly = observe.derive_occupancy(gated).groupBy("user_id", "event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.max("count").alias("n"))
    key = ["user_id", "event_type"]
    probed = probes.probe_presence(hourly, key, c("n"), F.lit(None).cast("boolean")).join(hourly.groupBy(*key).agg(F.count("*").alias("hours")), key)
    risk = c("aggregate_presence") + 3 * c("co_presence") + 2 * (c("activity") + c("location"))
    scored = probed.withColumn("risk", risk.cast("double")).where("co_presence <= 3")
    return select.first_per(scored, ["user_id"], [F.asc("risk"), F.desc("hours"), F.asc("event_type")]).select("user_id", "event_type", "risk", "hours")
