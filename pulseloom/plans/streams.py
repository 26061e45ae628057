"""Queries of the streaming jobs, run over what is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom.operators.aggregates import baselines, r6
from pulseloom.plans.core import BASE
from pulseloom.plans.outcomes import ALERTS, LIMITS
from pulseloom.plans import registry
from pulseloom.plans.registry import register_tables
from pulseloom.plans.relational import SCORED
from pulseloom.sources.readings import readings
from pulseloom.sources.shared import shared_path
from pulseloom.streaming import incremental as I, jobs as J, limiter

register_tables("str_1_ingest", lambda s, d: J.drain(J.ingest(J.reading_stream(s, d)), "ingest").select("event_id", "user_id", "metric_type", "value"), "SELECT event_id, user_id, metric_type, value FROM m")
register_tables("str_2_recent_activity", lambda s, d: J.drain(J.recent_activity(J.reading_stream(s, d)), "recent"), """
WITH w AS (SELECT metric_type, user_id, time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(unnest(range(0, 12))::INT * 5) AS start_ts FROM m)
SELECT start_ts, start_ts + INTERVAL 1 HOUR AS end_ts, metric_type, count(*) AS n, count(DISTINCT user_id) AS people FROM w GROUP BY ALL HAVING start_ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM m) - INTERVAL 1 HOUR""")
register_tables("str_2_recent_activity_sketched", lambda s, d: J.drain(J.recent_activity(J.reading_stream(s, d), exact=False), "sketched"))
register_tables("str_3_tumbling_stats", lambda s, d: J.drain(J.tumbling_stats(J.reading_stream(s, d)), "tumbling"), """
SELECT date_trunc('day', ts) AS start_ts, date_trunc('day', ts) + INTERVAL 1 DAY AS end_ts, metric_type, count(*) AS n, min(value) AS low, max(value) AS high FROM m GROUP BY 1, 2, 3 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM m) - INTERVAL 6 HOUR""")
register_tables("str_4_score_stream", lambda s, d: J.drain(J.score_stream(J.reading_stream(s, d), baselines(readings(s, d))), "scores"), f"WITH {SCORED} SELECT * FROM sc WHERE abs(z) >= 2")


def _alert_stream(s, d):
    v = F.col("value")
    severity = F.when(v >= 200, "critical").when(v >= 120, "high").when(v >= 60, "medium").otherwise("low")
    return J.reading_stream(s, d).where("metric_type = 'error'").select("user_id", severity.alias("severity"), "event_id", "ts")


register_tables("str_5_rate_limit_stream", lambda s, d: J.drain(J.rate_limit_stream(_alert_stream(s, d), LIMITS, 240), "limits"), f"""
WITH {ALERTS}, o AS (SELECT user_id, severity, event_id, created_at, row_number() OVER (PARTITION BY user_id, severity ORDER BY created_at, event_id) AS k FROM al),
w(user_id, severity, event_id, k, start, c) AS (SELECT user_id, severity, event_id, k, created_at, 1 FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.severity, o.event_id, o.k, CASE WHEN o.created_at - w.start >= INTERVAL 240 HOUR THEN o.created_at ELSE w.start END, CASE WHEN o.created_at - w.start >= INTERVAL 240 HOUR THEN 1 ELSE w.c + 1 END
FROM w JOIN o ON o.user_id = w.user_id AND o.severity = w.severity AND o.k = w.k + 1)
SELECT user_id, severity, event_id, c <= CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 8 WHEN 'medium' THEN 5 ELSE 3 END AS passed FROM w""")


def _limited_in_order(s, d):
    with limiter.rocksdb(s):
        return J.drain(limiter.limit_in_order(_alert_stream(s, d), LIMITS, 240), "limited")


# events are answered when the watermark, six hours before the last one, has passed their quarter of an hour
register_tables("str_5_limiter_in_order", _limited_in_order, registry.ORACLES["str_5_rate_limit_stream"].removeprefix(f"WITH RECURSIVE {registry.READINGS}, ").join(["WITH ", ""])
                + " WHERE event_id IN (SELECT event_id FROM al WHERE time_bucket(INTERVAL 15 MINUTE, created_at) + INTERVAL 15 MINUTE <= (SELECT max(created_at) FROM al) - INTERVAL 6 HOUR)")
register_tables("str_6_session_stream", lambda s, d: J.drain(J.session_stream(J.reading_stream(s, d)), "sessions"), """
WITH n AS (SELECT *, CASE WHEN lag(ts) OVER s IS NULL OR ts - lag(ts) OVER s > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM m WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM n) SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 30 MINUTE AS end_ts, count(*) AS n FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM m) - INTERVAL 1 HOUR""")
register_tables("str_7_refresh_baselines", lambda s, d: J.refresh_baselines(s, d).select("user_id", "metric_type", "n", r6("mean").alias("mean"), r6("sd").alias("sd")), f"WITH {BASE} SELECT user_id, metric_type, n, round(mean, 6) AS mean, round(sd, 6) AS sd FROM b")


def _incremental(s, d):
    state = I.keep_baselines(I.readings_in_parts(s, d), shared_path(s, "baselines")).table()
    return I.as_baselines(state).select("user_id", "metric_type", "n", *[r6(c).alias(c) for c in ("mean", "sd")], "low", "high", "q1", "median", "q3")


register_tables("str_7_incremental_baselines", _incremental, """
SELECT user_id, metric_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS low, max(value) AS high,
quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.75) AS q3 FROM m GROUP BY user_id, metric_type HAVING count(value) >= 3""")
