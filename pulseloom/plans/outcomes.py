"""Queries of interventions, alerts, reports and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom.functions.labels import label_sql
from pulseloom.operators import outcomes as Y
from pulseloom.operators.aggregates import KEYS, r6, resample_hourly
from pulseloom.operators.correlations import pearson
from pulseloom.plans.analysis import ENS, LIN
from pulseloom.plans.core import FILLED, NOW, by_person
from pulseloom.plans.registry import register
from pulseloom.plans.relational import BEFORE, INTERVENTIONS, SWEEP, rounded, sweep

K = "user_id, metric_type"
EFFECT = BEFORE + f""", ie AS (SELECT user_id, metric_type, any_value(category) AS category, count(*) FILTER (period = 'before') AS n0, count(*) FILTER (period = 'after') AS n1, avg(value) FILTER (period = 'before') AS mean0, avg(value) FILTER (period = 'after') AS mean1,
var_samp(value) FILTER (period = 'before') AS v0, var_samp(value) FILTER (period = 'after') AS v1, regr_slope(value, epoch_us(ts) / 8.64e10 - epoch_us(started_at) / 8.64e10) FILTER (period = 'before') AS sb, regr_slope(value, epoch_us(ts) / 8.64e10 - epoch_us(started_at) / 8.64e10) FILTER (period = 'after') AS sa FROM ba GROUP BY ALL),
ip AS (SELECT *, ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) AS pooled FROM ie WHERE n1 >= 2 AND n0 >= 2),
ef AS (SELECT *, (mean1 - mean0) / mean0 * 100 AS ch, (mean1 - mean0) / sqrt(pooled * (1 / n1 + 1 / n0)) AS t, (mean1 - mean0) / sqrt(pooled) AS d FROM ip WHERE pooled > 0)"""
register("int_1_intervention_baseline", Y.intervention_baseline, f"WITH {BEFORE} SELECT {K}, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM ba WHERE period = 'before' GROUP BY {K} HAVING count(*) >= 3")
register("int_2_intervention_effect", lambda m: rounded(Y.intervention_effect(m).drop("p")), f"""
WITH {EFFECT} SELECT {K}, category, n0 AS n_before, n1 AS n_after, round(mean0, 6) AS mean_before, round(mean1, 6) AS mean_after, round(ch, 6) AS change_percent, round(t, 6) AS t, round(d, 6) AS cohens_d, {label_sql('d', 'effect')} AS effect,
round(sb, 6) AS slope_before, round(sa, 6) AS slope_after, abs(ch) >= 10 AS counts FROM ef""")
SCORES = EFFECT + """, es AS (SELECT user_id, metric_type, category, least(50, abs(d) * 50) + least(30, abs(ch)) + CASE WHEN abs(t) >= 2 THEN 20 ELSE 0 END AS effectiveness,
least(40, least(n0, n1) * 4) + CASE WHEN abs(t) >= 2.6 THEN 40 WHEN abs(t) >= 2 THEN 30 ELSE 10 END + CASE WHEN abs(d) >= 0.5 THEN 20 ELSE 5 END AS confidence FROM ef)"""
register("int_3_intervention_scores", lambda m: rounded(Y.intervention_scores(m)), f"WITH {SCORES} SELECT {K}, category, round(effectiveness, 6) AS effectiveness, confidence::DOUBLE AS confidence FROM es")
register("int_4_intervention_summary", Y.intervention_summary, f"""
WITH {SCORES}, g AS (SELECT category, count(*) AS n, avg(CASE WHEN effectiveness >= 60 THEN 1 ELSE 0 END) AS rate, avg(effectiveness) AS mean, avg(confidence) AS c FROM es GROUP BY category),
v AS (SELECT *, CASE WHEN mean >= 60 THEN 'effective' WHEN mean >= 40 THEN 'mixed' ELSE 'ineffective' END AS verdict FROM g) SELECT category, n, round(rate, 6) AS success_rate, round(mean, 6) AS mean_effectiveness, verdict AS assessment,
CASE WHEN verdict = 'effective' THEN 'continue' WHEN c < 50 THEN 'collect_more_data' WHEN verdict = 'mixed' THEN 'adjust' ELSE 'stop' END AS recommendation,
CASE category WHEN 'nutrition' THEN 4 WHEN 'exercise' THEN 6 WHEN 'sleep' THEN 2 WHEN 'stress' THEN 3 ELSE 8 END AS expected_weeks FROM v""")
register("int_5_confounding", Y.confounding, f"""
WITH {INTERVENTIONS}, c AS (SELECT i.user_id, (SELECT count(*) FROM m WHERE m.user_id = i.user_id AND metric_type = 'error' AND ts >= started_at AND ts <= coalesce(ended_at, {NOW})) AS events FROM iv i)
SELECT user_id, events, CASE WHEN events <= 2 THEN 'low' WHEN events <= 5 THEN 'moderate' ELSE 'high' END AS risk FROM c""")
register("pat_10_response_consistency", lambda m: rounded(Y.response_consistency(m)), f"WITH {EFFECT} SELECT category, count(*) AS n, round(greatest(0, 1 - stddev_pop(d) / abs(avg(d))), 6) AS consistency, round(1 - stddev_pop(d) / abs(avg(d)), 6) AS raw, round(avg(d), 6) AS mean_effect, round(stddev_pop(d), 6) AS sd_effect FROM ef GROUP BY category")
ALERTS = """al AS (SELECT event_id, user_id, ts AS created_at, CASE WHEN value >= 200 THEN 'critical' WHEN value >= 120 THEN 'high' WHEN value >= 60 THEN 'medium' ELSE 'low' END AS severity, value,
coalesce((meta->>'$.k')::INT, 1) % 3 = 0 AS is_resolved FROM m WHERE metric_type = 'error')"""
register("prj_9_list_alerts", lambda m: Y.alerts(m).where("severity IN ('high', 'critical') AND NOT is_resolved").orderBy(F.desc("created_at"), "event_id").limit(200),
         f"WITH {ALERTS} SELECT * FROM al WHERE severity IN ('high', 'critical') AND NOT is_resolved ORDER BY created_at DESC, event_id LIMIT 200")
register("alr_2_batch_alerts", Y.batch_alerts, f"""
WITH {ENS}, d AS (SELECT {K}, count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (severe) AS severe FROM en GROUP BY {K}) SELECT *, CASE WHEN severe > 0 THEN 'high' ELSE 'medium' END AS severity FROM d WHERE severe > 0 OR anomalies >= 2""")
# Student's tail for whole degrees of freedom: a finite series in the sine and cosine of the angle, which follow from r
register("alr_3_correlation_alerts", lambda m: rounded(Y.correlation_alerts(sweep(m))), f"""
WITH {SWEEP}, q AS (SELECT *, n - 2 AS df, least(1, abs(r)) AS s, greatest(0, 1 - r * r) AS c2 FROM sw), v AS (SELECT *, CASE WHEN abs(r) >= 1 - 1e-12 THEN 0 WHEN df % 2 = 0 THEN 1 - s * list_sum(list_transform(range(0, df // 2), lambda j: pow(c2, j) * exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - 2 * j * ln(2))))
ELSE 1 - 2 / pi() * (atan(s / sqrt(c2)) + s * sqrt(c2) * list_sum(list_transform(range(0, (df - 1) // 2), lambda j: pow(c2, j) * exp(2 * j * ln(2) + 2 * lgamma(j + 1) - lgamma(2 * j + 2))))) END AS p FROM q),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM v), a AS (SELECT *, least(1, min(p * c / k) OVER (PARTITION BY user_id ORDER BY k DESC)) AS adjusted FROM k)
SELECT user_id, m1, m2, n, round(r, 6) AS r, CASE WHEN r > 0 THEN 'rise' ELSE 'fall' END AS direction FROM a WHERE adjusted <= 0.2 AND abs(r) >= 0.7""")
LIMITS = {"critical": 10, "high": 8, "medium": 5, "low": 3}
register("alr_4_rate_limit", lambda m: Y.rate_limit(Y.alerts(m), LIMITS, 240), f"""
WITH {ALERTS}, o AS (SELECT user_id, severity, event_id, created_at, row_number() OVER (PARTITION BY user_id, severity ORDER BY created_at, event_id) AS k FROM al),
w(user_id, severity, event_id, k, start, c) AS (SELECT user_id, severity, event_id, k, created_at, 1 FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.severity, o.event_id, o.k, CASE WHEN o.created_at - w.start >= INTERVAL 240 HOUR THEN o.created_at ELSE w.start END, CASE WHEN o.created_at - w.start >= INTERVAL 240 HOUR THEN 1 ELSE w.c + 1 END
FROM w JOIN o ON o.user_id = w.user_id AND o.severity = w.severity AND o.k = w.k + 1)
SELECT user_id, severity, event_id, c <= CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 8 WHEN 'medium' THEN 5 ELSE 3 END AS passed FROM w""")
register("alr_5_resolve_alerts", lambda m: Y.resolve_alerts(Y.alerts(m)), f"""
WITH {ALERTS} SELECT event_id, user_id, severity, is_resolved OR event_id % 4 = 0 AS is_resolved, CASE WHEN event_id % 4 = 0 AND NOT is_resolved THEN {NOW} END AS resolved_at FROM al""")
register("agg_17_alert_statistics", lambda m: Y.alert_statistics(Y.alerts(m)), f"""
WITH {ALERTS} SELECT severity, user_id, count(*) AS n, count(*) FILTER (is_resolved) AS resolved, round(count(*) FILTER (is_resolved) / count(*), 6) AS resolution_rate, round(count(*) / count(DISTINCT created_at::DATE), 6) AS per_day
FROM al GROUP BY GROUPING SETS ((severity), (user_id), ())""")
register("rpt_1_daily_reports", Y.daily_reports, f"""
WITH {ENS}, {LIN}, s AS (SELECT user_id, max(ts) AS last_ts, count(DISTINCT metric_type) AS series, count(*) AS readings FROM m GROUP BY ALL), a AS (SELECT user_id, count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (severe) AS severe FROM en GROUP BY ALL),
u AS (SELECT user_id, count(*) FILTER (slope > 0.01) AS rising, count(*) FILTER (slope < -0.01) AS falling FROM lg2 GROUP BY ALL), t AS (SELECT user_id, first(metric_type ORDER BY n DESC, metric_type) AS top_type FROM (SELECT user_id, metric_type, count(*) AS n FROM m GROUP BY ALL) GROUP BY user_id)
SELECT user_id, DATE '2024-01-31' AS report_date, last_ts, series, readings, coalesce(anomalies, 0) AS anomalies, coalesce(severe, 0) AS severe, coalesce(rising, 0) AS rising, coalesce(falling, 0) AS falling, top_type, round(least(1, readings / 100), 6) AS confidence,
left(readings || ' readings; ' || coalesce(anomalies, 0) || ' unusual; most of ' || top_type, 306) AS text FROM s LEFT JOIN a USING (user_id) LEFT JOIN u USING (user_id) JOIN t USING (user_id) WHERE last_ts >= {NOW} - INTERVAL 7 DAY""")
register("rpt_2_change_card", Y.change_card, f"""
WITH c AS (SELECT {K}, last(value ORDER BY ts, event_id) AS value, avg(value) AS mean FROM m GROUP BY {K}), d AS (SELECT {K}, value, round(mean, 6) AS mean, round((value - mean) / mean * 100, 6) AS change FROM c)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(change) DESC, metric_type) AS k FROM d WHERE abs(change) > 5 QUALIFY k <= 2""")
register("top_1_top_correlations", lambda m: rounded(Y.top_correlations(sweep(m))), f"WITH {SWEEP} SELECT user_id, m1, m2, n, round(r, 6) AS r, row_number() OVER (PARTITION BY user_id ORDER BY round(abs(r), 9) DESC, m1, m2) AS k FROM sw QUALIFY k <= 3")
PATTERN = FILLED + ", hh AS (SELECT metric_type, hour(hour) AS h, avg(mean) AS mean, stddev_samp(mean) AS sd, count(*) AS n FROM f GROUP BY ALL)"
CIRCADIAN = f"""WITH {PATTERN} SELECT metric_type, first(h ORDER BY round(mean, 9) DESC, h)::INT AS peak_hour, first(h ORDER BY round(mean, 9), h)::INT AS trough_hour, round(max(mean) - min(mean), 6) AS amplitude, CASE WHEN max(sd) > 1e-9 THEN round(1 - avg(sd) / max(sd), 6) END AS consistency, first(h ORDER BY round(sd, 9), h)::INT AS steadiest_hour FROM hh GROUP BY metric_type"""
register("pat_1_circadian_patterns", lambda m: Y.circadian_patterns(resample_hourly(m)), CIRCADIAN)
register("pat_1_circadian_patterns_by_person", lambda m: Y.circadian_patterns(resample_hourly(m, KEYS), KEYS), by_person(CIRCADIAN))
register("agg_32_grid_patterns", lambda m: rounded(resample_hourly(m).groupBy("metric_type", F.hour("hour").alias("h")).agg(F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("sd"), F.count(F.lit(1)).alias("n"))), f"WITH {PATTERN} SELECT metric_type, h::INT AS h, round(mean, 6) AS mean, round(sd, 6) AS sd, n FROM hh")


def _associations(m):
    g = resample_hourly(m).select("hour", "metric_type", F.col("mean").alias("v"))
    a, b = g.select("hour", F.col("metric_type").alias("m1"), F.col("v").alias("x")), g.select("hour", F.col("metric_type").alias("m2"), F.col("v").alias("y"))
    return pearson(a.join(b, "hour").where("m1 < m2"), ["m1", "m2"]).select("m1", "m2", "n", r6("r").alias("r"), F.when(F.abs("r") > 0.7, "strong").when(F.abs("r") > 0.3, "moderate").otherwise("weak").alias("association"))


register("pat_2_associations", _associations, f"""
WITH {FILLED}, pa AS (SELECT a.metric_type AS m1, b.metric_type AS m2, count(*) AS n, corr(a.mean, b.mean) AS r FROM f a JOIN f b ON a.hour = b.hour AND a.metric_type < b.metric_type GROUP BY ALL)
SELECT m1, m2, n, round(r, 6) AS r, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END AS association FROM pa WHERE n >= 10""")
