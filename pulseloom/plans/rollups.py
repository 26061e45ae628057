"""Queries of roll-ups and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom.operators import profiles as P, relations as R
from pulseloom.operators.aggregates import r6, with_mad, winsorized_mean
from pulseloom.operators.correlations import mean_ci, wilson
from pulseloom.operators.outcomes import intervention_scores
from pulseloom.plans.core import MAD, TQ, WINSOR
from pulseloom.plans.outcomes import SCORES
from pulseloom.plans.registry import register
from pulseloom.plans.relational import PAIRS, rounded

register("agg_14_multi_scale_corr", lambda m: P.multi_scale_corr(R.daily_pairs(m, "click", "view")), f"""
WITH {PAIRS}, w AS (SELECT *, min(day) OVER (PARTITION BY user_id) AS f, unnest([1, 3, 7, 14])::INT AS width FROM dp), b AS (SELECT user_id, width, floor(date_diff('day', f, day) / width) AS k, avg(x) AS x, avg(y) AS y FROM w GROUP BY ALL),
g AS (SELECT user_id, width, count(*) AS n, corr(x, y) AS r FROM b GROUP BY ALL) SELECT user_id, width, n, round(r, 6) AS r FROM g WHERE n >= 4 AND r IS NOT NULL AND NOT isnan(r)""")


def _logs(m):
    k = F.get_json_object("meta", "$.k").cast("int")
    status = F.when(k % 10 == 0, "failed").when(k % 10 == 1, "rate_limited").otherwise("sent")
    return m.where("metric_type = 'view'").select("user_id", F.col("ts").alias("created_at"), F.to_json(F.struct(status.alias("status"), F.when(k % 10 == 0, F.concat(F.lit("e"), (k % 3).cast("string"))).alias("error"))).alias("context"))


register("agg_19_delivery_stats", lambda m: P.delivery_stats(_logs(m)), """
WITH l AS (SELECT user_id, ts, (meta->>'$.k')::INT AS k FROM m WHERE metric_type = 'view'), s AS (SELECT *, CASE WHEN k % 10 = 0 THEN 'failed' WHEN k % 10 = 1 THEN 'rate_limited' ELSE 'sent' END AS status, CASE WHEN k % 10 = 0 THEN 'e' || (k % 3) END AS error FROM l),
e AS (SELECT user_id, first(error ORDER BY n DESC, error) AS top_error FROM (SELECT user_id, error, count(*) AS n FROM s WHERE error IS NOT NULL GROUP BY ALL) GROUP BY user_id)
SELECT user_id, count(*) FILTER (status = 'sent') AS sent, count(*) FILTER (status = 'rate_limited') AS limited, count(*) FILTER (status = 'failed') AS failed, round(count(*) FILTER (status = 'sent') / count(*), 6) AS success_rate,
max(ts) FILTER (status = 'sent') AS last_sent, any_value(top_error) AS top_error FROM s LEFT JOIN e USING (user_id) GROUP BY user_id""")
register("agg_23_nutrition_summary", lambda m: P.nutrition_summary(m.where("metric_type = 'purchase'").select("user_id", "ts", F.to_json(F.struct((F.col("value") * 10).alias("calories"), (F.col("value") / 5).alias("protein"))).alias("nutrition"))), """
SELECT user_id, count(*) AS meals, round(sum(value * 10), 6) AS calories, round(sum(value / 5), 6) AS protein, round(avg(value * 10), 6) AS calories_per_meal, round(sum(value * 10) / count(DISTINCT ts::DATE), 6) AS calories_per_day FROM m WHERE metric_type = 'purchase' GROUP BY user_id""")
BED = "bd AS (SELECT user_id, round(hour(ts) + minute(ts) / 60, 6) AS bed_hour, round((hour(ts) + minute(ts) / 60 + 8) % 24, 6) AS wake_hour FROM m WHERE metric_type = 'signup')"


def _beds(m):
    h = F.hour("ts") + F.minute("ts") / 60
    return m.where("metric_type = 'signup'").select("user_id", "event_id", r6(h).alias("bed_hour"), r6((h + 8) % 24).alias("wake_hour"))


CLOCK = "lpad((floor(floor(round({c}, 6) * 60 + 1e-9) / 60))::INT::VARCHAR, 2, '0') || ':' || lpad((floor(round({c}, 6) * 60 + 1e-9)::BIGINT % 60)::VARCHAR, 2, '0')"
register("agg_24_sleep_schedule", lambda m: P.sleep_schedule(_beds(m)), f"""
WITH {BED}, g AS (SELECT user_id, count(*) AS nights, avg(bed_hour) AS b, avg(wake_hour) AS w, stddev_pop(bed_hour) AS bs, stddev_pop(wake_hour) AS ws FROM bd GROUP BY ALL)
SELECT user_id, nights, round(b, 6) AS bed_mean, round(w, 6) AS wake_mean, round(bs, 6) AS bed_spread, round(ws, 6) AS wake_spread, {CLOCK.format(c='b')} AS bed_clock, {CLOCK.format(c='w')} AS wake_clock FROM g""")
register("agg_25_bedtime_mean", lambda m: P.bedtime_mean(_beds(m)), f"WITH {BED} SELECT user_id, round(avg(CASE WHEN bed_hour < 12 THEN bed_hour + 24 ELSE bed_hour END) % 24, 6) AS bed_mean, count(*) AS nights FROM bd GROUP BY user_id")
register("agg_26_stage_card", lambda m: P.stage_card(m, "2024-01-24 00:00:00"), """
SELECT user_id, metric_type, round(avg(value), 6) AS mean, round(avg(value) FILTER (ts >= TIMESTAMP '2024-01-24'), 6) AS recent_mean, min(value) AS low, max(value) AS high, last(value ORDER BY ts, event_id) AS last_value FROM m GROUP BY user_id, metric_type""")
register("agg_27_habits", P.habits, """
SELECT user_id, round(avg(hour(ts) + minute(ts) / 60) FILTER (metric_type = 'purchase'), 6) AS meal_hour, round(stddev_pop(hour(ts) + minute(ts) / 60) FILTER (metric_type = 'purchase'), 6) AS meal_spread,
count(*) FILTER (metric_type = 'purchase' AND hour(ts) >= 20) AS late_meals, round(count(DISTINCT ts::DATE) FILTER (metric_type = 'signup') / 30, 6) AS adherence, count(*) FILTER (metric_type = 'view') AS workouts, round(count(*) FILTER (metric_type = 'view') / 30 * 7, 6) AS workouts_per_week FROM m GROUP BY user_id""")
register("agg_29_learning_status", P.learning_status, """
WITH g AS (SELECT user_id, round(0.3 * least(1, count(*) / 100) + 0.3 * greatest(0, 1 - stddev_pop(value) / avg(value)) + 0.2 * least(1, count(DISTINCT metric_type) / 5) + 0.2 * (count(DISTINCT ts::DATE) / 30), 6) AS score FROM m GROUP BY user_id)
SELECT user_id, score, CASE WHEN score >= 0.8 THEN 'expert' WHEN score >= 0.6 THEN 'advanced' WHEN score >= 0.4 THEN 'developing' WHEN score >= 0.2 THEN 'beginning' ELSE 'initial' END AS stage,
CASE WHEN score >= 0.8 THEN NULL WHEN score >= 0.6 THEN 0.8 WHEN score >= 0.4 THEN 0.6 WHEN score >= 0.2 THEN 0.4 ELSE 0.2 END::DOUBLE AS next_milestone FROM g""")
register("agg_30_intervention_history", lambda m: P.intervention_history(intervention_scores(m)), f"""
WITH {SCORES}, g AS (SELECT user_id, category, count(*) AS n, avg(effectiveness) AS mean, count(*) FILTER (effectiveness >= 60) AS wins FROM es GROUP BY ALL)
SELECT user_id, sum(n)::BIGINT AS n, sum(wins)::BIGINT AS wins, last(category ORDER BY round(mean, 6), category) AS best_category, round(avg(mean), 6) AS mean_effectiveness, round(sum(wins) / sum(n), 6) AS preference FROM g GROUP BY user_id""")
register("agg_31_report_evolution", lambda m: P.report_evolution(m.select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("metric_type").alias("kind"), (F.col("value") / 1000).alias("confidence"))), """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM m QUALIFY k <= 30), h AS (SELECT *, ntile(2) OVER w AS half, row_number() OVER w AS i FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(DISTINCT metric_type) AS kinds, round(avg(value / 1000) FILTER (half = 1), 6) AS older, round(avg(value / 1000) FILTER (half = 2), 6) AS newer, CASE WHEN count(*) > 1 THEN round(regr_slope(value / 1000, i), 6) END AS slope FROM h GROUP BY user_id""")


def _candidates(m):
    g = m.groupBy("user_id", F.col("metric_type").alias("kind")).agg(F.least(F.lit(1.0), F.count(F.lit(1)) / 30).alias("confidence"), F.avg((F.col("value") > 60).cast("double")).alias("success"))
    return g.withColumn("preference", F.length("kind") / 10)


RANK = "ca AS (SELECT user_id, metric_type AS kind, round(least(1, count(*) / 30) * (1 + length(metric_type) / 10) * avg(CASE WHEN value > 60 THEN 1 ELSE 0 END), 6) AS score FROM m GROUP BY user_id, metric_type)"
register("top_2_rank_recommendations", lambda m: P.rank_recommendations(_candidates(m)), f"WITH {RANK} SELECT user_id, kind, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, kind) AS k FROM ca QUALIFY k <= 3")
register("top_3_compose_text", lambda m: P.compose_text(P.rank_recommendations(_candidates(m), 5).select("user_id", F.col("k").alias("rank"), F.concat(F.lit("Consider "), F.repeat("kind", 20)).alias("text"))), f"""
WITH {RANK}, k AS (SELECT user_id, kind, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, kind) AS k FROM ca QUALIFY k <= 3), t AS (SELECT user_id, string_agg('Consider ' || repeat(kind, 20), ' ' ORDER BY k) AS text FROM k GROUP BY user_id)
SELECT user_id, CASE WHEN length(text) > 306 THEN left(text, 305) || '…' ELSE text END AS text FROM t""")
register("tst_6_mad", lambda m: rounded(with_mad(m)), f"WITH {MAD} SELECT user_id, metric_type, round(median, 6) AS median, round(mad, 6) AS mad FROM mad")
register("tst_7_winsorized_mean", winsorized_mean, f"WITH {WINSOR} SELECT * FROM wins")


def _wilson(m):
    g = m.groupBy("metric_type").agg(F.count_if(F.col("value") > 60).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return g.select("metric_type", "k", "n", r6(low).alias("low"), r6(high).alias("high"))


register("tst_5_wilson_ci", _wilson, """
WITH g AS (SELECT metric_type, count(*) FILTER (value > 60) AS k, count(*) AS n, 1.959963984540054 AS z FROM m GROUP BY metric_type), p AS (SELECT *, k / n AS p FROM g)
SELECT metric_type, k, n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM p""")
register("tst_5_mean_ci", mean_ci, f"""
WITH g AS (SELECT user_id, metric_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM m GROUP BY user_id, metric_type), q AS (SELECT *, {TQ} * sd / sqrt(n) AS half FROM g WHERE n >= 2)
SELECT user_id, metric_type, n, round(mean, 6) AS mean, round(mean - half, 6) AS low, round(mean + half, 6) AS high FROM q""")
register("tst_9_confidence_factors", P.confidence_factors, """
WITH g AS (SELECT user_id, count(*) AS n, round((least(1, count(*) / 100) + count(DISTINCT metric_type) / 5 + least(1, count(DISTINCT ts::DATE) / 30) + greatest(0, 1 - stddev_pop(value) / avg(value) / 2) + CASE WHEN count(*) >= 30 THEN 1 ELSE count(*) / 30 END) / 5, 6) AS c FROM m GROUP BY user_id)
SELECT user_id, n, n >= 30 AS enough, c AS confidence, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.6 THEN 'medium' ELSE 'low' END AS level, CASE WHEN c >= 0.8 THEN 'use' WHEN c >= 0.6 THEN 'use with care' ELSE 'collect more data' END AS advice FROM g""")
