"""Queries over readings: scans, projections, grouped statistics, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom.functions import labels
from pulseloom.operators import aggregates as A, windows as W
from pulseloom.plans.registry import register
from pulseloom.sources.readings import scan

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
TYPES = ["click", "purchase", "error", "signup", "view", "heart_rate"]

register("src_1_metric_scan", lambda m: scan(m, 7, ["click", "view"], "2024-01-05 00:00:00", "2024-01-25 00:00:00", 100), """
SELECT * FROM m WHERE user_id = 7 AND metric_type IN ('click', 'view') AND value IS NOT NULL
AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' ORDER BY ts DESC, event_id DESC LIMIT 100""")

register("prj_3_hour_filter", lambda m: m.where(labels.hour_between(F.col("ts"), 22, 6)).select("event_id", "user_id", "ts", "value"),
         "SELECT event_id, user_id, ts, value FROM m WHERE hour(ts) >= 22 OR hour(ts) <= 6")

register("prj_7_labels", lambda m: m.select("event_id", *[labels.label(F.col("value") / 100, s).alias(s) for s in labels.SCALES]),
         "SELECT event_id, " + ", ".join(f"{labels.label_sql('value / 100', s)} AS {s}" for s in labels.SCALES) + " FROM m")

register("prj_8_day_phases", lambda m: m.select("event_id", labels.phase(F.col("ts")).alias("phase"), labels.meal(F.col("ts")).alias("meal"), F.when(F.weekday("ts") >= 5, "weekend").otherwise("weekday").alias("day_type")), """
SELECT event_id, CASE WHEN hour(ts) < 5 THEN 'night' WHEN hour(ts) < 8 THEN 'early_morning' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 17 THEN 'afternoon'
WHEN hour(ts) < 21 THEN 'evening' ELSE 'late_evening' END AS phase,
CASE WHEN hour(ts) BETWEEN 5 AND 10 THEN 'breakfast' WHEN hour(ts) BETWEEN 11 AND 15 THEN 'lunch' WHEN hour(ts) BETWEEN 16 AND 21 THEN 'dinner' ELSE 'snack' END AS meal,
CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type FROM m""")

register("prj_6_sample_series", lambda m: m.groupBy("user_id", "metric_type", F.date_trunc("hour", "ts").alias("bucket")).agg(F.min_by("value", F.struct("ts", "event_id")).alias("value")), """
SELECT user_id, metric_type, date_trunc('hour', ts) AS bucket, first(value ORDER BY ts, event_id) AS value FROM m GROUP BY ALL""")

register("agg_1_metric_aggregate", A.metric_aggregate, """
SELECT user_id, metric_type, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, round(sum(value), 6) AS sum_value, count(value) AS n,
last(value ORDER BY ts, event_id) AS latest FROM m GROUP BY user_id, metric_type""")

register("agg_2_availability", A.availability, f"""
SELECT user_id, metric_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, date_diff('day', min(ts), max(ts)) + 1 AS days_covered,
round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value FROM m WHERE ts >= {NOW} - INTERVAL 7 DAY AND ts < {NOW} GROUP BY user_id, metric_type""")

WINSOR = """k AS (SELECT *, row_number() OVER (PARTITION BY user_id, metric_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY user_id, metric_type) AS n FROM m),
lim AS (SELECT user_id, metric_type, max(value) FILTER (k = floor(n * 0.05) + 1) AS low, max(value) FILTER (k = n - floor(n * 0.05)) AS high FROM k GROUP BY ALL),
wins AS (SELECT user_id, metric_type, round(avg(least(greatest(value, low), high)), 6) AS winsorized_mean FROM m JOIN lim USING (user_id, metric_type) GROUP BY ALL)"""
MAD = """med AS (SELECT user_id, metric_type, median(value) AS median FROM m GROUP BY ALL),
mad AS (SELECT user_id, metric_type, any_value(median) AS median, median(abs(value - median)) * 1.4826 AS mad FROM m JOIN med USING (user_id, metric_type) GROUP BY ALL)"""

register("agg_3_metric_statistics", A.metric_statistics, f"""
WITH {WINSOR}, {MAD}
SELECT user_id, metric_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS min_value, max(value) AS max_value,
round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr,
round(greatest(0, 1 - stddev_samp(value) / abs(avg(value))), 6) AS consistency, round(any_value(mad.median), 6) AS median, round(any_value(mad.mad), 6) AS mad, any_value(winsorized_mean) AS winsorized_mean
FROM m JOIN mad USING (user_id, metric_type) JOIN wins USING (user_id, metric_type) GROUP BY user_id, metric_type""")

# the Cornish-Fisher expansion of Student's quantile at 0.975, as in functions.stats
Z = 1.959963984540054
TQ = (f"CASE n WHEN 2 THEN tan(pi() * 0.475) WHEN 3 THEN 0.95 * sqrt(2 / (1 - 0.95 * 0.95)) ELSE {Z} + {(Z**3 + Z) / 4} / (n - 1) + {(5 * Z**5 + 16 * Z**3 + 3 * Z) / 96} / pow(n - 1, 2) + "
      f"{(3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384} / pow(n - 1, 3) + {(79 * Z**9 + 776 * Z**7 + 1482 * Z**5 - 1920 * Z**3 - 945 * Z) / 92160} / pow(n - 1, 4) END")  # fmt: skip
BASE = f"""{MAD}, base AS (SELECT user_id, metric_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
FROM m GROUP BY ALL HAVING count(value) >= 3), b AS (SELECT *, q3 - q1 AS iqr, mean - {TQ} * sd / sqrt(n) AS ci_low, mean + {TQ} * sd / sqrt(n) AS ci_high FROM base JOIN mad USING (user_id, metric_type))"""
ROUNDED = ["mean", "sd", "median", "mad", "q1", "q3", "iqr", "ci_low", "ci_high"]
PATTERN = "(SELECT user_id, metric_type, string_agg(printf('%d:%.6f/%d', key, mean, n), ',' ORDER BY key) AS pattern FROM (SELECT user_id, metric_type, {key} AS key, round(avg(value), 6) AS mean, count(value) AS n FROM m WHERE value IS NOT NULL GROUP BY ALL) GROUP BY ALL)"


def _baselines(m):
    """Baselines with their patterns as text: hour (or weekday):mean/number."""
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.format_string("%d:%.6f/%d", e.key, A.r6(e.value["mean"]), e.value["n"])), ",").alias(c)
    return A.baselines(m, patterns=True).select("user_id", "metric_type", "n", *[A.r6(c).alias(c) for c in ROUNDED], text("circadian_pattern"), text("weekly_pattern"))


register("agg_4_baselines", _baselines, f"WITH {BASE} SELECT user_id, metric_type, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ROUNDED)
         + f", c.pattern AS circadian_pattern, w.pattern AS weekly_pattern FROM b JOIN {PATTERN.format(key='hour(ts)')} c USING (user_id, metric_type) JOIN {PATTERN.format(key='isodow(ts) - 1')} w USING (user_id, metric_type)")

for name, run, key in (("agg_5_hourly_pattern", A.hourly_pattern, "hour(ts) AS hour"), ("agg_5_weekly_pattern", A.weekly_pattern, "isodow(ts) - 1 AS weekday")):
    register(name, run, f"SELECT user_id, metric_type, {key}, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count(*) AS n FROM m GROUP BY ALL")

HOURS = "h AS (SELECT metric_type, hour(ts) AS hour, avg(value) AS mean, stddev_pop(value) AS sd, count(*) AS n FROM m GROUP BY ALL)"
register("agg_6_circadian_context", A.circadian_context, f"""
WITH {HOURS} SELECT metric_type, first(hour ORDER BY round(mean, 9) DESC, hour) AS peak_hour, count(*) AS hours, round(stddev_pop(mean), 6) AS spread,
round(greatest(0, 1 - stddev_pop(mean) / abs(avg(mean))), 6) AS regularity, round(avg(greatest(0, 1 - sd / abs(mean))), 6) AS peak_consistency FROM h WHERE n >= 2 GROUP BY metric_type""")
register("agg_7_daily_pattern", A.daily_pattern, f"""
WITH {HOURS}, e AS (SELECT metric_type, first(hour ORDER BY round(mean, 9) DESC, hour) AS peak_hour, first(hour ORDER BY round(mean, 9), hour) AS lowest_hour FROM h GROUP BY ALL)
SELECT metric_type, any_value(peak_hour) AS peak_hour, any_value(lowest_hour) AS lowest_hour, round(avg(value) FILTER (hour(ts) BETWEEN 6 AND 12), 6) AS morning,
round(avg(value) FILTER (hour(ts) BETWEEN 12 AND 18), 6) AS afternoon, round(avg(value) FILTER (hour(ts) BETWEEN 18 AND 22), 6) AS evening,
round(avg(value) FILTER (hour(ts) >= 22 OR hour(ts) <= 6), 6) AS overnight FROM m JOIN e USING (metric_type) GROUP BY metric_type""")
register("agg_8_weekend_effect", A.weekend_effect, """
WITH g AS (SELECT user_id, metric_type, avg(value) FILTER (isodow(ts) < 6) AS a, avg(value) FILTER (isodow(ts) >= 6) AS b FROM m GROUP BY ALL)
SELECT user_id, metric_type, round(a, 6) AS weekday_mean, round(b, 6) AS weekend_mean, round(b - a, 6) AS difference, round((b - a) / a * 100, 6) AS percent FROM g""")
register("agg_9_period_vs_typical", A.period_vs_typical, f"""
WITH g AS (SELECT user_id, metric_type, avg(value) FILTER (n) AS a, min(value) FILTER (n) AS recent_min, max(value) FILTER (n) AS recent_max, avg(value) FILTER (NOT n) AS b
FROM (SELECT *, ts >= {NOW} - INTERVAL 2 DAY AND ts < {NOW} AS n FROM m) GROUP BY ALL)
SELECT user_id, metric_type, round(a, 6) AS recent_mean, recent_min, recent_max, round(b, 6) AS typical_mean, round((a - b) / b * 100, 6) AS percent FROM g WHERE a IS NOT NULL""")
register("agg_10_weekly_averages", A.weekly_averages, """
WITH w AS (SELECT user_id, metric_type, date_trunc('week', ts)::DATE AS week, avg(value) AS mean, count(*) AS n FROM m GROUP BY ALL)
SELECT user_id, metric_type, week, round(mean, 6) AS mean, n, round(last_value(mean) OVER s - first_value(mean) OVER s, 6) AS change FROM w
WINDOW s AS (PARTITION BY user_id, metric_type ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
register("agg_11_trend_card", A.trend_card, f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, metric_type ORDER BY ts, event_id) AS k FROM m WHERE ts >= {NOW} - INTERVAL 15 DAY AND ts < {NOW}),
p AS (SELECT user_id, metric_type, round(avg(value), 6) AS previous_mean FROM m WHERE ts >= {NOW} - INTERVAL 30 DAY AND ts < {NOW} - INTERVAL 15 DAY GROUP BY ALL)
SELECT user_id, metric_type, round(avg(value), 6) AS mean, min(value) AS min_value, max(value) AS max_value, round(stddev_samp(value), 6) AS sd, CASE WHEN count(*) > 1 THEN round(regr_slope(value, k), 6) END AS slope, any_value(previous_mean) AS previous_mean
FROM r LEFT JOIN p USING (user_id, metric_type) GROUP BY user_id, metric_type""")

HOURLY = """hm AS (SELECT metric_type, date_trunc('hour', ts) AS hour, avg(value) AS mean FROM m GROUP BY ALL),
grid AS (SELECT metric_type, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM hm GROUP BY metric_type),
g AS (SELECT grid.metric_type, grid.hour, hm.mean FROM grid LEFT JOIN hm USING (metric_type, hour))"""
FILLED = HOURLY + """, f AS (SELECT metric_type, hour, coalesce(last_value(mean IGNORE NULLS) OVER (PARTITION BY metric_type ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value(mean IGNORE NULLS) OVER (PARTITION BY metric_type ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS mean FROM g)"""
register("agg_12_resample_hourly", lambda m: A.resample_hourly(m).withColumn("mean", A.r6("mean")), f"WITH {FILLED} SELECT metric_type, hour, round(mean, 6) AS mean FROM f")
LINEAR = f"""WITH {HOURLY}, s AS (SELECT *, epoch(hour) / 3600 AS h, last_value(CASE WHEN mean IS NOT NULL THEN epoch(hour) / 3600 END IGNORE NULLS) OVER a AS ph, last_value(mean IGNORE NULLS) OVER a AS pv,
first_value(CASE WHEN mean IS NOT NULL THEN epoch(hour) / 3600 END IGNORE NULLS) OVER b AS qh, first_value(mean IGNORE NULLS) OVER b AS qv FROM g
WINDOW a AS (PARTITION BY metric_type ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY metric_type ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT metric_type, hour, round(CASE WHEN mean IS NOT NULL THEN mean ELSE pv + (qv - pv) * (h - ph) / (qh - ph) END, 6) AS mean FROM s"""
register("agg_13_resample_linear", lambda m: A.resample_linear(m).withColumn("mean", A.r6("mean")), LINEAR)


def by_person(sql: str) -> str:
    """An equivalent over types as one over each person's types."""
    return sql.replace("metric_type", "user_id, metric_type")


register("agg_12_resample_hourly_by_person", lambda m: A.resample_hourly(m, A.KEYS).withColumn("mean", A.r6("mean")), by_person(f"WITH {FILLED} SELECT metric_type, hour, round(mean, 6) AS mean FROM f"))
# a value that lies half-way between two of six digits, as interpolated ones do, goes up on both sides
register("agg_13_resample_linear_by_person", lambda m: A.resample_linear(m, A.KEYS).withColumn("mean", A.r6(F.col("mean") + 1e-9)), by_person(LINEAR.replace("END, 6) AS mean FROM s", "END + 1e-9, 6) AS mean FROM s")))
register("agg_15_daily_features", A.daily_features, f"""
WITH {HOURLY} SELECT metric_type, hour::DATE AS day, count(*) AS hours, round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS sd, round(max(mean), 6) AS max_value, round(min(mean), 6) AS min_value
FROM hm GROUP BY ALL HAVING count(*) >= 12""")
register("agg_16_ingestion_audit", A.ingestion_audit, f"""
SELECT metric_type, count(*) AS n, count(DISTINCT ts::DATE) AS days, round(count(*) / count(DISTINCT ts::DATE), 6) AS per_day, count(*) FILTER (value IS NULL) AS nulls,
count(*) FILTER (ts > {NOW}) AS future, count(*) - count(DISTINCT (user_id, metric_type, ts)) AS repeated FROM m GROUP BY metric_type""")
register("agg_18_type_distribution", A.type_distribution, "SELECT metric_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM m GROUP BY metric_type")
register("agg_20_system_statistics", A.system_statistics, "SELECT " + ", ".join(
    f"count(*) FILTER (ts >= {NOW} - INTERVAL {d} DAY AND ts < {NOW}) AS readings_{d}d, count(DISTINCT user_id) FILTER (ts >= {NOW} - INTERVAL {d} DAY AND ts < {NOW}) AS users_{d}d" for d in (1, 7, 30)) + ", count(*) AS readings FROM m")
register("agg_21_series_quality", A.series_quality, """
WITH g AS (SELECT user_id, metric_type, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id, metric_type ORDER BY ts, event_id) AS gap FROM m),
q AS (SELECT user_id, metric_type, avg(gap) AS mean, stddev_pop(gap) AS sd, median(gap) AS mid, count(*) AS n, max(s) - min(s) AS span FROM g GROUP BY ALL HAVING count(*) >= 3)
SELECT user_id, metric_type, round(greatest(0, 1 - sd / mean / 2), 6) AS evenness, round(greatest(0, 1 - sd / mean), 6) AS strict_evenness, round(greatest(0, 1 - sd / mid), 6) AS median_evenness,
round(least(1, n / (span / 3600 + 1)), 6) AS completeness, round(mid, 6) AS interval_seconds FROM q""")
register("agg_22_percentile_of_score", A.percentile_of_score, """
SELECT event_id, user_id, metric_type, value, CASE WHEN count(*) OVER p < 10 THEN 50 ELSE round((rank() OVER o - 1 + count(*) OVER (o RANGE UNBOUNDED PRECEDING) + 1) * 50 / count(*) OVER p, 6) END AS percentile_rank
FROM m WINDOW p AS (PARTITION BY user_id, metric_type), o AS (PARTITION BY user_id, metric_type ORDER BY value)""")
register("agg_28_user_profile", A.user_profile, """
WITH g AS (SELECT user_id, min(ts) AS since, count(*) AS n, count(DISTINCT metric_type) AS types, date_diff('day', min(ts)::DATE, DATE '2024-01-31') AS d FROM m GROUP BY user_id)
SELECT user_id, d AS tenure_days, n, round(n / d, 6) AS per_day, CASE WHEN n / d >= 5 THEN 'high' WHEN n / d >= 2 THEN 'medium' ELSE 'low' END AS engagement, round(least(1, types / 15.0), 6) AS quality FROM g""")

O = "(PARTITION BY user_id, metric_type ORDER BY ts, event_id)"  # noqa: E741
register("win_1_latest", W.latest, "SELECT user_id, metric_type, event_id, ts, value FROM m QUALIFY row_number() OVER (PARTITION BY user_id, metric_type ORDER BY ts DESC, event_id DESC) = 1")
register("win_2_last_n", W.last_n, "SELECT event_id, user_id, metric_type, ts, value, row_number() OVER (PARTITION BY user_id, metric_type ORDER BY ts DESC, event_id DESC) AS k FROM m QUALIFY k <= 3")
register("win_3_gaps", W.gaps, f"""
WITH g AS (SELECT user_id, metric_type, lag(ts) OVER s AS previous, ts, round((epoch_us(ts) - epoch_us(lag(ts) OVER s)) / 3.6e9, 6) AS gap_hours FROM m WINDOW s AS {O}) SELECT * FROM g WHERE gap_hours > 25""")
register("win_4_lag_roll_features", W.lag_roll_features, "SELECT event_id, user_id, metric_type, value, " + ", ".join(f"lag(value, {k}) OVER s AS lag_{k}" for k in (1, 2, 3, 7)) + ", " + ", ".join(
    f"CASE WHEN count(*) OVER w{n} = {n} THEN round(avg(value) OVER w{n}, 6) END AS mean_{n}, CASE WHEN count(*) OVER w{n} = {n} THEN round(stddev_samp(value) OVER w{n}, 6) END AS sd_{n}" for n in (3, 7))
    + f" FROM m WINDOW s AS {O}, " + ", ".join(f"w{n} AS (PARTITION BY user_id, metric_type ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (3, 7)))
# each reading with the mean and deviation of the others of its window: the w rows around it, or the nearest w rows at the ends
OTHERS = f"""ok AS (SELECT *, row_number() OVER {O} AS k, count(*) OVER (PARTITION BY user_id, metric_type) AS n FROM m WHERE value IS NOT NULL), ow AS (SELECT *, least({{most}}, n // {{part}}) AS w FROM ok),
os AS (SELECT *, greatest(1, least(k - w // 2, n - w + 1)) AS a FROM ow WHERE w >= 3),
oc AS (SELECT x.event_id, x.user_id, x.metric_type, any_value(x.ts) AS ts, any_value(x.value) AS value, any_value(x.k) AS k, any_value(x.n) AS n, any_value(x.w) AS w, avg(y.value) AS mean, stddev_samp(y.value) AS sd
FROM os x JOIN ok y ON x.user_id = y.user_id AND x.metric_type = y.metric_type AND y.k >= x.a AND y.k < x.a + x.w AND y.k <> x.k GROUP BY x.event_id, x.user_id, x.metric_type)"""
CENTERED = """c AS (SELECT *, CASE WHEN count(*) OVER w = 5 THEN avg(value) OVER w END AS cm, CASE WHEN count(*) OVER w = 5 THEN stddev_samp(value) OVER w END AS cs FROM m
WINDOW w AS (PARTITION BY user_id, metric_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
rc AS (SELECT *, coalesce(last_value(cm IGNORE NULLS) OVER a, first_value(cm IGNORE NULLS) OVER b) AS mean, coalesce(last_value(cs IGNORE NULLS) OVER a, first_value(cs IGNORE NULLS) OVER b) AS sd FROM c
WINDOW a AS (PARTITION BY user_id, metric_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id, metric_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
register("win_5_rolling_centered", lambda m: W.rolling_centered(m).select("event_id", A.r6("mean").alias("mean"), A.r6("sd").alias("sd")), f"WITH {CENTERED} SELECT event_id, round(mean, 6) AS mean, round(sd, 6) AS sd FROM rc")
register("win_6_filled", W.filled, """
WITH s AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS seen FROM m) SELECT event_id, user_id, metric_type,
coalesce(last_value(seen IGNORE NULLS) OVER (PARTITION BY user_id, metric_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value(seen IGNORE NULLS) OVER (PARTITION BY user_id, metric_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM s""")
register("win_7_ma_trend", W.ma_trend, f"""
WITH s AS (SELECT *, row_number() OVER {O} AS k, count(*) OVER (PARTITION BY user_id, metric_type) AS n FROM m), v AS (SELECT *, least(7, n // 3) AS w FROM s WHERE n >= 6),
a AS (SELECT x.user_id, x.metric_type, x.k, avg(y.value) AS ma FROM v x JOIN v y ON x.user_id = y.user_id AND x.metric_type = y.metric_type AND y.k BETWEEN x.k - x.w AND x.k - 1 WHERE x.k > x.w GROUP BY ALL),
g AS (SELECT user_id, metric_type, arg_min(ma, k) AS f, arg_max(ma, k) AS l, count(*) AS p FROM a GROUP BY ALL)
SELECT user_id, metric_type, round(f, 6) AS first_ma, round(l, 6) AS last_ma, round((l - f) / greatest(1, p - 1), 6) AS slope,
CASE WHEN (l - f) / greatest(1, p - 1) > 0.1 THEN 'increasing' WHEN (l - f) / greatest(1, p - 1) < -0.1 THEN 'decreasing' ELSE 'stable' END AS direction FROM g""")
register("win_8_rolling_corr", lambda m: W.rolling_corr(m, "click", "view"), """
WITH d AS (SELECT user_id, ts::DATE AS day, avg(value) FILTER (metric_type = 'click') AS x, avg(value) FILTER (metric_type = 'view') AS y FROM m GROUP BY ALL),
r AS (SELECT user_id, CASE WHEN count(*) OVER w >= 5 THEN corr(x, y) OVER w END AS r FROM d WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 6 FOLLOWING))
SELECT user_id, round(avg(r), 6) AS mean_r, round(stddev_pop(r), 6) AS sd_r, round(max(r) - min(r), 6) AS range_r, count(*) AS windows, round(greatest(0, 1 - stddev_pop(r)), 6) AS stability FROM r WHERE r IS NOT NULL GROUP BY user_id""")
register("win_9_sessionise", W.sessionise, """
WITH n AS (SELECT *, CASE WHEN lag(ts) OVER s IS NULL OR ts - lag(ts) OVER s > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM m WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM n""")
register("win_10_thirds_trend", W.thirds_trend, f"""
WITH s AS (SELECT *, row_number() OVER {O} AS k, count(*) OVER (PARTITION BY user_id, metric_type) AS n FROM m),
g AS (SELECT user_id, metric_type, avg(value) FILTER (k <= n // 3) AS a, avg(value) FILTER (k > n - n // 3) AS b FROM s WHERE n >= 6 GROUP BY ALL)
SELECT user_id, metric_type, round(a, 6) AS first_third, round(b, 6) AS last_third, CASE WHEN (b - a) / a > 0.1 THEN 'increasing' WHEN (b - a) / a < -0.1 THEN 'decreasing' ELSE 'stable' END AS direction FROM g""")
IQR = """q AS (SELECT user_id, metric_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM m GROUP BY ALL),
fence AS (SELECT user_id, metric_type, round(q1 - 1.5 * (q3 - q1), 6) AS low, round(q3 + 1.5 * (q3 - q1), 6) AS high FROM q),
outl AS (SELECT event_id, user_id, metric_type, value, low, high FROM m JOIN fence USING (user_id, metric_type) WHERE value < low OR value > high)"""
register("win_11_iqr_outliers", W.iqr_outliers, f"WITH {IQR} SELECT * FROM outl")
register("win_12_integrity_report", lambda m: W.integrity_report(m, TYPES), f"""
WITH {IQR}, s AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER {O})) / 3.6e9 AS gap FROM m),
r AS (SELECT p.user_id, coalesce((SELECT count(*) FROM s WHERE s.user_id = p.user_id AND round(gap, 6) > 25), 0) AS gaps, coalesce((SELECT count(*) FROM outl o WHERE o.user_id = p.user_id), 0) AS outliers,
6 - (SELECT count(DISTINCT metric_type) FROM m WHERE m.user_id = p.user_id AND metric_type IN ('click', 'purchase', 'error', 'signup', 'view', 'heart_rate')) AS missing_types FROM (SELECT DISTINCT user_id FROM m) p)
SELECT *, CASE WHEN missing_types = 0 AND outliers = 0 THEN 'good' WHEN outliers <= 3 THEN 'fair' ELSE 'poor' END AS grade FROM r""")
