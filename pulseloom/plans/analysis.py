"""Queries of anomalies, trends and forecasts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pulseloom.functions.labels import label_sql
from pulseloom.operators import anomalies as X, trends as T
from pulseloom.plans.core import MAD, O, OTHERS
from pulseloom.plans.registry import register
from pulseloom.plans.relational import rounded

K = "user_id, metric_type"
P = "(PARTITION BY user_id, metric_type)"
Z = """sz AS (SELECT event_id, user_id, metric_type, tanh(abs(value - mu) / sd / 3) AS score FROM (SELECT *, avg(value) OVER p AS mu, stddev_samp(value) OVER p AS sd, count(*) OVER p AS n FROM m WINDOW p AS (PARTITION BY user_id, metric_type)) WHERE n >= 5 AND sd > 0)"""
MZ = MAD + """, sm AS (SELECT event_id, user_id, metric_type, CASE WHEN mad / 1.4826 > 0 THEN tanh(0.6745 * abs(value - median) / (mad / 1.4826) / 3.5) ELSE 0 END AS score FROM (SELECT *, count(*) OVER (PARTITION BY user_id, metric_type) AS n FROM m) x JOIN mad USING (user_id, metric_type) WHERE n >= 5)"""
SP = OTHERS.format(most=10, part=3) + f""", ss AS (SELECT event_id, user_id, metric_type, tanh(greatest(round(abs(value - mean) / sd, 9) - 3, 0) / 3) AS score, round(abs(value - mean) / sd, 9) > 3 AS out_of_control FROM oc WHERE sd > 1e-9
UNION ALL SELECT event_id, user_id, metric_type, score, score > tanh(1) FROM sz JOIN (SELECT user_id, metric_type FROM m GROUP BY ALL HAVING count(value) < 9) USING (user_id, metric_type))"""
register("ano_1_zscore", lambda m: rounded(X.zscore(m)), f"WITH {Z} SELECT event_id, {K}, round(score, 6) AS score FROM sz")
register("ano_2_modified_z", lambda m: rounded(X.modified_z(m)), f"WITH {MZ} SELECT event_id, {K}, round(score, 6) AS score FROM sm")
register("ano_8_spc", lambda m: rounded(X.spc(m)), f"WITH {Z}, {SP} SELECT event_id, {K}, round(score, 6) AS score, out_of_control FROM ss")
SEASONAL = f"""sp AS (SELECT *, row_number() OVER {O} % least(7, n // 3) AS ph FROM (SELECT *, count(*) OVER {P} AS n FROM m WHERE value IS NOT NULL) WHERE n >= 6), sr AS (SELECT *, value - avg(value) OVER (PARTITION BY user_id, metric_type, ph) AS res FROM sp),
s7 AS (SELECT event_id, user_id, metric_type, tanh(abs(res) / sd / 3) AS score FROM (SELECT *, stddev_pop(res) OVER {P} AS sd FROM sr) WHERE sd > 1e-9)"""
register("ano_7_seasonal", lambda m: rounded(X.seasonal(m)), f"WITH {SEASONAL} SELECT event_id, {K}, round(score, 6) AS score FROM s7")
LOF = f"""lc AS (SELECT *, least(20, greatest(5, n // 10)) AS nn FROM (SELECT *, row_number() OVER (PARTITION BY user_id, metric_type ORDER BY value, event_id) AS k, count(*) OVER {P} AS n FROM m WHERE value IS NOT NULL)),
nn AS (SELECT a.user_id, a.metric_type, a.event_id, a.nn, b.event_id AS o, abs(b.value - a.value) AS d FROM lc a JOIN lc b ON a.user_id = b.user_id AND a.metric_type = b.metric_type AND b.k BETWEEN a.k - a.nn AND a.k + a.nn AND a.k <> b.k
WHERE a.n > a.nn QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.value - a.value), b.event_id) <= a.nn),
kd AS (SELECT event_id, max(d) AS kd FROM nn GROUP BY ALL), de AS (SELECT nn.event_id, nn.user_id, nn.metric_type, any_value(nn.nn) / greatest(sum(greatest(nn.d, kd.kd)), 1e-10) AS de FROM nn JOIN kd ON kd.event_id = nn.o GROUP BY nn.event_id, nn.user_id, nn.metric_type),
s5 AS (SELECT x.event_id, x.user_id, x.metric_type, sum(y.de) / any_value(nn.nn) / any_value(x.de) AS score FROM de x JOIN nn ON nn.event_id = x.event_id JOIN de y ON y.event_id = nn.o GROUP BY x.event_id, x.user_id, x.metric_type)"""
register("ano_5_lof", lambda m: rounded(X.lof(m)), f"WITH {LOF} SELECT event_id, {K}, round(score, 6) AS lof FROM s5")
ENVELOPE = f"""vc AS (SELECT *, row_number() OVER (PARTITION BY user_id, metric_type ORDER BY value, event_id) AS k, count(*) OVER {P} AS n FROM m),
vw AS (SELECT a.user_id, a.metric_type, a.k, avg(b.value) AS center, var_pop(b.value) AS spread FROM vc a JOIN vc b ON a.user_id = b.user_id AND a.metric_type = b.metric_type AND b.k > a.k - (a.n // 2 + 1) AND b.k <= a.k
WHERE a.n >= 5 AND a.k >= a.n // 2 + 1 GROUP BY ALL), vb AS (SELECT user_id, metric_type, first(center ORDER BY round(spread, 6), k) AS center, first(spread ORDER BY round(spread, 6), k) AS spread FROM vw GROUP BY ALL),
s6 AS (SELECT event_id, user_id, metric_type, abs(value - center) / sqrt(spread) AS score FROM m JOIN vb USING (user_id, metric_type) WHERE spread > 1e-6)"""
register("ano_6_envelope", lambda m: X.envelope(m).select("event_id", "user_id", "metric_type", F.round("distance", 3).alias("distance")), f"WITH {ENVELOPE} SELECT event_id, {K}, round(score, 3) AS distance FROM s6")
UNION = " UNION ALL ".join(f"SELECT event_id, user_id, metric_type, '{n}' AS method, round(score, 4) AS score FROM {t}" for n, t in (("zscore", "sz"), ("mad", "sm"), ("spc", "ss"), ("seasonal", "s7"), ("lof", "s5"), ("envelope", "s6")))
ENS = f"""{Z}, {MZ}, {SP}, {SEASONAL}, {LOF}, {ENVELOPE}, pt AS ({UNION}),
sd2 AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM pt WINDOW w AS (PARTITION BY user_id, metric_type, method)), sc2 AS (SELECT *, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END AS scaled FROM sd2),
eg AS (SELECT event_id, user_id, metric_type, avg(scaled) AS score, count(*) AS methods, count(*) FILTER (scaled > 0.8) AS votes FROM sc2 GROUP BY ALL), li AS (SELECT user_id, metric_type, round(quantile_cont(score, 0.9), 9) AS threshold FROM eg GROUP BY ALL),
en AS (SELECT event_id, user_id, metric_type, score, threshold, round(score, 9) > threshold AS is_anomaly, least(1, votes / methods + 0.3 * tanh(2 * score)) AS confidence, round(score, 9) > threshold AND votes >= greatest(2, 0.7 * methods) AS severe FROM eg JOIN li USING (user_id, metric_type))"""
register("ano_9_ensemble", lambda m: rounded(X.ensemble(m)), f"WITH {ENS} SELECT event_id, {K}, round(score, 6) AS score, round(threshold, 6) AS threshold, is_anomaly, round(confidence, 6) AS confidence, severe FROM en")
register("ano_9_ensemble_with_forest", lambda m: rounded(X.ensemble(m, methods=tuple(X.METHODS))))
register("ano_10_details", X.details, f"WITH {ENS} SELECT {K}, count(*) AS n, count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (severe) AS severe, round(avg(score), 6) AS mean_score, round(max(score), 6) AS top_score FROM en GROUP BY {K}")
register("ano_11_simultaneous", X.simultaneous, f"""
WITH {ENS} SELECT m.user_id, ts::DATE AS day, string_agg(DISTINCT m.metric_type, ',' ORDER BY m.metric_type) AS types, count(DISTINCT m.metric_type) AS n_types FROM en JOIN m USING (event_id) WHERE is_anomaly GROUP BY 1, 2 HAVING count(DISTINCT m.metric_type) >= 2""")
register("ano_13_pattern_report", X.pattern_report, f"""
WITH {ENS}, k AS (SELECT *, row_number() OVER {O} AS k FROM m), h AS (SELECT k.*, k - lag(k) OVER {O} AS gap FROM k WHERE event_id IN (SELECT event_id FROM en WHERE is_anomaly))
SELECT metric_type, hour(ts) AS hour, count(*) AS n, count(*) FILTER (gap <= 3) AS clustered, round(avg(value), 6) AS mean_value, max(value) AS max_value FROM h GROUP BY 1, 2""")
register("ano_4_isolation_forest", lambda m: rounded(X.isolation_forest(m)))

LIN = f"""lx AS (SELECT *, epoch_us(ts) / 8.64e10 - min(epoch_us(ts) / 8.64e10) OVER {P} AS x FROM m), lg2 AS (SELECT user_id, metric_type, count(*) AS n, regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept, regr_r2(value, x) AS r2, regr_sxx(value, x) AS sxx, regr_syy(value, x) AS syy
FROM lx GROUP BY ALL HAVING count(*) >= 5 AND regr_sxx(value, x) > 0 AND regr_syy(value, x) > 0)"""
register("trd_1_linear_trend", lambda m: rounded(T.linear_trend(m).drop("p")), f"""
WITH {LIN} SELECT {K}, n, round(slope, 6) AS slope, round(slope * 7, 6) AS per_week, round(slope * 30, 6) AS per_month, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(sqrt((1 - r2) * syy / (n - 2) / sxx), 6) AS se,
CASE WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS direction, {label_sql('sqrt(r2)', 'trend')} AS strength FROM lg2""")
register("trd_2_mann_kendall", lambda m: rounded(T.mann_kendall(m)), f"""
WITH k AS (SELECT *, row_number() OVER {O} AS k FROM m), g AS (SELECT a.user_id, a.metric_type, sum(sign(b.value - a.value)) AS s, sum(abs(sign(b.value - a.value))) AS u, max(b.k)::INT AS n FROM k a JOIN k b ON a.user_id = b.user_id AND a.metric_type = b.metric_type AND a.k < b.k GROUP BY ALL)
SELECT {K}, n, s::DOUBLE AS s, round(s / sqrt(u * (n * (n - 1) / 2)), 6) AS tau, round(CASE WHEN s > 0 THEN s - 1 WHEN s < 0 THEN s + 1 ELSE 0 END / sqrt(n * (n - 1) * (2 * n + 5) / 18), 6) AS z FROM g WHERE n >= 4 AND u > 0""")
DEC = """dy AS (SELECT user_id, metric_type, ts::DATE AS day, avg(value) AS v FROM m GROUP BY ALL), tr AS (SELECT *, CASE WHEN count(*) OVER w = 7 THEN avg(v) OVER w END AS trend, row_number() OVER (PARTITION BY user_id, metric_type ORDER BY day) % 7 AS phase FROM dy
WINDOW w AS (PARTITION BY user_id, metric_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), rw AS (SELECT user_id, metric_type, phase, avg(v - trend) AS raw FROM tr GROUP BY ALL), se AS (SELECT user_id, metric_type, phase, raw - avg(raw) OVER (PARTITION BY user_id, metric_type) AS seasonal FROM rw),
dc AS (SELECT user_id, metric_type, day, v, trend, seasonal, v - trend - seasonal AS residual FROM tr JOIN se USING (user_id, metric_type, phase))"""
register("trd_3_decompose", lambda m: rounded(T.decompose(m)), f"WITH {DEC} SELECT user_id, metric_type, day, round(v, 6) AS v, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(residual, 6) AS residual FROM dc")
register("trd_3_decompose_whole", lambda m: rounded(T.decompose_whole(m)), f"""
WITH dd AS (SELECT user_id, metric_type, ts::DATE AS day, avg(value) AS v, count(*) AS c FROM m WHERE value IS NOT NULL GROUP BY ALL), sp AS (SELECT user_id, metric_type, min(day) AS a, max(day) AS b, sum(c)::INT AS c, (max(day) - min(day))::INT + 1 AS size FROM dd GROUP BY user_id, metric_type),
pe AS (SELECT *, CASE WHEN size > 14 THEN 7 WHEN size > 6 THEN least(3, c // 3) END AS p FROM sp), ok AS (SELECT * FROM pe WHERE p >= 2 AND size >= 2 * p), gr AS (SELECT user_id, metric_type, p, size, p // 2 AS h, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day, a FROM ok),
fi AS (SELECT gr.*, (gr.day - a)::INT AS k, last_value(v IGNORE NULLS) OVER (PARTITION BY gr.user_id, gr.metric_type ORDER BY gr.day ROWS UNBOUNDED PRECEDING) AS v FROM gr LEFT JOIN dd USING (user_id, metric_type, day)),
tr AS (SELECT *, CASE WHEN k >= h AND k < size - h THEN CASE p WHEN 7 THEN avg(v) OVER s3 WHEN 3 THEN avg(v) OVER s1 ELSE (lag(v) OVER s + 2 * v + lead(v) OVER s) / 4 END END AS t FROM fi WINDOW s AS (PARTITION BY user_id, metric_type ORDER BY day), s3 AS (PARTITION BY user_id, metric_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), s1 AS (PARTITION BY user_id, metric_type ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
li AS (SELECT user_id, metric_type, regr_slope(t, k) FILTER (k < h + p) AS s0, regr_intercept(t, k) FILTER (k < h + p) AS i0, regr_slope(t, k) FILTER (k >= size - h - p) AS s1, regr_intercept(t, k) FILTER (k >= size - h - p) AS i1 FROM tr WHERE t IS NOT NULL GROUP BY user_id, metric_type),
wh AS (SELECT tr.*, k % p AS ph, coalesce(t, CASE WHEN k < h THEN i0 + s0 * k ELSE i1 + s1 * k END) AS trend FROM tr JOIN li USING (user_id, metric_type)), ra AS (SELECT user_id, metric_type, ph, avg(v - trend) AS raw FROM wh GROUP BY user_id, metric_type, ph), se AS (SELECT *, raw - avg(raw) OVER (PARTITION BY user_id, metric_type) AS seasonal FROM ra)
SELECT user_id, metric_type, day, p AS period, round(v, 6) AS v, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(v - trend - seasonal, 6) AS residual FROM wh JOIN se USING (user_id, metric_type, ph)""")
register("trd_3_seasonal_strength", lambda m: rounded(T.seasonal_strength(m)), f"WITH {DEC} SELECT user_id, metric_type, count(*) AS days, round(greatest(0, 1 - var_pop(residual) / var_pop(seasonal + residual)), 6) AS strength FROM dc WHERE residual IS NOT NULL GROUP BY user_id, metric_type HAVING var_pop(seasonal + residual) > 1e-12")
register("trd_4_change_points", lambda m: rounded(T.change_points(m)), f"""
WITH k AS (SELECT *, row_number() OVER {O} AS k, count(*) OVER {P} AS n, value - avg(value) OVER {P} AS v, var_pop(value) OVER {P} AS sse FROM m), s AS (SELECT *, sum(v) OVER (PARTITION BY user_id, metric_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM k),
g AS (SELECT *, s * s * (1 / k + 1 / (n - k)) AS gain FROM s WHERE k >= 3 AND n - k >= 3 AND sse > 0) SELECT {K}, k::INT AS split_after, ts AS split_ts, n, round(gain / (sse * n), 6) AS share FROM g
QUALIFY row_number() OVER (PARTITION BY user_id, metric_type ORDER BY round(gain, 6) DESC, k) = 1""")
register("trd_4_segments", lambda m: rounded(T.segments(m)), f"""
WITH k AS (SELECT *, (row_number() OVER {O})::INT AS k, count(*) OVER {P} AS n, var_pop(value) OVER {P} AS spread FROM m WHERE value IS NOT NULL),
r(user_id, metric_type, ts, value, k, n, spread, seg, level) AS (SELECT user_id, metric_type, ts, value, k, n, spread, 1, 0 FROM k
UNION ALL SELECT user_id, metric_type, ts, value, k, n, spread, CASE WHEN k > cut THEN cut + 1 ELSE seg END, level + 1 FROM (
SELECT *, min(CASE WHEN place = 1 AND gain > greatest(1, 0.05 * n) THEN k END) OVER (PARTITION BY user_id, metric_type, seg) AS cut FROM (
SELECT *, row_number() OVER (PARTITION BY user_id, metric_type, seg ORDER BY gain DESC NULLS LAST, k) AS place FROM (
SELECT *, CASE WHEN a >= 3 AND c - a >= 3 AND spread > 1e-12 THEN round(s * s * (1 / a + 1 / (c - a)) / spread, 6) END AS gain FROM (
SELECT *, k - seg + 1 AS a, count(*) OVER g AS c, sum(v) OVER (PARTITION BY user_id, metric_type, seg ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT *, value - avg(value) OVER (PARTITION BY user_id, metric_type, seg) AS v FROM r) WINDOW g AS (PARTITION BY user_id, metric_type, seg))))) WHERE cut IS NOT NULL),
f AS (SELECT user_id, metric_type, k, any_value(ts) AS ts, any_value(value) AS value, arg_max(seg, level) AS seg FROM r GROUP BY user_id, metric_type, k)
SELECT user_id, metric_type, seg AS first_k, max(k) AS last_k, min(ts) AS start_ts, round(avg(value), 6) AS mean, round(regr_slope(value, k), 6) AS slope FROM f GROUP BY user_id, metric_type, seg""")
register("trd_5_rolling_change_flags", T.rolling_change_flags, f"WITH {OTHERS.format(most=5, part=2)} SELECT event_id, {K}, ts, value, round(abs(value - mean) / sd, 6) AS z FROM oc WHERE sd > 1e-9 AND n >= 10 AND k > w AND k <= n - w AND round(abs(value - mean) / sd, 6) > 2")
ACF = """ad AS (SELECT user_id, metric_type, ts::DATE AS day, avg(value) AS v FROM m GROUP BY ALL), ak AS (SELECT user_id, metric_type, row_number() OVER (PARTITION BY user_id, metric_type ORDER BY day) AS k, v - avg(v) OVER p AS c, count(*) OVER p AS n, var_pop(v) OVER p * count(*) OVER p AS tot FROM ad WINDOW p AS (PARTITION BY user_id, metric_type)),
ac AS (SELECT a.user_id, a.metric_type, (b.k - a.k)::INT AS lag, sum(a.c * b.c) / max(a.tot) AS r, max(a.n) AS n FROM ak a JOIN ak b ON a.user_id = b.user_id AND a.metric_type = b.metric_type AND b.k - a.k BETWEEN 1 AND {most} GROUP BY a.user_id, a.metric_type, b.k - a.k HAVING b.k - a.k <= max(a.n) / 2)"""
register("trd_6_acf", lambda m: rounded(T.acf(m).drop("n")), f"WITH {ACF.format(most=10)} SELECT user_id, metric_type, lag, round(r, 6) AS r, round(1.96 / sqrt(n), 6) AS bound, abs(r) > 1.96 / sqrt(n) AS significant FROM ac")
register("trd_6_pacf", lambda m: rounded(T.pacf(m)), f"""
WITH {ACF.format(most=10)}, g AS (SELECT user_id, metric_type, list(r ORDER BY ac.lag) AS r FROM ac GROUP BY user_id, metric_type),
d(user_id, metric_type, r, k, phi, last) AS (SELECT user_id, metric_type, r, 1, [r[1]], r[1] FROM g
UNION ALL SELECT user_id, metric_type, r, k + 1, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - new * phi[k + 1 - i]), new), new FROM (
SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[k + 1 - i]))) / (1 - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[i]))) AS new FROM d WHERE k < len(r)))
SELECT user_id, metric_type, k AS lag, round(last, 6) AS pacf FROM d""")
register("trd_7_seasonality", lambda m: rounded(T.seasonality(m)), f"""
WITH {ACF.format(most=14)}, b AS (SELECT *, lag(r) OVER w AS p, lead(r) OVER w AS q, max(r) OVER (PARTITION BY user_id, metric_type) AS top FROM ac WINDOW w AS (PARTITION BY user_id, metric_type ORDER BY ac.lag))
SELECT user_id, metric_type, min(lag) AS period, round(arg_min(r, lag), 6) AS strength, count(*) AS peaks FROM b WHERE r > p AND r > q AND r > 0 AND round(r - 0.1 * top, 9) > 0 AND lag >= 5 AND lag <= n / 2 GROUP BY user_id, metric_type""")
LF = f"""fk AS (SELECT *, row_number() OVER {O} AS k FROM m), fg AS (SELECT user_id, metric_type, count(*) AS n, regr_slope(value, k) AS b, regr_intercept(value, k) AS a, regr_syy(value, k) AS syy, coalesce(regr_r2(value, k), 0) AS r2 FROM fk GROUP BY ALL),
fl AS (SELECT user_id, metric_type, step, a + b * (n + step) AS f, 1.96 * sqrt((1 - r2) * syy / (n - 2)) * sqrt(1 + 1 / n) AS half FROM fg CROSS JOIN (SELECT unnest(range(1, 8))::INT AS step) WHERE n >= 5)"""
register("fcs_1_forecast_linear", lambda m: rounded(T.forecast_linear(m)), f"WITH {LF} SELECT {K}, step, round(f, 6) AS forecast, round(f - half, 6) AS low, round(f + half, 6) AS high FROM fl")
register("fcs_2_forecast_features", T.forecast_features, f"""
SELECT event_id, {K}, value, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS weekday, day(ts)::INT AS day, month(ts)::INT AS month, round(sin(hour(ts) * (6.283185307179586 / 24)), 6) AS hour_sin, round(cos(hour(ts) * (6.283185307179586 / 24)), 6) AS hour_cos,
round(sin((isodow(ts) - 1) * (6.283185307179586 / 7)), 6) AS weekday_sin, round(cos((isodow(ts) - 1) * (6.283185307179586 / 7)), 6) AS weekday_cos, lag(value, 1) OVER s AS lag_1, lag(value, 2) OVER s AS lag_2, lag(value, 3) OVER s AS lag_3, lag(value, 7) OVER s AS lag_7 FROM m WINDOW s AS {O}""")
HOLT = f"""hv AS (SELECT user_id, metric_type, list(value ORDER BY ts, event_id) AS v FROM m GROUP BY ALL HAVING count(*) >= 4), ga AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS alpha), gb AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS beta),
hr(user_id, metric_type, alpha, beta, v, k, level, trend, sse) AS (SELECT user_id, metric_type, alpha, beta, v, 1, v[1], v[2] - v[1], 0.0::DOUBLE FROM hv CROSS JOIN ga CROSS JOIN gb
UNION ALL SELECT user_id, metric_type, alpha, beta, v, k + 1, level + trend + alpha * (v[k + 1] - level - trend), trend + alpha * beta * (v[k + 1] - level - trend), sse + (v[k + 1] - level - trend) * (v[k + 1] - level - trend) FROM hr WHERE k < len(v)),
hb AS (SELECT * FROM hr WHERE k = len(v) QUALIFY row_number() OVER (PARTITION BY user_id, metric_type ORDER BY round(sse, 4), alpha, beta) = 1), hf AS (SELECT user_id, metric_type, alpha, beta, sse, step, level + step * trend AS forecast FROM hb CROSS JOIN (SELECT unnest(range(1, 8))::INT AS step))"""
register("fcs_6_forecast_holt", lambda m: rounded(T.forecast_holt(m)), f"WITH {HOLT} SELECT {K}, alpha, beta, round(sse, 6) AS sse, step, round(forecast, 6) AS forecast FROM hf")
register("fcs_8_forecast_ensemble", lambda m: rounded(T.forecast_ensemble(m)), f"""
WITH {LF}, {HOLT}, j AS (SELECT fl.user_id, fl.metric_type, fl.step, f, forecast, 1 / greatest(sqrt((1 - r2) * syy / n), 1e-6) AS w1, 1 / greatest(sqrt(sse / (n - 1)), 1e-6) AS w2 FROM fl JOIN hf USING (user_id, metric_type, step) JOIN fg USING (user_id, metric_type))
SELECT {K}, step, round((f * w1 + forecast * w2) / (w1 + w2), 6) AS forecast, CASE WHEN w1 >= w2 THEN 'linear' ELSE 'smoothing' END AS best FROM j""")
# the same smoothing, over the first four fifths of each series
HOLT_FIT = re.sub(r"\b(hv|ga|gb|hr|hb|hf)\b", r"\g<1>2", HOLT).replace("FROM m GROUP", "FROM mk WHERE k <= nf GROUP")
register("fcs_8_forecast_held_out", lambda m: rounded(T.forecast_held_out(m)), f"""
WITH {LF}, {HOLT}, mk AS (SELECT *, floor(n * 0.8) AS nf FROM (SELECT *, row_number() OVER {O} AS k, count(*) OVER {P} AS n FROM m WHERE value IS NOT NULL) WHERE n >= 10), {HOLT_FIT},
ln AS (SELECT user_id, metric_type, regr_slope(value, k) AS b, regr_intercept(value, k) AS a FROM mk WHERE k <= nf GROUP BY user_id, metric_type), tw AS (SELECT user_id, metric_type, max(forecast) FILTER (step = 1) AS f1, max(forecast) FILTER (step = 2) AS f2 FROM hf2 GROUP BY user_id, metric_type),
er AS (SELECT user_id, metric_type, sqrt(avg(pow(value - a - b * k, 2))) AS r1, sqrt(avg(pow(value - f1 - (k - nf - 1) * (f2 - f1), 2))) AS r2, var_pop(value) AS spread FROM mk JOIN ln USING (user_id, metric_type) JOIN tw USING (user_id, metric_type) WHERE k > nf GROUP BY user_id, metric_type),
gr AS (SELECT *, CASE WHEN spread > 1e-12 THEN round(1 - pow(least(r1, r2), 2) / spread, 9) END AS e FROM er)
SELECT {K}, fl.step, round((f / greatest(r1, 1e-6) + forecast / greatest(r2, 1e-6)) / (1 / greatest(r1, 1e-6) + 1 / greatest(r2, 1e-6)), 6) AS forecast, round(r1, 6) AS rmse_linear, round(r2, 6) AS rmse_smoothing,
CASE WHEN round(r1, 9) <= round(r2, 9) THEN 'linear' ELSE 'smoothing' END AS best, CASE WHEN e >= 0.8 THEN 'excellent' WHEN e >= 0.6 THEN 'good' WHEN e >= 0.4 THEN 'fair' WHEN e IS NOT NULL THEN 'poor' END AS grade
FROM gr JOIN fl USING (user_id, metric_type) JOIN hf USING (user_id, metric_type, step)""")
register("trd_8_trend_summary", T.trend_summary, f"""
WITH {LIN}, k AS (SELECT *, row_number() OVER {O} AS k, count(*) OVER {P} AS n, value - avg(value) OVER {P} AS v, var_pop(value) OVER {P} AS sse FROM m),
g AS (SELECT a.user_id, a.metric_type, sum(sign(b.value - a.value)) AS s, sum(abs(sign(b.value - a.value))) AS u, max(b.k)::INT AS n FROM k a JOIN k b ON a.user_id = b.user_id AND a.metric_type = b.metric_type AND a.k < b.k GROUP BY ALL),
mk AS (SELECT {K}, s, CASE WHEN s > 0 THEN s - 1 WHEN s < 0 THEN s + 1 ELSE 0 END / sqrt(n * (n - 1) * (2 * n + 5) / 18) AS z FROM g WHERE n >= 4 AND u > 0),
c AS (SELECT *, sum(v) OVER (PARTITION BY user_id, metric_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM k), cp AS (SELECT {K}, s * s * (1 / k + 1 / (n - k)) / (sse * n) AS share FROM c WHERE k >= 3 AND n - k >= 3 AND sse > 0
QUALIFY row_number() OVER (PARTITION BY user_id, metric_type ORDER BY round(s * s * (1 / k + 1 / (n - k)), 6) DESC, k) = 1),
j AS (SELECT {K}, slope, slope / sqrt((1 - r2) * syy / (lg2.n - 2) / sxx) AS t, mk.s, z, share FROM (SELECT DISTINCT {K} FROM m) LEFT JOIN lg2 USING ({K}) LEFT JOIN mk USING ({K}) LEFT JOIN cp USING ({K})),
d AS (SELECT *, CASE WHEN abs(t) >= 2 THEN 'regression' WHEN abs(z) >= 1.96 THEN 'mann_kendall' WHEN share >= 0.5 THEN 'change_point' ELSE 'none' END AS method FROM j),
e AS (SELECT *, CASE WHEN method = 'regression' THEN sign(slope) WHEN method = 'mann_kendall' THEN sign(s) ELSE 0 END AS way FROM d)
SELECT {K}, method, CASE WHEN way > 0 THEN 'increasing' WHEN way < 0 THEN 'decreasing' ELSE 'stable' END AS direction, method <> 'none' AS significant,
CASE WHEN way > 0 THEN 'likely to rise' WHEN way < 0 THEN 'likely to fall' WHEN method = 'change_point' THEN 'has moved to another level' ELSE 'no change expected' END AS outlook FROM e""")
