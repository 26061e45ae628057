"""Queries of joins, correlations, tests and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom.functions.labels import label_sql
from pulseloom.operators import correlations as C, relations as R
from pulseloom.operators.aggregates import KEYS, baselines, r6, resample_hourly
from pulseloom.operators.windows import latest
from pulseloom.plans.core import BASE, FILLED, NOW, by_person
from pulseloom.plans.registry import register

PAIRS = "dp AS (SELECT user_id, ts::DATE AS day, avg(value) FILTER (metric_type = 'click') AS x, avg(value) FILTER (metric_type = 'view') AS y FROM m GROUP BY ALL HAVING x IS NOT NULL AND y IS NOT NULL)"
U = ["user_id"]


def rounded(df, *keep):
    """Every double column to six digits; ``keep`` alone where given."""
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if not keep or c in keep])


register("jon_1_daily_pairs", lambda m: rounded(R.daily_pairs(m, "click", "view")), f"WITH {PAIRS} SELECT user_id, day, round(x, 6) AS x, round(y, 6) AS y FROM dp")
register("jon_2_raw_pairs", lambda m: R.raw_pairs(m, "click", "view"), """
SELECT a.user_id, a.ts::DATE AS day, a.event_id AS x_id, a.value AS x, b.event_id AS y_id, b.value AS y FROM m a JOIN m b ON a.user_id = b.user_id AND a.ts::DATE = b.ts::DATE
WHERE a.metric_type = 'click' AND b.metric_type = 'view'""")
NEAREST = """SELECT user_id, event_id, x, y, round(gap / 6e7, 6) AS gap_minutes FROM (SELECT a.user_id, a.event_id, a.value AS x, b.value AS y, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS gap, b.ts AS bt, b.event_id AS bid
FROM m a JOIN m b ON a.user_id = b.user_id WHERE a.metric_type = 'click' AND b.metric_type = 'view') WHERE {test} QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY gap, bt DESC, bid) = 1"""
register("jon_3_align_nearest", lambda m: R.nearest(R.of_type(m, "click"), R.of_type(m, "view"), 6), NEAREST.format(test="gap <= 21600000000"))
register("jon_4_asof_nearest", lambda m: R.nearest(R.of_type(m, "click"), R.of_type(m, "view"), None), NEAREST.format(test="true"))
register("jon_5_exact_pairs", lambda m: R.exact_pairs(m, "click", "view"), """
WITH h AS (SELECT user_id, metric_type, date_trunc('hour', ts) AS hour, round(avg(value), 6) AS v FROM m GROUP BY ALL)
SELECT a.user_id, a.hour, a.v AS x, b.v AS y FROM h a JOIN h b ON a.user_id = b.user_id AND a.hour = b.hour WHERE a.metric_type = 'click' AND b.metric_type = 'view'""")
LAGS = """lg AS (SELECT unnest([1, 2, 4, 6, 8, 12, 16, 24, 48])::INT AS lag),
lf AS (SELECT user_id, ts::DATE AS day, sum(value) AS x FROM m WHERE metric_type = 'signup' GROUP BY ALL),
lo AS (SELECT user_id, lag, (ts - to_hours(lag))::DATE AS day, avg(value) AS y FROM m CROSS JOIN lg WHERE metric_type = 'purchase' GROUP BY ALL),
lj AS (SELECT user_id, day, lag, x, y FROM lf JOIN lo USING (user_id, day))"""
register("jon_6_lagged_daily_join", lambda m: rounded(R.lagged_daily_join(m, "signup", "purchase")), f"WITH {LAGS} SELECT user_id, day, lag, round(x, 6) AS x, round(y, 6) AS y FROM lj")
register("jon_7_after_event", lambda m: R.after_event(m, "signup", "purchase"), """
SELECT e.event_id, e.user_id, round(avg(o.value), 6) AS mean_after, count(*) AS n FROM m e JOIN m o ON e.user_id = o.user_id AND o.ts BETWEEN e.ts AND e.ts + INTERVAL 24 HOUR
WHERE e.metric_type = 'signup' AND o.metric_type = 'purchase' GROUP BY e.event_id, e.user_id""")
SPLIT = """ww AS (SELECT event_id, user_id, ts::DATE AS day, value, EXISTS (SELECT 1 FROM m f WHERE f.metric_type = 'signup' AND f.user_id = o.user_id AND f.ts::DATE = o.ts::DATE) AS present FROM m o WHERE metric_type = 'purchase')"""
register("jon_8_with_without", lambda m: R.with_without(m, "signup", "purchase"), f"WITH {SPLIT} SELECT * FROM ww")
register("jon_9_active_users", lambda m: R.active_users(m, "2024-01-29 00:00:00"), "SELECT DISTINCT user_id FROM m WHERE ts >= TIMESTAMP '2024-01-29'")
register("jon_10_eligible_users", lambda m: R.eligible_users(m, 66), "SELECT user_id, count(*) AS n FROM m GROUP BY user_id HAVING count(*) >= 66")
INTERVENTIONS = """iv AS (SELECT user_id, min(ts) AS started_at, CASE WHEN user_id % 5 <> 0 THEN min(ts) + INTERVAL 10 DAY END AS ended_at,
['nutrition', 'exercise', 'sleep', 'stress', 'supplement'][user_id % 5 + 1] AS category FROM m WHERE metric_type = 'signup' AND ts >= TIMESTAMP '2024-01-15' GROUP BY user_id)"""


def _overlap(m):
    own = R.interventions(m).withColumn("name", F.lit("plan"))
    days = R.of_type(m, "error").select("user_id", F.concat(F.lit("z"), F.col("event_id").cast("string")).alias("name"), F.col("ts").alias("started_at"), F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ended_at"))
    return R.overlapping(own, days)


register("jon_11_overlapping", _overlap, f"""
WITH {INTERVENTIONS} SELECT i.user_id, 'plan' AS a, 'z' || e.event_id AS b, greatest(i.started_at, e.ts) AS overlap_start,
least(coalesce(i.ended_at, TIMESTAMP '9999-12-31'), CASE WHEN e.event_id % 2 = 0 THEN e.ts + INTERVAL 1 DAY ELSE TIMESTAMP '9999-12-31' END) AS overlap_end
FROM iv i JOIN m e ON i.user_id = e.user_id AND e.metric_type = 'error' WHERE i.started_at <= CASE WHEN e.event_id % 2 = 0 THEN e.ts + INTERVAL 1 DAY ELSE TIMESTAMP '9999-12-31' END
AND e.ts <= coalesce(i.ended_at, TIMESTAMP '9999-12-31')""")
BEFORE = INTERVENTIONS + f""", ba AS (SELECT event_id, m.user_id, m.metric_type, category, started_at, ts, value, CASE WHEN ts < started_at THEN 'before' ELSE 'after' END AS period FROM m JOIN iv USING (user_id)
WHERE metric_type IN ('click', 'purchase') AND ts >= started_at - INTERVAL 14 DAY AND ts <= coalesce(ended_at, {NOW}))"""
register("jon_12_before_after", lambda m: R.before_after(m, R.interventions(m)), f"WITH {BEFORE} SELECT * FROM ba")
SEVERITY = label_sql("round((value - mean) / sd, 6)", "severity")
SCORED = BASE + f""", sc AS (SELECT event_id, user_id, metric_type, ts, value, CASE WHEN sd > 0 THEN round((value - mean) / sd, 6) END AS z, CASE WHEN sd > 0 THEN {SEVERITY} END AS severity, n AS baseline_n FROM m JOIN b USING (user_id, metric_type))"""
register("jon_13_score_against_baseline", lambda m: R.score_against_baseline(m, baselines(m)).drop("mean", "sd"), f"WITH {SCORED} SELECT * FROM sc")
DAYS = "dm AS (SELECT user_id, metric_type, ts::DATE AS day, avg(value) AS v FROM m GROUP BY ALL), mp AS (SELECT a.user_id, a.day, a.metric_type AS m1, a.v AS x, b.metric_type AS m2, b.v AS y FROM dm a JOIN dm b ON a.user_id = b.user_id AND a.day = b.day AND a.metric_type < b.metric_type)"
register("jon_14_metric_pairs", lambda m: rounded(R.metric_pairs(R.day_means(m), ["user_id", "day"])), f"WITH {DAYS} SELECT user_id, day, m1, round(x, 6) AS x, m2, round(y, 6) AS y FROM mp")
register("jon_16_attach_outcomes", lambda m: R.attach_outcomes(m, "signup"), """
WITH d AS (SELECT user_id, ts::DATE AS day, metric_type, round(avg(value), 6) AS v FROM m GROUP BY ALL), o AS (SELECT user_id, day, string_agg(metric_type || '=' || format('{:.3f}', v), ',' ORDER BY metric_type) AS outcomes FROM d GROUP BY ALL)
SELECT event_id, e.user_id, o.day, outcomes FROM m e JOIN o ON o.user_id = e.user_id AND o.day = e.ts::DATE + 1 WHERE e.metric_type = 'signup'""")


def _senders(m):
    users = m.select("user_id").distinct().select(F.col("user_id").alias("id"), F.concat(F.lit("p"), "user_id").alias("address"), F.to_json(F.struct(F.array(F.concat(F.lit("a"), (F.col("user_id") * 2).cast("string")), F.concat(F.lit("p"), (F.col("user_id") + 1).cast("string"))).alias("alternates"))).alias("preferences"))
    messages = m.select(F.col("event_id").alias("message_id"), F.concat(F.when(F.col("event_id") % 2 == 0, "p").otherwise("a"), (F.col("event_id") % 400).cast("string")).alias("address"))
    return R.resolve_sender(messages, users)


register("jon_17_resolve_sender", _senders, """
WITH u AS (SELECT DISTINCT user_id AS id FROM m), k AS (SELECT id, 'p' || id AS address, 0 AS rank FROM u UNION ALL SELECT id, 'a' || (id * 2), 1 FROM u UNION ALL SELECT id, 'p' || (id + 1), 1 FROM u),
b AS (SELECT address, first(id ORDER BY rank, id) AS id FROM k GROUP BY address), s AS (SELECT event_id AS message_id, CASE WHEN event_id % 2 = 0 THEN 'p' ELSE 'a' END || (event_id % 400) AS address FROM m)
SELECT message_id, address, id AS user_id FROM s LEFT JOIN b USING (address)""")

PEARSON = """SELECT {keys}, n, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t, round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 6) AS ci_low, round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 6) AS ci_high,
""" + label_sql("r", "correlation") + """ AS strength FROM ({src}) WHERE n >= {least} AND r IS NOT NULL AND NOT isnan(r)"""
COLS = ("n", "r", "t", "ci_low", "ci_high", "strength")
register("cor_1_pearson", lambda m: rounded(C.pearson(R.daily_pairs(m, "click", "view"), U, 6), "user_id", *COLS),
         f"WITH {PAIRS} " + PEARSON.format(keys="user_id", src="SELECT user_id, count(*) AS n, corr(x, y) AS r FROM dp GROUP BY user_id", least=6))
RANKS = "rk AS (SELECT user_id, day, rank() OVER (PARTITION BY user_id ORDER BY x) + (count(*) OVER (PARTITION BY user_id, x) - 1) / 2 AS x, rank() OVER (PARTITION BY user_id ORDER BY y) + (count(*) OVER (PARTITION BY user_id, y) - 1) / 2 AS y FROM dp)"
register("cor_2_spearman", lambda m: rounded(C.spearman(R.daily_pairs(m, "click", "view"), U, 6), "user_id", "n", "r"),
         f"WITH {PAIRS}, {RANKS}, g AS (SELECT user_id, count(*) AS n, corr(x, y) AS r FROM rk GROUP BY user_id) SELECT user_id, n, round(r, 6) AS r FROM g WHERE n >= 6 AND r IS NOT NULL AND NOT isnan(r)")
register("cor_3_kendall", lambda m: rounded(C.kendall(R.daily_pairs(m, "click", "view"), U), "user_id", "n", "tau"), f"""
WITH {PAIRS}, g AS (SELECT a.user_id, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum(abs(sign(a.x - b.x))) AS px, sum(abs(sign(a.y - b.y))) AS py FROM dp a JOIN dp b ON a.user_id = b.user_id AND a.day < b.day GROUP BY ALL),
n AS (SELECT user_id, count(*)::INT AS n FROM dp GROUP BY ALL) SELECT user_id, n, round(s / sqrt(px * py), 6) AS tau FROM g JOIN n USING (user_id) WHERE n >= 3 AND px > 0 AND py > 0""")
MI = """nt AS (SELECT user_id, ntile({bins}) OVER (PARTITION BY user_id ORDER BY x, y) AS bx, ntile({bins}) OVER (PARTITION BY user_id ORDER BY y, x) AS by_ FROM dp), cl AS (SELECT user_id, bx, by_, count(*) AS c FROM nt GROUP BY ALL),
ct AS (SELECT *, sum(c) OVER (PARTITION BY user_id) AS n, sum(c) OVER (PARTITION BY user_id, bx) AS cx, sum(c) OVER (PARTITION BY user_id, by_) AS cy FROM cl),
mi AS (SELECT user_id, max(n)::BIGINT AS n, sum(c / n * ln(c * n / (cx * cy))) AS mi, sum(-c / n * ln(cx / n)) AS hx, sum(-c / n * ln(cy / n)) AS hy FROM ct GROUP BY ALL)"""
register("cor_4_mutual_information", lambda m: rounded(C.mutual_information(R.daily_pairs(m, "click", "view"), U)),
         f"WITH {PAIRS}, {MI.format(bins=4)} SELECT user_id, n, round(mi, 6) AS mi, CASE WHEN least(hx, hy) > 0 THEN round(mi / least(hx, hy), 6) END AS normalised FROM mi")
GRIDS = ", ".join(MI.format(bins=k).replace("nt AS", f"nt{k} AS").replace("FROM nt ", f"FROM nt{k} ").replace("cl AS", f"cl{k} AS").replace("FROM cl)", f"FROM cl{k})").replace("ct AS", f"ct{k} AS").replace("FROM ct ", f"FROM ct{k} ").replace("mi AS (", f"mi{k} AS (") for k in (2, 3, 4))
register("cor_5_mic_grid", lambda m: rounded(C.mic_grid(R.daily_pairs(m, "click", "view"), U)), f"""
WITH {PAIRS}, {GRIDS}, s AS (SELECT user_id, n, 2 AS bins, mi / ln(2) AS score FROM mi2 UNION ALL SELECT user_id, n, 3, mi / ln(3) FROM mi3 UNION ALL SELECT user_id, n, 4, mi / ln(4) FROM mi4)
SELECT user_id, max(n) AS n, round(max(score), 6) AS mic FROM s WHERE bins * bins <= greatest(4, pow(n, 0.6)) GROUP BY user_id""")


def _grid(m, person=False):
    """The hourly grid of clicks (x) and views (y), numbered; all people's, or each person's own."""
    rows = resample_hourly(m.where(F.col("metric_type").isin("click", "view")), KEYS if person else ("metric_type",))
    g = rows.groupBy(*(U if person else []), "hour").agg(F.max(F.when(F.col("metric_type") == "click", F.col("mean"))).alias("x"), F.max(F.when(F.col("metric_type") == "view", F.col("mean"))).alias("y"))
    return g.select("user_id" if person else F.lit("all").alias("user_id"), (F.unix_micros(F.col("hour").cast("timestamp")) / 3.6e9).cast("long").alias("i"), "x", "y")


GRID = FILLED + ", hg AS (SELECT (epoch(hour) / 3600)::BIGINT AS i, max(mean) FILTER (metric_type = 'click') AS x, max(mean) FILTER (metric_type = 'view') AS y FROM f GROUP BY hour)"
LAGGED = GRID + ", ll AS (SELECT unnest(range(-{n}, {n} + 1))::INT AS lag), lc AS (SELECT lag, count(*) AS n, corr(a.x, b.y) AS r FROM hg a CROSS JOIN ll JOIN hg b ON b.i = a.i + lag WHERE a.x IS NOT NULL AND b.y IS NOT NULL GROUP BY lag)"
register("cor_7_lagged_corr", lambda m: rounded(C.lagged_corr(_grid(m), U, 24).select("lag", "n", "r")), f"WITH {LAGGED.format(n=24)} SELECT lag, n, round(r, 6) AS r FROM lc WHERE n >= 10")
register("cor_8_lead_lag", lambda m: rounded(C.best_lag(C.lagged_corr(_grid(m), U, 12).where("lag <> 0"), U).select("lag", "r", "n", "leads")), f"""
WITH {LAGGED.format(n=12)} SELECT lag, round(r, 6) AS r, n, CASE WHEN lag > 0 THEN 'x' ELSE 'y' END AS leads FROM lc WHERE n >= 10 AND lag <> 0 ORDER BY round(abs(r), 9) DESC, abs(lag), lag DESC LIMIT 1""")


def _cross(m, person=False):
    return C.best_lag(C.lagged_corr(_grid(m, person), U, 48, standard=True), U).select("user_id", "lag", "r", "n")


register("cor_6_cross_correlation", lambda m: rounded(_cross(m).drop("user_id")), f"""
WITH {GRID}, c AS (SELECT i, x, y FROM hg WHERE x IS NOT NULL AND y IS NOT NULL), z AS (SELECT i, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y, count(*) OVER () AS t FROM c),
l AS (SELECT b.i - a.i AS lag, sum(a.x * b.y) / any_value(a.t) AS r, count(*) AS n FROM z a JOIN z b ON b.i BETWEEN a.i - 48 AND a.i + 48 GROUP BY 1)
SELECT lag::INT AS lag, round(r, 6) AS r, n FROM l WHERE n >= 10 ORDER BY round(abs(r), 9) DESC, abs(lag), lag DESC LIMIT 1""")


GRIDS_BY_PERSON = by_person(FILLED) + ", hg AS (SELECT user_id, (epoch(hour) / 3600)::BIGINT AS i, max(mean) FILTER (metric_type = 'click') AS x, max(mean) FILTER (metric_type = 'view') AS y FROM f GROUP BY user_id, hour)"
LAGGED_BY_PERSON = GRIDS_BY_PERSON + """, ll AS (SELECT unnest(range(-{n}, {n} + 1))::INT AS lag), al AS (SELECT user_id, i + lag AS j, x, lag FROM hg CROSS JOIN ll WHERE x IS NOT NULL),
lc AS (SELECT a.user_id, a.lag, count(*) AS n, corr(a.x, b.y) AS r FROM al a JOIN hg b ON b.user_id = a.user_id AND b.i = a.j WHERE b.y IS NOT NULL GROUP BY a.user_id, a.lag HAVING count(*) >= 10), lf AS (SELECT * FROM lc WHERE r IS NOT NULL AND NOT isnan(r))"""
register("cor_7_lagged_corr_by_person", lambda m: rounded(C.lagged_corr(_grid(m, True), U, 24).select("user_id", "lag", "n", "r")), f"WITH {LAGGED_BY_PERSON.format(n=24)} SELECT user_id, lag, n, round(r, 6) AS r FROM lf")
register("cor_8_lead_lag_by_person", lambda m: rounded(C.best_lag(C.lagged_corr(_grid(m, True), U, 12).where("lag <> 0"), U).select("user_id", "lag", "r", "n", "leads")), f"""
WITH {LAGGED_BY_PERSON.format(n=12)} SELECT user_id, lag, round(r, 6) AS r, n, CASE WHEN lag > 0 THEN 'x' ELSE 'y' END AS leads FROM lf WHERE lag <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(abs(r), 9) DESC, abs(lag), lag DESC) = 1""")
register("cor_6_cross_correlation_by_person", lambda m: rounded(_cross(m, True)), f"""
WITH {GRIDS_BY_PERSON}, c AS (SELECT user_id, i, x, y FROM hg WHERE x IS NOT NULL AND y IS NOT NULL), s AS (SELECT user_id, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy, count(*) AS t FROM c GROUP BY user_id HAVING stddev_pop(x) > 1e-9 AND stddev_pop(y) > 1e-9),
z AS (SELECT user_id, i, (x - mx) / sx AS x, (y - my) / sy AS y, t FROM c JOIN s USING (user_id)), al AS (SELECT user_id, i + lag AS j, x, t, lag FROM z CROSS JOIN (SELECT unnest(range(-48, 49))::INT AS lag)),
l AS (SELECT a.user_id, a.lag, sum(a.x * b.y) / any_value(a.t) AS r, count(*) AS n FROM al a JOIN z b ON b.user_id = a.user_id AND b.i = a.j GROUP BY a.user_id, a.lag HAVING count(*) >= 10)
SELECT user_id, lag, round(r, 6) AS r, n FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(abs(r), 9) DESC, abs(lag), lag DESC) = 1""")


def _triples(m):
    g = m.groupBy("user_id", F.to_date("ts").alias("day"))
    mean = lambda t, n: F.avg(F.when(F.col("metric_type") == t, F.col("value"))).alias(n)
    return g.agg(mean("click", "x"), mean("view", "y"), mean("error", "z")).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").withColumn("part", F.weekday("day"))


register("cor_9_partial_corr", lambda m: rounded(C.partial_corr(_triples(m), ["part"])), """
WITH t AS (SELECT user_id, ts::DATE AS day, avg(value) FILTER (metric_type = 'click') AS x, avg(value) FILTER (metric_type = 'view') AS y, avg(value) FILTER (metric_type = 'error') AS z FROM m GROUP BY ALL
HAVING x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL), g AS (SELECT isodow(day)::INT - 1 AS part, count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM t GROUP BY ALL)
SELECT part, n, round(xy, 6) AS r, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial_r FROM g WHERE n >= 4""")


def _weeks(m):
    """The mean of four types in each person's weeks."""
    mean = lambda t, n: F.avg(F.when(F.col("metric_type") == t, F.col("value"))).alias(n)
    g = m.groupBy("user_id", F.date_trunc("week", "ts").cast("date").alias("week")).agg(mean("click", "x"), mean("view", "y"), mean("error", "z1"), mean("purchase", "z2"))
    return g.dropna(subset=["x", "y", "z1", "z2"])


register("cor_9_partial_corr_k", lambda m: rounded(C.partial_corr(_weeks(m), ["week"], ("z1", "z2"))), """
WITH t AS (SELECT user_id, date_trunc('week', ts)::DATE AS week, avg(value) FILTER (metric_type = 'click') AS x, avg(value) FILTER (metric_type = 'view') AS y, avg(value) FILTER (metric_type = 'error') AS z1, avg(value) FILTER (metric_type = 'purchase') AS z2
FROM m GROUP BY user_id, date_trunc('week', ts)::DATE HAVING x IS NOT NULL AND y IS NOT NULL AND z1 IS NOT NULL AND z2 IS NOT NULL),
a AS (SELECT week, count(*) AS n, corr(x, y) AS xy, corr(x, z1) AS x1, corr(y, z1) AS y1, corr(x, z2) AS x2, corr(y, z2) AS y2, corr(z1, z2) AS zz FROM t GROUP BY week HAVING count(*) >= 5),
b AS (SELECT week, n, xy, (xy - x2 * y2) / sqrt((1 - x2 * x2) * (1 - y2 * y2)) AS p, (x1 - x2 * zz) / sqrt((1 - x2 * x2) * (1 - zz * zz)) AS q, (y1 - y2 * zz) / sqrt((1 - y2 * y2) * (1 - zz * zz)) AS s FROM a)
SELECT week, n, round(xy, 6) AS r, round((p - q * s) / sqrt((1 - q * q) * (1 - s * s)), 6) AS partial_r FROM b""")


def sweep(m, least=5):
    """All pairs of types of each person at daily grain."""
    return C.pearson(R.metric_pairs(R.day_means(m), ["user_id", "day"]), ["user_id", "m1", "m2"], least)


SWEEP = DAYS + ", sw AS (SELECT * FROM (SELECT user_id, m1, m2, count(*) AS n, corr(x, y) AS r FROM mp GROUP BY ALL) WHERE n >= 5 AND r IS NOT NULL AND NOT isnan(r))"
register("cor_10_correlation_sweep", lambda m: rounded(sweep(m), "user_id", "m1", "m2", "n", "r", "strength"), f"WITH {SWEEP} SELECT user_id, m1, m2, n, round(r, 6) AS r, {label_sql('r', 'correlation')} AS strength FROM sw")
register("cor_11_fdr", lambda m: C.fdr(latest(m).select(*KEYS, F.round(1 / (1 + F.col("value")), 4).alias("p")), U).select(*KEYS, "p", r6("p_adjusted").alias("p_adjusted")), """
WITH l AS (SELECT user_id, metric_type, round(1 / (1 + last(value ORDER BY ts, event_id)), 4) AS p FROM m GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM l)
SELECT user_id, metric_type, p, round(least(1, min(p * c / k) OVER (PARTITION BY user_id ORDER BY k DESC)), 6) AS p_adjusted FROM s""")
EDGES = SWEEP + ", ed AS (SELECT user_id, m1 AS node, abs(r) AS w FROM sw UNION ALL SELECT user_id, m2, abs(r) FROM sw)"
register("cor_12_network_metrics", lambda m: rounded(C.network_metrics(sweep(m), U)), f"""
WITH {EDGES} SELECT user_id, node, count(*) FILTER (w > 0.3) AS degree, round(sum(w), 6) AS strength, round(count(*) FILTER (w > 0.3) * sum(w), 6) AS hub_score FROM ed GROUP BY user_id, node""")
register("cor_13_components", lambda m: C.small_components(sweep(m).where(F.abs("r") > 0.5), m.select("user_id", F.col("metric_type").alias("node")).distinct(), U), f"""
WITH {SWEEP}, e AS (SELECT user_id, m1 AS a, m2 AS b FROM sw WHERE abs(r) > 0.5 UNION SELECT user_id, m2, m1 FROM sw WHERE abs(r) > 0.5),
w(user_id, node, other) AS (SELECT DISTINCT user_id, metric_type, metric_type FROM m UNION SELECT w.user_id, w.node, e.b FROM w JOIN e ON w.user_id = e.user_id AND w.other = e.a)
SELECT user_id, node, min(other) AS component FROM w GROUP BY user_id, node""")
NODES = lambda m: m.select("user_id", F.col("metric_type").alias("node")).distinct()
register("cor_12_network", lambda m: rounded(C.network(sweep(m), NODES(m), U)), f"""
WITH {EDGES}, nd AS (SELECT DISTINCT user_id, metric_type AS node FROM m), wt AS (SELECT user_id, node, count(*) FILTER (w > 0.3) AS degree, sum(w) AS strength FROM ed GROUP BY user_id, node),
e AS (SELECT user_id, m1 AS a, m2 AS b FROM sw WHERE abs(r) > 0.3 UNION SELECT user_id, m2, m1 FROM sw WHERE abs(r) > 0.3), p(user_id, a, b, path) AS (SELECT user_id, a, b, [a, b] FROM e UNION ALL SELECT p.user_id, p.a, e.b, list_append(path, e.b) FROM p JOIN e ON e.user_id = p.user_id AND e.a = p.b AND NOT list_contains(path, e.b)),
s AS (SELECT * FROM p QUALIFY len(path) = min(len(path)) OVER (PARTITION BY user_id, a, b)), c AS (SELECT *, count(*) OVER (PARTITION BY user_id, a, b) AS c FROM s), v AS (SELECT user_id, a, b, c, unnest(path[2:-2]) AS node FROM c WHERE len(path) > 2),
bt AS (SELECT user_id, node, sum(1 / c) / 2 AS between_ FROM v GROUP BY user_id, node), n AS (SELECT nd.*, coalesce(degree, 0) AS degree, coalesce(strength, 0) AS strength, coalesce(degree * strength, 0) AS hub, coalesce(between_, 0) AS bt, count(*) OVER u AS nodes, sum(coalesce(degree, 0)) OVER u AS ends
FROM nd LEFT JOIN wt USING (user_id, node) LEFT JOIN bt USING (user_id, node) WINDOW u AS (PARTITION BY user_id)), l AS (SELECT user_id, quantile_cont(hub, 0.75) AS lim FROM n GROUP BY user_id)
SELECT user_id, node, degree, round(strength, 6) AS strength, round(hub, 6) AS hub_score, round(CASE WHEN nodes > 2 THEN bt / ((nodes - 1) * (nodes - 2) / 2) ELSE 0 END, 6) AS betweenness, round(hub, 6) >= round(lim, 6) AS is_hub,
round(CASE WHEN nodes > 1 THEN ends / (nodes * (nodes - 1)) ELSE 0 END, 6) AS density FROM n JOIN l USING (user_id)""")
register("cor_13_clusters", lambda m: rounded(C.strong_clusters(sweep(m), NODES(m), U)), f"""
WITH {SWEEP}, e AS (SELECT user_id, m1 AS a, m2 AS b FROM sw WHERE abs(r) > 0.5 UNION SELECT user_id, m2, m1 FROM sw WHERE abs(r) > 0.5),
w(user_id, node, other) AS (SELECT DISTINCT user_id, metric_type, metric_type FROM m UNION SELECT w.user_id, w.node, e.b FROM w JOIN e ON w.user_id = e.user_id AND w.other = e.a),
nm AS (SELECT user_id, node, min(other) AS component FROM w GROUP BY user_id, node), sz AS (SELECT user_id, component, count(*) AS size, string_agg(node, ',' ORDER BY node) AS members FROM nm GROUP BY user_id, component HAVING count(*) > 1),
g AS (SELECT sw.user_id, x.component, avg(abs(r)) FILTER (r <> 0) AS cohesion, count(*) FILTER (abs(r) > 0.5) AS ties FROM sw JOIN nm x ON x.user_id = sw.user_id AND x.node = m1 JOIN nm y ON y.user_id = sw.user_id AND y.node = m2 AND x.component = y.component GROUP BY sw.user_id, x.component)
SELECT user_id, component, size, members, round(cohesion, 6) AS cohesion, round(ties / (size * (size - 1) / 2), 6) AS density, CASE WHEN cohesion >= 0.7 THEN 'tight' WHEN cohesion >= 0.5 THEN 'close' ELSE 'loose' END AS label FROM sz JOIN g USING (user_id, component)""")
TTEST = """tt AS (SELECT user_id, count(*) FILTER (present) AS n1, count(*) FILTER (NOT present) AS n0, avg(value) FILTER (present) AS mean1, avg(value) FILTER (NOT present) AS mean0, var_samp(value) FILTER (present) AS v1, var_samp(value) FILTER (NOT present) AS v0 FROM ww GROUP BY ALL),
tp AS (SELECT *, n1 + n0 - 2 AS df, ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) AS pooled FROM tt WHERE n1 >= 2 AND n0 >= 2)"""
TCOLS = ("user_id", "n1", "n0", "mean1", "mean0", "df", "t")
TSQL = f"WITH {SPLIT}, {TTEST} SELECT user_id, n1, n0, " + "{what} FROM tp WHERE pooled > 0"
register("tst_1_ttest", lambda m: rounded(C.ttest(R.with_without(m, "signup", "purchase"), U), *TCOLS),
         TSQL.format(what="round(mean1, 6) AS mean1, round(mean0, 6) AS mean0, df, round((mean1 - mean0) / sqrt(pooled * (1 / n1 + 1 / n0)), 6) AS t"))
register("tst_4_effect_sizes", lambda m: rounded(C.ttest(R.with_without(m, "signup", "purchase"), U), "user_id", "n1", "n0", "cohens_d", "hedges_g", "glass_delta"),
         TSQL.format(what="round((mean1 - mean0) / sqrt(pooled), 6) AS cohens_d, round((mean1 - mean0) / sqrt(pooled) * (1 - 3 / (4 * df - 1)), 6) AS hedges_g, CASE WHEN v0 > 0 THEN round((mean1 - mean0) / sqrt(v0), 6) END AS glass_delta"))
register("cor_14_factor_effect", lambda m: rounded(
    C.ttest(R.with_without(m, "signup", "purchase"), U).select("user_id", "mean1", "mean0", F.col("t").alias("t_value")).join(C.pearson(R.daily_pairs(m, "signup", "purchase"), U, 4).select("user_id", "r"), "user_id", "left")),
    f"""WITH {SPLIT}, {TTEST}, q AS (SELECT user_id, ts::DATE AS day, avg(value) FILTER (metric_type = 'signup') AS x, avg(value) FILTER (metric_type = 'purchase') AS y FROM m GROUP BY ALL HAVING x IS NOT NULL AND y IS NOT NULL),
c AS (SELECT user_id, count(*) AS n, corr(x, y) AS r FROM q GROUP BY ALL) SELECT user_id, round(mean1, 6) AS mean1, round(mean0, 6) AS mean0, round((mean1 - mean0) / sqrt(pooled * (1 / n1 + 1 / n0)), 6) AS t_value,
CASE WHEN c.n >= 4 AND NOT isnan(r) THEN round(r, 6) END AS r FROM tp LEFT JOIN c USING (user_id) WHERE pooled > 0""")  # fmt: skip
register("cor_15_lifestyle_sweep", lambda m: rounded(C.pearson(R.lagged_daily_join(m, "signup", "purchase"), ["lag"]).where(F.abs("r") > 0.01), "lag", "n", "r"),
         f"WITH {LAGS}, g AS (SELECT lag, count(*) AS n, corr(x, y) AS r FROM lj GROUP BY lag) SELECT lag, n, round(r, 6) AS r FROM g WHERE n >= 10 AND abs(r) > 0.01")
register("tst_2_paired", lambda m: rounded(C.paired(R.daily_pairs(m, "click", "view"), U), "user_id", "n", "mean_difference", "t", "cohens_d"), f"""
WITH {PAIRS}, g AS (SELECT user_id, count(*) AS n, avg(y - x) AS d, stddev_samp(y - x) AS s FROM dp GROUP BY ALL) SELECT user_id, n, round(d, 6) AS mean_difference, round(d / (s / sqrt(n)), 6) AS t, round(d / s, 6) AS cohens_d FROM g WHERE n >= 3 AND s > 0""")
register("tst_3_wilcoxon", lambda m: rounded(C.wilcoxon(R.daily_pairs(m, "click", "view"), U), "user_id", "n", "w_plus", "w_minus", "z"), f"""
WITH {PAIRS}, d AS (SELECT user_id, round(y - x, 9) AS d FROM dp WHERE round(y - x, 9) <> 0), c AS (SELECT *, abs(d) AS a, count(*) OVER (PARTITION BY user_id, abs(d)) AS c FROM d),
k AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY a) + (c - 1) / 2 AS k FROM c), g AS (SELECT user_id, count(*) AS n, coalesce(sum(k) FILTER (d > 0), 0) AS p, coalesce(sum(k) FILTER (d < 0), 0) AS q, sum(c * c - 1) AS tie FROM k GROUP BY ALL)
SELECT user_id, n, p AS w_plus, q AS w_minus, round((least(p, q) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48), 6) AS z FROM g WHERE n >= 6""")
register("alr_1_anomaly_alerts", R.anomaly_alerts, f"""
WITH {SCORED}, l AS (SELECT event_id FROM m QUALIFY row_number() OVER (PARTITION BY user_id, metric_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT event_id, user_id, metric_type, ts, value, z, severity, round(least(0.99, 0.5 + abs(z) / 10), 6) AS confidence,
metric_type || ' is ' || CASE WHEN z > 0 THEN 'above' ELSE 'below' END || ' its baseline: ' || format('{{:.2f}}', value) AS message FROM sc WHERE event_id IN (SELECT event_id FROM l) AND abs(z) >= 2""")
