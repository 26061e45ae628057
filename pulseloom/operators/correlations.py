"""Correlations, comparisons and the graphs that follow from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseloom.functions.labels import label
from pulseloom.functions.stats import corr, normal_two_sided, t_quantile_975, t_two_sided
from pulseloom.operators.aggregates import KEYS, r6
from pulseloom.operators.graphs import betweenness
from pulseloom.sources.shared import staged


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def pearson(pairs: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """r, t, p, Fisher interval and strength of x and y per group, for ``least`` pairs or more that vary."""
    g = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), finite(corr("x", "y")).alias("r")).where((F.col("n") >= least) & F.col("r").isNotNull())
    near_one = F.abs("r") >= 1 - 1e-12
    t = F.when(~near_one, F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))
    g = g.withColumn("t", t).withColumn("p", F.when(near_one, 0.0).otherwise(t_two_sided(F.col("t"), F.col("n") - 2)))
    half = 1.96 / F.sqrt(F.col("n") - 3)
    low, high = F.tanh(F.atanh("r") - half), F.tanh(F.atanh("r") + half)
    return g.select(*keys, "n", "r", "t", "p", F.when(~near_one, low).alias("ci_low"), F.when(~near_one, high).alias("ci_high"), label(F.col("r"), "correlation").alias("strength"))


def with_ranks(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Average ranks of x and y in place of the values."""
    def rank(c: str) -> Column:
        w = Window.partitionBy(*keys)
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2

    return pairs.withColumn("rx", rank("x")).withColumn("ry", rank("y")).withColumn("x", F.col("rx").cast("double")).withColumn("y", F.col("ry").cast("double")).drop("rx", "ry")


def spearman(pairs: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """Rank correlation with p per group."""
    return pearson(with_ranks(pairs, keys), keys, least)


def sign_sums(rows: DataFrame, keys: list[str], rank: str, value: str) -> DataFrame:
    """Per group, over its pairs of rows of a lower and a higher rank (from 1 on): s, the sum of the sign of the change of ``value``; untied, how many change; n, the highest rank.

    Two ranks differ first at one binary digit, where the lower one has a zero. So
    each row is taken once per digit, and among those that share the digits before
    it each row with a one counts the zeros of smaller and of larger value. No
    pairs are made, and a large group is dealt out over its digits.
    """
    rows = rows.select(*keys, F.col(rank).cast("long").alias("__r"), F.col(value).alias("__v"))
    rows = rows.withColumn("__n", F.max("__r").over(Window.partitionBy(*keys)))
    rows = rows.withColumn("__bit", F.explode(F.expr("sequence(0, length(bin(__n)) - 1)")))
    rows = rows.withColumn("__prefix", F.expr("shiftright(__r, __bit + 1)")).withColumn("__zero", 1 - F.expr("shiftright(__r, __bit) & 1"))
    part = [*keys, "__bit", "__prefix"]
    up_to = F.sum("__zero").over(Window.partitionBy(*part).orderBy("__v").rangeBetween(Window.unboundedPreceding, 0))
    same, whole = F.sum("__zero").over(Window.partitionBy(*part, "__v")), F.sum("__zero").over(Window.partitionBy(*part))
    rows = rows.withColumn("__less", up_to - same).withColumn("__more", whole - up_to)
    one = F.col("__zero") == 0
    total = lambda c: F.coalesce(F.sum(F.when(one, c)), F.lit(0))
    return rows.groupBy(*keys).agg(total(F.col("__less") - F.col("__more")).cast("double").alias("s"), total(F.col("__less") + F.col("__more")).cast("double").alias("untied"), F.max("__n").cast("int").alias("n"))


def _untied(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Pairs of rows of a group that differ in a column."""
    g = rows.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("t"))
    return g.select(*keys, (F.col("n") * (F.col("n") - 1) / 2 - F.col("t")).alias(name))


def kendall(pairs: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """tau-b and its normal p per group, without making pairs."""
    ranked = pairs.withColumn("rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy("x")))
    n = pairs.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"))
    g = sign_sums(ranked, keys, "rank", "y").select(*keys, "s").join(_untied(pairs, keys, "x", "px"), keys).join(_untied(pairs, keys, "y", "py"), keys).join(n, keys)
    g = g.where((F.col("n") >= least) & (F.col("px") > 0) & (F.col("py") > 0))
    n = F.col("n")
    z = F.col("s") / F.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    return g.select(*keys, "n", (F.col("s") / F.sqrt(F.col("px") * F.col("py"))).alias("tau"), normal_two_sided(z).alias("p"))


def mutual_information(pairs: DataFrame, keys: list[str], bins: int = 4) -> DataFrame:
    """Mutual information over equal-frequency bins, raw and as a share of the smaller marginal entropy."""
    w = Window.partitionBy(*keys)
    rows = pairs.withColumn("bx", F.ntile(bins).over(w.orderBy("x", "y"))).withColumn("by", F.ntile(bins).over(w.orderBy("y", "x")))
    cells = rows.groupBy(*keys, "bx", "by").agg(F.count(F.lit(1)).alias("c"))
    cells = cells.withColumn("n", F.sum("c").over(w)).withColumn("cx", F.sum("c").over(Window.partitionBy(*keys, "bx"))).withColumn("cy", F.sum("c").over(Window.partitionBy(*keys, "by")))
    g = cells.groupBy(*keys).agg(
        F.max("n").alias("n"), F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("mi"),
        F.sum(-F.col("c") / F.col("n") * F.ln(F.col("cx") / F.col("n"))).alias("hx"), F.sum(-F.col("c") / F.col("n") * F.ln(F.col("cy") / F.col("n"))).alias("hy"),
    )
    return g.select(*keys, "n", "mi", F.when(F.least("hx", "hy") > 0, F.col("mi") / F.least("hx", "hy")).alias("normalised"))


def mic_grid(pairs: DataFrame, keys: list[str], most: int = 4) -> DataFrame:
    """The largest normalised mutual information over grids of 2 to ``most`` bins a side."""
    out = None
    for bins in range(2, most + 1):
        one = mutual_information(pairs, keys, bins).select(*keys, "n", F.lit(bins).alias("bins"), (F.col("mi") / F.ln(F.lit(float(bins)))).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out.where(F.col("bins") * F.col("bins") <= F.greatest(F.lit(4.0), F.pow("n", F.lit(0.6)))).groupBy(*keys).agg(F.max("n").alias("n"), F.max("score").alias("mic"))


def lagged_corr(series: DataFrame, keys: list[str], most: int, least: int = 10, standard: bool = False) -> DataFrame:
    """Correlation of x at i with y at i + lag for each lag; columns keys, i, x, y, one row per i.

    With ``standard``, the cross-correlation of both series over n, standardised
    over the rows that have both; a series that doesn't vary has none. A task has
    the steps of one group in memory at a time, and no copies per lag are made.
    """
    kinds = [f"{k} {series.schema[k].dataType.simpleString()}" for k in keys]

    def lags(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        i = table.column("i").to_numpy()
        size = int(i.max() - i.min()) + 1 if len(i) else 0
        has, v = np.zeros((2, size), bool), np.zeros((2, size))
        for side, c in enumerate(("x", "y")):
            known = ~table.column(c).is_null().to_numpy()
            at = i[known] - i.min()
            has[side, at], v[side, at] = True, table.column(c).to_numpy()[known]
        total = 1
        if standard:
            has[:] = has.all(0)
            total = int(has[0].sum())
            for side in (0, 1):
                own = v[side, has[side]]
                sd = own.std() if total else 0.0
                if not sd > 1e-9:
                    has[:] = False
                    break
                v[side, has[side]] = (own - own.mean()) / sd
        out = []
        for lag in range(max(-most, 1 - size), min(most, size - 1) + 1):
            a, b = slice(max(0, -lag), size - max(0, lag)), slice(max(0, lag), size + min(0, lag))
            both = has[0, a] & has[1, b]
            x, y = v[0, a][both], v[1, b][both]
            if len(x) < least:
                continue
            if standard:
                r = x @ y / total
            else:
                if x.min() == x.max() or y.min() == y.max():
                    continue
                x, y = x - x.mean(), y - y.mean()
                r = x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y))
            if not np.isnan(r):
                out.append((lag, len(x), r))
        own = [pa.repeat(k, len(out)) for k in key]
        return pa.table([*own, pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], names=[*keys, "lag", "n", "r"])

    return series.select(*keys, F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).groupBy(*keys).applyInArrow(lags, f"{', '.join(kinds)}, lag int, n long, r double")


def best_lag(by_lag: DataFrame, keys: list[str]) -> DataFrame:
    """The lag of the largest absolute correlation (the nearest to zero of equal ones), and which side leads."""
    g = by_lag.groupBy(*keys).agg(F.max_by(F.struct("lag", "r", "n"), F.struct(F.round(F.abs("r"), 9), -F.abs("lag"), "lag")).alias("b"))
    return g.select(*keys, "b.lag", "b.r", "b.n", F.when(F.col("b.lag") > 0, "x").when(F.col("b.lag") < 0, "y").otherwise("none").alias("leads"))


def partial_corr(rows: DataFrame, keys: list[str], controls: tuple[str, ...] = ("z",)) -> DataFrame:
    """Correlation of x and y with all of ``controls`` held fixed: all correlations in one pass, then one control after another is taken out.

    Groups of fewer rows than three and the controls, and those in which a column
    depends on the controls alone, have no row.
    """
    names = ["x", "y", *controls]
    r = lambda i, j: F.col(f"__r{min(i, j)}_{max(i, j)}")
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[finite(corr(names[i], names[j])).alias(f"__r{i}_{j}") for j in range(len(names)) for i in range(j)])
    g = g.withColumn("r", r(0, 1))
    for c in range(len(names) - 1, 1, -1):
        free = lambda i, c=c: F.sqrt(F.greatest(F.lit(0.0), 1 - r(i, c) * r(i, c)))
        left = [F.when(free(i) * free(j) > 1e-9, (r(i, j) - r(i, c) * r(j, c)) / (free(i) * free(j))).alias(f"__r{i}_{j}") for j in range(c) for i in range(j)]
        g = g.select(*keys, "n", "r", *left)
    return g.where((F.col("n") >= 3 + len(controls)) & r(0, 1).isNotNull()).select(*keys, "n", "r", r(0, 1).alias("partial_r"))


def fdr(rows: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Benjamini-Hochberg adjusted p within each group."""
    w = Window.partitionBy(*keys)
    scaled = rows.withColumn("k", F.row_number().over(w.orderBy(p))).withColumn("scaled", F.col(p) * F.count(F.lit(1)).over(w) / F.col("k"))
    return scaled.withColumn("p_adjusted", F.least(F.lit(1.0), F.min("scaled").over(w.orderBy(F.desc("k"))))).drop("k", "scaled")


def network_metrics(edges: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """Degree, strength and hub score of each node (columns keys, m1, m2, r)."""
    weight = F.abs("r").alias("w")
    both = edges.select(*keys, F.col("m1").alias("node"), weight).unionByName(edges.select(*keys, F.col("m2").alias("node"), weight))
    g = both.groupBy(*keys, "node").agg(F.count_if(F.col("w") > least).alias("degree"), F.sum("w").alias("strength"))
    return g.withColumn("hub_score", F.col("degree") * F.col("strength"))


def network(edges: DataFrame, nodes: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """Each node of each group's network (edges of keys, m1, m2, r; nodes of keys, node): degree, strength, hub score, betweenness, hub, density.

    Edges above ``least`` count for degree, betweenness and density (the share of
    all pairs of nodes that are edges); all edges for strength. Hubs are the nodes
    whose score is at least the 75th percentile of their network's. Betweenness is
    in shares of the pairs of other nodes.
    """
    own = nodes.join(network_metrics(edges, keys, least), [*keys, "node"], "left").join(betweenness(edges.where(F.abs("r") > least), keys), [*keys, "node"], "left")
    own = own.fillna(0, ["degree"]).fillna(0.0, ["strength", "hub_score", "betweenness"])
    whole = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes"), F.sum("degree").alias("ends"), F.percentile("hub_score", F.lit(0.75)).alias("limit"))
    j = own.join(whole, keys)
    pairs = (F.col("nodes") - 1) * (F.col("nodes") - 2) / 2
    density = F.when(F.col("nodes") > 1, F.col("ends") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    return j.select(*keys, "node", "degree", "strength", "hub_score", F.when(pairs > 0, F.col("betweenness") / pairs).otherwise(0.0).alias("betweenness"), (F.round("hub_score", 6) >= F.round("limit", 6)).alias("is_hub"), density.alias("density"))


def strong_clusters(edges: DataFrame, nodes: DataFrame, keys: list[str], strong: float = 0.5) -> DataFrame:
    """Components of two nodes or more of each network by edges above ``strong``: members, cohesion (mean of all edges within), density, and a label."""
    named = small_components(edges.where(F.abs("r") > strong), nodes, keys)
    sizes = named.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("members")).where("size > 1")
    side = lambda c: named.select(*keys, F.col("node").alias(c), F.col("component").alias(f"in_{c}"))
    inside = edges.join(side("m1"), [*keys, "m1"]).join(side("m2"), [*keys, "m2"]).where("in_m1 = in_m2")
    g = inside.groupBy(*keys, F.col("in_m1").alias("component")).agg(F.avg(F.when(F.col("r") != 0, F.abs("r"))).alias("cohesion"), F.count_if(F.abs("r") > strong).alias("ties"))
    density = F.col("ties") / (F.col("size") * (F.col("size") - 1) / 2)
    label = F.when(F.col("cohesion") >= 0.7, "tight").when(F.col("cohesion") >= 0.5, "close").otherwise("loose")
    return sizes.join(g, [*keys, "component"]).select(*keys, "component", "size", "members", "cohesion", density.alias("density"), label.alias("label"))


def small_components(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Components of graphs, one per group, by the repeated minimum over neighbours until nothing changes."""
    both = edges.select(*keys, F.col("m1").alias("node"), F.col("m2").alias("other")).unionByName(edges.select(*keys, F.col("m2").alias("node"), F.col("m1").alias("other")))
    both = staged(both, "edges")
    named = staged(nodes.select(*keys, "node", F.col("node").alias("component")), "named")
    while True:
        seen = both.join(named.select(*keys, F.col("node").alias("other"), F.col("component").alias("near")), [*keys, "other"]).groupBy(*keys, "node").agg(F.min("near").alias("near"))
        low = F.least("component", F.coalesce("near", "component"))
        named = staged(named.join(seen, [*keys, "node"], "left").select(*keys, "node", low.alias("component"), (low != F.col("component")).alias("moved")), "named")
        if named.where("moved").isEmpty():
            return named.drop("moved")


def ttest(rows: DataFrame, keys: list[str], group: str = "present") -> DataFrame:
    """Pooled t-test of value between the rows where ``group`` is true and those where it is not, with effect sizes."""
    yes, no = F.col(group), ~F.col(group)
    v = F.col("value")
    g = rows.groupBy(*keys).agg(
        F.count_if(yes).alias("n1"), F.count_if(no).alias("n0"), F.avg(F.when(yes, v)).alias("mean1"), F.avg(F.when(no, v)).alias("mean0"),
        F.var_samp(F.when(yes, v)).alias("v1"), F.var_samp(F.when(no, v)).alias("v0"),
    ).where("n1 >= 2 AND n0 >= 2")
    df = F.col("n1") + F.col("n0") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / df
    g = g.withColumn("df", df).withColumn("pooled", pooled).where("pooled > 0")
    gap = F.col("mean1") - F.col("mean0")
    t = gap / F.sqrt(F.col("pooled") * (1 / F.col("n1") + 1 / F.col("n0")))
    d = gap / F.sqrt("pooled")
    return g.select(*keys, "n1", "n0", "mean1", "mean0", "df", t.alias("t"), t_two_sided(t, F.col("df")).alias("p"), d.alias("cohens_d"), (d * (1 - 3 / (4 * F.col("df") - 1))).alias("hedges_g"), F.when(F.col("v0") > 0, gap / F.sqrt("v0")).alias("glass_delta"))


def paired(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Paired comparison of x and y: mean difference with interval, t, effect size."""
    g = rows.withColumn("d", F.col("y") - F.col("x")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("sd")).where("n >= 3 AND sd > 0")
    se = F.col("sd") / F.sqrt("n")
    t = F.col("mean_difference") / se
    half = t_quantile_975(F.col("n") - 1) * se
    return g.select(*keys, "n", "mean_difference", t.alias("t"), t_two_sided(t, F.col("n") - 1).alias("p"), (F.col("mean_difference") / F.col("sd")).alias("cohens_d"), (F.col("mean_difference") - half).alias("ci_low"), (F.col("mean_difference") + half).alias("ci_high"))


def wilcoxon(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Signed ranks of y - x without zeros: both sums, and the normal z with the tie term."""
    d = rows.withColumn("d", F.round(F.col("y") - F.col("x"), 9)).where("d <> 0").withColumn("a", F.abs("d"))
    w, ties = Window.partitionBy(*keys), Window.partitionBy(*keys, "a")
    d = d.withColumn("c", F.count(F.lit(1)).over(ties)).withColumn("rank", F.rank().over(w.orderBy("a")) + (F.col("c") - 1) / 2)
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"), F.sum(F.col("c") * F.col("c") - 1).alias("tie"))
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48)
    z = (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / spread
    return g.where("n >= 6").select(*keys, "n", "w_plus", "w_minus", z.alias("z"), normal_two_sided(z).alias("p"))


def mean_ci(m: DataFrame) -> DataFrame:
    """95 % interval of the mean per person and type by Student's t."""
    g = m.groupBy(*KEYS).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).where("n >= 2")
    half = t_quantile_975(F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    return g.select(*KEYS, "n", r6("mean").alias("mean"), r6(F.col("mean") - half).alias("low"), r6(F.col("mean") + half).alias("high"))


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """Wilson 95 % interval of a share."""
    z = 1.959963984540054
    p = successes / n
    mid, half, down = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (mid - half) / down, (mid + half) / down
