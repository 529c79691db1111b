"""Statistics over titles and series: shares, ranks, regression, lags, resampling.

Everything that grows with the data is aggregated in Spark; the driver sees sums of fixed
size (normal equations, counts of leads and lags) only.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def corr(x: str, y: str) -> Column:
    """Pearson correlation over rows where both are known; null where one doesn't vary."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(a) * F.stddev_pop(b))


def delivery(rows: DataFrame, least_titles: int, least_charting: int, weight: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Share of hours over share of chart slots by genre; rows are (title_id, genre, hours, slots, weeks_charted).

    A title of several genres counts in each, above and below the line. by adds leading
    group columns (replicates), and weight how often a row was drawn.
    """
    w = F.lit(1) if weight is None else weight
    by = by or []
    g = rows.groupBy(*by, "genre").agg(F.count_distinct("title_id").alias("titles"), F.sum(w * F.col("hours")).alias("hours"), F.sum(w * F.col("slots")).alias("slots"), F.count_if(F.col("weeks_charted") > 0).alias("charting"))
    every = Window.partitionBy(*by) if by else Window.partitionBy()
    g = g.withColumn("hours_share", F.col("hours") / F.sum("hours").over(every)).withColumn("slots_share", F.col("slots") / F.sum("slots").over(every))
    g = g.withColumn("delivery", F.when(F.col("slots") > 0, F.col("hours_share") / F.col("slots_share")))
    return g.where((F.col("titles") >= least_titles) & (F.col("charting") >= least_charting))


def numbered(units: DataFrame, unit: str) -> DataFrame:
    """(unit, i): distinct units numbered from 0 in order.

    Strings are numbered within their first characters, whose counts are a small table, so
    no task sees all of them; other types take one window, which suits summaries only.
    """
    each = units.select(unit).distinct()
    if each.schema[unit].dataType.simpleString() != "string":
        return each.withColumn("i", F.row_number().over(Window.orderBy(unit)) - 1)
    each = each.withColumn("head", F.substring(unit, 1, 5))
    heads = each.groupBy("head").count()
    before = F.sum("count").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select("head", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("head").orderBy(unit)) - 1
    return each.withColumn("nth", nth).join(heads, "head").select(unit, (F.col("before") + F.col("nth")).cast("int").alias("i"))


def draws(units: DataFrame, unit: str, replicates: int, seed: str = "s") -> DataFrame:
    """(rep, unit, times): how often each unit is drawn in each replicate, by a hash of the draw.

    Units are numbered in order, so a rerun, or another engine, draws the same. Replicates
    are dealt to tasks; each draws its own.
    """
    spark = units.sparkSession
    place = numbered(units, unit)
    n = place.agg(F.count("*").alias("n")).where("n > 0")
    reps = spark.range(1, replicates + 1, 1, min(replicates, 4 * spark.sparkContext.defaultParallelism)).select(F.col("id").cast("int").alias("rep"))
    # the other side is one row
    drawn = reps.crossJoin(F.broadcast(n)).select("rep", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("draw"))
    h = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col("rep").cast("string"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = drawn.groupBy("rep", (h % F.col("n")).cast("int").alias("i")).agg(F.count("*").alias("times"))
    return drawn.join(place, "i").select("rep", unit, "times")


def delivery_interval(rows: DataFrame, replicates: int, seed: str = "s") -> DataFrame:
    """(genre, ci_low, ci_high): percentile interval over resampled titles."""
    drawn = draws(rows, "title_id", replicates, seed)
    per = delivery(rows.join(drawn, "title_id"), 0, 0, F.col("times"), ["rep"])
    return per.where("delivery is not null").groupBy("genre").agg(F.percentile("delivery", F.lit(0.025)).alias("ci_low"), F.percentile("delivery", F.lit(0.975)).alias("ci_high"))


def average_ranks(values: DataFrame, c: str, n: str = "n", parts: int = 256) -> DataFrame:
    """(c, rank) of each distinct value, ties at their mean; rows are (c, n), n the times of c.

    Values are dealt by approximate quantiles, at most `parts` of them in one row, so each
    window sees a part; any cuts give the same ranks.
    """
    per = values.groupBy(c).agg(F.sum(n).alias("n"))
    cuts = per.agg(F.percentile_approx(c, [i / parts for i in range(1, parts)], 10_000).alias("cuts"))
    # the other side is one row
    dealt = per.crossJoin(F.broadcast(cuts)).withColumn("part", F.size(F.filter("cuts", lambda x: x < F.col(c)))).drop("cuts")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("part").agg(F.sum("n").alias("m")).select("part", F.coalesce(F.sum("m").over(order), F.lit(0)).alias("before"))
    up_to = F.sum("n").over(Window.partitionBy("part").orderBy(c))
    return dealt.withColumn("up_to", up_to).join(before, "part").select(c, (F.col("before") + F.col("up_to") - (F.col("n") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho) over rows where both are known; rho is null where one doesn't vary.

    Equal pairs are counted first, and ranks are those of distinct values, so no task sees all rows.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    ranks = lambda c, out: average_ranks(pairs.select(c, "n"), c).select(c, F.col("rank").alias(out))
    r = pairs.join(ranks("x", "rx"), "x").join(ranks("y", "ry"), "y")
    # a mean rank is (n + 1) / 2, known from the count alone
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    r = r.crossJoin(F.broadcast(total)).select("n", (F.col("rx") - (F.col("total") + 1) / 2).alias("a"), (F.col("ry") - (F.col("total") + 1) / 2).alias("b"))
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    rho = F.try_divide(F.sum(n * a * b), F.sqrt(F.sum(n * a * a)) * F.sqrt(F.sum(n * b * b)))
    return r.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), rho.alias("rho"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p by the t approximation with n - 2 degrees of freedom."""
    if n < 3 or abs(rho) >= 1:
        return float("nan") if n < 3 else 0.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def normal_equations(df: DataFrame, y: str, xs: list[str], by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Sums of products of an intercept, xs and y, one row a group: all that least squares needs."""
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    w = F.col(weight) if weight else F.lit(1.0)
    aggs = [F.sum(w * cols[i] * cols[j]).alias(f"s_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return df.groupBy(*(by or [])).agg(*aggs)


def solve(row, k: int) -> tuple[np.ndarray, float]:
    """(coefficients, R squared) of one row of normal_equations with k terms."""
    m = np.array([[row[f"s_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], float)
    beta = np.linalg.lstsq(m[:k, :k], m[:k, k], rcond=None)[0]
    n, total = m[0, 0], m[k, k] - m[0, k] ** 2 / m[0, 0]
    rest = m[k, k] - 2 * beta @ m[:k, k] + beta @ m[:k, :k] @ beta - (m[0, k] - beta @ m[0, :k]) ** 2 / n
    return beta, 1 - rest / total if total else float("nan")


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(term, estimate, r2), one row a term; no rows in, none out."""
    row, terms = normal_equations(df, y, xs).first(), ["intercept", *xs]
    beta, r2 = solve(row, len(terms)) if row.s_0_0 else ([], float("nan"))
    return df.sparkSession.createDataFrame([(t, float(b), float(r2)) for t, b in zip(terms, beta, strict=False)], "term string, estimate double, r2 double")


def ols_interval(df: DataFrame, unit: str, y: str, xs: list[str], replicates: int, seed: str = "s") -> DataFrame:
    """(term, ci_low, ci_high) from resampled units: one row of sums a replicate reaches the driver."""
    rows = normal_equations(df.join(draws(df, unit, replicates, seed), unit), y, xs, ["rep"], "times").collect()
    betas = np.array([solve(r, len(xs) + 1)[0] for r in rows])
    low, high = np.percentile(betas, [2.5, 97.5], axis=0)
    return df.sparkSession.createDataFrame([(t, float(a), float(b)) for t, a, b in zip(["intercept", *xs], low, high, strict=True)], "term string, ci_low double, ci_high double")


def differences(series: DataFrame, key: str = "key", at: str = "week", h: str = "hours", p: str = "pageviews") -> DataFrame:
    """(key, i, dh, dp): week-on-week changes of log1p of both series, numbered in order."""
    order = Window.partitionBy(key).orderBy(at)
    s = series.withColumn("i", F.row_number().over(order) - 1)
    for c, out in ((h, "dh"), (p, "dp")):
        s = s.withColumn(out, F.log1p(c) - F.lag(F.log1p(c)).over(order))
    return s.where("i > 0").select(key, (F.col("i") - 1).alias("i"), "dh", "dp")


def lag_correlations(series: DataFrame, key: str = "key", max_lag: int = 4, min_pairs: int = 6, **cols) -> DataFrame:
    """(key, lag, r, pairs) for lags with min_pairs changes left that vary; at a negative lag pageviews move first."""
    d = differences(series, key, **cols)
    h = d.select(key, "i", "dh", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")).withColumn("j", F.col("i") + F.col("lag"))
    p = d.select(key, F.col("i").alias("j"), "dp")
    r = h.join(p, [key, "j"]).groupBy(key, "lag").agg(corr("dh", "dp").alias("r"), F.count("*").alias("pairs"), F.stddev_pop("dh").alias("sh"), F.stddev_pop("dp").alias("sp"))
    return r.where((F.col("pairs") >= min_pairs) & (F.col("sh") > 0) & (F.col("sp") > 0)).select(key, "lag", "r", "pairs")


def best_lag(series: DataFrame, key: str = "key", min_weeks: int = 8, digits: int = 9, **args) -> DataFrame:
    """(key, lag, r, lags_considered): the lag with the largest r, ties to the smallest lag.

    r is rounded before it is compared, so that ties don't turn on the order of summation.
    """
    at = args.get("at", "week")
    long = series.groupBy(key).agg(F.count(at).alias("n")).where(F.col("n") >= min_weeks).select(key)
    c = lag_correlations(series.join(long, key, "left_semi"), key, **args).withColumn("r", F.round("r", digits))
    c = c.withColumn("lags_considered", F.count("*").over(Window.partitionBy(key))).withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("r"), "lag")))
    return c.where("k = 1").select(key, "lag", "r", "lags_considered")


def placebo(series: DataFrame, key: str = "key", draws_: int = 500, min_pairs: int = 6, seed: str = "p") -> DataFrame:
    """(draw, r): changes of one series' hours against another's pageviews, cut to the shorter.

    Pairs are drawn by hash; the second member is moved past the first, so they differ.
    """
    d = differences(series, key)
    ids = numbered(d, key)
    n = ids.agg(F.count("*").alias("n")).where("n > 1")
    h = lambda part: F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed + part), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long")
    pairs = n.select("n", F.explode(F.sequence(F.lit(1), F.lit(draws_))).alias("draw")).withColumn("a", (h("a") % F.col("n")).cast("int"))
    pairs = pairs.withColumn("b", ((F.col("a") + 1 + h("b") % (F.col("n") - 1)) % F.col("n")).cast("int"))
    one = d.select(F.col(key).alias("ka"), F.col("i").alias("t"), "dh").join(ids.select(F.col(key).alias("ka"), F.col("i").alias("a")), "ka")
    two = d.select(F.col(key).alias("kb"), F.col("i").alias("t"), "dp").join(ids.select(F.col(key).alias("kb"), F.col("i").alias("b")), "kb")
    j = pairs.join(one, "a").join(two, ["b", "t"])
    return j.groupBy("draw").agg(corr("dh", "dp").alias("r"), F.count("*").alias("pairs")).where((F.col("pairs") >= min_pairs) & F.col("r").isNotNull()).select("draw", "r")


def placebo_summary(series: DataFrame, key: str = "key", min_weeks: int = 8, **args) -> DataFrame:
    """One row: real same-week correlations beside those of mismatched pairs, and how many real ones pass the 95th percentile."""
    long = series.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= min_weeks).select(key)
    some = series.join(long, key, "left_semi")
    real = differences(some, key).groupBy(key).agg(corr("dh", "dp").alias("r")).where("r is not null")
    fake = placebo(some, key, **args).agg(F.median("r").alias("placebo_median"), F.count("*").alias("placebo_draws"), F.percentile("r", F.lit(0.95)).alias("placebo_p95"))
    # the placebo side is one row
    return real.crossJoin(F.broadcast(fake)).groupBy("placebo_median", "placebo_draws", "placebo_p95").agg(F.count("*").alias("n_titles"), F.median("r").alias("real_median"), F.count_if(F.col("r") > F.col("placebo_p95")).alias("real_above_p95"))


def strongest(fits: DataFrame, most: int = 10, key: str = "key") -> DataFrame:
    """The fits with the largest correlations in either direction."""
    return fits.orderBy(F.desc(F.abs("r")), key).limit(most)


def stratified(rows: DataFrame, key: str, band: Column, per_band: int, target: int, seed: str = "7") -> DataFrame:
    """At most target rows: per_band of each band, topped up from the rest, distinct by key, in a shuffled order (column place).

    All choices are by a seeded hash of the key, so any run and engine takes the same rows.
    """
    h = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    one = rows.withColumn("_band", band).withColumn("_h", h).dropDuplicates([key])
    one = one.withColumn("_r", F.row_number().over(Window.partitionBy("_band").orderBy("_h", key)))
    # those within their band's share come first; limit keeps a bounded number
    some = one.orderBy(F.col("_r") > per_band, "_h", key).limit(target)
    place = F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit("order-"), "_h")), key))
    return some.withColumn("place", place).drop("_band", "_h", "_r")


def sample(rows: DataFrame, key: str, n: int, seed: str = "7") -> DataFrame:
    """n rows by a seeded hash of the key."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), key).limit(n)


def sign_test(leads: int, lags: int) -> float:
    """Exact two-sided binomial p that leads and lags are equally likely; nan without either."""
    n = leads + lags
    if not n:
        return float("nan")
    term = lambda k: math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
    return min(1.0, 2 * sum(term(k) for k in range(min(leads, lags) + 1)))
