"""Statistics queries on the engagement model."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lanternfish.operators import stats as S

from . import analogue as A
from .analogue import SQL
from .registry import query
from .relational import EARNING, earning, round_all

GENRES = (
    SQL
    + """,
slots AS (SELECT title_id, count(*) AS slots, count(DISTINCT week) AS weeks_charted FROM fact_top10 JOIN dim_period ON week BETWEEN period_start AND period_end WHERE title_id IS NOT NULL GROUP BY 1),
hours AS (SELECT title_id, CAST(sum(hours_viewed) AS BIGINT) AS hours FROM fact_engagement GROUP BY 1),
genre_rows AS (
  SELECT t.title_id, trim(g.genre) AS genre, h.hours, coalesce(s.slots, 0) AS slots, coalesce(s.weeks_charted, 0) AS weeks_charted
  FROM dim_title t JOIN hours h USING (title_id) LEFT JOIN slots s USING (title_id), unnest(string_split(t.genres, ',')) AS g(genre) WHERE t.genres IS NOT NULL)
"""
)


def genre_rows(spark, d):
    top = A.fact_top10(spark, d).where("title_id is not null").join(F.broadcast(A.dim_period(spark)), F.col("week").between(F.col("period_start"), F.col("period_end")))
    slots = top.groupBy("title_id").agg(F.count("*").alias("slots"), F.count_distinct("week").alias("weeks_charted"))
    hours = A.fact_engagement(spark, d).groupBy("title_id").agg(F.sum("hours_viewed").alias("hours"))
    t = A.dim_title(spark, d).where("genres is not null").select("title_id", F.explode(F.split("genres", ",")).alias("genre"))
    j = t.join(hours, "title_id").join(slots, "title_id", "left")
    return j.select("title_id", F.trim("genre").alias("genre"), "hours", F.coalesce("slots", F.lit(0)).alias("slots"), F.coalesce("weeks_charted", F.lit(0)).alias("weeks_charted"))


@query("genre_rows", GENRES + "SELECT * FROM genre_rows")
def q_genre_rows(spark, d):
    return genre_rows(spark, d)


@query("genre_delivery", GENRES + """,
g AS (SELECT genre, count(DISTINCT title_id) AS titles, CAST(sum(hours) AS BIGINT) AS hours, CAST(sum(slots) AS BIGINT) AS slots, count(*) FILTER (WHERE weeks_charted > 0) AS charting FROM genre_rows GROUP BY 1),
s AS (SELECT *, hours / sum(hours) OVER () AS hours_share, slots / sum(slots) OVER () AS slots_share FROM g)
SELECT genre, titles, hours, slots, charting, round(hours_share, 9) AS hours_share, round(slots_share, 9) AS slots_share, round(hours_share / slots_share, 6) AS delivery FROM s WHERE titles >= 10 AND charting >= 3""")
def genre_delivery(spark, d):
    g = S.delivery(genre_rows(spark, d), 10, 3)
    return g.select("genre", "titles", "hours", "slots", "charting", F.round("hours_share", 9).alias("hours_share"), F.round("slots_share", 9).alias("slots_share"), F.round("delivery", 6).alias("delivery"))


@query("delivery_bootstrap", GENRES + """,
units AS (SELECT title_id, row_number() OVER (ORDER BY title_id) - 1 AS i FROM (SELECT DISTINCT title_id FROM genre_rows)),
n AS (SELECT count(*) AS n FROM units),
drawn AS (SELECT rep, ('0x' || substr(md5('s-' || rep || '-' || draw), 1, 8))::BIGINT % n AS i FROM range(1, 201) r(rep), n, range(1, (SELECT n FROM n) + 1) q(draw)),
times AS (SELECT rep, title_id, count(*) AS times FROM drawn JOIN units USING (i) GROUP BY ALL),
per AS (SELECT rep, genre, sum(times * hours) AS h, sum(times * slots) AS s FROM genre_rows JOIN times USING (title_id) GROUP BY ALL),
ratio AS (SELECT rep, genre, CASE WHEN s > 0 THEN (h / sum(h) OVER (PARTITION BY rep)) / (s / sum(s) OVER (PARTITION BY rep)) END AS delivery FROM per)
SELECT genre, round(quantile_cont(delivery, 0.025), 6) AS ci_low, round(quantile_cont(delivery, 0.975), 6) AS ci_high FROM ratio WHERE delivery IS NOT NULL GROUP BY 1""")
def delivery_bootstrap(spark, d):
    """Two hundred replicates here, for the oracle's sake; findings() takes two thousand."""
    return round_all(S.delivery_interval(genre_rows(spark, d), 200))


@query("spearman", EARNING + """,
r AS (SELECT rank() OVER (ORDER BY rating) + (count(*) OVER (PARTITION BY rating) - 1) / 2.0 AS rx, rank() OVER (ORDER BY weeks_charted) + (count(*) OVER (PARTITION BY weeks_charted) - 1) / 2.0 AS ry FROM earning WHERE rating IS NOT NULL AND weeks_charted IS NOT NULL)
SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r""")
def spearman(spark, d):
    return round_all(S.spearman(earning(spark, d), "rating", "weeks_charted"))


@query("ols", EARNING + """,
x AS (SELECT rating AS a, log10(hours) AS b, CAST(weeks_charted AS DOUBLE) AS y FROM earning WHERE rating IS NOT NULL AND weeks_charted IS NOT NULL),
m AS (SELECT covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS "by", var_pop(y) AS yy, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x),
s AS (SELECT *, (ay * bb - "by" * ab) / (aa * bb - ab * ab) AS ca, ("by" * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM m),
f AS (SELECT *, my - ca * ma - cb * mb AS c0, (ca * ay + cb * "by") / yy AS r2 FROM s)
SELECT 'intercept' AS term, round(c0, 4) AS estimate, round(r2, 4) AS r2 FROM f UNION ALL SELECT 'rating', round(ca, 4), round(r2, 4) FROM f UNION ALL SELECT 'log_hours', round(cb, 4), round(r2, 4) FROM f""")
def ols(spark, d):
    e = earning(spark, d).where("rating is not null and weeks_charted is not null").select("rating", F.log10("hours").alias("log_hours"), "weeks_charted")
    return round_all(S.ols(e, "weeks_charted", ["rating", "log_hours"]), 4)


SERIES = (
    SQL
    + """,
shipped AS (SELECT p_brand AS key, CAST(date_trunc('week', day) + INTERVAL 6 DAY AS DATE) AS week, CAST(sum(v.hours) AS BIGINT) AS hours FROM viewing v JOIN titles USING (part) GROUP BY ALL),
wanted AS (SELECT p_brand AS key, CAST(date_trunc('week', CAST(o_orderdate AS DATE)) + INTERVAL 6 DAY AS DATE) AS week, count(*) AS pageviews FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN titles ON l_partkey = part GROUP BY ALL),
series AS (SELECT key, week, hours, pageviews FROM shipped JOIN wanted USING (key, week)),
logs AS (SELECT key, row_number() OVER w - 1 AS i, ln(1 + hours) - lag(ln(1 + hours)) OVER w AS dh, ln(1 + pageviews) - lag(ln(1 + pageviews)) OVER w AS dp, count(*) OVER (PARTITION BY key) AS weeks FROM series WINDOW w AS (PARTITION BY key ORDER BY week)),
changes AS (SELECT key, i - 1 AS i, dh, dp FROM logs WHERE i > 0 AND weeks >= 8),
lags AS (
  SELECT a.key, l.lag, round(corr(a.dh, b.dp), 9) AS r, count(*) AS pairs
  FROM changes a, range(-4, 5) l(lag), changes b WHERE b.key = a.key AND b.i = a.i + l.lag GROUP BY ALL HAVING count(*) >= 6 AND stddev_pop(a.dh) > 0 AND stddev_pop(b.dp) > 0),
best AS (SELECT key, lag, r, lags_considered FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r DESC, lag) AS k, count(*) OVER (PARTITION BY key) AS lags_considered FROM lags) WHERE k = 1)
"""
)


def series(spark, d):
    """Weekly shipped cents and orders of each brand."""
    brand = A.titles(spark, d).select("part", F.col("p_brand").alias("key"))
    shipped = A.viewing(spark, d).groupBy("part", A.week_ending(F.col("day")).alias("week")).agg(F.sum("hours").alias("hours")).join(brand, "part").groupBy("key", "week").agg(F.sum("hours").alias("hours"))
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), A.week_ending(F.to_date("o_orderdate")).alias("week"))
    wanted = A.table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part")).join(o, "l_orderkey").groupBy("part", "week").agg(F.count("*").alias("n"))
    wanted = wanted.join(brand, "part").groupBy("key", "week").agg(F.sum("n").alias("pageviews"))
    return shipped.join(wanted, ["key", "week"])


@query("best_lag", SERIES + "SELECT key, CAST(lag AS INTEGER) AS lag, round(r, 6) AS r, lags_considered FROM best")
def best_lag(spark, d):
    return round_all(S.best_lag(series(spark, d)))


@query("lag_histogram", SERIES + "SELECT CAST(lag AS INTEGER) AS lag, count(*) AS n, round(median(r), 6) AS median_r FROM best GROUP BY 1")
def lag_histogram(spark, d):
    return S.best_lag(series(spark, d)).groupBy("lag").agg(F.count("*").alias("n"), F.round(F.median("r"), 6).alias("median_r"))


@query("sign_test", SERIES + """,
c AS (SELECT count(*) FILTER (WHERE lag < 0) AS leads, count(*) FILTER (WHERE lag > 0) AS lags, count(*) FILTER (WHERE lag = 0) AS same_week FROM best)
SELECT leads, lags, same_week, leads + lags AS n_decisive,
  round(least(1, 2 * (SELECT sum(exp(lgamma(leads + lags + 1) - lgamma(k + 1) - lgamma(leads + lags - k + 1) - (leads + lags) * ln(2))) FROM range(0, 101) r(k) WHERE k <= least(leads, lags))), 9) AS p FROM c""")
def sign_test(spark, d):
    """Counts leave Spark as one row; the exact p is a sum over them."""
    c = S.best_lag(series(spark, d)).agg(F.count_if(F.col("lag") < 0).alias("leads"), F.count_if(F.col("lag") > 0).alias("lags"), F.count_if(F.col("lag") == 0).alias("same_week"))
    r = c.first()
    p = S.sign_test(r.leads, r.lags)
    return spark.createDataFrame([(r.leads, r.lags, r.same_week, r.leads + r.lags, round(p, 9))], "leads long, lags long, same_week long, n_decisive long, p double")


@query("placebo", SERIES + """,
ids AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i FROM (SELECT DISTINCT key FROM changes)),
n AS (SELECT count(*) AS n FROM ids),
p1 AS (SELECT draw, n, ('0x' || substr(md5('pa-' || draw), 1, 8))::BIGINT % n AS a, ('0x' || substr(md5('pb-' || draw), 1, 8))::BIGINT AS hb FROM range(1, 501) q(draw), n),
pairs AS (SELECT draw, a, (a + 1 + hb % (n - 1)) % n AS b FROM p1)
SELECT draw, round(corr(x.dh, y.dp), 6) AS r FROM pairs JOIN ids ia ON ia.i = a JOIN ids ib ON ib.i = b JOIN changes x ON x.key = ia.key JOIN changes y ON y.key = ib.key AND y.i = x.i GROUP BY draw HAVING count(*) >= 6""")
def placebo(spark, d):
    """Five hundred mismatched pairs."""
    return round_all(S.placebo(series(spark, d), draws_=500)).select(F.col("draw").cast("long").alias("draw"), "r")


@query("censoring", SQL + "SELECT count(*) FILTER (WHERE last_week = m) AS still_charting, count(*) AS titles FROM (SELECT title_id, max(week) AS last_week, max(max(week)) OVER () AS m FROM fact_top10 WHERE title_id IS NOT NULL GROUP BY 1)")
def censoring(spark, d):
    g = A.fact_top10(spark, d).where("title_id is not null").groupBy("title_id").agg(F.max("week").alias("last_week"))
    g = g.withColumn("m", F.max("last_week").over(Window.partitionBy()))
    return g.agg(F.count_if(F.col("last_week") == F.col("m")).alias("still_charting"), F.count("*").alias("titles"))


@query("placebo_summary", SERIES + """,
ids AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i FROM (SELECT DISTINCT key FROM changes)),
n AS (SELECT count(*) AS n FROM ids),
p1 AS (SELECT draw, n, ('0x' || substr(md5('pa-' || draw), 1, 8))::BIGINT % n AS a, ('0x' || substr(md5('pb-' || draw), 1, 8))::BIGINT AS hb FROM range(1, 501) q(draw), n),
pairs AS (SELECT draw, a, (a + 1 + hb % (n - 1)) % n AS b FROM p1),
fake AS (SELECT draw, corr(x.dh, y.dp) AS r FROM pairs JOIN ids ia ON ia.i = a JOIN ids ib ON ib.i = b JOIN changes x ON x.key = ia.key JOIN changes y ON y.key = ib.key AND y.i = x.i GROUP BY draw HAVING count(*) >= 6),
f AS (SELECT median(r) AS m, count(*) AS n, quantile_cont(r, 0.95) AS p95 FROM fake WHERE r IS NOT NULL),
own AS (SELECT key, corr(dh, dp) AS r FROM changes GROUP BY 1)
SELECT round(f.m, 6) AS placebo_median, f.n AS placebo_draws, round(f.p95, 6) AS placebo_p95, count(*) AS n_titles, round(median(r), 6) AS real_median, count(*) FILTER (WHERE r > f.p95) AS real_above_p95 FROM own, f WHERE r IS NOT NULL GROUP BY f.m, f.n, f.p95""")
def placebo_summary(spark, d):
    return round_all(S.placebo_summary(series(spark, d)))


@query("strongest_lags", SERIES + "SELECT key, CAST(lag AS INTEGER) AS lag, round(r, 6) AS r FROM best ORDER BY abs(r) DESC, key LIMIT 10")
def strongest_lags(spark, d):
    return round_all(S.strongest(S.best_lag(series(spark, d)))).select("key", "lag", "r")
