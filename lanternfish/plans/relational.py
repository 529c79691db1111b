"""Queries over the engagement model: views, joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternfish.functions import titles as T
from lanternfish.operators import stats as S

from . import analogue as A
from . import views as V
from .analogue import SQL
from .registry import query


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def earning(spark: SparkSession, d: str) -> DataFrame:
    return V.earning_its_place(A.fact_engagement(spark, d), A.fact_top10(spark, d), A.fact_pageviews(spark, d), A.dim_title(spark, d), A.dim_period(spark))


EARNING = (
    SQL
    + """,
engagement AS (SELECT title_id, sum(hours_viewed) AS hours, sum(views) AS views, min(release_date) AS release_date, min(period) AS first_period FROM fact_engagement GROUP BY 1),
avail AS (
  SELECT e.*, coalesce(e.release_date, make_date(t.start_year, 1, 1), p.period_start) AS available_from,
    CASE WHEN e.release_date IS NOT NULL THEN 'release_date' WHEN t.start_year IS NOT NULL THEN 'start_year' ELSE 'first_period_reported' END AS available_from_source
  FROM engagement e JOIN dim_title t USING (title_id) JOIN dim_period p ON p.period = e.first_period),
weeks AS (SELECT *, greatest(1, CAST(floor(((SELECT max(period_end) FROM dim_period) - available_from) / 7) AS BIGINT)) AS weeks_available FROM avail),
demand AS (
  SELECT v.title_id, CAST(sum(v.views) AS BIGINT) AS pageviews, count(DISTINCT v.date) AS pageview_days
  FROM fact_pageviews v JOIN (SELECT DISTINCT title_id, period FROM fact_engagement) r USING (title_id)
  JOIN dim_period d ON d.period = r.period AND v.date BETWEEN d.period_start AND d.period_end GROUP BY 1),
charted AS (SELECT title_id, count(DISTINCT week) AS weeks_charted, min(weekly_rank) AS best_rank FROM fact_top10 WHERE title_id IS NOT NULL GROUP BY 1),
earning AS (
  SELECT t.title_id, t.canonical_title, t.kind, t.genres, t.rating, t.votes, CAST(w.hours AS BIGINT) AS hours, CAST(w.views AS BIGINT) AS views, w.release_date, w.available_from, w.available_from_source,
    w.weeks_available, w.hours / w.weeks_available AS hours_per_week_available, c.weeks_charted, c.best_rank, d.pageviews, d.pageview_days,
    CASE WHEN d.pageviews > 0 THEN w.hours / (d.pageviews / 1000.0) END AS hours_per_1k_pageviews
  FROM dim_title t JOIN weeks w USING (title_id) LEFT JOIN charted c USING (title_id) LEFT JOIN demand d USING (title_id))
"""
)


@query("earning_its_place", EARNING + "SELECT title_id, canonical_title, kind, genres, rating, votes, hours, views, release_date, available_from, available_from_source, weeks_available, round(hours_per_week_available, 3) AS hours_per_week_available, weeks_charted, best_rank, pageviews, pageview_days, round(hours_per_1k_pageviews, 3) AS hours_per_1k_pageviews FROM earning")
def earning_its_place(spark, d):
    return round_all(earning(spark, d), 3)


@query("headline", EARNING + "SELECT title_id, canonical_title, kind, genres, rating, hours, round(hours_per_week_available, 3) AS hours_per_week_available, weeks_available, available_from_source, coalesce(weeks_charted, 0) AS weeks_charted, best_rank, weeks_charted IS NOT NULL AS ever_charted FROM earning WHERE weeks_available >= 8 ORDER BY hours_per_week_available DESC, title_id")
def headline(spark, d):
    return round_all(V.headline(earning(spark, d)), 3).orderBy(F.desc("hours_per_week_available"), "title_id")


@query("title_period", SQL + "SELECT t.title_id, p.period, t.canonical_title, t.kind, t.matched, period_start, period_end, count(*) AS seasons_reported_in_period, CAST(sum(hours_viewed) AS BIGINT) AS hours_viewed, CAST(sum(views) AS BIGINT) AS views, min(release_date) AS first_release_date, bool_or(available_globally) AS available_globally FROM fact_engagement f JOIN dim_title t USING (title_id) JOIN dim_period p USING (period) GROUP BY ALL")
def title_period(spark, d):
    return V.title_period(A.fact_engagement(spark, d), A.dim_title(spark, d), A.dim_period(spark))


@query("longevity", SQL + "SELECT title_id, string_agg(DISTINCT charting_title, ' | ' ORDER BY charting_title) AS charting_titles, count(DISTINCT week) AS weeks_charted, min(weekly_rank) AS best_rank, min(week) AS first_week, max(week) AS last_week, CAST(sum(weekly_hours) AS BIGINT) AS top10_hours, count(DISTINCT category) AS categories FROM fact_top10 WHERE title_id IS NOT NULL GROUP BY 1")
def longevity(spark, d):
    return V.longevity(A.fact_top10(spark, d))


@query("weekly_demand", SQL + """,
pv AS (SELECT title_id, CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS week, CAST(sum(views) AS BIGINT) AS pageviews FROM fact_pageviews GROUP BY ALL),
top AS (SELECT title_id, week, CAST(sum(weekly_hours) AS BIGINT) AS hours, min(weekly_rank) AS best_rank FROM fact_top10 WHERE title_id IS NOT NULL GROUP BY ALL)
SELECT coalesce(t.title_id, p.title_id) AS title_id, coalesce(t.week, p.week) AS week, t.hours, t.best_rank, p.pageviews FROM top t FULL OUTER JOIN pv p ON p.title_id = t.title_id AND p.week = t.week""")
def weekly_demand(spark, d):
    return V.weekly_demand(A.fact_top10(spark, d), A.fact_pageviews(spark, d))


@query("inperiod_charted", SQL + "SELECT period, count(DISTINCT charting_title) AS titles, count(DISTINCT week) AS weeks, min(weekly_rank) AS best_rank, CAST(sum(weekly_hours) AS BIGINT) AS hours FROM fact_top10 JOIN dim_period ON week BETWEEN period_start AND period_end GROUP BY 1")
def inperiod_charted(spark, d):
    """A range join; the period side is a few rows, so it is broadcast."""
    j = A.fact_top10(spark, d).join(F.broadcast(A.dim_period(spark)), F.col("week").between(F.col("period_start"), F.col("period_end")))
    return j.groupBy("period").agg(F.count_distinct("charting_title").alias("titles"), F.count_distinct("week").alias("weeks"), F.min("weekly_rank").alias("best_rank"), F.sum("weekly_hours").alias("hours"))


@query("demand_scope", SQL + "SELECT t.title_id, t.tconst, t.canonical_title, count(DISTINCT f.week) AS weeks_charted, CAST(sum(f.weekly_hours) AS BIGINT) AS top10_hours FROM fact_top10 f JOIN dim_period ON f.week BETWEEN period_start AND period_end JOIN dim_title t USING (title_id) WHERE t.matched AND t.tconst IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT f.week) >= 5")
def demand_scope(spark, d):
    return V.charting_titles(A.fact_top10(spark, d), A.dim_title(spark, d), A.dim_period(spark), 5).select("title_id", "tconst", "canonical_title", "weeks_charted", "top10_hours")


@query("demand_in_period", SQL + "SELECT d.period, count(DISTINCT v.title_id) AS titles, count(DISTINCT v.date) AS days, CAST(sum(v.views) AS BIGINT) AS pageviews FROM fact_pageviews v JOIN (SELECT DISTINCT title_id, period FROM fact_engagement) r USING (title_id) JOIN dim_period d ON d.period = r.period AND v.date BETWEEN d.period_start AND d.period_end GROUP BY 1")
def demand_in_period(spark, d):
    """Equal keys with a range beside them: the range part becomes a computed period."""
    reported = A.fact_engagement(spark, d).select("title_id", "period").distinct()
    daily = A.fact_pageviews(spark, d).withColumn("period", A.period_of(F.col("date")))
    return daily.join(reported, ["title_id", "period"]).groupBy("period").agg(F.count_distinct("title_id").alias("titles"), F.count_distinct("date").alias("days"), F.sum("views").alias("pageviews"))


@query("period_arrays", SQL + "SELECT title_id, CAST(to_json(list(period ORDER BY period)) AS VARCHAR) AS periods, CAST(to_json(list(hours ORDER BY period)) AS VARCHAR) AS hours FROM (SELECT title_id, period, CAST(sum(hours_viewed) AS BIGINT) AS hours FROM fact_engagement GROUP BY ALL) GROUP BY 1")
def period_arrays(spark, d):
    """Ordered lists: structs are sorted inside each group's array (a few periods a title)."""
    g = A.fact_engagement(spark, d).groupBy("title_id", "period").agg(F.sum("hours_viewed").alias("h"))
    g = g.groupBy("title_id").agg(F.array_sort(F.collect_list(F.struct("period", "h"))).alias("x"))
    return g.select("title_id", F.to_json("x.period").alias("periods"), F.to_json("x.h").alias("hours"))


@query("filtered_counts", SQL + "SELECT count(*) AS titles, count(*) FILTER (WHERE matched) AS matched, count(*) FILTER (WHERE kind = 'tv') AS tv, CAST(sum(votes) FILTER (WHERE kind = 'film') AS BIGINT) AS film_votes, bool_or(max_season > 8) AS any_long FROM dim_title")
def filtered_counts(spark, d):
    return A.dim_title(spark, d).agg(F.count("*").alias("titles"), F.count_if("matched").alias("matched"), F.count_if(F.col("kind") == "tv").alias("tv"), F.sum(F.when(F.col("kind") == "film", F.col("votes"))).alias("film_votes"), F.bool_or(F.col("max_season") > 8).alias("any_long"))


@query("metric_coverage", EARNING + "SELECT count(*) AS titles, count(weeks_charted) AS charted, count(pageviews) AS with_pageviews, count(rating) AS rated, count(hours_per_1k_pageviews) AS with_ratio FROM earning")
def metric_coverage(spark, d):
    return earning(spark, d).agg(F.count("*").alias("titles"), F.count("weeks_charted").alias("charted"), F.count("pageviews").alias("with_pageviews"), F.count("rating").alias("rated"), F.count("hours_per_1k_pageviews").alias("with_ratio"))


@query("metric_agreement", EARNING + "SELECT round(corr(hours_per_week_available, weeks_charted), 6) AS headline_longevity, round(corr(hours_per_week_available, hours_per_1k_pageviews), 6) AS headline_ratio, round(corr(rating, weeks_charted), 6) AS rating_longevity FROM earning WHERE hours >= 1000000")
def metric_agreement(spark, d):
    e = earning(spark, d).where("hours >= 1000000")
    return e.agg(*[F.round(S.corr(a, b), 6).alias(n) for a, b, n in (("hours_per_week_available", "weeks_charted", "headline_longevity"), ("hours_per_week_available", "hours_per_1k_pageviews", "headline_ratio"), ("rating", "weeks_charted", "rating_longevity"))])


@query("available_source_split", EARNING + "SELECT available_from_source, count(*) AS titles, round(median(weeks_available), 1) AS median_weeks, CAST(sum(hours) AS BIGINT) AS hours, round(sum(hours) * 1.0 / (SELECT sum(hours) FROM earning), 9) AS share FROM earning GROUP BY 1")
def available_source_split(spark, d):
    g = earning(spark, d).groupBy("available_from_source").agg(F.count("*").alias("titles"), F.round(F.median("weeks_available"), 1).alias("median_weeks"), F.sum("hours").alias("hours"))
    return g.withColumn("share", F.round(F.col("hours") / F.sum("hours").over(Window.partitionBy()), 9))


@query("young_old_extremes", EARNING + """,
young AS (SELECT 'young' AS side, title_id, hours, weeks_available FROM earning WHERE weeks_available <= 330 AND hours >= 100000 ORDER BY hours DESC, title_id LIMIT 5),
old AS (SELECT 'old' AS side, title_id, hours, weeks_available FROM earning WHERE weeks_available > 500 ORDER BY hours DESC, title_id LIMIT 5)
SELECT * FROM young UNION ALL SELECT * FROM old""")
def young_old_extremes(spark, d):
    e = earning(spark, d)
    top = lambda side, cond: e.where(cond).select(F.lit(side).alias("side"), "title_id", "hours", "weeks_available").orderBy(F.desc("hours"), "title_id").limit(5)
    return top("young", "weeks_available <= 330 and hours >= 100000").unionByName(top("old", "weeks_available > 500"))


@query("orphans", SQL + ", chosen AS (SELECT * FROM dim_title WHERE matched) SELECT 'engagement' AS fact, count(*) AS orphans FROM fact_engagement f WHERE NOT EXISTS (SELECT 1 FROM chosen s WHERE s.title_id = f.title_id) UNION ALL SELECT 'top10', count(*) FROM fact_top10 f LEFT JOIN chosen s USING (title_id) WHERE f.title_id IS NOT NULL AND s.title_id IS NULL")
def orphans(spark, d):
    some = A.dim_title(spark, d).where("matched").select("title_id")
    check = lambda name, f: f.join(some, "title_id", "left_anti").agg(F.lit(name).alias("fact"), F.count("*").alias("orphans"))
    return check("engagement", A.fact_engagement(spark, d)).unionByName(check("top10", A.fact_top10(spark, d).where("title_id is not null")))


@query("charted_semi", SQL + "SELECT title_id, canonical_title FROM dim_title WHERE title_id IN (SELECT title_id FROM fact_top10 WHERE weekly_rank = 1)")
def charted_semi(spark, d):
    return A.dim_title(spark, d).join(A.fact_top10(spark, d).where("weekly_rank = 1").select("title_id"), "title_id", "left_semi").select("title_id", "canonical_title")


@query("top10_slots", SQL + "SELECT week, category, count(*) AS slots, min(weekly_rank) AS first_rank, max(weekly_rank) AS last_rank, count(*) = 10 AS complete FROM fact_top10 GROUP BY 1, 2")
def top10_slots(spark, d):
    """The cell contract of the chart: ten ranks a week and category."""
    return A.fact_top10(spark, d).groupBy("week", "category").agg(F.count("*").alias("slots"), F.min("weekly_rank").alias("first_rank"), F.max("weekly_rank").alias("last_rank"), (F.count("*") == 10).alias("complete"))


@query("weak_scope_fallback", SQL + """,
known AS (SELECT p.period, charting_title, min(title_id) AS title_id FROM fact_top10 JOIN dim_period p ON week BETWEEN period_start AND period_end WHERE title_id IS NOT NULL AND weekly_rank <= 5 GROUP BY 1, 2),
ever AS (SELECT charting_title, arg_min(title_id, period) AS title_id FROM known GROUP BY 1)
SELECT f.week, f.category, f.weekly_rank, coalesce(k.title_id, e.title_id) AS found_id, CASE WHEN k.title_id IS NOT NULL THEN 'period' WHEN e.title_id IS NOT NULL THEN 'name_only' END AS scope
FROM fact_top10 f LEFT JOIN dim_period p ON f.week BETWEEN period_start AND period_end LEFT JOIN known k ON k.period = p.period AND k.charting_title = f.charting_title LEFT JOIN ever e ON e.charting_title = f.charting_title""")
def weak_scope_fallback(spark, d):
    """A name looked up in its own half-year, else in the earliest that has it, and labelled."""
    f = A.fact_top10(spark, d).withColumn("period", A.period_of(F.col("week")))
    known = f.where("title_id is not null and weekly_rank <= 5").groupBy("period", "charting_title").agg(F.min("title_id").alias("k"))
    ever = known.groupBy("charting_title").agg(F.min_by("k", "period").alias("e"))
    j = f.join(known, ["period", "charting_title"], "left").join(ever, "charting_title", "left")
    return j.select("week", "category", "weekly_rank", F.coalesce("k", "e").alias("found_id"), F.when(F.col("k").isNotNull(), F.lit("period")).when(F.col("e").isNotNull(), F.lit("name_only")).alias("scope"))


@query("article_map", SQL + ", m AS (SELECT part, title_id, p_name AS article FROM keyed_titles) SELECT article, arg_max(title_id, part) AS title_id, count(DISTINCT title_id) AS claimed_by FROM m GROUP BY 1")
def article_map(spark, d):
    """Several titles share an article: the last in map order keeps it."""
    return A.keyed_titles(spark, d).groupBy(F.col("p_name").alias("article")).agg(F.max_by("title_id", "part").alias("title_id"), F.count_distinct("title_id").alias("claimed_by"))


@query("shared_ids", SQL + "SELECT title_id, part, title FROM (SELECT *, count(*) OVER (PARTITION BY title_id) AS n FROM keyed_titles) WHERE n > 1")
def shared_ids(spark, d):
    n = F.count("*").over(Window.partitionBy("title_id"))
    return A.keyed_titles(spark, d).withColumn("n", n).where("n > 1").select("title_id", "part", "title")


@query("title_ids", SQL + "SELECT part, kind, name_key, year, title_id FROM keyed_titles")
def title_ids(spark, d):
    return A.keyed_titles(spark, d).select("part", "kind", "name_key", "year", "title_id")


@query("dashboard_rows", EARNING + """,
inside AS (SELECT title_id, count(DISTINCT week) AS weeks_in_periods, min(weekly_rank) AS best_in_periods FROM fact_top10 JOIN dim_period ON week BETWEEN period_start AND period_end WHERE title_id IS NOT NULL GROUP BY 1),
arrays AS (SELECT title_id, CAST(to_json(list(period ORDER BY period)) AS VARCHAR) AS periods FROM (SELECT DISTINCT title_id, period FROM fact_engagement WHERE hours_viewed > 0) GROUP BY 1)
SELECT e.title_id, e.canonical_title, e.hours, i.weeks_in_periods, i.best_in_periods, a.periods
FROM earning e LEFT JOIN inside i USING (title_id) LEFT JOIN arrays a USING (title_id)
WHERE e.weeks_available >= 8 AND e.kind = 'tv' AND e.genres IS NOT NULL AND list_contains(string_split(e.genres, ','), split_part((SELECT min(genres) FROM dim_title), ',', 1)) AND i.title_id IS NOT NULL
ORDER BY e.hours DESC, e.title_id LIMIT 200""")
def dashboard_rows(spark, d):
    """The dashboard's filters: kind, genre membership, charted or not; then sort and first 200."""
    dim, fact = A.dim_title(spark, d), A.fact_engagement(spark, d)
    inside = A.fact_top10(spark, d).where("title_id is not null").join(F.broadcast(A.dim_period(spark)), F.col("week").between(F.col("period_start"), F.col("period_end"))).groupBy("title_id").agg(F.count_distinct("week").alias("weeks_in_periods"), F.min("weekly_rank").alias("best_in_periods"))
    arrays = fact.where("hours_viewed > 0").groupBy("title_id").agg(F.to_json(F.array_sort(F.collect_set("period"))).alias("periods"))
    genre = dim.agg(F.split(F.min("genres"), ",")[0].alias("genre"))
    e = earning(spark, d).where("weeks_available >= 8 and kind = 'tv'").crossJoin(F.broadcast(genre)).where(F.array_contains(F.split("genres", ","), F.col("genre")))
    return e.join(inside, "title_id").join(arrays, "title_id", "left").orderBy(F.desc("hours"), "title_id").limit(200).select("title_id", "canonical_title", "hours", "weeks_in_periods", "best_in_periods", "periods")


@query("global_scalars", SQL + "SELECT (SELECT count(*) FROM dim_title) AS titles, (SELECT CAST(sum(hours_viewed) AS BIGINT) FROM fact_engagement) AS hours, (SELECT count(*) FROM fact_top10) AS slots, (SELECT count(*) FROM fact_top10 WHERE title_id IS NULL) AS unmatched_slots, (SELECT count(DISTINCT title_id) FROM fact_pageviews) AS with_demand")
def global_scalars(spark, d):
    """One aggregate a table, put side by side: every side is one row."""
    out = A.dim_title(spark, d).agg(F.count("*").alias("titles")).crossJoin(A.fact_engagement(spark, d).agg(F.sum("hours_viewed").alias("hours")))
    out = out.crossJoin(A.fact_top10(spark, d).agg(F.count("*").alias("slots"), F.count_if(F.col("title_id").isNull()).alias("unmatched_slots")))
    return out.crossJoin(A.fact_pageviews(spark, d).agg(F.count_distinct("title_id").alias("with_demand")))


@query("profile_nulls", SQL + "SELECT 'dim_title' AS name, count(*) AS n_rows, count(*) - count(year) AS null_year, count(*) - count(tconst) AS null_tconst, count(*) - count(rating) AS null_rating, count(*) - count(start_year) AS null_start_year FROM dim_title")
def profile_nulls(spark, d):
    """Rows and nulls of each column in one pass."""
    cols = ("year", "tconst", "rating", "start_year")
    return A.dim_title(spark, d).agg(F.lit("dim_title").alias("name"), F.count("*").alias("n_rows"), *[(F.count("*") - F.count(c)).alias(f"null_{c}") for c in cols])


@query("props_json", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY 1, 2")
def props_json(spark, d):
    e = A.table(spark, d, "events").withColumn("k", F.from_json("props", "k long")["k"]).where("k is not null")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"))


@query("stratified_sample", SQL + ", banded AS (SELECT part, title, CAST(floor(p_size / 10) AS BIGINT) AS band, md5('7-' || part) AS h FROM keyed_titles) SELECT band, part, title FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY h, part) AS r FROM banded) WHERE r <= 5")
def stratified_sample(spark, d):
    """Five of each band by a seeded hash: the same rows in any run and engine."""
    t = A.keyed_titles(spark, d).withColumn("band", F.floor(F.col("p_size") / 10)).withColumn("h", F.md5(F.concat(F.lit("7-"), F.col("part").cast("string"))))
    return t.withColumn("r", F.row_number().over(Window.partitionBy("band").orderBy("h", "part"))).where("r <= 5").select("band", "part", "title")


@query("title_parse", SQL + r"""
SELECT part, base, CASE part % 8 WHEN 2 THEN 'limited' WHEN 3 THEN 'part' WHEN 0 THEN 'season' WHEN 1 THEN 'season' WHEN 4 THEN 'season' WHEN 5 THEN 'season' END AS season_kind,
  CAST(season_number AS INTEGER) AS season_number, CASE WHEN part % 8 = 4 THEN CAST(p_size % 3 + 1 AS INTEGER) END AS part_number, part % 8 = 5 AS bare_number, CASE WHEN year_text <> '' THEN CAST(year_text AS INTEGER) END AS title_year,
  CASE WHEN part % 8 = 6 THEN split_part(title, ' // ', 2) END AS alternate
FROM keyed_titles""")
def title_parse(spark, d):
    p = A.keyed_titles(spark, d)
    return p.select("part", "p.base", "p.season_kind", "p.season_number", "p.part_number", "p.bare_number", F.col("p.year").alias("title_year"), F.get("p.alternates", F.lit(0)).alias("alternate"))


@query("text_keys", r"""
WITH k AS (SELECT doc_id, lang, trim(regexp_replace(replace(lower(strip_accents(replace(replace(replace(text, '&', ' and '), '+', ' and '), '×', ' x '))), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM documents)
SELECT doc_id, lang, length(key) AS key_length, sha1(replace(key, ' ', '')) AS compact_sha, sha1(key) AS key_sha FROM k""")
def text_keys(spark, d):
    """The normaliser, acronym runs left apart, on text in four languages."""
    k = A.table(spark, d, "documents").select("doc_id", "lang", T.normalise(F.col("text"), collapse_acronyms=False).alias("key"))
    return k.select("doc_id", "lang", F.length("key").cast("long").alias("key_length"), F.sha1(T.compact(F.col("key"))).alias("compact_sha"), F.sha1("key").alias("key_sha"))


@query("seasons_json", SQL + "SELECT name_key, kind, CAST(to_json(list(DISTINCT CAST(season_number AS INTEGER) ORDER BY CAST(season_number AS INTEGER))) AS VARCHAR) AS seasons, CAST(max(season_number) AS INTEGER) AS max_season FROM keyed_titles WHERE season_number IS NOT NULL GROUP BY 1, 2")
def seasons_json(spark, d):
    t = A.keyed_titles(spark, d).where("p.season_number is not null")
    seasons = F.array_sort(F.collect_set("p.season_number"))
    return t.groupBy("name_key", "kind").agg(F.to_json(seasons).alias("seasons"), F.max("p.season_number").alias("max_season"))


@query("per_thousand_views", EARNING + " SELECT title_id, round(hours / (pageviews / 1000.0), 2) AS hours_per_1k_pageviews, pageview_days FROM earning WHERE pageviews > 0 AND pageview_days >= 60 AND hours >= 100000 ORDER BY hours / (pageviews / 1000.0) DESC, title_id LIMIT 10")
def per_thousand_views(spark, d):
    """Hours per thousand pageviews, over titles with at least sixty days of pageviews."""
    e = earning(spark, d).where("pageviews > 0 and pageview_days >= 60 and hours >= 100000")
    return round_all(e.orderBy(F.desc("hours_per_1k_pageviews"), "title_id").limit(10).select("title_id", "hours_per_1k_pageviews", "pageview_days"), 2)


SHAPED = f"""
WITH s AS (SELECT p_partkey AS part, p_name AS name, p_partkey % 20 AS shape, p_size % 9 + 1 AS n, p_size % 3 + 1 AS m, p_size % 13 AS w, p_size % 20 AS o FROM part)
SELECT part, name AS base,
  CASE WHEN shape = 5 OR shape = 6 AND w = {T.SEASON_WORDS.index("Series")} THEN 'series' WHEN shape IN (0, 1, 2, 3, 4, 6, 7, 16, 17, 18) THEN 'season' WHEN shape IN (8, 9) THEN 'part' WHEN shape = 10 THEN 'volume' WHEN shape = 11 THEN 'chapter' WHEN shape = 12 THEN 'collection' WHEN shape IN (13, 14) THEN 'limited' WHEN shape = 15 THEN 'episode_date' END AS season_kind,
  CAST(CASE WHEN shape IN (0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 18) THEN n WHEN shape = 7 THEN o + 1 WHEN shape IN (16, 17) THEN n + 1 END AS INTEGER) AS season_number,
  CAST(CASE WHEN shape = 0 THEN m END AS INTEGER) AS part_number, CASE WHEN shape = 15 THEN 'June ' || n || ', 2020' END AS episode_date, shape IN (16, 17, 18) AS bare_number, CAST(CASE WHEN shape = 19 THEN 2011 END AS INTEGER) AS title_year
FROM s"""


@query("title_shapes", SHAPED)
def title_shapes(spark, d):
    """Every shape of the grammar, Roman numerals and bare numbers included, on names made for it."""
    shape, name = F.col("p_partkey") % 20, F.col("p_name")
    n, m = (F.col("p_size") % 9 + 1).cast("string"), (F.col("p_size") % 3 + 1).cast("string")
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (at + 1).cast("int"))
    roman = pick(T.ROMAN, F.col("p_size") % 9)
    ends = [
        F.concat(F.lit(": Season "), n, F.lit(": Part "), m), F.concat(F.lit(": Season "), n), F.concat(F.lit(": 시즌 "), n), F.concat(F.lit(": Season "), n, F.lit(": The Long Way")), F.concat(F.lit(": S"), n, F.lit(": Oslo")),
        F.concat(F.lit(": Series "), n), F.concat(F.lit(": "), pick(T.SEASON_WORDS, F.col("p_size") % 13), F.lit(" "), n), F.concat(F.lit(": The "), pick(T.ORDINALS, F.col("p_size") % 20), F.lit(" Year")),
        F.concat(F.lit(": Part "), n), F.concat(F.lit(" Part "), n), F.concat(F.lit(": Volume "), n), F.concat(F.lit(": Chapter "), n), F.concat(F.lit(": Collection "), n), F.lit(": Limited Series"), F.lit(": Miniserie"),
        F.concat(F.lit(": June "), n, F.lit(", 2020")), F.concat(F.lit(": "), roman), F.concat(F.lit(" "), roman), F.concat(F.lit(" "), n), F.lit(" (2011)"),
    ]
    title = F.concat(name, F.element_at(F.array(*ends), (shape + 1).cast("int")))
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("part"), T.parse(title).alias("p"))
    return p.select("part", "p.base", "p.season_kind", "p.season_number", "p.part_number", "p.episode_date", "p.bare_number", F.col("p.year").alias("title_year"))


@query("norm_function", SQL + " SELECT part, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key FROM titles")
def norm_function(spark, d):
    """The normaliser as a SQL function."""
    T.register(spark)
    A.titles(spark, d).createOrReplaceTempView("lanternfish_titles")
    return spark.sql("SELECT part, lanternfish_norm(title) AS key FROM lanternfish_titles")
