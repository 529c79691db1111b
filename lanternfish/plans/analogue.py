"""The engagement model's tables, defined on the supplied order tables.

A part is a published title, a line item is viewing, an order is outside interest:

* dim_period: half-years from 1995H1 to 2001H2
* titles: parts with a title string in one of eight published shapes
* dim_title: one row per (kind, name key, year), under a hashed title_id
* fact_engagement: hours (cents) and views (units) of a title by half-year
* fact_top10: the ten largest parts of each week and category
* fact_pageviews: orders of a title by day

`SQL` holds the same definitions as common table expressions for DuckDB.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternfish.functions import titles as T

from .store import kept

PERIODS = [(f"{y}H{h}", dt.date(y, 1 + 6 * (h - 1), 1), dt.date(y, 6, 30) if h == 1 else dt.date(y, 12, 31)) for y in range(1995, 2002) for h in (1, 2)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dim_period(spark: SparkSession) -> DataFrame:
    """One row per half-year; small by definition, so joins with it broadcast it."""
    return spark.createDataFrame(PERIODS, "period string, period_start date, period_end date")


def period_of(day: Column) -> Column:
    """The half-year of a day, computed: fact rows need no range join for it."""
    return F.concat(F.year(day).cast("string"), F.when(F.month(day) <= 6, F.lit("H1")).otherwise(F.lit("H2")))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, kind, title, release_date, p_name, p_size, p_retailprice): the published titles."""
    n = (F.col("p_size") % 9 + 1).cast("string")
    shape = F.col("p_partkey") % 8
    name = F.col("p_name")
    word = F.split(name, " ")
    title = (
        F.when(shape == 0, F.concat(name, F.lit(": Season "), n))
        .when(shape == 1, F.concat(name, F.lit(" ("), (1990 + F.col("p_size") % 20).cast("string"), F.lit("): Season "), n))
        .when(shape == 2, F.concat(name, F.lit(": Limited Series")))
        .when(shape == 3, F.concat(name, F.lit(": Part "), n))
        .when(shape == 4, F.concat(name, F.lit(": Season "), n, F.lit(": Part "), (F.col("p_size") % 3 + 1).cast("string")))
        .when(shape == 5, F.concat(name, F.lit(" "), n))
        .when(shape == 6, F.concat(name, F.lit(" // "), word[1], F.lit(" "), word[0]))
        .otherwise(name)
    )
    kind = F.when(F.col("p_partkey") % 3 == 0, F.lit("film")).otherwise(F.lit("tv"))
    release = F.when(F.col("p_partkey") % 3 != 1, F.date_add(F.lit(dt.date(1994, 1, 1)), (F.col("p_partkey") % 1500).cast("int")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), kind.alias("kind"), title.alias("title"), release.alias("release_date"), "p_name", "p_size", "p_retailprice", "p_brand")


def keyed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """titles with parsed p, name_key, year and title_id; parsed once a session, in as many tasks as there are cores."""
    return kept(spark, sf_dir, "keyed_titles", lambda: _keyed(titles(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)))


def _keyed(t: DataFrame) -> DataFrame:
    t = t.withColumn("p", T.parse(F.col("title")))
    key = F.when(F.col("kind") == "film", T.normalise(T.without_year(F.col("p.primary")))).otherwise(T.normalise(F.col("p.base")))
    t = t.withColumn("name_key", key).withColumn("year", F.coalesce("p.year", F.year("release_date")))
    return t.withColumn("title_id", T.title_id(F.col("kind"), F.col("name_key"), F.col("year")))


def dim_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical title: that of the smallest part. Matched titles have rating and votes."""
    t = keyed_titles(spark, sf_dir)
    g = t.groupBy("title_id", "kind", "name_key", "year").agg(F.min_by("title", "part").alias("canonical_title"), F.min("part").alias("part"), F.max("p.season_number").alias("max_season"), F.min_by("p_name", "part").alias("p_name"), F.min_by("p_size", "part").alias("p_size"))
    matched = F.col("part") % 10 != 9
    return g.select(
        "title_id", "kind", "name_key", "year", "canonical_title", "part", "max_season", matched.alias("matched"),
        F.when(matched, F.concat(F.lit("tt"), F.lpad(F.col("part").cast("string"), 7, "0"))).alias("tconst"),
        F.when(matched, F.replace("p_name", F.lit(" "), F.lit(","))).alias("genres"),
        F.when(matched, (F.col("p_size") * 7 % 90 + 10) / F.lit(10.0)).alias("rating"),
        F.when(matched, F.col("part") * 37 % 5000 + 20).alias("votes"),
        F.when(matched & (F.col("part") % 4 != 0), (1980 + F.col("part") % 21).cast("int")).alias("start_year"),
    )


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def viewing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, day, hours, views) of line items; days are dates."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("part"), F.to_date("l_shipdate").alias("day"), _cents("l_extendedprice").alias("hours"), F.col("l_quantity").cast("long").alias("views"))


def fact_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part and half-year. Lines are summed by part before titles join."""
    per = viewing(spark, sf_dir).groupBy("part", period_of(F.col("day")).alias("period")).agg(F.sum("hours").alias("hours_viewed"), F.sum("views").alias("views"))
    t = keyed_titles(spark, sf_dir).select("part", "title_id", F.col("title").alias("published_title"), "release_date", (F.col("part") % 2 == 0).alias("available_globally"), (F.col("p_size") / 10.0).alias("runtime_hours"))
    return per.join(t, "part").select("title_id", "part", "period", "published_title", "release_date", "hours_viewed", "views", "available_globally", "runtime_hours")


def week_ending(day: Column) -> Column:
    """The Sunday that ends the day's week."""
    return F.date_add(F.to_date(F.date_trunc("WEEK", day)), 6)


CATEGORIES = ("TV (English)", "TV (Non-English)", "Films (English)", "Films (Non-English)")


def fact_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten ranks a week and category; parts divisible by 11 have no title, as unmatched names."""
    w = viewing(spark, sf_dir).groupBy("part", week_ending(F.col("day")).alias("week")).agg(F.sum("hours").alias("weekly_hours"), F.sum("views").alias("weekly_views"))
    w = w.withColumn("category", F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("part") % 4 + 1).cast("int")))
    rank = F.row_number().over(Window.partitionBy("week", "category").orderBy(F.desc("weekly_hours"), "part"))
    w = w.withColumn("weekly_rank", rank).where("weekly_rank <= 10")
    t = keyed_titles(spark, sf_dir).select("part", F.when(F.col("part") % 11 != 0, F.col("title_id")).alias("title_id"), F.col("title").alias("charting_title"))
    return w.join(t, "part").select("title_id", "week", "category", "weekly_rank", "charting_title", "weekly_hours", "weekly_views", "part")


def fact_pageviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(title_id, date, views): orders per title and day."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("date"))
    per = li.join(o, "l_orderkey").groupBy("part", "date").agg(F.count("*").alias("views"))
    t = keyed_titles(spark, sf_dir).select("part", "title_id")
    return per.join(t, "part").groupBy("title_id", "date").agg(F.sum("views").alias("views"))


_VALUES = ", ".join(f"('{p}', DATE '{a}', DATE '{b}')" for p, a, b in PERIODS)
_NAMES = ", ".join(f"'{c}'" for c in CATEGORIES)

SQL = rf"""
WITH dim_period AS (SELECT * FROM (VALUES {_VALUES}) AS v(period, period_start, period_end)),
titles AS (
  SELECT p_partkey AS part, CASE WHEN p_partkey % 3 = 0 THEN 'film' ELSE 'tv' END AS kind, p_name, p_size, p_brand, p_retailprice,
    CASE p_partkey % 8
      WHEN 0 THEN p_name || ': Season ' || (p_size % 9 + 1)
      WHEN 1 THEN p_name || ' (' || (1990 + p_size % 20) || '): Season ' || (p_size % 9 + 1)
      WHEN 2 THEN p_name || ': Limited Series'
      WHEN 3 THEN p_name || ': Part ' || (p_size % 9 + 1)
      WHEN 4 THEN p_name || ': Season ' || (p_size % 9 + 1) || ': Part ' || (p_size % 3 + 1)
      WHEN 5 THEN p_name || ' ' || (p_size % 9 + 1)
      WHEN 6 THEN p_name || ' // ' || split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
      ELSE p_name END AS title,
    CASE WHEN p_partkey % 3 <> 1 THEN DATE '1994-01-01' + CAST(p_partkey % 1500 AS INTEGER) END AS release_date
  FROM part),
named AS (
  SELECT *, split_part(title, ' // ', 1) AS primary_name,
    regexp_extract(title, '\(((?:19|20)\d\d)\)', 1) AS year_text,
    regexp_replace(regexp_replace(split_part(title, ' // ', 1), '(: Season \d+: Part \d+|: Season \d+|: Limited Series|: Part \d+| \d+)$', ''), '\s*\((?:19|20)\d\d\)', '') AS base
  FROM titles),
keyed AS (
  SELECT *, trim(regexp_replace(lower(CASE WHEN kind = 'film' THEN regexp_replace(primary_name, '\s*\((?:19|20)\d\d\)', '') ELSE base END), '[^a-z0-9]+', ' ', 'g')) AS name_key,
    coalesce(CASE WHEN year_text <> '' THEN CAST(year_text AS INTEGER) END, CAST(year(release_date) AS INTEGER)) AS year
  FROM named),
keyed_titles AS (
  SELECT *, 't_' || substr(sha1(kind || '|' || name_key || '|' || coalesce(CAST(year AS VARCHAR), '')), 1, 12) AS title_id,
    CASE WHEN part % 8 IN (0, 1, 3, 4, 5) THEN p_size % 9 + 1 END AS season_number
  FROM keyed),
first_title AS (
  SELECT title_id, kind, name_key, year, arg_min(title, part) AS canonical_title, min(part) AS part, max(season_number) AS max_season, arg_min(p_name, part) AS p_name, arg_min(p_size, part) AS p_size
  FROM keyed_titles GROUP BY ALL),
dim_title AS (
  SELECT title_id, kind, name_key, year, canonical_title, part, max_season, part % 10 <> 9 AS matched,
    CASE WHEN part % 10 <> 9 THEN 'tt' || lpad(CAST(part AS VARCHAR), 7, '0') END AS tconst,
    CASE WHEN part % 10 <> 9 THEN replace(p_name, ' ', ',') END AS genres,
    CASE WHEN part % 10 <> 9 THEN (p_size * 7 % 90 + 10) / 10.0 END AS rating,
    CASE WHEN part % 10 <> 9 THEN part * 37 % 5000 + 20 END AS votes,
    CASE WHEN part % 10 <> 9 AND part % 4 <> 0 THEN CAST(1980 + part % 21 AS INTEGER) END AS start_year
  FROM first_title),
viewing AS (
  SELECT l_partkey AS part, CAST(l_shipdate AS DATE) AS day, CAST(round(l_extendedprice * 100) AS BIGINT) AS hours, CAST(l_quantity AS BIGINT) AS views FROM lineitem),
fact_engagement AS (
  SELECT t.title_id, v.part, v.period, t.title AS published_title, t.release_date, v.hours_viewed, v.views, t.part % 2 = 0 AS available_globally, t.p_size / 10.0 AS runtime_hours
  FROM (SELECT part, period, CAST(sum(hours) AS BIGINT) AS hours_viewed, CAST(sum(views) AS BIGINT) AS views
        FROM viewing JOIN dim_period ON day BETWEEN period_start AND period_end GROUP BY ALL) v
  JOIN keyed_titles t USING (part)),
weekly AS (
  SELECT part, CAST(date_trunc('week', day) + INTERVAL 6 DAY AS DATE) AS week, CAST(sum(hours) AS BIGINT) AS weekly_hours, CAST(sum(views) AS BIGINT) AS weekly_views,
    ([{_NAMES}])[part % 4 + 1] AS category
  FROM viewing GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY week, category ORDER BY weekly_hours DESC, part) AS weekly_rank FROM weekly),
fact_top10 AS (
  SELECT CASE WHEN r.part % 11 <> 0 THEN t.title_id END AS title_id, week, category, CAST(weekly_rank AS INTEGER) AS weekly_rank, t.title AS charting_title, weekly_hours, weekly_views, r.part
  FROM ranked r JOIN keyed_titles t USING (part) WHERE weekly_rank <= 10),
fact_pageviews AS (
  SELECT title_id, CAST(o_orderdate AS DATE) AS date, count(*) AS views
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN keyed_titles ON l_partkey = part
  GROUP BY ALL)
"""
