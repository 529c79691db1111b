"""The model's metric views as functions of its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weeks_between(start: Column, end: Column) -> Column:
    """Whole weeks: days divided by seven, not Monday boundaries crossed."""
    return F.floor(F.datediff(end, start) / 7).cast("long")


def title_period(fact: DataFrame, dim: DataFrame, period: DataFrame) -> DataFrame:
    """Sums per title and half-year. Facts are summed before the dimensions join."""
    s = fact.groupBy("title_id", "period").agg(
        F.count("*").alias("seasons_reported_in_period"), F.sum("hours_viewed").alias("hours_viewed"), F.sum("views").alias("views"),
        F.min("release_date").alias("first_release_date"), F.bool_or("available_globally").alias("available_globally"))
    return s.join(dim.select("title_id", "canonical_title", "kind", "matched"), "title_id").join(F.broadcast(period), "period")


def longevity(top10: DataFrame) -> DataFrame:
    """How long each title charted, under all its names."""
    return top10.where("title_id is not null").groupBy("title_id").agg(
        F.array_join(F.array_sort(F.collect_set("charting_title")), " | ").alias("charting_titles"),
        F.count_distinct("week").alias("weeks_charted"), F.min("weekly_rank").alias("best_rank"), F.min("week").alias("first_week"), F.max("week").alias("last_week"),
        F.sum("weekly_hours").alias("top10_hours"), F.count_distinct("category").alias("categories"))


def weekly_demand(top10: DataFrame, pageviews: DataFrame) -> DataFrame:
    """On-platform hours beside outside interest, by week; a week ends on Sunday."""
    pv = pageviews.groupBy("title_id", F.date_add(F.to_date(F.date_trunc("WEEK", "date")), 6).alias("week")).agg(F.sum("views").alias("pageviews"))
    top = top10.where("title_id is not null").groupBy("title_id", "week").agg(F.sum("weekly_hours").alias("hours"), F.min("weekly_rank").alias("best_rank"))
    return top.join(pv, ["title_id", "week"], "full").select("title_id", "week", "hours", "best_rank", "pageviews")


def earning_its_place(fact: DataFrame, top10: DataFrame, pageviews: DataFrame, dim: DataFrame, period: DataFrame) -> DataFrame:
    """The headline metric, with its parts: hours per week that the title was available."""
    small = F.broadcast(period)
    e = fact.groupBy("title_id").agg(F.sum("hours_viewed").alias("hours"), F.sum("views").alias("views"), F.min("release_date").alias("release_date"), F.min("period").alias("first_period"), F.count_distinct("period").alias("periods_reported"))
    e = e.join(dim.select("title_id", "canonical_title", "kind", "genres", "rating", "votes", "start_year"), "title_id")
    e = e.join(small.select(F.col("period").alias("first_period"), "period_start"), "first_period", "left").crossJoin(F.broadcast(period.agg(F.max("period_end").alias("last_end"))))
    released = F.col("release_date").isNotNull()
    dated = F.col("start_year").isNotNull()
    e = e.withColumn("available_from", F.coalesce("release_date", F.when(dated, F.make_date("start_year", F.lit(1), F.lit(1))), "period_start"))
    e = e.withColumn("available_from_source", F.when(released, F.lit("release_date")).when(dated, F.lit("start_year")).otherwise(F.lit("first_period_reported")))
    e = e.withColumn("weeks_available", F.greatest(F.lit(1), weeks_between(F.col("available_from"), F.col("last_end"))))
    reported = fact.select("title_id", "period").distinct()
    # the period of a day is found through the few period rows first, so the large join is on equal keys
    daily = pageviews.join(small, F.col("date").between(F.col("period_start"), F.col("period_end"))).select("title_id", "period", "date", "views")
    demand = daily.join(reported, ["title_id", "period"]).groupBy("title_id").agg(F.sum("views").alias("pageviews"), F.count_distinct("date").alias("pageview_days"))
    charted = longevity(top10).select("title_id", "weeks_charted", "best_rank")
    out = e.join(charted, "title_id", "left").join(demand, "title_id", "left")
    return out.select(
        "title_id", "canonical_title", "kind", "genres", "rating", "votes", "hours", "views", "release_date", "available_from", "available_from_source", "weeks_available",
        (F.col("hours") / F.col("weeks_available")).alias("hours_per_week_available"), "weeks_charted", "best_rank", "pageviews", "pageview_days",
        F.when(F.col("pageviews") > 0, F.col("hours") / (F.col("pageviews") / F.lit(1000.0))).alias("hours_per_1k_pageviews"))


def headline(earning: DataFrame, least_weeks: int = 8) -> DataFrame:
    """Titles available for at least least_weeks, which is part of the definition."""
    return earning.where(F.col("weeks_available") >= least_weeks).select(
        "title_id", "canonical_title", "kind", "genres", "rating", "hours", "hours_per_week_available", "weeks_available", "available_from_source",
        F.coalesce("weeks_charted", F.lit(0)).alias("weeks_charted"), "best_rank", F.col("weeks_charted").isNotNull().alias("ever_charted"))


def charting_titles(top10: DataFrame, dim: DataFrame, period: DataFrame, least_weeks: int) -> DataFrame:
    """Matched titles with at least least_weeks in the chart inside the report periods."""
    inside = top10.where("title_id is not null").join(F.broadcast(period), F.col("week").between(F.col("period_start"), F.col("period_end")))
    g = inside.groupBy("title_id").agg(F.count_distinct("week").alias("weeks_charted"), F.sum("weekly_hours").alias("top10_hours")).where(F.col("weeks_charted") >= least_weeks)
    return g.join(dim.where("matched and tconst is not null").select("title_id", "tconst", "canonical_title"), "title_id")
