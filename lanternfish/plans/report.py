"""Reports rendered from small results: match quality, and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.operators import stats as S
from lanternfish.sources.exports import markdown

from . import views as V


def match_summary(dim: DataFrame, fact: DataFrame) -> dict[str, DataFrame]:
    """How titles were matched, by rung, tie-break and kind, and what share of hours that covers."""
    hours = fact.groupBy("title_id").agg(F.sum("hours_viewed").alias("hours"))
    d = dim.join(hours, "title_id", "left")
    every = Window.partitionBy()
    share = lambda c: F.round(F.col(c) / F.sum(c).over(every), 4)
    by_kind = d.groupBy("kind").agg(F.count("*").alias("titles"), F.count_if("matched").alias("matched"), F.round(F.avg(F.col("matched").cast("int")), 4).alias("rate"))
    covered = d.groupBy("matched").agg(F.count("*").alias("titles"), F.sum("hours").alias("hours")).withColumn("share_of_hours", share("hours"))
    rungs = d.groupBy(F.coalesce("match_rung", F.when(F.col("matched"), F.lit("fuzzy")).when(F.col("rejected_candidate").isNotNull(), F.lit("near_miss")).otherwise(F.lit("none"))).alias("rung")).agg(F.count("*").alias("n")).withColumn("share", share("n"))
    ties = d.where("match_rung is not null").groupBy("match_rung").pivot("match_tie_break", ["none", "year", "year_within_one", "votes"]).count().na.fill(0)
    bands = d.where("match_score < 100").groupBy((F.floor(F.col("match_score") / 5) * 5).alias("band")).agg(F.count("*").alias("n"), F.count_if("matched").alias("accepted"))
    seasons = d.where("seasons_present is not null").groupBy("seasons_present").count()
    return {"Titles by kind": by_kind, "Hours on matched titles": covered, "Rungs": rungs.orderBy(F.desc("n")), "Tie-breaks": ties.orderBy("match_rung"), "Scores of the fuzzy stage": bands.orderBy("band"), "Season check": seasons}


def findings(tables: dict[str, DataFrame], replicates: int = 2000) -> dict[str, DataFrame]:
    """The three questions: genre delivery, rating against longevity, lead or lag of outside interest."""
    dim, period, fact = tables["dim_title"], tables["dim_period"], tables["fact_engagement_halfyear"]
    top = tables["fact_top10_weekly"].withColumnRenamed("weekly_hours_viewed", "weekly_hours")
    inside = top.where("title_id is not null").join(F.broadcast(period.select("period_start", "period_end")), F.col("week").between(F.col("period_start"), F.col("period_end")))
    charted = inside.groupBy("title_id").agg(F.count("*").alias("slots"), F.count_distinct("week").alias("weeks_charted"), F.min("language").alias("language"))
    hours = fact.groupBy("title_id").agg(F.sum("hours_viewed").alias("hours"))
    genres = dim.where("genres is not null and genres <> ''").select("title_id", F.explode(F.split("genres", ",")).alias("genre")).join(hours, "title_id").join(charted.drop("language"), "title_id", "left").na.fill(0, ["slots", "weeks_charted"])
    delivery = S.delivery(genres, 25, 10).join(S.delivery_interval(genres, replicates), "genre", "left").orderBy(F.desc("delivery"))
    rated = dim.where("rating is not null").join(charted, "title_id").join(hours, "title_id")
    rated = rated.select("title_id", "weeks_charted", "rating", F.log10("hours").alias("log_hours"), F.log10(F.greatest(F.lit(1), F.col("votes"))).alias("log_votes"), (F.col("kind") == "tv").cast("int").alias("is_tv"), (F.col("language") == "non-english").cast("int").alias("non_english"))
    xs = ["rating", "log_hours", "log_votes", "is_tv", "non_english"]
    series = V.weekly_demand(top, tables["fact_pageviews"]).where("hours is not null and pageviews is not null").withColumnRenamed("title_id", "key")
    lags = S.best_lag(series).groupBy("lag").agg(F.count("*").alias("titles"), F.round(F.median("r"), 3).alias("median_r")).orderBy("lag")
    fit = S.ols(rated, "weeks_charted", xs).join(S.ols_interval(rated, "title_id", "weeks_charted", xs, replicates), "term")
    rank = S.spearman(rated, "rating", "weeks_charted")
    row = rank.first()
    rank = rank.withColumn("p", F.lit(S.spearman_p(row.rho, row.n) if row.rho is not None else None).cast("double"))
    return {"Delivery by genre": delivery, "Rating and longevity": rank, "Weeks charted, least squares": fit, "Best lag": lags, "Strongest in either direction": S.strongest(S.best_lag(series)), "Mismatched pairs": S.placebo_summary(series)}


def metric_options(earning: DataFrame) -> dict[str, DataFrame]:
    """The candidate metrics: what each can be computed for, its extremes, its ranking under its floor, and how far they agree."""
    big = earning.where("hours >= 1000000")
    top = lambda c, cond: big.where(cond).where(F.col(c).isNotNull()).orderBy(F.desc(c), "title_id").limit(10).select("canonical_title", "kind", c, "weeks_available", "available_from_source", "pageview_days")
    coverage = big.agg(F.count("*").alias("titles"), F.count("hours_per_week_available").alias("hours_per_week"), F.count("weeks_charted").alias("longevity"), F.count("hours_per_1k_pageviews").alias("per_1k_pageviews"))
    sources = big.groupBy("available_from_source").agg(F.count("*").alias("titles"), F.round(F.median("weeks_available")).alias("median_weeks"))
    large = big.where("hours >= 10000000").select("canonical_title", "hours", "weeks_available", "hours_per_week_available")
    agreement = big.agg(S.corr("hours_per_week_available", "weeks_charted").alias("rate_longevity"), S.corr("hours_per_week_available", "hours_per_1k_pageviews").alias("rate_demand"), S.corr("weeks_charted", "hours_per_1k_pageviews").alias("longevity_demand"))
    return {
        "Coverage": coverage, "Where the first week comes from": sources.orderBy("available_from_source"), "Old titles": large.where("weeks_available > 500").orderBy(F.desc("hours"), "canonical_title").limit(5),
        "Young titles": large.where("weeks_available <= 3").orderBy(F.desc("hours"), "canonical_title").limit(5), "Hours per week available, eight weeks at least": top("hours_per_week_available", "weeks_available >= 8"),
        "Weeks charted": top("weeks_charted", "true"), "Hours per thousand pageviews, sixty days at least": top("hours_per_1k_pageviews", "pageview_days >= 60"), "Agreement": agreement,
    }


def render(title: str, parts: dict[str, DataFrame]) -> str:
    return f"# {title}\n\n" + "\n".join(f"## {k}\n\n{markdown(df)}" for k, df in parts.items())
