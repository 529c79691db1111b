"""Raw sources to the star schema: one lazy plan per table, written as Parquet.

dim_title, dim_period, fact_engagement_halfyear, fact_top10_weekly, fact_pageviews, with
the columns below. Unmatched titles keep an id and their facts; nothing is dropped but
catch-all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.functions import titles as T
from lanternfish.operators import catalogue as C
from lanternfish.operators import ladder as L
from lanternfish.sources.exports import check_keys, write_table
from lanternfish.sources.files import charting_title

# --- fixed values -----------------------------------------------------------------------
TV_TYPES = ("tvSeries", "tvMiniSeries")
FILM_TYPES = ("movie", "tvMovie", "video", "tvSpecial", "tvShort", "short")
DIM_TITLE = ["title_id", "kind", "name_key", "canonical_title", "published_year", "catalogue_id", "catalogue_type", "catalogue_start_year", "genres", "rating", "votes", "max_season", "rejected_candidate", "match_rung", "match_tie_break", "match_score", "matched", "seasons_reported", "seasons_present", "article"]
FACT_ENGAGEMENT = ["title_id", "period", "published_title", "season_kind", "season_number", "part_number", "available_globally", "release_date", "hours_viewed", "views", "runtime_hours", "runtime_withheld", "runtime_starred", "source_row"]
FACT_TOP10 = ["title_id", "title_match_scope", "week", "category", "kind", "language", "weekly_rank", "charting_title", "season_number", "weekly_hours_viewed", "weekly_views", "runtime", "cumulative_weeks_in_top_10"]
FACT_PAGEVIEWS = ["title_id", "article", "date", "views"]
# -----------------------------------------------------------------------------------------


def catalogue_titles(basics: DataFrame) -> DataFrame:
    """The titles that can be meant, by type; the filter comes before names and aliases join."""
    kept = basics.where(F.col("titleType").isin(*TV_TYPES, *FILM_TYPES))
    return kept.select("tconst", F.col("titleType").alias("type"), F.col("startYear").alias("start_year"), F.col("titleType").isin(*TV_TYPES).alias("is_series"), F.col("primaryTitle").alias("primary_title"), F.col("originalTitle").alias("original_title"), "genres")


def report_rows(engagement: DataFrame) -> DataFrame:
    """Rows that are titles, with the order in which they were published."""
    n = F.element_at(F.split("source_row", "!"), -1).cast("int")
    return engagement.where(~F.col("is_catch_all")).withColumn("row_no", F.struct("period_start", "kind", n.alias("n"))).withColumn("hours", F.col("hours_viewed"))


def row_ids(rows: DataFrame) -> DataFrame:
    """rows with the title they belong to, and their parse."""
    k = C.row_keys(rows)
    return k.withColumn("title_id", T.title_id(F.col("kind"), F.col("key"), F.col("year")))


def dim_title(rows: DataFrame, titles: DataFrame, akas: DataFrame, ratings: DataFrame, episodes: DataFrame, articles: DataFrame, threshold: float) -> DataFrame:
    ents = C.entities(rows)
    names = C.name_index(titles.drop("genres"), akas.select(F.col("titleId").alias("tconst"), "title"))
    votes = ratings.select("tconst", F.col("averageRating").alias("rating"), F.col("numVotes").alias("votes"))
    m = C.resolve(ents, names, votes.select("tconst", "votes"), threshold)
    m = C.validate_seasons(m.drop("votes", "type", "start_year"), episodes.select(F.col("parentTconst").alias("parent"), F.col("seasonNumber").alias("season")))
    # attributes come for matched ids only: a rejected candidate's would pass for the title's own
    m = m.join(titles.select("tconst", "type", "start_year", "genres"), "tconst", "left").join(votes, "tconst", "left")
    m = m.join(ents.select("title_id", F.col("example_title").alias("canonical_title")), "title_id").join(articles.groupBy("title_id").agg(F.min("article").alias("article")), "title_id", "left")
    return m.select(
        "title_id", "kind", F.col("key").alias("name_key"), "canonical_title", F.col("year").alias("published_year"), F.col("tconst").alias("catalogue_id"), F.col("type").alias("catalogue_type"), F.col("start_year").alias("catalogue_start_year"),
        "genres", "rating", "votes", "max_season", "rejected_candidate", F.col("rung").alias("match_rung"), F.col("tie_break").alias("match_tie_break"), F.col("score").alias("match_score"), "matched", F.to_json("seasons").alias("seasons_reported"), "seasons_present", "article")


def chart_lookup(rows: DataFrame, chart: DataFrame, threshold: float) -> DataFrame:
    """(period, kind, charting_title, title_id) of chart names that the ladder matches in their half-year."""
    block = ["period", "kind"]
    left = chart.where("period is not null").select(*block, "charting_title").distinct().withColumn("id", F.struct(*block, "charting_title"))
    ids = rows.select("row_no", "period", "kind", "title", "title_id")
    got = L.match(L.candidates(left, "id", "charting_title", block), L.candidates(ids, "row_no", "title", block), block, threshold).where("matched")
    return got.join(ids.select(F.col("row_no").alias("right_id"), "title_id"), "right_id").select("left_id.period", "left_id.kind", "left_id.charting_title", "title_id")


def fact_top10(rows: DataFrame, chart: DataFrame, period: DataFrame, threshold: float) -> DataFrame:
    """Chart slots with their title: by the week's own half-year, else by name in the earliest that matched."""
    inside = F.col("week").between(F.col("period_start"), F.col("period_end"))
    c = charting_title(chart).join(F.broadcast(period.select("period", "period_start", "period_end")), inside, "left")
    own = chart_lookup(rows, c, threshold)
    ever = own.groupBy("kind", "charting_title").agg(F.min_by("title_id", "period").alias("any_id"))
    c = c.join(own, ["period", "kind", "charting_title"], "left").join(ever, ["kind", "charting_title"], "left")
    scope = F.when(F.col("title_id").isNotNull(), F.lit("period")).when(F.col("any_id").isNotNull(), F.lit("name_only"))
    p = T.parse(F.col("charting_title"))
    return c.select(F.coalesce("title_id", "any_id").alias("title_id"), scope.alias("title_match_scope"), *FACT_TOP10[2:8], p["season_number"].alias("season_number"), *FACT_TOP10[9:])


def fact_pageviews(articles: DataFrame, pageviews: DataFrame, dim: DataFrame) -> DataFrame:
    """Daily views of titles that have an article; of several with one article the last in map order has it."""
    owner = articles.groupBy("article").agg(F.max_by("title_id", "ord").alias("title_id"))
    return pageviews.join(owner, "article").join(dim.select("title_id"), "title_id", "left_semi").select(*FACT_PAGEVIEWS)


def build(engagement: DataFrame, chart: DataFrame, basics: DataFrame, akas: DataFrame, ratings: DataFrame, episodes: DataFrame, articles: DataFrame, pageviews: DataFrame, threshold: float = L.THRESHOLD) -> dict[str, DataFrame]:
    """The five tables. articles is (ord, title_id, article); the rest is as the sources read it."""
    rows = report_rows(engagement)
    keyed = row_ids(rows)
    period = engagement.select("period", "period_start", "period_end").distinct()
    dim = dim_title(rows, catalogue_titles(basics), akas, ratings, episodes, articles, threshold)
    fact = keyed.select("title_id", "period", F.col("title").alias("published_title"), "p.season_kind", "p.season_number", "p.part_number", *FACT_ENGAGEMENT[6:])
    return {"dim_title": dim, "dim_period": period, "fact_engagement_halfyear": fact, "fact_top10_weekly": fact_top10(keyed, chart, period, threshold), "fact_pageviews": fact_pageviews(articles, pageviews, dim)}


PARTITIONS = {"fact_engagement_halfyear": "period"}
COLUMNS = {"dim_title": DIM_TITLE, "fact_engagement_halfyear": FACT_ENGAGEMENT, "fact_top10_weekly": FACT_TOP10, "fact_pageviews": FACT_PAGEVIEWS}


def write(tables: dict[str, DataFrame], path: str) -> None:
    """Write the tables below path, dimensions first; half-years are partitions of their facts."""
    for name, df in tables.items():
        write_table(df, f"{path}/{name}", COLUMNS.get(name), PARTITIONS.get(name))
    spark = next(iter(tables.values())).sparkSession
    check_keys(spark.read.parquet(f"{path}/dim_title"), "title_id")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("dim_title", "dim_period", *list(COLUMNS)[1:])}
