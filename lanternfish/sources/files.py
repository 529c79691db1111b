"""Text and JSON sources: weekly chart, catalogue dumps, article map, daily pageviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .contracts import ContractError, expect_columns, expect_rows

# --- fixed values -----------------------------------------------------------------------
CHART_COLUMNS = ["week", "category", "weekly_rank", "show_title", "season_title", "weekly_hours_viewed", "runtime", "weekly_views", "cumulative_weeks_in_top_10"]
CATALOGUE = {
    "title.basics": {"tconst": "string", "titleType": "string", "primaryTitle": "string", "originalTitle": "string", "isAdult": "boolean", "startYear": "int", "endYear": "int", "runtimeMinutes": "int", "genres": "string"},
    "title.ratings": {"tconst": "string", "averageRating": "double", "numVotes": "int"},
    "title.akas": {"titleId": "string", "ordering": "int", "title": "string", "region": "string", "language": "string", "types": "string", "attributes": "string", "isOriginalTitle": "boolean"},
    "title.episode": {"tconst": "string", "parentTconst": "string", "seasonNumber": "int", "episodeNumber": "int"},
}
# -----------------------------------------------------------------------------------------


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).head(1)
    if not first:
        raise ContractError(f"{path}: empty")
    return first[0].value.rstrip("\r").split("\t")


def _strings(columns: list[str]) -> str:
    return ", ".join(f"`{c}` string" for c in columns)


def read_chart(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """The weekly chart. N/A is null in three columns only: a show may be called NA.

    Adds kind and language. With check, every week and category must have ten rows.
    """
    expect_columns(_header(spark, path), CHART_COLUMNS, path)
    raw = spark.read.schema(_strings(CHART_COLUMNS)).csv(path, sep="\t", header=True, quote="", escape="", nullValue="\u0000", emptyValue="")
    missing = lambda c: F.when(~F.col(c).isin("N/A", ""), F.col(c))
    out = raw.select(
        F.col("week").cast("date").alias("week"), "category", F.col("weekly_rank").cast("int").alias("weekly_rank"), "show_title", missing("season_title").alias("season_title"),
        F.col("weekly_hours_viewed").cast("long").alias("weekly_hours_viewed"), missing("runtime").cast("double").alias("runtime"), missing("weekly_views").cast("long").alias("weekly_views"), F.col("cumulative_weeks_in_top_10").cast("int").alias("cumulative_weeks_in_top_10"),
        F.when(F.startswith(F.col("category"), F.lit("TV")), F.lit("tv")).otherwise(F.lit("film")).alias("kind"), F.when(F.contains(F.col("category"), F.lit("Non-English")), F.lit("non-english")).otherwise(F.lit("english")).alias("language"))
    if check:
        bad = out.groupBy("week", "category").count().where("count <> 10").head(3)
        if bad:
            raise ContractError(f"{path}: not ten rows in {[tuple(r) for r in bad]}")
    return out


def charting_title(df: DataFrame) -> DataFrame:
    return df.withColumn("charting_title", F.coalesce("season_title", "show_title"))


def read_dump(spark: SparkSession, path: str, name: str, partitions: int | None = None, check: bool = True) -> DataFrame:
    """A catalogue dump: tab-separated without quoting, \\N for null, typed by declaration.

    A gzipped file is one task to read whatever its size, so rows are dealt out after it.
    With check, the rows must be as many as the file's lines without the header.
    """
    kinds = CATALOGUE[name]
    expect_columns(_header(spark, path), list(kinds), path)
    raw = spark.read.schema(_strings(list(kinds))).csv(path, sep="\t", header=True, quote="", escape="", nullValue="\\N", emptyValue="")
    if partitions:
        raw = raw.repartition(partitions)
    out = raw.select(*[F.col(c).cast("int").cast("boolean").alias(c) if t == "boolean" else F.col(c).cast(t).alias(c) for c, t in kinds.items()])
    return expect_rows(out, spark.read.text(path).count() - 1, path) if check else out


_MAP = "imdb_ids array<string>, response struct<results: struct<bindings: array<struct<imdb: struct<value: string>, item: struct<value: string>, article: struct<value: string>>>>>"
_VIEWS = "article string, response struct<items: array<struct<granularity: string, agent: string, timestamp: string, views: bigint>>>"


def read_articles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(catalogue_id, item, article): ids without a binding stay as rows with nulls."""
    raw = spark.read.schema(_MAP).json(path, multiLine=True)
    asked = raw.select(F.explode("imdb_ids").alias("catalogue_id")).distinct()
    b = raw.select(F.explode("response.results.bindings").alias("b"))
    name = F.element_at(F.split(F.col("b.article.value"), "/wiki/"), -1)
    found = b.select(F.col("b.imdb.value").alias("catalogue_id"), F.substring_index("b.item.value", "/", -1).alias("item"), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("article")).distinct()
    return asked.join(found, "catalogue_id", "left")


def read_pageviews(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(article, date, views) of daily views by people; a file without items gives nothing."""
    items = spark.read.schema(_VIEWS).json(path, multiLine=True).select("article", F.explode("response.items").alias("i"))
    daily = (F.col("i.granularity") == "daily") & (F.col("i.agent") == "user")
    stamp = F.when(F.coalesce(daily, F.lit(False)), F.col("i.timestamp")).otherwise(F.raise_error(F.concat(F.lit("not daily views by people: "), F.col("article"))).cast("string"))
    return items.select("article", F.to_date(F.substring(stamp, 1, 8), "yyyyMMdd").alias("date"), F.col("i.views").alias("views"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def naive_match(chart: DataFrame, report: DataFrame) -> DataFrame:
    """(names, matched, share): chart names that a report has letter for letter, the floor to beat."""
    names = chart.select("charting_title").distinct()
    hit = names.join(report.select(F.col("title").alias("charting_title")).distinct(), "charting_title", "left_semi")
    return names.agg(F.count("*").alias("names")).crossJoin(hit.agg(F.count("*").alias("matched"))).withColumn("share", F.col("matched") / F.col("names"))


def encode_segment(c: Column) -> Column:
    """A name as one segment of an address: url_encode, with spaces as %20."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
