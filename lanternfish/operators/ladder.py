"""Match ladder inside blocks: exact, alternate, year, season-equivalent, then fuzzy.

Every rung is an equi-join of what no rung above it settled; a row of the left side comes
out once, matched or not. Where several right rows would do, the one that comes first
(smallest right id) is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.functions import titles as T
from lanternfish.functions.similarity import token_sort_ratio

#: Chosen on a small labelled sample; see the label fixture in the tests.
THRESHOLD = 87.0
STAGES = ("exact", "alternate", "year", "season_equiv", "fuzzy")
#: Three ways to write a first and only season.
FIRST_SEASON = ("|||", "season|1||", "limited|||")


def candidates(df: DataFrame, row_id: str, title: str, block: list[str]) -> DataFrame:
    """(id, raw, block columns, key, keys, season, year) of one side."""
    p = df.select(F.col(row_id).alias("id"), F.col(title).alias("raw"), *block).withColumn("p", T.parse(F.col("raw")))
    return p.select("id", "raw", *block, T.normalise(F.col("p.base")).alias("key"), T.alternate_keys(F.col("p")).alias("keys"), T.season_key(F.col("p")).alias("season"), F.col("p.year").alias("year"))


def _counted(rows: DataFrame, by: list[str]) -> DataFrame:
    """Right rows of each combination of `by`: their number and the smallest id."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("right_id").alias("right_id"))


def _nearest(rest: DataFrame, right: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """(id, stage, right_id, score, candidates, runner_up) by similarity: each pair of distinct names is scored once."""
    theirs = _counted(right.select(*block, "season", F.col("key").alias("r_key"), F.col("id").alias("right_id")), [*block, "season", "r_key"])
    names = rest.select(*block, "season", "key").distinct()
    mine = Window.partitionBy(*block, "season", "key")
    order = mine.orderBy(F.desc("score"), "right_id")
    near = names.join(theirs, [*block, "season"]).withColumn("score", token_sort_ratio(F.col("key"), F.col("r_key")))
    # a name that several rows have is its own runner-up
    second = F.when(F.col("n") > 1, F.col("score")).otherwise(F.lead("score").over(order))
    near = near.withColumn("r", F.row_number().over(order)).withColumn("candidates", F.sum("n").over(mine)).withColumn("runner_up", second).where("r = 1")
    near = near.select(*block, "season", F.col("key").alias("n_key"), "right_id", "score", "candidates", "runner_up")
    back = [rest[c] == near[c] for c in [*block, "season"]] + [rest["key"].eqNullSafe(near["n_key"])]
    got = rest.join(near, back).select("id", "right_id", "score", "candidates", "runner_up")
    # left rows that share an id are one
    best = F.min(F.struct((-F.col("score")).isNull().alias("no"), (-F.col("score")).alias("less"), "right_id")).alias("best")
    scores = F.sort_array(F.flatten(F.collect_list(F.array("score", "runner_up"))), asc=False)
    got = got.groupBy("id").agg(best, F.sum("candidates").alias("candidates"), F.get(scores, F.lit(1)).alias("runner_up"))
    score = -F.col("best.less")
    return got.select("id", F.when(score >= threshold, F.lit("fuzzy")).otherwise(F.lit("near_miss")).alias("stage"), "best.right_id", score.alias("score"), "candidates", "runner_up")


def match(left: DataFrame, right: DataFrame, block: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(left_id, stage, matched, right_id, score, candidates, runner_up) for each left row of candidates().

    Right rows are counted by what a rung compares before anything joins, so a name that
    many rows of both sides share costs no pairs. No rung's ids are a side of an anti join.
    """
    # a row's own key at -1, then all its keys
    places = F.concat(F.array(F.struct(F.lit(-1).alias("pos"), "key")), F.transform("keys", lambda k, i: F.struct(i.alias("pos"), k.alias("key"))))
    seats = lambda df, *cols: df.select(*block, *cols, F.inline(places)).withColumn("own", F.col("pos") < 0)
    asks = seats(left, "id", "season", "year")
    same = [*block, "key", "own"]
    dated = _counted(seats(right, F.col("id").alias("right_id"), "season", F.col("year").alias("r_year")), [*same, "season", "r_year"])
    years = F.map_from_entries(F.filter(F.collect_list(F.struct("r_year", F.struct("n", "right_id"))), lambda x: x.r_year.isNotNull()))
    told = dated.groupBy(*same, "season").agg(F.sum("n").alias("n"), F.min("right_id").alias("right_id"), years.alias("years"))
    hits = asks.join(told, [*same, "season"]).withColumn("y", F.col("years")[F.col("year")])
    hits = hits.select("id", "pos", "n", "right_id", F.col("y.n").alias("dated"), F.col("y.right_id").alias("dated_id"))
    hits = hits.groupBy("id", "pos").agg(F.sum("n").alias("n"), F.min("right_id").alias("right_id"), F.sum("dated").alias("dated"), F.min("dated_id").alias("dated_id"))
    by_year = (F.col("n") > 1) & (F.coalesce("dated", F.lit(0)) > 0)
    stage = F.when(by_year, F.lit("year")).when(F.col("pos") < 0, F.lit("exact")).otherwise(F.lit("alternate"))
    hits = hits.select("id", F.lit(0).alias("rung"), "pos", stage.alias("stage"), F.when(by_year, F.col("dated_id")).otherwise(F.col("right_id")).alias("right_id"), F.when(by_year, F.col("dated")).otherwise(F.col("n")).alias("candidates"))
    # a first season under another name, only where exactly one row could be meant
    first = F.col("season").isin(*FIRST_SEASON) & ~F.col("own")
    pool = asks.where(first).join(told.where(first).groupBy(*same).agg(F.sum("n").alias("n"), F.min("right_id").alias("right_id")), same).groupBy("id", "pos").agg(F.sum("n").alias("candidates"), F.min("right_id").alias("right_id")).where("candidates = 1")
    hits = hits.union(pool.select("id", F.lit(1).alias("rung"), "pos", F.lit("season_equiv").alias("stage"), "right_id", "candidates"))
    # the first rung, and on it the first key, that found something
    hits = hits.groupBy("id").agg(F.min(F.struct("rung", "pos", "stage", "right_id", "candidates")).alias("h"))
    hits = hits.select("id", "h.stage", "h.right_id", F.lit(100.0).alias("score"), "h.candidates", F.lit(None).cast("double").alias("runner_up"))
    rest = left.select(*block, "id", "season", "key").join(hits.select("id", "stage"), "id", "left").where("stage is null").drop("stage")
    out = left.select("id").join(hits.union(_nearest(rest, right, block, threshold)), "id", "left")
    stage = F.coalesce("stage", F.lit("unmatched"))
    return out.select(F.col("id").alias("left_id"), stage.alias("stage"), stage.isin(*STAGES).alias("matched"), "right_id", "score", F.coalesce("candidates", F.lit(0)).alias("candidates"), "runner_up")


def rate(matched: DataFrame) -> DataFrame:
    """Rows and share of each stage."""
    return matched.groupBy("stage").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def pick_nearest(df: DataFrame, group: list[str], target: Column, name: Column, score=token_sort_ratio) -> DataFrame:
    """Of each group the name nearest to target; the only one without a look at the score; ties to the first by name."""
    n = F.count("*").over(Window.partitionBy(*group))
    s = df.withColumn("_name", name).withColumn("_n", n).withColumn("_score", score(target, T.normalise(F.replace(name, F.lit("_"), F.lit(" ")))))
    order = Window.partitionBy(*group).orderBy(F.desc("_score"), "_name")
    return s.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_n", "_name")
