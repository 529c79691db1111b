import datetime as dt

import pytest
from pyspark.sql import functions as F

from lanternfish.operators import ladder as L
from lanternfish.plans import model
from lanternfish.sources import files

D = dt.date


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    def rows(period, start, end, *titles):
        return [(period, start, end, k, t, True, r, h, 1.5, False, False, h // 10, t == "Other Shows", f"{'Shows' if k == 'tv' else 'Movies'}!{7 + i}") for i, (k, t, r, h) in enumerate(titles)]

    e = rows("2023H2", D(2023, 7, 1), D(2023, 12, 31), ("tv", "Suits (2011): Season 1", None, 900), ("tv", "Other Shows", None, 5), ("film", "Extraction 2", D(2023, 6, 16), 700))
    e += rows("2024H1", D(2024, 1, 1), D(2024, 6, 30), ("tv", "Suits (2011): Season 1", None, 400), ("tv", "Suits (2011): Season 2", None, 300), ("tv", "Nowhere Show: Season 1", None, 30), ("film", "Extraction 2", D(2023, 6, 16), 100))
    engagement = spark.createDataFrame(e, "period string, period_start date, period_end date, kind string, title string, available_globally boolean, release_date date, hours_viewed long, runtime_hours double, runtime_withheld boolean, runtime_starred boolean, views long, is_catch_all boolean, source_row string")
    chart = spark.createDataFrame(
        [(w, "TV (English)", k, s, se, 50, None, None, 1, "tv", "english") for w, k, s, se in [(D(2023, 8, 6), 1, "Suits", "Suits: Season 1"), (D(2022, 8, 7), 1, "Suits", "Suits (2011): Season 1"), (D(2023, 8, 6), 2, "Suits", "Suits (2011): Season 1"), (D(2024, 2, 4), 1, "Ghost", None)]],
        "week date, category string, weekly_rank int, show_title string, season_title string, weekly_hours_viewed long, runtime double, weekly_views long, cumulative_weeks_in_top_10 int, kind string, language string")
    typed = lambda name: ", ".join(f"{c} {t}" for c, t in files.CATALOGUE[name].items())
    basics = spark.createDataFrame([("t1", "tvSeries", "Suits", "Suits", False, 2011, None, 44, "Drama"), ("t2", "tvEpisode", "Extraction 2", "x", False, 2023, None, 1, None), ("t3", "movie", "Extraction II", "Extraction 2", False, 2023, None, 120, "Action")], typed("title.basics"))
    akas = spark.createDataFrame([("t1", 1, "La ley", "ES", None, None, None, False)], typed("title.akas"))
    ratings = spark.createDataFrame([("t1", 8.4, 1000), ("t3", 7.0, 500)], typed("title.ratings"))
    episodes = spark.createDataFrame([("e1", "t1", 9, 1)], typed("title.episode"))
    suits = "t_" + __import__("hashlib").sha1(b"tv|suits|2011").hexdigest()[:12]
    articles = spark.createDataFrame([(0, "t_other", "Suits_(TV)"), (1, suits, "Suits_(TV)")], "ord int, title_id string, article string")
    views = spark.createDataFrame([("Suits_(TV)", D(2023, 8, 1), 10), ("Else", D(2023, 8, 1), 3)], "article string, date date, views long")
    path = str(tmp_path_factory.mktemp("model"))
    built = model.build(engagement, chart, basics, akas, ratings, episodes, articles, views)
    model.write(built, path)
    return model.read(spark, path) | {"engagement": engagement}


def test_conservation(tables):
    kept = tables["engagement"].where("not is_catch_all")
    fact = tables["fact_engagement_halfyear"]
    assert fact.count() == kept.count() and fact.agg(F.sum("hours_viewed")).first() == kept.agg(F.sum("hours_viewed")).first()
    assert fact.join(tables["dim_title"], "title_id", "left_anti").count() == 0
    assert tables["dim_title"].columns == model.DIM_TITLE and tables["dim_period"].count() == 2


def test_titles(tables):
    d = {r.name_key: r for r in tables["dim_title"].collect()}
    s = d["suits"]
    assert (s.catalogue_id, s.match_rung, s.votes, s.rating, s.seasons_reported, s.max_season, s.seasons_present, s.article) == ("t1", "name", 1000, 8.4, "[1,2]", 9, True, "Suits_(TV)")
    assert (d["extraction 2"].catalogue_id, d["extraction 2"].genres) == ("t3", "Action")
    assert not d["nowhere show"].matched and d["nowhere show"].catalogue_id is None
    assert d["suits"].canonical_title == "Suits (2011): Season 1"


def test_chart_scopes(tables):
    rows = {(r.week, r.weekly_rank): r for r in tables["fact_top10_weekly"].collect()}
    assert len(rows) == 4
    suits = rows[D(2023, 8, 6), 2]
    assert suits.title_match_scope == "period" and rows[D(2023, 8, 6), 1].title_id == suits.title_id
    early = rows[D(2022, 8, 7), 1]
    assert early.title_match_scope == "name_only" and early.title_id == suits.title_id
    assert rows[D(2024, 2, 4), 1].title_id is None and rows[D(2024, 2, 4), 1].title_match_scope is None


def test_pageviews_go_to_the_last_title(tables):
    (r,) = tables["fact_pageviews"].collect()
    assert r.views == 10 and r.title_id == tables["dim_title"].where("name_key = 'suits'").first().title_id


def test_pick_nearest(spark):
    df = spark.createDataFrame([("a", "Monster: Ed", "Monster:_The_Ed_Story"), ("a", "Monster: Ed", "Monster_(series)"), ("b", "X", "Y")], "k string, t string, article string")
    from lanternfish.functions.titles import normalise

    got = {r.k: r.article for r in L.pick_nearest(df, ["k"], normalise(F.col("t")), F.col("article")).collect()}
    assert got == {"a": "Monster:_The_Ed_Story", "b": "Y"}


def test_naive_match(spark):
    chart = spark.createDataFrame([("A",), ("B",), ("B",)], "charting_title string")
    r = files.naive_match(chart, spark.createDataFrame([("B",)], "title string")).first()
    assert (r.names, r.matched, r.share) == (2, 1, 0.5)


def test_reports(tables):
    from lanternfish.plans import report

    text = report.render("Match quality", report.match_summary(tables["dim_title"], tables["fact_engagement_halfyear"]))
    assert "## Rungs" in text and "| name |" in text and "| tv |" in text
    parts = report.findings(tables, replicates=5)
    assert "## Best lag" in report.render("Findings", {"Best lag": parts["Best lag"]})
