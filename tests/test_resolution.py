import datetime as dt

from lanternfish.operators import catalogue as C
from lanternfish.operators import ladder as L


def ladder(spark, left, right):
    side = lambda rows: L.candidates(spark.createDataFrame([(i, t, "p", "tv") for i, t in enumerate(rows)], "id int, t string, period string, kind string"), "id", "t", ["period", "kind"])
    return {r.left_id: r for r in L.match(side(left), side(right), ["period", "kind"]).collect()}


def test_ladder_rungs(spark):
    right = ["Lupin: Part 1", "Liebes Kind: Miniserie", "Suits (2011): Season 1", "Suits (2015): Season 1", "Adolescence: Limited Series", "The Broken Hearts Gallery", "Berlin: Season 2"]
    left = ["LUPIN: part 1", "Dear Child: Limited Series // Liebes Kind: Miniserie", "Suits (2015): Season 1", "Adolescence", "Broken Hearts Gallery", "Berlin: Season 1", "Nothing Like It: Season 9"]
    got = ladder(spark, left, right)
    assert [got[i].stage for i in range(7)] == ["exact", "alternate", "year", "season_equiv", "fuzzy", "near_miss" if got[5].right_id is not None else "unmatched", "unmatched"]
    assert [got[i].right_id for i in range(5)] == [0, 1, 3, 4, 5]
    assert got[2].candidates == 1 and not got[5].matched
    assert sum(r["n"] for r in L.rate(spark.createDataFrame(list(got.values()))).collect()) == 7


def test_season_equivalence_only_when_one_row_can_be_meant(spark):
    assert ladder(spark, ["Show"], ["Show: Season 1", "Show: Limited Series"])[0].stage != "season_equiv"
    assert ladder(spark, ["Show: Season 2"], ["Show: Season 1"])[0].stage != "season_equiv"


def test_first_right_row_wins_and_every_left_row_comes_out(spark):
    got = ladder(spark, ["A b", "zzz"], ["A b", "A b"])
    assert got[0].right_id == 0 and got[0].candidates == 2 and len(got) == 2


def rows_made(df):
    """The largest number of rows that an operator of the executed plan put out."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        todo += [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        n = p.metrics().get("numOutputRows")
        most = max(most, n.get().value() if n.isDefined() else 0)
    return most


def test_names_that_many_rows_share_make_no_pairs(spark):
    side = lambda rows: spark.createDataFrame([(i, t, "p", "tv", t.lower(), [t.lower()], "|||", None) for i, t in enumerate(rows)], "id int, raw string, period string, kind string, key string, keys array<string>, season string, year int")
    n = 500
    left, right = side(["Red bolt"] * n + ["Hot ringg"] * n), side(["Red bolt"] * n + ["Hot ring"] * n)
    df = L.match(left, right, ["period", "kind"])
    got = {r.left_id: r for r in df.collect()}
    assert rows_made(df) <= 10 * n
    assert len(got) == 2 * n and {(r.stage, r.right_id, r.candidates, r.score) for i, r in got.items() if i < n} == {("exact", 0, n, 100.0)}
    # candidates of a fuzzy match are all right rows of the block, and the second row of the same name is the runner-up
    assert {(r.stage, r.right_id, r.candidates, r.score == r.runner_up > 90) for i, r in got.items() if i >= n} == {("fuzzy", n, 2 * n, True)}


BASICS = "tconst string, type string, start_year int, is_series boolean, primary_title string, original_title string"


def world(spark):
    basics = spark.createDataFrame(
        [("t1", "movie", 2010, False, "Despicable Me", "Despicable Me"), ("t2", "movie", 2013, False, "Despicable Me 2", "Despicable Me 2"), ("t3", "movie", 2017, False, "Despicable Me 3", "Despicable Me 3"),
         ("t4", "tvSeries", 2011, True, "Suits", "Suits"), ("t5", "tvSeries", 2019, True, "Suits", "Suits"), ("t6", "tvSeries", 2017, True, "S.W.A.T.", "S.W.A.T."), ("t7", "tvSeries", 1999, True, "One Piece", "Wan pisu"), ("t8", "tvSeries", 2011, True, "Shameless", "Shameless")], BASICS)
    akas = spark.createDataFrame([("t7", "Eine Piece")], "tconst string, title string")
    votes = spark.createDataFrame([("t1", 900), ("t2", 500), ("t3", 100), ("t4", 800), ("t6", 50), ("t7", 70)], "tconst string, votes int")
    return C.name_index(basics, akas), votes


def entities(spark, rows):
    df = spark.createDataFrame([(k, t, d, "p1", 10, None, i) for i, (k, t, d) in enumerate(rows)], "kind string, title string, release_date date, period string, hours long, views long, row_no int")
    return C.entities(df)


def test_catalogue_ladder(spark):
    names, votes = world(spark)
    rows = [("film", "Despicable Me 3", None), ("tv", "Suits (2011): Season 1", None), ("tv", "Suits: Season 2", None), ("tv", "S.W.A.T.: Season 1", None), ("tv", "ONE PIECE: East Blue", dt.date(2023, 8, 31)), ("tv", "Shameless (U.S.): Season 3", None), ("film", "Despicable Me Three", None), ("film", "Qqq", None)]
    e = entities(spark, rows)
    got = {r.key: r for r in C.resolve(e, names, votes).collect()}
    assert (got["despicable me 3"].tconst, got["despicable me 3"].rung) == ("t3", "name")
    by = {(r.key, r.year): r for r in C.resolve(e, names, votes).collect()}
    assert (by["suits", 2011].tconst, by["suits", 2011].tie_break) == ("t4", "year")
    assert (by["suits", None].tconst, by["suits", None].tie_break) == ("t4", "votes")
    assert (got["swat"].tconst, got["swat"].rung) == ("t6", "spacing")
    assert (got["one piece east blue"].tconst, got["one piece east blue"].rung) == ("t7", "prefix")
    assert (got["shameless us"].tconst, got["shameless us"].rung) == ("t8", "qualifier_dropped")
    assert got["despicable me three"].rejected_candidate is not None or got["despicable me three"].matched
    assert got["qqq"].stage == "unmatched" and not got["qqq"].matched


def test_pooling_and_seasons(spark):
    names, votes = world(spark)
    e = entities(spark, [("tv", "Suits (2011): Season 1", None), ("tv", "Suits (2011): Season 9", None)])
    r = e.first()
    assert e.count() == 1 and r.seasons == [1, 9] and r.hours == 20 and r.example_title.endswith("1")
    episodes = spark.createDataFrame([("t4", 1), ("t4", 8)], "parent string, season int")
    assert C.validate_seasons(C.resolve(e, names, votes), episodes).first().seasons_present is False


def test_name_source_and_token_cap(spark):
    names, _ = world(spark)
    assert {r.key: r.source for r in names.where("tconst = 't7'").collect()} == {"one piece": "primary", "wan pisu": "original", "eine piece": "aka"}
    tokens, freq = C.token_index(names)
    assert {r.token: r.df for r in freq.collect()}["despicable"] == 3
    e = entities(spark, [("film", "Despicable You", None)])
    assert C.fuzzy_pool(e, tokens, freq, cap=2).count() == 2 and C.fuzzy_pool(e, tokens, freq, max_df=1).count() == 0
