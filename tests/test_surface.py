"""Landing without a network, and the sinks that people read."""

import json

import pytest
from pyspark.sql import functions as F

from lanternfish.operators import stats as S
from lanternfish.sources import connect, contracts, exports, files


class Server:
    """Answers in order; remembers what it was asked and how long it was waited for."""

    def __init__(self, *replies):
        self.replies, self.asked, self.slept = list(replies), [], []

    def __call__(self, url, params, headers):
        self.asked.append((url, params))
        return self.replies.pop(0)

    def reply(status=200, body=b"{}", **headers):
        return connect.Reply(status, headers, body)


def test_busy_servers_are_asked_again_but_not_for_ever():
    s = Server(connect.Reply(429, {"Retry-After": "3"}, b""), connect.Reply(503, {}, b""), connect.Reply(200, {}, b"x"))
    assert connect.ask(s, "u", sleep=s.slept.append).body == b"x" and s.slept == [3.0, 10.0]
    s = Server(*[connect.Reply(429, {}, b"")] * 9)
    with pytest.raises(connect.LandingError):
        connect.ask(s, "u", sleep=s.slept.append)
    assert len(s.asked) == 4 and len(s.slept) == 3


def test_landing(tmp_path):
    book = str(tmp_path / "manifest.json")
    page = b'<a href="https://h/a.xlsx">a</a> <a href="https://h/a.xlsx">again</a>'
    path = connect.land_linked(Server(connect.Reply(200, {}, page), connect.Reply(200, {}, b"PK..")), "p", ".xlsx", str(tmp_path / "a.xlsx"), "report", book)
    contracts.verify(path, book)
    with pytest.raises(connect.LandingError):
        connect.land_linked(Server(connect.Reply(200, {}, page + b"https://h/b.xlsx")), "p", ".xlsx", path, "report", book)
    with pytest.raises(contracts.ContractError):
        connect.land_file(Server(connect.Reply(200, {}, b"<!doctype html>")), "u", path, "report", book)


def test_landing_goes_on_where_it_stopped(spark, tmp_path):
    book, folder = str(tmp_path / "m.json"), str(tmp_path / "ids")
    ids = [f"tt{i:07d}" for i in range(450)]
    body = json.dumps({"results": {"bindings": []}}).encode()
    s = Server(*[connect.Reply(200, {}, body)] * 3)
    paths = connect.land_articles(s, "e", ids + ids[:9], lambda part: " ".join(part), folder, book)
    assert len(paths) == 3 == len(s.asked) and len(s.asked[0][1]["query"].split()) == 200
    assert connect.land_articles(Server(), "e", ids, " ".join, folder, book) == paths
    with pytest.raises(connect.LandingError):
        connect.batches(["nm1"])
    views = json.dumps({"items": []}).encode()
    got, kept = connect.land_pageviews(Server(connect.Reply(200, {}, views), connect.Reply(404, {}, b"")), "v/{article}", ["A b", "C/d", "A b"], str(tmp_path / "pv"), book)
    assert kept == 0 and [p.rsplit("/", 1)[1] for p in got] == ["A%20b.json", "C%2Fd.json"] and json.load(open(got[1]))["response"]["items"] == []
    assert connect.land_pageviews(Server(), "v/{article}", ["A b"], str(tmp_path / "pv"), book)[1] == 1


def test_addresses(spark):
    assert spark.range(1).select(files.encode_segment(F.lit("A b/c+é"))).first()[0] == "A%20b%2Fc%2B%C3%A9"


TITLES = [("t1", "Alpha One", "tv", "Drama,Crime", 9, 3, 7.5, 10), ("t2", "Beta", "film", "Drama", 5, None, 6.0, 20), ("t3", "Alpha Two", "tv", "Comedy", 0, 1, 5.0, 30), ("t4", "Gamma", "tv", "Crime", 7, None, 4.0, 40)]


def test_dashboard(spark):
    df = spark.createDataFrame(TITLES, "title_id string, canonical_title string, kind string, genres string, hours long, weeks_charted int, rating double, votes int")
    ids = lambda **how: [r.title_id for r in exports.dashboard_rows(df, **how).collect()]
    assert ids() == ["t1", "t4", "t2"] and ids(genre="Crime") == ["t1", "t4"] and ids(kind="film") == ["t2"]
    assert ids(charted=True) == ["t1"] and ids(charted=False, most=1) == ["t4"] and ids(contains=" ALPHA ") == ["t1"]
    page = exports.page("T", {"titles": df})
    assert "rating" not in page and "votes" not in page and "Alpha One" in page and "rating" not in exports.dashboard_rows(df).columns
    with pytest.raises(ValueError, match="no summary"):
        exports.to_json({"x": spark.range(5)}, most=4)


def test_labelling(spark):
    df = spark.createDataFrame([("a</script>", "b", "x", "y", 90.55, "fuzzy"), ("c", "d", "x", "y", None, "near_miss")], "left string, right string, left_source string, right_source string, score double, stage string")
    data, page = exports.labelling(df)
    pairs = json.loads(data)["pairs"]
    assert [p["id"] for p in pairs] == ["p00", "p01"] and pairs[1]["score"] is None
    assert "fuzzy" not in page and "90.5" not in page and "a</script>" not in page


def test_tables_and_matches(spark, tmp_path):
    exports.write_matches({"chart": spark.range(3).withColumnRenamed("id", "left_id")}, str(tmp_path))
    got = exports.describe(spark, {"chart": f"{tmp_path}/match_chart.parquet"}).collect()
    assert [(r.table_name, r.column_name, r.data_type) for r in got] == [("chart", "left_id", "bigint")]


def test_samples(spark):
    rows = spark.range(100).select("id", (F.col("id") % 4).alias("b")).union(spark.range(3).select("id", F.lit(0).cast("long")))
    got = S.stratified(rows, "id", F.col("b"), 3, 20).collect()
    assert len({r.id for r in got}) == 20 and sorted(r.place for r in got) == list(range(1, 21))
    per = {b: sum(r.b == b for r in got) for b in range(4)}
    assert min(per.values()) >= 3
    assert [r.id for r in S.sample(rows, "id", 5).collect()] == [r.id for r in S.sample(rows.repartition(7), "id", 5).collect()]


def test_numbering_is_the_order_of_the_whole(spark):
    names = [f"t_{i * 7919 % 1000:03x}{c}" for i in range(300) for c in "xy"]
    got = {r.u: r.i for r in S.numbered(spark.createDataFrame([(n,) for n in names + names[:5]], "u string"), "u").collect()}
    assert got == {n: i for i, n in enumerate(sorted(set(names)))}
