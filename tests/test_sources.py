import datetime as dt
import gzip
import json
import zipfile

import pytest

from lanternfish.sources import contracts, exports, files, workbook
from lanternfish.streaming import weekly

HEAD = ["Title", "Available Globally?", "Release Date", "Hours Viewed", "Runtime", "Views"]


def xlsx(path, sheets):
    """A workbook of inline strings and numbers, data from row 6, column B."""
    def cell(r, c, v):
        ref = f"{chr(65 + c)}{r}"
        return "" if v is None else f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, int | float) else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{6 + k}">' + "".join(cell(6 + k, 1 + c, v) for c, v in enumerate(row)) + "</row>" for k, row in enumerate(rows))
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet {ns}><sheetData><row r="1">{cell(1, 1, "preamble")}</row>{body}</sheetData></worksheet>')
    return str(path)


def read(spark, path):
    return workbook.read_workbooks(spark, path, "2024H1", dt.date(2024, 1, 1), dt.date(2024, 6, 30))


def test_workbook(spark, tmp_path):
    tv = [HEAD, ["Show: Season 1", "Yes", "2023-05-01", 1000, "2:30", 400], [1899, "No", None, 500, "*", 10], [None] * 6, ["Other Shows", "*", "*", 77, "*", "*"], ["* footnote", None, None, None, None, None]]
    film = [HEAD, ["NA", "Yes", 45292, 20, "1:00*", None]]
    got = {r.title: r for r in read(spark, xlsx(tmp_path / "a.xlsx", {"Shows": tv, "Movies": film})).collect()}
    assert set(got) == {"Show: Season 1", "1899", "Other Shows", "NA"}
    s = got["Show: Season 1"]
    assert (s.kind, s.hours_viewed, s.runtime_hours, s.views, s.release_date, s.source_row, s.available_globally) == ("tv", 1000, 2.5, 400, dt.date(2023, 5, 1), "Shows!7", True)
    assert got["1899"].runtime_withheld and got["1899"].available_globally is False
    o = got["Other Shows"]
    assert o.is_catch_all and o.views is None and o.available_globally is None and o.hours_viewed == 77
    assert got["NA"].runtime_starred and got["NA"].release_date == dt.date(2024, 1, 1) and got["NA"].kind == "film"


@pytest.mark.parametrize(("sheets", "message"), [
    ({"TV": [HEAD[:-1]], "Film": [HEAD]}, "missing"), ({"TV": [HEAD]}, "sheet"), ({"TV": [HEAD], "Film": [HEAD], "More": [HEAD]}, "sheet"),
    ({"TV": [HEAD, ["a", "Yes", None, 1, "1h30", 1]], "Film": [HEAD]}, "runtime"), ({"TV": [HEAD, ["a", "*", None, 1, "1:30", 1]], "Film": [HEAD]}, "Globally"),
    ({"TV": [HEAD, ["a", "Yes", None, "lots", "1:30", 1]], "Film": [HEAD]}, "hours"), ({"TV": [HEAD, ["a", "Yes", None, 1, "1:30", "*"]], "Film": [HEAD]}, "views")])
def test_workbook_refuses(spark, tmp_path, sheets, message):
    with pytest.raises(Exception, match=message):
        read(spark, xlsx(tmp_path / "bad.xlsx", sheets)).collect()


def test_chart(spark, tmp_path):
    lines = ["\t".join(files.CHART_COLUMNS)] + [f"2024-01-07\tTV (Non-English)\t{k}\t{'NA' if k == 1 else 'x'}\tN/A\t10\t\tN/A\t2" for k in range(1, 11)]
    p = tmp_path / "chart.tsv"
    p.write_text("\n".join(lines) + "\n")
    rows = files.charting_title(files.read_chart(spark, str(p))).orderBy("weekly_rank").collect()
    assert (rows[0].show_title, rows[0].season_title, rows[0].runtime, rows[0].weekly_views, rows[0].kind, rows[0].language, rows[0].charting_title) == ("NA", None, None, None, "tv", "non-english", "NA")
    p.write_text("\n".join(lines[:-1]) + "\n")
    with pytest.raises(contracts.ContractError, match="ten rows"):
        files.read_chart(spark, str(p))
    p.write_text("\n".join(["week\tcategory"] + lines[1:]))
    with pytest.raises(contracts.ContractError, match="missing"):
        files.read_chart(spark, str(p))


def test_dump_keeps_bare_quotes(spark, tmp_path):
    rows = ["\t".join(files.CATALOGUE["title.basics"]), 'tt1\tmovie\t"A" day\tA\t0\t1999\t\\N\t90\tDrama,War', 'tt2\tmovie\t"unbalanced\tB\t1\t\\N\t\\N\t\\N\t\\N', "tt3\tshort\tC\tC\t0\t2001\t\\N\t1\tShort"]
    p = tmp_path / "basics.tsv.gz"
    p.write_bytes(gzip.compress(("\n".join(rows) + "\n").encode()))
    got = {r.tconst: r for r in files.read_dump(spark, str(p), "title.basics", partitions=2).collect()}
    assert got["tt1"].primaryTitle == '"A" day' and got["tt2"].primaryTitle == '"unbalanced' and len(got) == 3
    assert got["tt1"].startYear == 1999 and got["tt2"].startYear is None and got["tt2"].isAdult is True and got["tt2"].genres is None


def test_json_sources(spark, tmp_path):
    v = lambda x: {"value": x}
    binding = [{"imdb": v("tt1"), "item": v("http://x/entity/Q1"), "article": v("https://en.w/wiki/Caf%C3%A9_%2B")}, {"imdb": v("tt1"), "item": v("http://x/entity/Q2")}, {"imdb": v("tt2"), "item": v("http://x/entity/Q3"), "article": v("https://en.w/wiki/B")}]
    (tmp_path / "m.json").write_text(json.dumps({"imdb_ids": ["tt1", "tt2", "tt3"], "response": {"results": {"bindings": binding}}}))
    got = sorted((r.catalogue_id, r.item or "", r.article or "") for r in files.read_articles(spark, str(tmp_path / "m.json")).collect())
    assert got == [("tt1", "Q1", "Café_+"), ("tt1", "Q2", ""), ("tt2", "Q3", "B"), ("tt3", "", "")]
    item = lambda g, a: {"granularity": g, "agent": a, "timestamp": "2024010300", "views": 7}
    (tmp_path / "p.json").write_text(json.dumps({"article": "B", "response": {"items": [item("daily", "user")]}}))
    (tmp_path / "e.json").write_text(json.dumps({"article": "C", "response": {"items": []}}))
    assert [tuple(r) for r in files.read_pageviews(spark, [str(tmp_path / "p.json"), str(tmp_path / "e.json")]).collect()] == [("B", dt.date(2024, 1, 3), 7)]
    (tmp_path / "p.json").write_text(json.dumps({"article": "B", "response": {"items": [item("monthly", "user")]}}))
    with pytest.raises(Exception, match="not daily"):
        files.read_pageviews(spark, str(tmp_path / "p.json")).collect()


def test_manifest(spark, tmp_path):
    f, m = tmp_path / "f.bin", str(tmp_path / "manifest.json")
    f.write_bytes(b"abc")
    with pytest.raises(contracts.ContractError, match="not in"):
        contracts.verify(str(f), m)
    entry = contracts.record(str(f), "s", "u", m, period="p")
    contracts.verify(str(f), m)
    assert contracts.checksums(spark, str(f)).first().sha256 == entry["sha256"]
    f.write_bytes(b"abd")
    with pytest.raises(contracts.ContractError, match="differs"):
        contracts.verify(str(f), m)
    with pytest.raises(contracts.ContractError):
        contracts.expect_not_html(b" <!DOCTYPE html><p>", "x")


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.5, 1000), ("c", float("nan"), None)], "k string, score double, n long")
    md = exports.markdown(df)
    assert "a\\|b | 1.500 | 1,000" in md and "c | – | –" in md
    data = json.loads(exports.to_json({"x": df}))
    assert data["x"][1] == {"k": "c", "score": None, "n": None}
    assert "</script><" not in exports.page("t", {"x": df}).split("const D=")[1].split(";")[0]
    exports.write_table(df, str(tmp_path / "t"), ["n", "k"])
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["n", "k"]
    exports.write_near_misses(df, str(tmp_path / "c"))
    with pytest.raises(ValueError, match="not unique"):
        exports.check_keys(df, "n")
    p = contracts.profile(df, "df").first()
    assert p.n_rows == 2 and p.nulls["n"] == 1


def test_weekly_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    late = spark.createDataFrame([(9999999, dt.datetime(2024, 6, 1), 1, "flush", 0.0, None)], events.schema)
    events.unionByName(late).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = weekly.weekly_counts(weekly.deduplicated(stream, ["event_id"]), late=None).writeStream.outputMode("append").format("memory").queryName("weekly").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r.week_start, r.week_ending, r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(spark.table("weekly")) == key(weekly.weekly_counts(events))
    assert all(r[0].weekday() == 0 and r[1].weekday() == 6 for r in key(weekly.weekly_counts(events)))
