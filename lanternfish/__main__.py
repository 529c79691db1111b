"""python -m lanternfish build|report: landed files to the star schema, and reports from it.

The landing folder holds reports/<period>.xlsx (such as 2024H1.xlsx), chart.tsv,
title.{basics,akas,ratings,episode}.tsv.gz, articles.json (title_id to article) and
pageviews/*.json.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os

from lanternfish.plans import model, report
from lanternfish.session import local_session
from lanternfish.sources import files, workbook


def half_year(label: str) -> tuple[dt.date, dt.date]:
    """'2024H1' -> its first and last day."""
    year, half = int(label[:4]), int(label[5:])
    return (dt.date(year, 1, 1), dt.date(year, 6, 30)) if half == 1 else (dt.date(year, 7, 1), dt.date(year, 12, 31))


def build(spark, landing: str, out: str) -> None:
    labels = sorted(f.removesuffix(".xlsx") for f in os.listdir(f"{landing}/reports") if f.endswith(".xlsx"))
    engagement = files.union_all([workbook.read_workbooks(spark, f"{landing}/reports/{p}.xlsx", p, *half_year(p)) for p in labels])
    dump = {n: files.read_dump(spark, f"{landing}/{n}.tsv.gz", n, spark.sparkContext.defaultParallelism) for n in files.CATALOGUE}
    with open(f"{landing}/articles.json", encoding="utf-8") as f:
        articles = spark.createDataFrame([(i, t, a) for i, (t, a) in enumerate(json.load(f).items())], "ord int, title_id string, article string")
    views = files.read_pageviews(spark, f"{landing}/pageviews")
    chart = files.read_chart(spark, f"{landing}/chart.tsv")
    model.write(model.build(engagement, chart, dump["title.basics"], dump["title.akas"], dump["title.ratings"], dump["title.episode"], articles, views), out)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("what", choices=["build", "report"])
    parser.add_argument("--landing")
    parser.add_argument("--model", required=True)
    args = parser.parse_args()
    spark = local_session("*")
    if args.what == "build":
        build(spark, args.landing, args.model)
    else:
        t = model.read(spark, args.model)
        print(report.render("Match quality", report.match_summary(t["dim_title"], t["fact_engagement_halfyear"])))
        print(report.render("Findings", report.findings(t)))


if __name__ == "__main__":
    main()
