"""Sinks: tables, CSV, and reports rendered from small results."""

from __future__ import annotations

import html
import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that a licence keeps off published pages.
LICENSED = ("rating", "votes")


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, partition_by: str | None = None) -> None:
    """Replace a table, columns in a declared order."""
    out = (df.select(*columns) if columns else df).write.mode("overwrite")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)


def check_keys(df: DataFrame, key: str) -> DataFrame:
    """df, if key is unique in it and never null."""
    bad = df.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).head(3)
    if bad:
        raise ValueError(f"{key} is not unique: {[tuple(r) for r in bad]}")
    return df


def write_near_misses(df: DataFrame, path: str) -> None:
    """One sorted CSV: near misses are read by people."""
    df.orderBy(F.desc("score"), *[c for c in df.columns if c != "score"]).coalesce(1).write.mode("overwrite").csv(path, header=True)


def _cell(v) -> str:
    if v is None or (isinstance(v, float) and not math.isfinite(v)):
        return "–"
    return f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else f"{v:,.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a markdown table; longer ones say how many rows are left out."""
    rows = df.limit(most + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(_cell, r)) + " |" for r in rows[:most]]
    return "\n".join(lines + ([f"", f"(first {most} rows)"] if len(rows) > most else [])) + "\n"


def finite(x):
    """Non-finite numbers as null, at any depth: JSON has no word for them."""
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, dict):
        return {k: finite(v) for k, v in x.items()}
    return [finite(v) for v in x] if isinstance(x, list | tuple) else x


def to_json(frames: dict[str, DataFrame], most: int = 50_000) -> str:
    """Several small results as one JSON object of row lists; one of more than `most` rows is refused."""
    data = {}
    for k, df in frames.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{k} has more than {most} rows: it is no summary")
        data[k] = [r.asDict(recursive=True) for r in rows]
    return json.dumps(finite(data), allow_nan=False, default=str, sort_keys=True)


def write_matches(frames: dict[str, DataFrame], folder: str) -> None:
    """Match results, a table each: match_<name>.parquet."""
    for name, df in frames.items():
        write_table(df, f"{folder}/match_{name}.parquet")


def describe(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table_name, place, column_name, data_type) of named Parquet tables."""
    rows = [(name, i, f.name, f.dataType.simpleString()) for name, path in sorted(paths.items()) for i, f in enumerate(spark.read.parquet(path).schema.fields)]
    return spark.createDataFrame(rows, "table_name string, place int, column_name string, data_type string")


def dashboard_rows(titles: DataFrame, *, genre: str | None = None, kind: str | None = None, charted: bool | None = None, contains: str = "", sort: str = "hours", most: int = 200) -> DataFrame:
    """The filters of the page as a query: titles with hours, by genre, kind, chart and part of the name; licensed columns go."""
    t = titles.where("hours > 0")
    t = t.where(F.array_contains(F.split("genres", ","), genre)) if genre else t
    t = t.where(F.col("kind") == kind) if kind else t
    t = t.where((F.coalesce("weeks_charted", F.lit(0)) > 0) == charted) if charted is not None else t
    t = t.where(F.contains(F.lower("canonical_title"), F.lit(contains.strip().lower()))) if contains.strip() else t
    return t.drop(*LICENSED).orderBy(F.desc_nulls_last(sort), "title_id").limit(most)


def labelling(pairs: DataFrame, seed: str = "7", most: int = 500) -> tuple[str, str]:
    """(JSON, page) of pairs (left, right, left_source, right_source, score, stage) to label; score and stage stay off the page."""
    rows = pairs.limit(most).collect()
    records = [{"id": f"p{i:02d}", **{c: r[c] for c in ("left", "right", "left_source", "right_source", "stage")}, "score": None if r.score is None else round(float(r.score), 1)} for i, r in enumerate(rows)]
    shown = json.dumps([{k: v for k, v in r.items() if k not in ("score", "stage")} for r in records], ensure_ascii=False).replace("</", "<\\/")
    script = "const V={};for(const p of D){const d=document.createElement('p');d.append(`${p.left} (${p.left_source}) / ${p.right} (${p.right_source}) `);for(const v of['same','different','unsure']){const b=document.createElement('button');b.textContent=v;b.onclick=()=>{V[p.id]=v;O.value=JSON.stringify({version:1,labels:V})};d.append(b)}document.body.insertBefore(d,O)}"
    body = f"<!doctype html><meta charset=utf-8><title>Pairs</title><h1>{len(records)} pairs</h1><textarea id=O></textarea><script>const D={shown};{script}</script>\n"
    return json.dumps({"seed": seed, "pairs": finite(records)}, ensure_ascii=False, allow_nan=False), body


def page(title: str, frames: dict[str, DataFrame]) -> str:
    """A self-contained HTML page with its data inside; licensed columns of titles are left out."""
    data = to_json({k: df.drop(*LICENSED) for k, df in frames.items()}).replace("</", "<\\/")
    script = "for(const[k,rows]of Object.entries(D)){const t=document.createElement('table');t.createCaption().textContent=k;rows.slice(0,200).forEach((r,i)=>{if(!i){const h=t.insertRow();Object.keys(r).forEach(c=>h.insertCell().textContent=c)}const x=t.insertRow();Object.values(r).forEach(v=>x.insertCell().textContent=v)});document.body.append(t)}"
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><script>const D={data};{script}</script>\n"
