"""Registered queries against their SQL on DuckDB."""

import sys

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["headline", "title_period", "longevity", "weekly_demand", "weak_scope_fallback", "orphans", "period_arrays", "title_parse", "text_keys", "exact_ladder", "tie_break_crosstab", "fuzzy_topk", "season_validation", "genre_delivery", "delivery_bootstrap", "best_lag", "sign_test", "spearman", "ols", "resolve", "chart_ladder", "weak_rungs", "title_shapes", "norm_function", "placebo", "placebo_summary", "strongest_lags", "per_thousand_views"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, duck, name):
    from lanternfish.plans import registry

    df = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    show = lambda v: None if v is None else str(v)
    a = sorted(str([show(r[c]) for c in order]) for r in df.collect())
    b = sorted(str([show(r[names.index(c)]) for c in order]) for r in want.fetchall())
    assert a == b


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_optional_part(monkeypatch):
    for name in [m for m in sys.modules if m in ("__spark_entry__", "corpus_pipeline") or m.startswith("lanternfish.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lanternfish.llm", None)
    import __spark_entry__ as e

    assert "headline" in e.queries() and not any(k.startswith("op") and k[2:3].isdigit() for k in e.queries())
