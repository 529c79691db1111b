import datetime as dt
import math

import numpy as np
import pandas as pd

from lanternfish.operators import stats as S


def series(spark, shifts, n=40, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for key, shift in shifts.items():
        base = np.exp(rng.standard_normal(n + 20).cumsum() * 0.3 + 8)
        for i in range(n):
            rows.append((key, dt.date(2020, 1, 5) + dt.timedelta(7 * i), float(base[i + 10]), float(base[i + 10 - shift]) * 3))
    return spark.createDataFrame(rows, "key string, week date, hours double, pageviews double")


def test_planted_lags(spark):
    got = {r.key: r for r in S.best_lag(series(spark, {"a": -2, "b": 3, "c": 0})).collect()}
    # pageviews that follow three weeks later are found at +3
    assert {k: r.lag for k, r in got.items()} == {"a": -2, "b": 3, "c": 0}
    assert all(r.r > 0.99 and r.lags_considered == 9 for r in got.values())


def test_short_and_flat_series(spark):
    short = series(spark, {"s": 0}, n=8)
    assert {r.lag for r in S.lag_correlations(short).collect()} == {-1, 0, 1}
    assert S.best_lag(series(spark, {"s": 0}, n=7)).count() == 0
    flat = short.selectExpr("key", "week", "1.0 as hours", "pageviews")
    assert S.best_lag(flat).count() == 0


def test_placebo_is_lower_than_real(spark):
    s = series(spark, {f"k{i}": 0 for i in range(12)})
    fake = [r.r for r in S.placebo(s, draws_=60).collect()]
    assert len(fake) == 60 and abs(float(np.median(fake))) < 0.3


def genres(spark):
    rows = [(f"t{i}", g, 10 + i, 5 + i, i % 3) for i in range(60) for g in (["A", "B"] if i % 2 else ["A"])]
    return spark.createDataFrame(rows, "title_id string, genre string, hours long, slots long, weeks_charted int")


def test_delivery(spark):
    g = {r.genre: r for r in S.delivery(genres(spark), 0, 0).collect()}
    assert math.isclose(sum(r.hours_share for r in g.values()), 1) and math.isclose(sum(r.slots_share for r in g.values()), 1)
    same = genres(spark).selectExpr("title_id", "genre", "hours", "hours as slots", "weeks_charted")
    assert all(math.isclose(r.delivery, 1) for r in S.delivery(same, 0, 0).collect())
    assert S.delivery(genres(spark), 31, 0).count() == 1 and S.delivery(genres(spark), 0, 41).count() == 0
    ci = {r.genre: r for r in S.delivery_interval(genres(spark), 60).collect()}
    assert all(ci[k].ci_low <= g[k].delivery <= ci[k].ci_high for k in g)


def test_ols_and_interval(spark):
    rng = np.random.default_rng(0)
    x, z = rng.standard_normal((2, 300))
    rows = [(str(i), float(a), float(b), float(2 + 3 * a - b + e)) for i, (a, b, e) in enumerate(zip(x, z, rng.standard_normal(300) * 0.1, strict=True))]
    df = spark.createDataFrame(rows, "u string, a double, b double, y double")
    got = {r.term: r for r in S.ols(df, "y", ["a", "b"]).collect()}
    want, *_ = np.linalg.lstsq(np.column_stack([np.ones(300), x, z]), np.array([r[3] for r in rows]), rcond=None)
    assert np.allclose([got[t].estimate for t in ("intercept", "a", "b")], want) and got["a"].r2 > 0.99
    ci = {r.term: r for r in S.ols_interval(df, "u", "y", ["a", "b"], 80).collect()}
    assert ci["a"].ci_low < 3 < ci["a"].ci_high


def test_rank_correlation_and_p(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (4.0, 4.0), (None, 9.0)], "x double, y double")
    r = S.spearman(df, "x", "y").first()
    assert r.n == 4 and math.isclose(r.rho, 0.9486832980505138)
    none = S.spearman(df.where("x > 9"), "x", "y").first()
    assert none.n == 0 and none.rho is None
    assert S.spearman(df.selectExpr("1.0D AS x", "y"), "x", "y").first().rho is None
    assert math.isclose(S.spearman_p(0.118, 2292), 1.5e-8, rel_tol=0.2)
    assert math.isclose(S.incomplete_beta(2, 3, 0.4), 0.5248, rel_tol=1e-9)


def test_ranks_of_many_values_and_a_hot_one(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.random(3000) < 0.4, 7, rng.integers(-900, 900, 3000))
    rows = pd.DataFrame({"x": x, "y": rng.integers(0, 40, 3000) + x // 300})
    df = spark.createDataFrame(rows)
    got = {r.x: r["rank"] for r in S.average_ranks(df.selectExpr("x", "1 AS n"), "x", parts=16).collect()}
    assert got == dict(zip(rows.x.tolist(), rows.x.rank().tolist(), strict=True))
    r = S.spearman(df, "x", "y").first()
    assert r.n == 3000 and math.isclose(r.rho, rows.x.rank().corr(rows.y.rank()))


def test_sign_test():
    assert math.isclose(S.sign_test(8, 2), 0.109375) and S.sign_test(5, 5) == 1.0 and math.isnan(S.sign_test(0, 0))
