"""Series, anomalies, forecasts and insights on the reference's test inputs."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyframe.operators import anomalies, forecast, insights, metrics, series
from tallyframe.operators.prepare import from_prepared, prepare
from tallyframe.roles import Roles

PTS_SCHEMA = "period timestamp_ntz, revenue double, expenses double, profit double, amount double"


def points(spark, revenue=None, expenses=None, amount=None, start=datetime(2026, 1, 1), step=timedelta(days=1)):
    n = len(revenue or expenses or amount)
    rows = []
    for i in range(n):
        r = (revenue or [0.0] * n)[i]
        e = (expenses or [0.0] * n)[i]
        a = (amount or [0.0] * n)[i]
        rows.append((start + i * step, float(r), float(e), float(r - e), float(a)))
    return spark.createDataFrame(rows, PTS_SCHEMA)


def ledger(spark, revenue=True, expenses=True, amount=False):
    df = spark.createDataFrame([], "ts timestamp_ntz, revenue double, expenses double, amount double, category string")
    return from_prepared(df, revenue=revenue, expenses=expenses, amount=amount)


def test_time_series_sums_and_visibility(spark):
    rows = [("01.01.2026", "1000", "20", "North"), ("01.01.2026", "1500", "25", "South"),
            ("02.01.2026", "1200", "22", "North"), ("02.01.2026", "900", "18", "East"),
            ("03.01.2026", "1100", "30", "South"), ("03.01.2026", "1300", "26", "North"),
            ("04.01.2026", "1250", "24", "East"), ("04.01.2026", "1400", "28", "South")]
    df = spark.createDataFrame(rows, "Date string, Sales string, Shipping string, Region string")
    led = prepare(df, Roles(date="Date", revenue="Sales", expense="Shipping", category="Region"))
    pts = series.time_series(led, "day")
    tot = pts.agg(F.sum("revenue"), F.sum("expenses")).first()
    assert (tot[0], tot[1]) == (9650.0, 193.0)
    assert str(pts.agg(F.min("period")).first()[0].date()) == "2026-01-01"
    vis = [r.series for r in series.visible_series(pts, led).orderBy("series_order").collect()]
    assert vis == ["revenue", "expenses", "profit"]


def test_week_start_and_grains(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 1, 13, 45),)], "ts timestamp_ntz")  # Thursday
    got = df.select(*[series.period_start(F.col("ts"), g, w).alias(f"{g}_{w}") for g, w in
                      [("hour", "monday"), ("day", "monday"), ("week", "monday"), ("week", "sunday"),
                       ("month", "monday"), ("year", "monday"), ("bogus", "monday")]]).first()
    assert [str(x) for x in got] == ["2026-01-01 13:00:00", "2026-01-01 00:00:00", "2025-12-29 00:00:00",
                                     "2025-12-28 00:00:00", "2026-01-01 00:00:00", "2026-01-01 00:00:00",
                                     "2026-01-01 00:00:00"]


def test_expense_spike_and_profit_drop(spark):
    pts = points(spark, revenue=[300] * 8, expenses=[100, 110, 95, 105, 500, 98, 102, 99])
    found = anomalies.detect_anomalies(pts, ledger(spark)).orderBy("rank").collect()
    kinds = {(r.series, r.kind, r.period.day) for r in found}
    assert ("expenses", "spike", 5) in kinds and ("profit", "drop", 5) in kinds


def test_few_periods_message(spark):
    pts = points(spark, revenue=[100, 200, 300])
    st = anomalies.anomaly_status(pts, ledger(spark)).first()
    assert st.message == "Need at least 4 periods to detect anomalies."
    empty = spark.createDataFrame([], PTS_SCHEMA)
    assert anomalies.anomaly_status(empty, ledger(spark)).first().message == \
        "No chart data available for anomaly detection."


def test_linear_trend_continues(spark):
    pts = points(spark, revenue=[100, 200, 300, 400, 500, 600])
    fc = forecast.forecast(pts, ledger(spark, expenses=False), "day", 2).orderBy("step").collect()
    assert [round(r.value, 6) for r in fc] == [700.0, 800.0] and fc[0].method == "linear_trend"
    assert [str(r.period.date()) for r in fc] == ["2026-01-07", "2026-01-08"]


def test_flat_series_keeps_moving_average(spark):
    pts = points(spark, revenue=[250] * 8)
    fc = forecast.forecast(pts, ledger(spark, expenses=False), "day", 3).collect()
    assert {(r.method, r.value) for r in fc} == {("moving_average", 250.0)}


def test_noisy_growth_is_trend(spark):
    pts = points(spark, revenue=[100, 110, 125, 130, 145, 150, 162, 170])
    r = forecast.forecast(pts, ledger(spark, expenses=False), "day", 1).first()
    assert r.method == "linear_trend" and r.value > 170


def test_forecast_guards_and_steps(spark):
    led = ledger(spark, expenses=False)
    assert forecast.forecast(points(spark, revenue=[1, 2, 3, 4, 5]), led, "day").count() == 0
    assert forecast.forecast(points(spark, revenue=[1, 2, 3, 4, 5, 6]), led, "day", 0).count() == 0
    wk = forecast.forecast(points(spark, revenue=[1, 2, 3, 4, 5, 6], step=timedelta(days=7)), led, "week", 1).first()
    assert str(wk.period.date()) == "2026-02-12"
    months = [datetime(2026, m, 1) for m in range(1, 7)]
    mp = spark.createDataFrame([(d, float(i), 0.0, float(i), 0.0) for i, d in enumerate(months)], PTS_SCHEMA)
    assert str(forecast.forecast(mp, led, "month", 1).first().period.date()) == "2026-07-01"
    ends = [datetime(2025, m, 28) for m in range(8, 13)] + [datetime(2026, 1, 31)]
    ep = spark.createDataFrame([(d, float(i), 0.0, float(i), 0.0) for i, d in enumerate(ends)], PTS_SCHEMA)
    steps = forecast.forecast(ep, led, "month", 2).orderBy("step").collect()
    assert [str(r.period.date()) for r in steps] == ["2026-02-28", "2026-03-28"]
    spiky = points(spark, revenue=[0, 0, 0, 0, 0, 1, 0, 0])
    assert all(abs(r.value) < 1e9 for r in forecast.forecast(spiky, led, "day").collect())


def test_insight_percentages(spark):
    up = insights.last_period_change(points(spark, revenue=[50, 100]), [], "en").first()
    assert up.text == "Profit in the last period rose 100% against the one before it."
    down = insights.last_period_change(points(spark, revenue=[200, 100]), [], "en").first()
    assert "fell 50%" in down.text
    assert insights.last_period_change(points(spark, revenue=[0, 100]), [], "en").count() == 0
    assert insights.last_period_change(points(spark, revenue=[100]), [], "en").count() == 0


def test_category_share_and_cash_gap(spark):
    cats = spark.createDataFrame([("A", 750.0, 0.0, 1), ("B", 250.0, 0.0, 2)],
                                 "category string, revenue double, expenses double, rank int")
    share = insights.category_concentration(cats, [], "en").first()
    assert share.text == 'Category "A" accounts for 75% of turnover.'
    df = spark.createDataFrame([(datetime(2026, 1, 1), 100000.0, 0.0), (datetime(2026, 1, 10), 0.0, 900000.0)],
                               "ts timestamp_ntz, revenue double, expenses double")
    led = prepare(df, Roles(date="ts", revenue="revenue", expense="expenses"))
    rules = {r.rule: r.text for r in insights.burn_rate_and_cash_gap(metrics.basic_metrics(led), [], "en").collect()}
    assert rules["cash_gap"] == "The average day closes 80 000.00 short. At this rate there is a cash gap risk."


def test_insights_cap_at_six(spark):
    from tallyframe.plans.analyze import analyze
    rows = [(datetime(2026, 1, 1) + timedelta(days=i), float(100 + (i % 5) * 10 + (900 if i == 9 else 0)),
             float(300 + i), "A" if i % 3 else "B") for i in range(20)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, rev double, exp double, cat string")
    a = analyze(df, Roles(date="ts", revenue="rev", expense="exp", category="cat"), "day")
    out = insights.generate_insights(a.ledger, a.points, a.basic, a.categories, a.anomalies, a.forecast, "ru")
    texts = [r.text for r in out.collect()]
    assert 1 <= len(texts) <= 6 and all("nan" not in t for t in texts)


def test_keyed_equals_union_of_single_runs(spark):
    rows = [(k, datetime(2026, 1, 1) + timedelta(days=i), float((i * 37 + len(k)) % 23), float(i % 7))
            for k in ("a", "b", "c") for i in range(30)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, rev double, exp double")
    roles = Roles(date="ts", revenue="rev", expense="exp")
    keyed = prepare(df, roles, keys=["k"])
    kp = {(r.k, r.period, r.profit) for r in series.time_series(keyed, "week").collect()}
    single = set()
    for k in ("a", "b", "c"):
        led = prepare(df.where(F.col("k") == k), roles)
        single |= {(k, r.period, r.profit) for r in series.time_series(led, "week").collect()}
    assert kp == single


def test_partition_invariance(spark):
    rows = [(datetime(2026, 1, 1) + timedelta(hours=7 * i), float(i % 13) * 1.25, float(i % 5)) for i in range(400)]
    base = spark.createDataFrame(rows, "ts timestamp_ntz, rev double, exp double")
    roles = Roles(date="ts", revenue="rev", expense="exp")
    results = []
    for n in (1, 7, 64):
        led = prepare(base.repartition(n), roles)
        pts = series.time_series(led, "day")
        results.append(sorted((r.series, str(r.period), r.rank) for r in anomalies.detect_anomalies(pts, led).collect()))
    assert results[0] == results[1] == results[2]
