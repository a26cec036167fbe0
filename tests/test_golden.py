"""End to end on a ledger file: file → catalog → detection → analysis, against plain
Python over the same rows."""

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import forecast, metrics
from tallyframe.operators.detection import detect_roles
from tallyframe.plans.analyze import analyze
from tallyframe.roles import Roles
from tallyframe.sources import files
from tests.fixtures import golden_ledger, write_golden_csv

SERIES = ("revenue", "expenses", "profit")


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    path = write_golden_csv(tmp_path_factory.mktemp("golden"))
    cat = files.file_catalog(spark, path).collect()[0]
    assert (cat.encoding, cat.delimiter, cat.has_header, cat.status) == ("utf-8", ";", True, "ok")
    df = files.read_ledgers(spark, files.file_catalog(spark, path)).drop("source_file").cache()
    assign, _ = detect_roles(df, sample_rows=100)
    roles = {r.role: r.column for r in assign.collect() if r.column}
    return df, Roles(**roles), roles


def expected_points(grain):
    """Series by name: sorted periods with the values of each."""
    sums = {}
    for day, _, revenue, expense in golden_ledger():
        period = day - timedelta(days=day.weekday()) if grain == "week" else day
        r, e = sums.get(period, (0, 0))
        sums[period] = (r + revenue, e + expense)
    periods = sorted(sums)
    r, e = (np.array([sums[p][k] for p in periods], float) for k in (0, 1))
    return periods, dict(zip(SERIES, (r, e, r - e)))


def expected_anomalies(grain):
    """(series, day, value, score, median, rules, severity), strongest first."""
    periods, points = expected_points(grain)
    found = []
    for order, (name, v) in enumerate(points.items()):
        q1, median, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        side = -1 if name == "profit" else 1  # a low profit, a high revenue or expense
        fence = (q3 if side > 0 else q1) + side * 1.5 * (q3 - q1)
        limit = v.mean() + side * 2.5 * v.std()
        for period, x in zip(periods, v):
            by_iqr, by_z = bool(side * (x - fence) > 0), bool(side * (x - limit) > 0)
            if by_iqr or by_z:
                score = max([1 + abs(x - fence) / max(abs(fence), 1)] * by_iqr + [abs(x - median) / v.std()] * by_z)
                found.append((-score, -abs(x - median), order, period,
                              (name, str(period), x, score, median, ", ".join(["IQR"] * by_iqr + ["Z-score"] * by_z),
                               "High" if score >= 3 else "Medium")))
    return [f[-1] for f in sorted(found)]


def test_detected_roles(golden):
    _, _, roles = golden
    assert roles == {"date": "Дата операции", "revenue": "Сумма дохода", "expense": "Сумма расхода",
                     "category": "Категория"}


def test_totals_and_period(golden):
    df, roles, _ = golden
    m = analyze(df, roles, "day").basic.collect()[0]
    rows = golden_ledger()
    revenue, expenses = (sum(r[k] for r in rows) for k in (2, 3))
    assert m.transaction_count == len(rows) > 200
    assert (m.total_revenue, m.total_expenses, m.total_profit) == (revenue, expenses, revenue - expenses)
    assert (m.date_min.date(), m.date_max.date()) == (rows[0][0], rows[-1][0])
    assert m.period_days == (rows[-1][0] - rows[0][0]).days + 1


@pytest.mark.parametrize("grain", ["day", "week"])
def test_points(golden, grain):
    df, roles, _ = golden
    periods, points = expected_points(grain)
    got = analyze(df, roles, grain).points.orderBy("period").collect()
    assert [r.period.date() for r in got] == periods
    for name in SERIES:
        assert [r[name] for r in got] == points[name].tolist()


def test_categories(golden):
    df, roles, _ = golden
    want = {}
    for _, category, revenue, expense in golden_ledger():
        profit, n = want.get(category, (0, 0))
        want[category] = (profit + revenue - expense, n + 1)
    a = analyze(df, roles, "day")
    got = {r.category: (r.profit, r.transaction_count) for r in metrics.top_categories(a.ledger, 25).collect()}
    assert got == want and len(want) == 5


@pytest.mark.parametrize("grain", ["day", "week"])
def test_anomalies(golden, grain):
    df, roles, _ = golden
    want = expected_anomalies(grain)
    assert len(want) >= 3
    got = analyze(df, roles, grain).anomalies.orderBy("rank").collect()
    assert len(got) == min(len(want), 8) and {r.total_found for r in got} == {len(want)}
    for r, w in zip(got, want):
        assert (r.series, str(r.period.date()), r.value, r.rule, r.severity) == (*w[:3], *w[5:])
        assert (r.score, r.baseline) == (pytest.approx(w[3]), pytest.approx(w[4]))


@pytest.mark.parametrize("grain", ["day", "week"])
def test_forecast(golden, grain):
    df, roles, _ = golden
    a = analyze(df, roles, grain)
    fit = {r.series: r for r in forecast.forecast_fit(a.points, a.ledger).collect()}
    following = {r.series: r.value for r in a.forecast.where(F.col("step") == 0).collect()}
    for name, v in expected_points(grain)[1].items():
        x = np.arange(len(v))
        slope, level = np.polyfit(x, v, 1)
        trend_mae = np.abs(v - slope * x - level)[3:].mean()
        ma_mae = np.abs(v[3:] - (v[:-3] + v[1:-2] + v[2:-1]) / 3).mean()
        linear = trend_mae < 0.85 * ma_mae
        assert (fit[name].trend_mae, fit[name].ma_mae) == (pytest.approx(trend_mae), pytest.approx(ma_mae))
        assert fit[name].method == ("linear_trend" if linear else "moving_average")
        assert following[name] == pytest.approx(slope * len(v) + level if linear else v[-3:].mean())


def test_a_misspelt_column_is_an_error(golden):
    df, roles, _ = golden
    with pytest.raises(ValueError, match="Суммы"):
        analyze(df, Roles(date=roles.date, revenue="Суммы дохода"), "day")
