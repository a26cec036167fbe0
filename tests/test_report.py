"""Labels, number text and report tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyframe.functions.format import compact_number, format_money, format_percent
from tallyframe.operators import labels
from tallyframe.operators import report as R
from tallyframe.plans.analyze import analyze
from tallyframe.roles import Roles


def test_label_tables_have_identical_keys():
    assert set(labels.LABELS["ru"]) == set(labels.LABELS["en"])
    assert labels.label("de", "metric_revenue") == "Revenue"
    assert labels.label("ru", "no_such_key") == "no_such_key"
    assert labels.label("ru", labels.SERIES_LABEL_KEYS["expenses"]) == "Расходы"


def test_number_text(spark):
    df = spark.createDataFrame([(1234567.891,), (-0.5,), (0.0,), (None,), (1500.0,), (99.5,), (2500000000.0,)],
                               "x double")
    got = df.select(format_money("x").alias("m"), compact_number("x").alias("c")).collect()
    assert [r.m for r in got] == ["1 234 567.89", "-0.50", "0.00", "not available", "1 500.00", "99.50",
                                  "2 500 000 000.00"]
    assert [r.c for r in got] == ["1.2m", "-0.5", "0", None, "1.5k", "99.5", "2.5b"]
    pct = spark.createDataFrame([(100.0,), (12.34,), (7.96,)], "p double").select(format_percent("p")).collect()
    assert [r[0] for r in pct] == ["100", "12.3", "8"]


def _analysis(spark, n=12):
    rows = [(datetime(2026, 1, 1) + timedelta(days=i), float(100 + 10 * i), float(40 + (200 if i == 5 else 0)),
             f"c{i % 8}") for i in range(n)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, rev double, exp double, cat string")
    return analyze(df, Roles(date="ts", revenue="rev", expense="exp", category="cat"), "day")


def test_brief_and_detailed_reports(spark):
    a = _analysis(spark)
    brief = R.build_report(a, "f.csv", R.DEPTH_BRIEF, "en")
    detailed = R.build_report(a, "f.csv", R.DEPTH_DETAILED, "en")

    def rows(df, section):
        return df.where((F.col("section") == section) & (F.col("row_no") > 0)).select("row_no").distinct().count()
    assert rows(brief, "categories") == 5 and rows(detailed, "categories") == 8
    assert rows(brief, "periods") == 0 and rows(detailed, "periods") == 12
    assert all(isinstance(r.value, str) for r in detailed.collect())
    head = detailed.where((F.col("section") == "forecast") & (F.col("row_no") == 0)).count()
    assert head == 3 + 2


def test_amount_only_summary(spark):
    rows = [(datetime(2026, 1, 1) + timedelta(days=i), float(i - 3)) for i in range(8)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, amt double")
    a = analyze(df, Roles(date="ts", amount="amt"), "day")
    s = R.summary_section(a.basic, [], a.ledger.amount_only, R.DEPTH_BRIEF, "en")
    labels_ = [r.value for r in s.where(F.col("col_no") == 0).orderBy("row_no").collect()]
    assert "Amount" in labels_ and "Profit" not in labels_
