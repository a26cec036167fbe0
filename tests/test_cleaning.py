"""Money, date and category cleaning (FIXTURES §H)."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.dates import parse_date_text
from tallyframe.functions.money import with_profile_number
from tallyframe.operators.partials import raw_rollup
from tallyframe.operators.prepare import clean_money, prepare
from tallyframe.roles import Roles

NB = " "
VALUES = ["100000", "100 000", "100 000 ₸", "100,000", "100.000", "1.234,56", "1,234.56", "(123.45)", "12,5",
          "1,000,000", "-", "", "n/a", "1e3", f"100{NB}000"]
# forgiving reading, cell by cell (the column is dirty)
DIRTY = [100000.0, 100000.0, 100000.0, 100000.0, 100000.0, 1234.56, 1234.56, -123.45, 12.5, 0.0, 0.0, 0.0, 0.0,
         13.0, 100000.0]


def _clean(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.v for r in clean_money(df, ["v"]).orderBy("i").collect()]


def test_dirty_column_is_read_cell_by_cell(spark):
    assert _clean(spark, VALUES) == DIRTY


def test_clean_column_is_read_directly(spark):
    assert _clean(spark, ["1.234", "1e3", "", None, " 5 ", "-7.5"]) == [1.234, 1000.0, 0.0, 0.0, 5.0, -7.5]


def test_nan_text_trips_the_switch(spark):
    assert _clean(spark, ["1.234", "nan"]) == [1234.0, 0.0]


def test_numeric_columns_fill_missing_with_zero(spark):
    df = spark.createDataFrame([(1, 2.5), (2, None), (3, float("nan"))], "i int, v double")
    assert [r.v for r in clean_money(df, ["v"]).orderBy("i").collect()] == [2.5, 0.0, 0.0]


def test_profile_parser(spark):
    vals = ["1 234,56 ₸", "12,345", "(12.5)", "Country 5", "{'a': 1}", "abc", "+7", "1.000.000"]
    df = with_profile_number(spark.createDataFrame([(v,) for v in vals], "v string"), "v", "p")
    got = [(r.p.value, r.p.has_decimal) if r.p else None for r in df.collect()]
    assert got == [(1234.56, True), (12345.0, False), (-12.5, True), (5.0, False), None, None, (7.0, False),
                   (1000000.0, False)]


def test_dates(spark):
    vals = ["2024-01-31", "31.01.2024", "31/01/2024", "2024-01-02 10:00:00", "2024-01-02 10:30:00.000000 +03:00",
            "2024/1/3", "31-01-2024", "", "junk", "2024-02-30", "2024-01-02T08:00:00Z"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(parse_date_text(F.col("v"))).collect()]
    assert got == [datetime(2024, 1, 31), datetime(2024, 1, 31), datetime(2024, 1, 31), datetime(2024, 1, 2, 10),
                   datetime(2024, 1, 2, 7, 30), datetime(2024, 1, 3), datetime(2024, 1, 31), None, None, None,
                   datetime(2024, 1, 2, 8)]


def test_categories_and_signed_amounts(spark):
    rows = [("a", " Food ", "100"), ("b", "", "-40"), ("c", "None", "(10)"), ("d", " NULL ", "n/a"),
            ("e", f"{NB}nan{NB}", "5")]
    df = spark.createDataFrame(rows, "id string, cat string, amt string")
    led = prepare(df, Roles(amount="amt", category=["cat", "id"]))
    got = {r.category: (r.amount, r.revenue, r.expenses) for r in led.df.collect()}
    assert got == {"Food / a": (100.0, 100.0, 0.0), "Uncategorized / b": (-40.0, 0.0, 40.0),
                   "Uncategorized / c": (-10.0, 0.0, 10.0), "Uncategorized / d": (0.0, 0.0, 0.0),
                   "Uncategorized / e": (5.0, 5.0, 0.0)}
    assert (led.has_revenue, led.has_expenses, led.amount_only) == (True, True, True)


def test_dotted_and_spaced_column_names(spark):
    df = spark.createDataFrame([("01.01.2026", "1 000,5", "a"), ("02.01.2026", "n/a", "b")],
                               "`Op.Date` string, `Total.Price (₸)` string, `Kind.Name` string")
    led = prepare(df, Roles(date="Op.Date", revenue="Total.Price (₸)", category="Kind.Name"))
    got = sorted((str(r.ts.date()), r.revenue, r.category) for r in led.df.collect())
    assert got == [("2026-01-01", 1000.5, "a"), ("2026-01-02", 0.0, "b")]


def test_role_columns_that_do_not_exist_are_named(spark):
    df = spark.createDataFrame([("2024-01-01", "1")], "day string, income string")
    for build in (prepare, raw_rollup):
        with pytest.raises(ValueError, match="incmoe"):
            build(df, Roles(date="day", revenue="incmoe"))
        build(df, Roles(date="day", revenue="income"))


def test_usual_cells_are_read_as_by_the_full_parsers(spark):
    """Dates and amounts of the usual forms skip the full parsers of a rollup, with the same result."""
    from tallyframe.functions import dates, money
    from tallyframe.operators import partials
    texts = [None, "", " ", "2024-02-29", "2023-02-29", "2023/04/31", "2024.12.01", "0000-01-01", "2024-13-01", "2024-1-5", "31.12.2023",
             "29-02-2023", "01/02/2024", "12/31/2024", "13.13.2024", "31.04.2024", "2024-01-31 10:00", " 2024-01-31", "2024-01-31\n", "31.12.23",
             "5", "-5", "+5", "0", "-0", "-0.00", "007", "1.5", "1.50", "1.500", "-12.34", "1.", ".5", "1,5", "-1,50", "1,500", "1.234,56",
             "1,234.56", "(5)", "(1,5)", "$5", "5 руб.", "1e5", "inf", "nan", "5 ", "5\n", "--5", "1,5\n", "12345678901234567890.12"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    seen = partials._with_money(partials._with_ts(df, "c", "t"), "c", 0)
    full = money.with_clean_money_text(dates.with_ledger_ts(df, "c", "t"), "c", "clean").withColumn(
        "direct", money.direct_number(F.col("c")))
    full = full.withColumn("dirty", F.coalesce(F.col("direct").isNull() & (money.utrim(F.col("c")) != ""), F.lit(False)))
    got = {r.c: (r.t, r["__clean0"], r["__direct0"], r["__dirty0"]) for r in seen.select("c", F.col("t").cast("string").alias("t"), "__clean0", "__direct0", "__dirty0").collect()}
    want = {r.c: (r.t, r.clean, r.direct, r.dirty) for r in full.select("c", F.col("t").cast("string").alias("t"), "clean", "direct", "dirty").collect()}
    assert got == want and len(got) == len(texts)


def test_staged_rollup_reads_the_ledger_once(spark):
    """The sums of a key serve its decisions and its rows; they used to be taken twice."""
    df = spark.createDataFrame([("a", "2024-01-31", "5.00", "x"), ("a", "01.02.2024", "-2,50", "y"), ("b", "bad", "1.25", "x")],
                               "shop string, day string, price string, kind string")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    roles = Roles(date="day", amount="price", category="kind")
    rows = lambda d, **how: sorted(map(str, raw_rollup(d, roles, ["shop"], "month", **how).collect()))
    got = rows(df.mapInArrow(seen, df.schema), staged=True)
    assert read.value == 3
    # a: total, two categories and two periods; b has no valid date: total and category
    assert got == rows(df) and len(got) == 7
