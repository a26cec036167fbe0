"""Queries over totals, preparation splits and categories (M, P6-P10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import metrics
from tallyframe.operators.prepare import prepare
from tallyframe.plans import views
from tallyframe.plans.registry import query, r
from tallyframe.plans.sql_views import ORDERS, SALES
from tallyframe.roles import Roles

_COUNTS = ("revenue_column_count", "expense_column_count", "amount_column_count",
           "category_column_count")


def _basic(m):
    return m.select("transaction_count", r("total_revenue"), r("total_expenses"), r("total_profit"),
                    r("average_revenue", 4), r("average_expense", 4), *_COUNTS)


@query("q_basic_metrics", f"""WITH {SALES}
SELECT count(*)::BIGINT AS transaction_count, round(sum(revenue), 2) AS total_revenue,
       round(sum(expenses), 2) AS total_expenses, round(sum(revenue) - sum(expenses), 2) AS total_profit,
       round(sum(revenue) / count(*), 4) AS average_revenue, round(sum(expenses) / count(*), 4) AS average_expense,
       1::BIGINT AS revenue_column_count, 1::BIGINT AS expense_column_count,
       0::BIGINT AS amount_column_count, 1::BIGINT AS category_column_count
FROM sales""")
def q_basic_metrics(spark, sf):
    """M1-M2, M6: totals, per-transaction averages and column counts of the sales ledger."""
    return _basic(metrics.basic_metrics(views.sales(spark, sf)))


def _period(m, *keys):
    return m.select(*keys, "date_min", "date_max", "period_days", r("average_daily_revenue", 4),
                    r("average_daily_expense", 4), r("average_daily_profit", 4))


_PERIOD_SQL = """CAST(min(ts) AS TIMESTAMP) AS date_min, CAST(max(ts) AS TIMESTAMP) AS date_max,
       greatest(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1, 1)::BIGINT AS period_days,
       round(sum(revenue) / greatest(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1, 1), 4) AS average_daily_revenue,
       round(sum(expenses) / greatest(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1, 1), 4) AS average_daily_expense,
       round((sum(revenue) - sum(expenses)) / greatest(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1, 1), 4) AS average_daily_profit"""


@query("q_period_metrics", f"WITH {SALES}\nSELECT {_PERIOD_SQL} FROM sales")
def q_period_metrics(spark, sf):
    """M3-M5: date range, period days and daily averages of the sales ledger."""
    return _period(metrics.basic_metrics(views.sales(spark, sf)))


@query("q_metrics_keyed", f"""WITH {SALES}
SELECT k AS l_linestatus, count(*)::BIGINT AS transaction_count, round(sum(revenue), 2) AS total_revenue,
       round(sum(expenses), 2) AS total_expenses, round(sum(revenue) - sum(expenses), 2) AS total_profit,
       round(sum(revenue) / count(*), 4) AS average_revenue, round(sum(expenses) / count(*), 4) AS average_expense,
       {_PERIOD_SQL}
FROM sales GROUP BY k""")
def q_metrics_keyed(spark, sf):
    """M1-M5 per key: totals, averages and date range per line status."""
    m = metrics.basic_metrics(views.sales(spark, sf, keyed=True))
    return m.select("l_linestatus", "transaction_count", r("total_revenue"), r("total_expenses"),
                    r("total_profit"), r("average_revenue", 4), r("average_expense", 4),
                    "date_min", "date_max", "period_days", r("average_daily_revenue", 4),
                    r("average_daily_expense", 4), r("average_daily_profit", 4))


def _events_signed(spark, sf):
    ev = views.table(spark, sf, "events")
    return ev.select("ts", "event_type", F.when(F.col("event_type") == "error", -F.col("value"))
                     .otherwise(F.col("value")).alias("signed_value"))


@query("q_signed_split", """SELECT event_type AS category, count(*)::BIGINT AS transaction_count,
       round(sum(s), 2) AS amount, round(sum(greatest(s, 0.0)), 2) AS revenue,
       round(sum(abs(least(s, 0.0))), 2) AS expenses
FROM (SELECT event_type, CASE WHEN event_type = 'error' THEN -value ELSE value END AS s FROM events)
GROUP BY event_type""")
def q_signed_split(spark, sf):
    """A signed amount column splits into revenue and expenses."""
    led = prepare(_events_signed(spark, sf), Roles(date="ts", amount="signed_value", category="event_type"))
    return led.df.groupBy("category").agg(
        F.count(F.lit(1)).alias("transaction_count"), r(F.sum("amount"), 2, "amount"),
        r(F.sum("revenue"), 2, "revenue"), r(F.sum("expenses"), 2, "expenses"))


@query("q_multi_money", """SELECT l_returnflag AS category, count(*)::BIGINT AS transaction_count,
       round(sum(coalesce(l_extendedprice, 0) + coalesce(l_tax, 0)), 2) AS revenue,
       round(sum(coalesce(l_discount, 0)), 2) AS expenses,
       round(sum(c_acct), 2) AS amount,
       round(sum(coalesce(l_extendedprice, 0) + coalesce(l_tax, 0) + greatest(c_acct, 0)), 2) AS revenue_with_amount,
       round(sum(coalesce(l_discount, 0) + abs(least(c_acct, 0))), 2) AS expenses_with_amount
FROM (SELECT *, l_quantity - 25.0 AS c_acct FROM lineitem) GROUP BY l_returnflag""")
def q_multi_money(spark, sf):
    """Several revenue columns sum row-wise; an amount column adds its
    positive part to revenue and its negative part to expenses."""
    li = views.table(spark, sf, "lineitem").withColumn("c_acct", F.col("l_quantity") - 25.0)
    plain = prepare(li, Roles(revenue=["l_extendedprice", "l_tax"], expense="l_discount",
                              category="l_returnflag"))
    both = prepare(li, Roles(revenue=["l_extendedprice", "l_tax"], expense="l_discount",
                             amount="c_acct", category="l_returnflag"))
    a = plain.df.groupBy("category").agg(F.count(F.lit(1)).alias("transaction_count"),
                                         r(F.sum("revenue"), 2, "revenue"), r(F.sum("expenses"), 2, "expenses"))
    b = both.df.groupBy("category").agg(r(F.sum("amount"), 2, "amount"),
                                        r(F.sum("revenue"), 2, "revenue_with_amount"),
                                        r(F.sum("expenses"), 2, "expenses_with_amount"))
    return a.join(b, "category")


def _cats(df):
    return df.select("category", "transaction_count", r("revenue"), r("expenses"), r("profit"))


@query("q_category_breakdown", f"""WITH {ORDERS}
SELECT category, count(*)::BIGINT AS transaction_count, round(sum(revenue), 2) AS revenue,
       round(sum(0.0::DOUBLE), 2) AS expenses, round(sum(revenue), 2) AS profit
FROM ords GROUP BY category""")
def q_category_breakdown(spark, sf):
    """M7: count and sums per order priority."""
    return _cats(metrics.category_breakdown(views.orders(spark, sf)))


@query("q_top_categories", """SELECT category, transaction_count, round(revenue, 2) AS revenue,
       round(expenses, 2) AS expenses, round(profit, 2) AS profit, rank
FROM (SELECT *, row_number() OVER (ORDER BY abs(profit) DESC, category)::BIGINT AS rank FROM (
  SELECT CAST(o_custkey AS VARCHAR) AS category, count(*)::BIGINT AS transaction_count,
         sum(o_totalprice) AS revenue, sum(0.0::DOUBLE) AS expenses, sum(o_totalprice) AS profit
  FROM orders GROUP BY o_custkey)) WHERE rank <= 25""")
def q_top_categories(spark, sf):
    """M8: the 25 customers with the largest |profit| (one ledger → TakeOrdered)."""
    o = views.table(spark, sf, "orders")
    led = prepare(o, Roles(date="o_orderdate", revenue="o_totalprice", category="o_custkey"))
    return metrics.top_categories(led, 25).select(
        "category", "transaction_count", r("revenue"), r("expenses"), r("profit"), "rank")


@query("q_top_categories_keyed", f"""WITH {SALES}
SELECT k AS l_linestatus, category, transaction_count, round(revenue, 2) AS revenue,
       round(expenses, 2) AS expenses, round(profit, 2) AS profit, rank
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY abs(profit) DESC, category)::BIGINT AS rank FROM (
  SELECT k, CAST(l_partkey AS VARCHAR) AS category, count(*)::BIGINT AS transaction_count,
         sum(revenue) AS revenue, sum(expenses) AS expenses, sum(revenue - expenses) AS profit
  FROM sales GROUP BY k, l_partkey)) WHERE rank <= 5""")
def q_top_categories_keyed(spark, sf):
    """M8 per key: top 5 parts per line status (WindowGroupLimit)."""
    li = views.table(spark, sf, "lineitem").withColumn("expense_value", views.sales_expense())
    led = prepare(li, Roles(date="l_shipdate", revenue="l_extendedprice", expense="expense_value",
                            category="l_partkey"), keys=["l_linestatus"])
    return metrics.top_categories(led, 5).select(
        "l_linestatus", "category", "transaction_count", r("revenue"), r("expenses"), r("profit"), "rank")


_DIRTY_CATEGORY = """CASE l_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN ' None ' WHEN 2 THEN 'NULL '
     WHEN 3 THEN chr(160) || l_returnflag || chr(160) WHEN 4 THEN 'nan' ELSE l_returnflag END"""


def _dirty_category(col="l_returnflag"):
    k = F.col("l_orderkey") % 6
    nb = " "
    return (F.when(k == 0, F.lit("")).when(k == 1, F.lit(" None ")).when(k == 2, F.lit("NULL "))
            .when(k == 3, F.concat(F.lit(nb), F.col(col), F.lit(nb))).when(k == 4, F.lit("nan"))
            .otherwise(F.col(col)))


@query("q_category_clean", f"""SELECT CASE WHEN trim(c, ' ' || chr(160)) = '' OR lower(trim(c, ' ' || chr(160))) IN ('nan', 'none', 'null')
            THEN 'Uncategorized' ELSE trim(c, ' ' || chr(160)) END AS category,
       count(*)::BIGINT AS transaction_count, round(sum(l_extendedprice), 2) AS revenue
FROM (SELECT *, {_DIRTY_CATEGORY} AS c FROM lineitem) GROUP BY 1""")
def q_category_clean(spark, sf):
    """Blank / None / NULL / nan and NBSP padding."""
    li = views.table(spark, sf, "lineitem").withColumn("cat", _dirty_category())
    led = prepare(li, Roles(revenue="l_extendedprice", category="cat"))
    return metrics.category_breakdown(led).select("category", "transaction_count", r("revenue"))


@query("q_category_multi", f"""SELECT category, count(*)::BIGINT AS transaction_count, round(sum(l_extendedprice), 2) AS revenue
FROM (SELECT *, (CASE WHEN trim(c, ' ' || chr(160)) = '' OR lower(trim(c, ' ' || chr(160))) IN ('nan', 'none', 'null')
            THEN 'Uncategorized' ELSE trim(c, ' ' || chr(160)) END) || ' / ' || l_linestatus AS category
      FROM (SELECT *, {_DIRTY_CATEGORY} AS c FROM lineitem)) GROUP BY category""")
def q_category_multi(spark, sf):
    """P10: two category columns joined with ' / '."""
    li = views.table(spark, sf, "lineitem").withColumn("cat", _dirty_category())
    led = prepare(li, Roles(revenue="l_extendedprice", category=["cat", "l_linestatus"]))
    return metrics.category_breakdown(led).select("category", "transaction_count", r("revenue"))


@query("q_ledger_rollup", f"""WITH {SALES}
SELECT k AS l_linestatus, category, CAST(date_trunc('month', ts) AS TIMESTAMP) AS period,
       CASE GROUPING(category, date_trunc('month', ts)) WHEN 3 THEN 'total' WHEN 1 THEN 'category' ELSE 'period' END AS level,
       count(*)::BIGINT AS transaction_count, round(sum(revenue), 2) AS revenue, round(sum(expenses), 2) AS expenses,
       round(sum(revenue - expenses), 2) AS profit
FROM sales GROUP BY GROUPING SETS ((k), (k, category), (k, date_trunc('month', ts)))""")
def q_ledger_rollup(spark, sf):
    """analyze()'s single-scan aggregate: totals, categories and monthly points per key."""
    led = views.sales(spark, sf, keyed=True)
    roll = metrics.ledger_rollup(led, "month")
    return roll.select("l_linestatus", "category", "period", "level", "transaction_count", r("revenue"),
                       r("expenses"), r("profit"))
