"""Cleaning queries over the raw-text orders view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.dates import parse_date_text, unreadable
from tallyframe.functions.money import with_profile_number
from tallyframe.operators import metrics
from tallyframe.operators.partials import raw_rollup
from tallyframe.operators.prepare import clean_money, prepare
from tallyframe.plans import views
from tallyframe.plans.registry import query, r
from tallyframe.plans.sql_raw import RAW, clean_sql, date_sql, direct_sql, dirty_sql
from tallyframe.roles import Roles


@query("q_clean_money", f"""WITH {RAW},
flags AS (SELECT bool_or({dirty_sql('money_text')}) AS dm, bool_or({dirty_sql('clean_text')}) AS dc FROM raw),
c AS (SELECT money_kind, money_text, clean_text,
        coalesce(CASE WHEN dm THEN {clean_sql('money_text')} ELSE {direct_sql('money_text')} END, 0.0) AS money,
        coalesce(CASE WHEN dc THEN {clean_sql('clean_text')} ELSE {direct_sql('clean_text')} END, 0.0) AS clean
      FROM raw, flags)
SELECT money_kind, count(*)::BIGINT AS n, round(sum(money), 2) AS money_total, round(sum(clean), 2) AS clean_total,
       count(*) FILTER (WHERE money = 0 AND trim(money_text) <> '')::BIGINT AS coerced_to_zero
FROM c GROUP BY money_kind""")
def q_clean_money(spark, sf):
    """A dirty column is re-read cell by cell; a clean one is read directly.
    ``coerced_to_zero`` counts non-blank cells that became 0."""
    raw = views.raw_orders(spark, sf).withColumn("raw_money", F.col("money_text"))
    c = clean_money(raw, ["money_text", "clean_text"])
    return c.groupBy("money_kind").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("money_text"), 2, "money_total"),
        r(F.sum("clean_text"), 2, "clean_total"),
        F.count_if((F.col("money_text") == 0) & (F.trim("raw_money") != "")).alias("coerced_to_zero"))


def _profile_sql() -> str:
    from tallyframe.plans.sql_detect import has_currency
    return f"""WITH {RAW},
k AS (SELECT money_kind, trim(money_text) AS s, regexp_replace(trim(money_text), '[^0-9,.+()-]', '', 'g') AS kept FROM raw),
n AS (SELECT *, replace(replace(kept, '(', ''), ')', '') AS nums FROM k),
sp AS (SELECT *, CASE WHEN strpos(nums, ',') > 0 AND strpos(nums, '.') > 0 THEN
                   CASE WHEN length(nums) - strpos(reverse(nums), ',') > length(nums) - strpos(reverse(nums), '.') THEN ',' ELSE '.' END
                 WHEN strpos(nums, ',') > 0 THEN CASE WHEN strpos(reverse(nums), ',') - 1 <= 2 THEN ',' ELSE '' END
                 WHEN strpos(nums, '.') > 0 THEN CASE WHEN strpos(reverse(nums), '.') - 1 <= 2 THEN '.' ELSE '' END
                 ELSE '' END AS sep FROM n),
nm AS (SELECT *, replace(CASE WHEN sep = ',' THEN replace(replace(nums, '.', ''), ',', '.')
                              WHEN sep = '.' THEN replace(nums, ',', '')
                              ELSE replace(replace(nums, ',', ''), '.', '') END, '+', '') AS norm0 FROM sp),
sg AS (SELECT *, CASE WHEN starts_with(kept, '(') AND ends_with(kept, ')') AND NOT starts_with(norm0, '-')
                      THEN '-' || norm0 ELSE norm0 END AS norm FROM nm),
pv AS (SELECT money_kind, sep,
         CASE WHEN s = '' OR regexp_matches(s, '[{{}}\\[\\]:]')
                   OR (regexp_matches(lower(s), '[a-zа-я]') AND NOT {has_currency('s')})
                   OR NOT regexp_matches(kept, '\\d') OR NOT regexp_matches(norm, '^-?(\\d+\\.?\\d*|\\.\\d+)$')
              THEN NULL ELSE CAST(norm AS DOUBLE) END AS v FROM sg)
SELECT money_kind, count(*)::BIGINT AS n, count(v)::BIGINT AS parsed, round(sum(v), 2) AS parsed_total,
       count(*) FILTER (WHERE v IS NOT NULL AND sep <> '')::BIGINT AS with_decimal
FROM pv GROUP BY money_kind"""


@query("q_money_parse", _profile_sql())
def q_money_parse(spark, sf):
    """The profiling number parser on every money cell."""
    raw = views.raw_orders(spark, sf)
    p = with_profile_number(raw, "money_text", "p")
    return p.groupBy("money_kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("p.value").alias("parsed"),
        r(F.sum("p.value"), 2, "parsed_total"),
        F.count_if(F.col("p.has_decimal") & F.col("p").isNotNull()).alias("with_decimal"))


@query("q_clean_dates", f"""WITH {RAW}
SELECT date_kind, count(*)::BIGINT AS n, count(ts)::BIGINT AS valid, count(*) FILTER (WHERE ts IS NULL)::BIGINT AS unreadable,
       min(ts) AS first_ts, max(ts) AS last_ts
FROM (SELECT date_kind, {date_sql('date_text')} AS ts FROM raw) GROUP BY date_kind
UNION ALL SELECT 10 + o_orderkey % 5, count(*), count(*), 0, min(o_orderdate + to_hours(h)), max(o_orderdate + to_hours(h))
FROM (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate,
             CASE o_orderkey % 5 WHEN 1 THEN 15 ELSE 0 END AS h FROM orders
      WHERE o_orderkey % 5 <> 4 OR day(o_orderdate) > 12) GROUP BY o_orderkey % 5""")
def q_clean_dates(spark, sf):
    """Every cell read on its own: ISO, day-first, time and offset, and (kinds 10
    to 14) month names in both orders, compact ISO, AM/PM, month-first where the day is
    over 12."""
    raw = views.raw_orders(spark, sf)
    o, d = views.table(spark, sf, "orders"), F.col("o_orderdate")
    kind = F.col("o_orderkey") % 5
    text = (F.when(kind == 0, F.date_format(d, "d MMMM yyyy")).when(kind == 1, F.date_format(d, "MMM d, yyyy '3:00 PM'"))
            .when(kind == 2, F.date_format(d, "yyyyMMdd")).when(kind == 3, F.date_format(d, "yyyy-MM-dd'T12:00:00 AM'"))
            .otherwise(F.date_format(d, "MM/dd/yyyy")))
    more = o.where((kind != 4) | (F.dayofmonth(d) > 12)).select((kind + 10).alias("date_kind"), text.alias("date_text"))
    cells = raw.select("date_kind", "date_text").unionAll(more)
    p = cells.withColumn("ts", parse_date_text(F.col("date_text")))
    return p.groupBy("date_kind").agg(F.count(F.lit(1)).alias("n"), F.count("ts").alias("valid"),
                                      F.count_if(unreadable(F.col("date_text"), F.col("ts"))).alias("unreadable"),
                                      F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("q_first_valid_date", f"""WITH {RAW},
d AS (SELECT o_orderpriority, {date_sql('alt_date')} AS a, {date_sql('date_text')} AS b FROM raw),
pick AS (SELECT o_orderpriority, count(a) > 0 AS use_a FROM d GROUP BY o_orderpriority)
SELECT o_orderpriority, count(ts)::BIGINT AS dated_rows, min(ts) AS date_min, max(ts) AS date_max
FROM (SELECT d.o_orderpriority, CASE WHEN use_a THEN a ELSE b END AS ts FROM d JOIN pick USING (o_orderpriority))
GROUP BY o_orderpriority""")
def q_first_valid_date(spark, sf):
    """P5 per key: the first selected date column with a valid date is used."""
    raw = views.raw_orders(spark, sf)
    roll = raw_rollup(raw, Roles(date=["alt_date", "date_text"], revenue="clean_text"), ["o_orderpriority"])
    return roll.where("level = 'total'").select("o_orderpriority", "dated_rows", "date_min", "date_max")


@query("q_prepared", f"""WITH {RAW},
flags AS (SELECT bool_or({dirty_sql('money_text')}) AS dm FROM raw),
c AS (SELECT o_orderpriority AS category, {date_sql('date_text')} AS ts,
        coalesce(CASE WHEN dm THEN {clean_sql('money_text')} ELSE {direct_sql('money_text')} END, 0.0) AS v
      FROM raw, flags)
SELECT category, count(*)::BIGINT AS transaction_count, round(sum(greatest(v, 0)), 2) AS revenue,
       round(sum(abs(least(v, 0))), 2) AS expenses, round(sum(v), 2) AS amount, count(ts)::BIGINT AS dated_rows
FROM c GROUP BY category""")
def q_prepared(spark, sf):
    """Raw text ledger → prepared ledger (signed amount, dates, category)."""
    raw = views.raw_orders(spark, sf)
    roll = raw_rollup(raw, Roles(date="date_text", amount="money_text", category="o_orderpriority"))
    return roll.where("level = 'category'").select("category", "transaction_count", r("revenue"), r("expenses"),
                                                   r("amount"), "dated_rows")
