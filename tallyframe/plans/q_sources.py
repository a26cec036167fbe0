"""Source and sink queries over files staged from ``orders``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators import metrics
from tallyframe.operators.detection import detect_roles
from tallyframe.operators.prepare import prepare
from tallyframe.plans import staging, views
from tallyframe.plans.registry import query, r
from tallyframe.roles import Roles
from tallyframe.session import shared_path
from tallyframe.sources import files
from tallyframe.sources.workbook import read_workbooks

_BY_PRIORITY_SQL = """SELECT o_orderpriority AS category, count(*)::BIGINT AS transaction_count,
       round(sum(round(o_totalprice, 2)), 2) AS revenue FROM orders GROUP BY o_orderpriority"""


def _catalog(spark, sf, *variants, n_files=None, **how):
    """The catalog of the named variants' folders (all six by default), of ``n_files`` files each if given."""
    return files.file_catalog(spark, staging.stage_csv(spark, sf, variants or tuple(staging.VARIANTS), n_files), **how)


def _variant(col="path"):
    return F.regexp_extract(F.col(col), r"/csv/([^/]+)/", 1)


def _by_category(led):
    return metrics.category_breakdown(led).select("category", "transaction_count", r("revenue"))


@query("q_csv_scan", """SELECT v.variant, CASE WHEN v.variant = 'late_cp1251' AND o_orderpriority = '5-LOW' THEN 'Низкий'
         ELSE o_orderpriority END AS category, count(*)::BIGINT AS transaction_count,
       round(sum(round(o_totalprice, 2)), 2) AS revenue
FROM orders CROSS JOIN (VALUES ('utf8_comma'), ('pipe'), ('permuted_quotes'), ('late_cp1251')) v(variant) GROUP BY ALL""")
def q_csv_scan(spark, sf):
    """Files of four layouts (another column order, padded names, doubled
    quotes, line ends in quotes, a late cp1251 row) read together by their own headers,
    only the selected columns, money cleaned from text."""
    cat = _catalog(spark, sf, *staging.ENGLISH)
    df = files.read_ledgers(spark, cat, columns=["OrderDate", "TotalPrice", "Priority"])
    led = prepare(df.withColumn("variant", _variant("source_file")),
                  Roles(date="OrderDate", revenue="TotalPrice", category="Priority"), ["variant"], staged=True)
    return metrics.category_breakdown(led).select("variant", "category", "transaction_count", r("revenue"))


@query("q_headerless", _BY_PRIORITY_SQL)
def q_headerless(spark, sf):
    """Headerless tab files get ``Column N`` names; columns picked by position."""
    cat = _catalog(spark, sf, "tab_headerless")
    df = files.read_ledgers(spark, cat, columns=["Column 4", "Column 3"])
    led = prepare(df, Roles(revenue="Column 4", category="Column 3"))
    return _by_category(led)


@query("q_csv_cp1251", """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Срочно' WHEN '2-HIGH' THEN 'Высокий'
         WHEN '3-MEDIUM' THEN 'Средний' WHEN '4-NOT SPECIFIED' THEN 'Не указан' ELSE 'Низкий' END AS category,
       count(*)::BIGINT AS transaction_count, round(sum(round(o_totalprice, 2)), 2) AS revenue
FROM orders GROUP BY 1""")
def q_csv_cp1251(spark, sf):
    """S2/S3 + D + P1: cp1251 ';' files with Russian headers and comma decimals;
    roles detected from the whole files, which are then analysed."""
    cat = _catalog(spark, sf, "cp1251_semicolon")
    df = files.read_ledgers(spark, cat).drop("source_file")
    assign, _ = detect_roles(df)
    chosen = {row.role: row.column for row in assign.collect() if row.column}
    led = prepare(df, Roles(**chosen))
    return _by_category(led)


#: Per staged variant: encoding, delimiter, header, names, quoted line ends.
_VARIANTS_SQL = """(VALUES
  ('utf8_comma', 'utf-8', ',', TRUE, 'OrderID, OrderDate, Priority, TotalPrice, Status', FALSE),
  ('cp1251_semicolon', 'cp1251', ';', TRUE, 'Дата операции, Категория, Сумма дохода, Номер заказа', FALSE),
  ('tab_headerless', 'utf-8', chr(9), FALSE, 'Column 1, Column 2, Column 3, Column 4, Column 5', FALSE),
  ('pipe', 'utf-8', '|', TRUE, 'OrderID, OrderDate, Priority, TotalPrice, Status', FALSE),
  ('permuted_quotes', 'utf-8', ',', TRUE, 'TotalPrice, Priority, Note, OrderDate', TRUE),
  ('late_cp1251', 'cp1251', ',', TRUE, 'OrderDate, Priority, TotalPrice', FALSE)
) v(variant, encoding, delimiter, has_header, column_names, multi_line)"""


@query("q_header_check", f"""SELECT variant, encoding, delimiter, has_header, column_names, multi_line,
       (SELECT count(*) FROM orders)::BIGINT AS records FROM {_VARIANTS_SQL} WHERE (SELECT count(*) FROM orders) > 0""")
def q_header_check(spark, sf):
    """Per staged CSV variant, the settings and names found for its files, and their records."""
    cat = _catalog(spark, sf)
    return cat.groupBy(_variant().alias("variant"), "encoding", "delimiter", "has_header",
                       F.array_join("column_names", ", ").alias("column_names"), "multi_line").agg(
        F.sum("records").alias("records"))


@query("q_file_catalog", f"""SELECT variant, '.csv' AS extension, 'ok' AS status, encoding, delimiter, has_header,
       len(string_split(column_names, ', '))::BIGINT AS column_count, column_names, (SELECT count(*) FROM orders)::BIGINT AS records,
       TRUE AS several_files, CASE WHEN (SELECT count(*) FROM orders) > 600 THEN '100+ (fast preview)' END AS row_count_text
FROM {_VARIANTS_SQL}
UNION ALL SELECT variant, '.csv', 'ok', 'utf-8', ',', TRUE, 2, name || ', TotalPrice', (SELECT count(*) FROM orders),
       TRUE, '100+ (fast preview)'
FROM (VALUES ('long_name', repeat('note, ', 2500) || 'x'), ('many_quotes', repeat('"', 50000))) o(variant, name)
UNION ALL SELECT 'workbooks', '.xlsx', 'ok', NULL, NULL, NULL, 0, NULL, NULL, TRUE, NULL""")
def q_file_catalog(spark, sf):
    """The catalog of every staged CSV file and workbook, by variant; files whose
    names are very long or full of quotes leave the others alone."""
    cat = files.file_catalog(spark, [*staging.stage_csv(spark, sf), staging.stage_workbooks(spark, sf)])
    variant = F.when(F.col("extension") == ".xlsx", F.lit("workbooks")).otherwise(_variant())
    return cat.groupBy(variant.alias("variant"), "extension", "status", "encoding", "delimiter", "has_header",
                       F.coalesce("column_count", F.lit(0)).cast("bigint").alias("column_count"),
                       F.array_join("column_names", ", ").alias("column_names"), "row_count_text").agg(
        F.sum("records").alias("records"), (F.count(F.lit(1)) >= 3).alias("several_files"))


@query("q_kept_catalog", """SELECT 'ok' AS status, (SELECT count(*) FROM orders)::BIGINT AS records, TRUE AS several_files,
       0::BIGINT AS judged_again""")
def q_kept_catalog(spark, sf):
    """The catalog of unchanged files, from the kept rows of an earlier run alone."""
    folder = staging.stage_csv(spark, sf, ("pipe",))
    kept = shared_path(spark, "kept", uuid.uuid4().hex)
    first = files.file_catalog(spark, folder, kept=kept)
    again = files.file_catalog(spark, folder, kept=kept)
    rows = spark.read.parquet(kept).count() - first.count()
    return again.groupBy("status").agg(F.sum("records").alias("records"), (F.count(F.lit(1)) >= 3).alias("several_files")) \
        .withColumn("judged_again", F.lit(rows).cast("bigint"))


@query("q_record_issues", f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % {staging.RAGGED_PARTS} AS part FROM orders),
l AS (SELECT part, max(k) AS last FROM o GROUP BY part),
t AS (SELECT part, k, (k = last AND part % 2 = 1) AS spoilt FROM o JOIN l USING (part))
SELECT part::BIGINT AS part, count(*)::BIGINT AS records, count(*) FILTER (WHERE NOT spoilt AND k % 10 = 0)::BIGINT AS short,
       count(*) FILTER (WHERE NOT spoilt AND k % 10 = 1)::BIGINT AS long, part % 2 = 1 AS odd_quotes, 0::BIGINT AS lines_in_quotes
FROM t GROUP BY part""")
def q_record_issues(spark, sf):
    """Short and overlong rows and quotes that nothing closes, counted per file."""
    cat = files.file_catalog(spark, staging.stage_ragged(spark, sf))
    found = files.record_issues(spark, cat)
    return found.select(F.regexp_extract("source_file", r"/part=(\d+)/", 1).cast("bigint").alias("part"), "records", "short",
                        "long", "odd_quotes", "lines_in_quotes")


@query("q_file_metrics", """SELECT v.variant, count(*)::BIGINT AS transaction_count, round(sum(round(o_totalprice, 2)), 2) AS total_revenue,
       0.0::DOUBLE AS total_expenses
FROM orders CROSS JOIN (VALUES ('utf8_comma'), ('permuted_quotes')) v(variant) GROUP BY ALL""")
def q_file_metrics(spark, sf):
    """M9: totals per file in one call, from paths and role columns."""
    from tallyframe.plans.analyze import file_metrics
    per_file = file_metrics(spark, staging.stage_csv(spark, sf, ("utf8_comma", "permuted_quotes")),
                            Roles(date="OrderDate", amount="TotalPrice", category="Priority"))
    return per_file.groupBy(_variant("source_file").alias("variant")).agg(
        F.sum("transaction_count").alias("transaction_count"), r(F.sum("total_revenue"), 2, "total_revenue"),
        r(F.sum("total_expenses"), 2, "total_expenses"))


@query("q_all_categories_ranked", """SELECT category, transaction_count, revenue, rank FROM (
  SELECT o_clerk AS category, count(*)::BIGINT AS transaction_count, round(sum(o_totalprice), 2) AS revenue,
         row_number() OVER (ORDER BY round(sum(o_totalprice), 2) DESC, o_clerk)::BIGINT AS rank FROM
  (SELECT 'C' || o_orderkey AS o_clerk, o_totalprice FROM orders) GROUP BY 1)""")
def q_all_categories_ranked(spark, sf):
    """M8 without a limit: as many categories as rows, ranked over all partitions."""
    from tallyframe.operators._keys import top_k
    o = views.table(spark, sf, "orders").select(F.concat(F.lit("C"), F.col("o_orderkey")).alias("category"), "o_totalprice")
    rows = o.groupBy("category").agg(F.count("*").alias("transaction_count"), r(F.sum("o_totalprice"), 2, "revenue"))
    return top_k(rows, [], [F.col("revenue").desc(), F.col("category").asc()], None)


@query("q_preview", """SELECT variant, 300::BIGINT AS rows, 3::BIGINT AS files, '100+ (fast preview)' AS row_count_text,
       300::BIGINT AS in_orders, least(count(*), 100)::BIGINT AS last_row_no
FROM orders CROSS JOIN (VALUES ('utf8_comma'), ('pipe')) v(variant) GROUP BY variant""")
def q_preview(spark, sf):
    """The first 100 records of every file, each found in the table that the files
    were written from, with its own price."""
    cat = _catalog(spark, sf, "utf8_comma", "pipe", n_files=3, heads_only=True)
    p = files.preview_files(spark, cat)
    cell = lambda name: F.element_at("cells", F.array_position("column_names", name).cast("int"))
    p = p.select("source_file", "row_no", "row_count_text", cell("OrderID").cast("bigint").alias("key"),
                 cell("TotalPrice").cast("double").alias("price"))
    o = views.table(spark, sf, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("total"))
    same = p.join(o, F.col("key") == F.col("o_orderkey"), "left")
    return same.groupBy(_variant("source_file").alias("variant"), "row_count_text").agg(
        F.count("*").alias("rows"), F.count_distinct("source_file").alias("files"),
        F.count_if(F.abs(F.col("total") - F.col("price")) < 0.006).alias("in_orders"),
        F.max("row_no").alias("last_row_no"))


@query("q_workbooks", """SELECT o_orderpriority AS category, count(*)::BIGINT AS transaction_count,
       round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY o_orderpriority""")
def q_workbooks(spark, sf):
    """Workbooks staged from orders (one per task), read back and analysed."""
    path = staging.stage_workbooks(spark, sf)
    df = read_workbooks(spark, path).drop("source_file")
    led = prepare(df, Roles(date="OrderDate", revenue="TotalPrice", category="Priority"))
    return _by_category(led)


def _sink_sql() -> str:
    from tallyframe.plans.q_report import _report_sql
    return (f"SELECT section, section_order::BIGINT AS section_order, row_no::BIGINT AS row_no, col_no::BIGINT AS col_no, "
            f"value FROM ({_report_sql('ru')})")


@query("q_report_sink", _sink_sql())
def q_report_sink(spark, sf):
    """The brief report written as ';' CSV to a new folder of the shared one, and
    every cell read back."""
    from tallyframe.plans.q_report import q_report_rows
    out = shared_path(spark, "report", uuid.uuid4().hex)
    rows = q_report_rows(spark, sf)
    files.write_report(rows, out, keys=["section"])
    back = (spark.read.schema(T.StructType([f for f in rows.schema.fields if f.name != "section"] +
                                           [T.StructField("section", T.StringType())]))
            .option("sep", ";").option("header", "true").option("multiLine", "true").option("escape", '"').csv(out))
    return back.select("section", "section_order", "row_no", "col_no", "value")


_FLEET_ROLES = """(VALUES
  ('utf8_comma', 'amount=TotalPrice, category=Status, date=OrderDate'),
  ('pipe', 'amount=TotalPrice, category=Status, date=OrderDate'),
  ('tab_headerless', 'amount=Column 4, date=Column 2'),
  ('cp1251_semicolon', 'category=Категория, date=Дата операции, revenue=Сумма дохода'),
  ('permuted_quotes', 'amount=TotalPrice, category=Priority, date=OrderDate'),
  ('late_cp1251', 'amount=TotalPrice, category=Priority, date=OrderDate')) v(variant, roles)"""


@query("q_auto_fleet", f"""SELECT variant, roles, count(*)::BIGINT AS transaction_count,
       round(sum(round(o_totalprice, 2)), 2) AS total_revenue, 0.0::DOUBLE AS total_expenses, 3::BIGINT AS files
FROM orders CROSS JOIN {_FLEET_ROLES} GROUP BY ALL""")
def q_auto_fleet(spark, sf):
    """O2 over a fleet of files: every staged CSV variant gets its own roles, each file
    is read once to detect and once to analyse; totals by variant and roles."""
    from tallyframe.plans.analyze import fleet_analysis
    fleet = fleet_analysis(spark, _catalog(spark, sf, n_files=3), grain="month")
    basic = fleet.basic.select("source_file", "transaction_count", "total_revenue", "total_expenses", "roles")
    return basic.groupBy(_variant("source_file").alias("variant"), "roles").agg(
        F.sum("transaction_count").alias("transaction_count"), r(F.sum("total_revenue"), 2, "total_revenue"),
        r(F.sum("total_expenses"), 2, "total_expenses"), F.count("*").alias("files"))


def _file_report_sql(lang: str = "en") -> str:
    """DuckDB text of ``q_file_report``: the detailed daily report of the staged
    order files read as an amount-only ledger (amount = TotalPrice, category =
    Status, date = OrderDate — the roles detection assigns to these files)."""
    from tallyframe.plans.q_insights import _half_sql, _last_change_sql, lbl, money_sql, pct_sql, series_lbl_sql, tmpl_sql
    from tallyframe.plans.q_report import count_sql
    from tallyframe.plans.sql_views import anomaly_ctes, forecast_ctes, points
    view = """oa AS (SELECT o_orderdate AS ts, round(o_totalprice, 2) AS amount,
         greatest(round(o_totalprice, 2), 0.0) AS revenue, abs(least(round(o_totalprice, 2), 0.0)) AS expenses,
         o_orderstatus AS category FROM orders)"""
    L = lambda key: lbl(lang, key)
    money = money_sql
    days = "greatest(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1, 1)"

    def cells(order, section, rows):
        return " UNION ALL ".join(f"SELECT {order}::BIGINT AS section_order, '{section}' AS section, {r}::BIGINT AS row_no, "
                                  f"{c}::BIGINT AS col_no, {v} AS value FROM m" for r, c, v in rows)

    period = f"strftime(a, '%d.%m.%Y') || ' — ' || strftime(b, '%d.%m.%Y') || ' (' || {count_sql('d')} || ')'"
    src = cells(1, "source", [(0, 0, L("source_file")), (0, 1, "'orders.csv'"), (1, 0, L("source_period")),
                              (1, 1, period), (2, 0, L("source_transactions")), (2, 1, count_sql("n")),
                              (3, 0, L("source_grouping")), (3, 1, L("grouping_day"))])
    summary = [("metric_transactions", count_sql("n")), ("metric_amount", money("rv - ex")),
               ("metric_average_daily_profit", money("(rv - ex) / d")), ("metric_average_revenue", money("rv / n")),
               ("metric_average_expense", money("ex / n")), ("metric_period_days", count_sql("d")),
               ("metric_average_daily_revenue", money("rv / d")), ("metric_average_daily_expense", money("ex / d")),
               ("metric_revenue_fields", "'0'"), ("metric_expense_fields", "'0'"), ("metric_amount_fields", "'1'"),
               ("metric_category_fields", "'1'")]
    summ = cells(2, "summary", [x for i, (k, v) in enumerate(summary) for x in ((i, 0, L(k)), (i, 1, v))])
    kind = f"CASE kind WHEN 'drop' THEN {L('anomaly_drop')} ELSE {L('anomaly_spike')} END"
    sev = f"CASE severity WHEN 'High' THEN {L('severity_high')} ELSE {L('severity_medium')} END"
    method = (f"CASE method WHEN 'linear_trend' THEN {L('forecast_method_linear_trend')} "
              f"ELSE {L('forecast_method_moving_average')} END")
    an_text = tmpl_sql(lang, "insight_anomalies", count="CAST(total_found AS VARCHAR)", kind=kind,
                       series=series_lbl_sql(lang, "series"), date="strftime(period, '%d.%m.%Y')")
    fc_text = tmpl_sql(lang, "insight_forecast", series=series_lbl_sql(lang, "series"), value=money("value"))
    heads = lambda keys: ", ".join(f"({i}, {L(k)})" for i, k in enumerate(keys))
    an_ctes = anomaly_ctes(view, "oa", "day", amount_only=True)
    fc_ctes = forecast_ctes(view, "oa", "day", amount_only=True)
    return f"""WITH {view}, p AS ({points('oa', 'day')}), {_last_change_sql('', lang)}, {_half_sql('', lang)},
m AS (SELECT count(*) AS n, sum(revenue) AS rv, sum(expenses) AS ex, min(ts) AS a, max(ts) AS b, {days} AS d FROM oa),
c AS (SELECT category, count(*) AS cn, sum(revenue) AS crv, sum(expenses) AS cex, sum(revenue - expenses) AS cpf,
        row_number() OVER (ORDER BY abs(sum(revenue - expenses)) DESC, category) AS rank FROM oa GROUP BY category),
cb AS (SELECT * FROM c WHERE rank <= 25),
cs_g AS (SELECT sum(abs(crv) + abs(cex)) AS total, arg_max(category, abs(crv) + abs(cex)) AS leader,
           max(abs(crv) + abs(cex)) AS lt FROM cb),
cs AS (SELECT 3::BIGINT AS rule_order, 'category_concentration' AS rule, lt / total * 100 AS value,
         {tmpl_sql(lang, 'insight_category_share', name='leader', percent=pct_sql('lt / total * 100'))} AS text
       FROM cs_g WHERE total > 1e-9 AND lt / total * 100 >= 25),
br AS (SELECT 5::BIGINT AS rule_order, 'burn_rate' AS rule, ex / d AS value,
         {tmpl_sql(lang, 'insight_burn_rate', value=money('ex / d'))} AS text FROM m WHERE ex / d > 0
       UNION ALL SELECT 6::BIGINT, 'cash_gap', (rv - ex) / d,
         {tmpl_sql(lang, 'insight_cash_gap', value=money('abs((rv - ex) / d)'))} FROM m WHERE (rv - ex) / d < 0),
allr AS (SELECT * FROM lc UNION ALL SELECT * FROM ht UNION ALL SELECT * FROM cs UNION ALL SELECT * FROM br
         UNION ALL SELECT * FROM (WITH {an_ctes} SELECT 4::BIGINT AS rule_order, 'anomaly_summary' AS rule,
                                  CAST(total_found AS DOUBLE) AS value, {an_text} AS text FROM ar WHERE rank = 1)
         UNION ALL SELECT * FROM (WITH {fc_ctes} SELECT 7::BIGINT AS rule_order, 'forecast_summary' AS rule, value,
                                  {fc_text} AS text FROM fc WHERE step = 0 AND series IN ('profit', 'amount', 'revenue')
                                  ORDER BY CASE series WHEN 'profit' THEN 0 WHEN 'amount' THEN 1 ELSE 2 END LIMIT 1)),
ins AS (SELECT row_number() OVER (ORDER BY rule_order)::BIGINT AS position, text FROM allr QUALIFY position <= 6),
pr AS (SELECT *, row_number() OVER (ORDER BY period) AS rn FROM p)
{src}
UNION ALL {summ}
UNION ALL SELECT 3, 'insights', position, 0, text FROM ins
UNION ALL SELECT * FROM (WITH {fc_ctes}
      SELECT 4::BIGINT, 'forecast', 0::BIGINT, 0::BIGINT, {L('header_indicator')}
      UNION ALL SELECT 4, 'forecast', 0, step + 1, strftime(min(period), '%d.%m.%Y') FROM fc GROUP BY step
      UNION ALL SELECT 4, 'forecast', 0, 4, {L('header_method')}
      UNION ALL SELECT 4, 'forecast', series_order + 1, 0, {series_lbl_sql(lang, 'series')} FROM fc WHERE step = 0
      UNION ALL SELECT 4, 'forecast', series_order + 1, step + 1, {money('value')} FROM fc
      UNION ALL SELECT 4, 'forecast', series_order + 1, 4, {method} FROM fc WHERE step = 0)
UNION ALL SELECT 5::BIGINT, 'categories', 0::BIGINT, c::BIGINT, h FROM (VALUES {heads(['header_category', 'header_transactions', 'header_revenue', 'header_expenses', 'header_profit'])}) t(c, h)
UNION ALL SELECT 5, 'categories', rank, 0, category FROM cb
UNION ALL SELECT 5, 'categories', rank, 1, {count_sql('cn')} FROM cb
UNION ALL SELECT 5, 'categories', rank, 2, {money('crv')} FROM cb
UNION ALL SELECT 5, 'categories', rank, 3, {money('cex')} FROM cb
UNION ALL SELECT 5, 'categories', rank, 4, {money('cpf')} FROM cb
UNION ALL SELECT * FROM (WITH {an_ctes}
      SELECT 6::BIGINT, 'anomalies', 0::BIGINT, c::BIGINT, h FROM (VALUES {heads(['header_period', 'header_indicator', 'header_kind', 'header_value', 'header_baseline', 'header_severity'])}) t(c, h)
             WHERE (SELECT count(*) FROM ar) > 0
      UNION ALL SELECT 6, 'anomalies', rank, 0, strftime(period, '%d.%m.%Y') FROM ar WHERE rank <= 8
      UNION ALL SELECT 6, 'anomalies', rank, 1, {series_lbl_sql(lang, 'series')} FROM ar WHERE rank <= 8
      UNION ALL SELECT 6, 'anomalies', rank, 2, {kind} FROM ar WHERE rank <= 8
      UNION ALL SELECT 6, 'anomalies', rank, 3, {money('value')} FROM ar WHERE rank <= 8
      UNION ALL SELECT 6, 'anomalies', rank, 4, {money('baseline')} FROM ar WHERE rank <= 8
      UNION ALL SELECT 6, 'anomalies', rank, 5, {sev} FROM ar WHERE rank <= 8)
UNION ALL SELECT 7::BIGINT, 'periods', 0::BIGINT, c::BIGINT, h FROM (VALUES {heads(['header_period', 'header_amount'])}) t(c, h)
UNION ALL SELECT 7, 'periods', rn, 0, strftime(period, '%d.%m.%Y') FROM pr
UNION ALL SELECT 7, 'periods', rn, 1, {money('amount')} FROM pr"""


@query("q_file_report", _file_report_sql())
def q_file_report(spark, sf):
    """The application's whole action on real files: catalog → read → detect roles
    on all rows → analyse them (day grain) → detailed English report."""
    from tallyframe.operators import report
    from tallyframe.plans.analyze import analyze
    cat = _catalog(spark, sf, "utf8_comma")
    df = files.read_ledgers(spark, cat).drop("source_file")
    assign, _ = detect_roles(df)
    roles = Roles(**{row.role: row.column for row in assign.collect() if row.column})
    return report.build_report(analyze(df, roles, grain="day"), "orders.csv", report.DEPTH_DETAILED, "en") \
        .select("section_order", "section", "row_no", "col_no", "value")
