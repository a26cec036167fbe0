"""DuckDB text of the ledger views (same definitions as ``views``)."""

SALES = """sales AS (
  SELECT l_linestatus AS k, l_shipdate AS ts, l_extendedprice AS revenue,
         CASE WHEN l_returnflag = 'R' THEN l_extendedprice
              ELSE CAST(CAST(round(l_extendedprice * 100) AS BIGINT)
                        * CAST(round(l_discount * 100) AS BIGINT) // 100 AS DOUBLE) / 100.0::DOUBLE
         END AS expenses,
         CAST(NULL AS DOUBLE) AS amount, l_returnflag AS category, l_orderkey, l_partkey
  FROM lineitem)"""

CASH = """cash AS (
  SELECT ts, CASE WHEN event_type = 'error' THEN -value ELSE value END AS amount,
         greatest(CASE WHEN event_type = 'error' THEN -value ELSE value END, 0.0) AS revenue,
         abs(least(CASE WHEN event_type = 'error' THEN -value ELSE value END, 0.0)) AS expenses,
         event_type AS category
  FROM events)"""

ORDERS = """ords AS (
  SELECT o_orderdate AS ts, o_totalprice AS revenue, CAST(NULL AS DOUBLE) AS expenses,
         CAST(NULL AS DOUBLE) AS amount, o_orderpriority AS category, o_custkey, o_orderstatus
  FROM orders)"""


def period(grain: str, ts: str = "ts", week_start: int = 0) -> str:
    if grain == "week":
        return (f"CAST(CAST({ts} AS DATE) - CAST((((isodow({ts}) - 1 - {week_start}) % 7) + 7) % 7 "
                f"AS INTEGER) AS TIMESTAMP)")
    return f"CAST(date_trunc('{grain}', {ts}) AS TIMESTAMP)"


def points(src: str, grain: str, keys: str = "", week_start: int = 0) -> str:
    """Points CTE body over a view with ts/revenue/expenses/amount."""
    k = f"{keys}, " if keys else ""
    return (f"SELECT {k}{period(grain, 'ts', week_start)} AS period, "
            f"sum(coalesce(revenue, 0.0)) AS revenue, sum(coalesce(expenses, 0.0)) AS expenses, "
            f"sum(coalesce(revenue, 0.0) - coalesce(expenses, 0.0)) AS profit, "
            f"sum(coalesce(amount, 0.0)) AS amount FROM {src} WHERE ts IS NOT NULL "
            f"GROUP BY {k}{period(grain, 'ts', week_start)}")


def visible(pts: str, keys: str = "", amount_only: bool = False, money: bool = True,
            has_amount: bool = False) -> str:
    """Visible series rows (keys, series, series_order) from a points CTE."""
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    if amount_only:
        return f"SELECT DISTINCT {k}'amount' AS series, 3::BIGINT AS series_order FROM {pts}"
    m = "TRUE" if money else "FALSE"
    ha = "TRUE" if has_amount else "FALSE"
    flags = (f"SELECT {k}bool_or(abs(revenue) > 0) AS nr, bool_or(abs(expenses) > 0) AS ne, "
             f"bool_or(abs(profit) > 0) AS np, bool_or(abs(amount) > 0) AS na FROM {pts} {g}")
    return (f"SELECT {k}s.series, s.series_order FROM ({flags}) f, (VALUES ('revenue', 0::BIGINT), "
            f"('expenses', 1::BIGINT), ('profit', 2::BIGINT), ('amount', 3::BIGINT)) s(series, series_order) "
            f"WHERE (s.series = 'revenue' AND {m} AND nr) OR (s.series = 'expenses' AND {m} AND ne) "
            f"OR (s.series = 'profit' AND {m} AND nr AND ne AND np) "
            f"OR (s.series = 'amount' AND NOT ({m} AND (nr OR ne)) AND {ha} AND na)")


def long(pts: str, vis: str, keys: str = "") -> str:
    """Visible long points (keys, period, series, series_order, value)."""
    k = f"p.{keys}, " if keys else ""
    on = f" AND v.{keys} IS NOT DISTINCT FROM p.{keys}" if keys else ""
    return (f"SELECT {k}p.period, v.series, v.series_order, CASE v.series WHEN 'revenue' THEN p.revenue "
            f"WHEN 'expenses' THEN p.expenses WHEN 'profit' THEN p.profit ELSE p.amount END AS value "
            f"FROM {pts} p JOIN {vis} v ON TRUE{on}")


def _kk(keys: str, prefix: str = "") -> str:
    return f"{prefix}{keys}, " if keys else ""


def anomaly_ctes(src_cte: str, src: str, grain: str, keys: str = "", amount_only: bool = False,
                 week_start: int = 0, money: bool = True, has_amount: bool = False) -> str:
    """CTEs p (points), v (visible), l (long), sb (stats+bounds), a (anomalies)."""
    k = _kk(keys)
    part = f"PARTITION BY {keys}" if keys else ""
    join_np = f"JOIN np USING ({keys})" if keys else ", np"
    gk = f"GROUP BY {keys}" if keys else ""

    def side(d):
        op = "<" if d == "low" else ">"
        iqr = f"CASE WHEN value {op} {d}_iqr THEN 1 + abs(value - {d}_iqr) / greatest(abs({d}_iqr), 1) END"
        z = f"CASE WHEN value {op} {d}_z THEN abs(value - median) / std END"
        rule = (f"concat_ws(', ', CASE WHEN value {op} {d}_iqr THEN 'IQR' END, "
                f"CASE WHEN value {op} {d}_z THEN 'Z-score' END)")
        return f"greatest({iqr}, {z})", rule

    lo_s, lo_r = side("low")
    hi_s, hi_r = side("high")
    return f"""{src_cte}, p AS ({points(src, grain, keys, week_start)}),
v AS ({visible('p', keys, amount_only, money, has_amount)}),
l AS ({long('p', 'v', keys)}),
np AS (SELECT {k}count(*) AS n_points FROM p {gk}),
st AS (SELECT {k}series, series_order, count(*)::BIGINT AS n_values, sum(abs(value)) AS abs_sum,
         quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
         quantile_cont(value, 0.75) AS q3, avg(value) AS mean, stddev_pop(value) AS std
       FROM l WHERE isfinite(value) GROUP BY {k}series, series_order),
sb AS (SELECT st.*, CASE WHEN q3 - q1 > 0 THEN q3 + 1.5 * (q3 - q1) END AS high_iqr,
         CASE WHEN q3 - q1 > 0 THEN q1 - 1.5 * (q3 - q1) END AS low_iqr,
         CASE WHEN std > 0 THEN mean + 2.5 * std END AS high_z,
         CASE WHEN std > 0 THEN mean - 2.5 * std END AS low_z
       FROM st {join_np} WHERE n_points >= 4 AND n_values >= 4 AND abs_sum <> 0),
c AS (SELECT l.period, l.value, sb.*,
         (sb.series IN ('profit', 'amount') AND (coalesce(l.value < low_iqr, FALSE) OR coalesce(l.value < low_z, FALSE))) AS low_hit,
         (sb.series IN ('revenue', 'expenses', 'amount') AND (coalesce(l.value > high_iqr, FALSE) OR coalesce(l.value > high_z, FALSE))) AS high_hit
      FROM l JOIN sb USING ({k}series) WHERE isfinite(l.value)),
a AS (SELECT {k}period, series, series_order, value, median AS baseline,
         CASE WHEN low_hit THEN 'drop' ELSE 'spike' END AS kind,
         CASE WHEN low_hit THEN {lo_s} ELSE {hi_s} END AS score,
         CASE WHEN low_hit THEN {lo_r} ELSE {hi_r} END AS rule
      FROM c WHERE low_hit OR high_hit),
ar AS (SELECT a.*, CASE WHEN score >= 3 THEN 'High' ELSE 'Medium' END AS severity,
         CASE series WHEN 'revenue' THEN 'Revenue' WHEN 'expenses' THEN 'Expenses' WHEN 'profit' THEN 'Profit' ELSE 'Amount' END AS series_label,
         row_number() OVER ({part} ORDER BY score DESC, abs(value - baseline) DESC, series_order, period)::BIGINT AS rank,
         count(*) OVER ({part})::BIGINT AS total_found
       FROM a)"""


def forecast_ctes(src_cte: str, src: str, grain: str, keys: str = "", amount_only: bool = False,
                  week_start: int = 0, horizon: int = 3) -> str:
    """CTEs p, v, l, ix (indexed), fit (+errors, method), fc (projections)."""
    k = _kk(keys)
    kx = _kk(keys, "ix.")
    unit = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY",
            "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}[grain]
    return f"""{src_cte}, p AS ({points(src, grain, keys, week_start)}),
v AS ({visible('p', keys, amount_only)}),
l AS ({long('p', 'v', keys)}),
ix AS (SELECT l.*, (row_number() OVER (PARTITION BY {k}series ORDER BY period) - 1)::BIGINT AS idx,
         count(*) OVER (PARTITION BY {k}series) AS n,
         avg(value) OVER (PARTITION BY {k}series ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS ma_prev
       FROM l),
f0 AS (SELECT {k}series, series_order, max(n) AS n, regr_slope(value, idx) AS slope,
         regr_intercept(value, idx) AS intercept, max(period) AS last_period,
         avg(CASE WHEN idx >= n - 3 THEN value END) AS ma_level,
         avg(CASE WHEN idx >= least(3, n) THEN abs(value - ma_prev) END) AS ma_mae,
         count(*) FILTER (WHERE NOT isfinite(value)) AS nonfinite
       FROM ix GROUP BY {k}series, series_order HAVING max(n) >= 6 AND count(*) FILTER (WHERE NOT isfinite(value)) = 0),
te AS (SELECT {kx}ix.series, avg(CASE WHEN ix.idx >= least(3, ix.n) THEN abs(ix.value - (f0.slope * ix.idx + f0.intercept)) END) AS trend_mae
       FROM ix JOIN f0 USING ({k}series) GROUP BY {kx}ix.series),
fit AS (SELECT f0.*, te.trend_mae,
          CASE WHEN f0.slope IS NOT NULL AND isfinite(te.trend_mae) AND (ma_mae IS NULL OR NOT isfinite(ma_mae)) THEN 'linear_trend'
               WHEN f0.slope IS NOT NULL AND isfinite(te.trend_mae) AND isfinite(ma_mae) AND te.trend_mae < ma_mae * 0.85 THEN 'linear_trend'
               ELSE 'moving_average' END AS method
        FROM f0 JOIN te USING ({k}series)),
fc AS (SELECT {k}series, series_order, s.step::BIGINT AS step,
         CAST(last_period + (s.step + 1) * {unit} AS TIMESTAMP) AS period,
         CASE WHEN method = 'linear_trend' THEN slope * (n + s.step) + intercept ELSE ma_level END AS value, method
       FROM fit, range(0, {horizon}) s(step))"""
