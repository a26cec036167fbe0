"""DuckDB text of the raw-orders view and of the cleaning rules."""

RAW = """raw AS (
  SELECT o_orderkey, o_orderpriority, o_orderstatus, o_orderkey % 8 AS money_kind,
         (o_orderkey // 8) % 4 AS date_kind,
         CASE o_orderkey % 8
           WHEN 0 THEN CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
           WHEN 1 THEN replace(format('{:,}', c // 100), ',', ' ') || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || ' ₸'
           WHEN 2 THEN replace(format('{:,}', c // 100), ',', '.') || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
           WHEN 3 THEN '(' || CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || ')'
           WHEN 4 THEN CAST(c // 100 AS VARCHAR) || ',' || substr(lpad(CAST(c % 100 AS VARCHAR), 2, '0'), 1, 1)
           WHEN 5 THEN ''
           WHEN 6 THEN 'n/a'
           ELSE format('{:,}', c // 100) END AS money_text,
         CASE WHEN o_orderkey % 8 = 5 THEN '' ELSE CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') END AS clean_text,
         CASE (o_orderkey // 8) % 4
           WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
           WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y')
           WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y')
           ELSE CASE WHEN (o_orderkey // 32) % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:30:00.000000 +03:00' ELSE 'n/d' END
         END AS date_text,
         CASE WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%d.%m.%Y') ELSE '--' END AS alt_date
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders))"""

PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def direct_sql(x: str) -> str:
    t = f"trim({x})"
    return (f"(CASE WHEN regexp_matches({t}, '{PLAIN_NUMBER}') OR regexp_matches(lower({t}), '^[+-]?(inf|infinity)$') "
            f"THEN TRY_CAST({t} AS DOUBLE) END)")


def dirty_sql(x: str) -> str:
    return f"({x} IS NOT NULL AND trim({x}) <> '' AND {direct_sql(x)} IS NULL)"


def clean_sql(x: str) -> str:
    """The forgiving money cleaner (one cell)."""
    s = f"trim({x})"
    kept = f"regexp_replace({s}, '[^0-9,.+-]', '', 'g')"
    nc = f"(length({kept}) - length(replace({kept}, ',', '')))"
    nd = f"(length({kept}) - length(replace({kept}, '.', '')))"
    right_c = f"split_part({kept}, ',', 2)"
    right_d = f"split_part({kept}, '.', 2)"
    left_c = f"split_part({kept}, ',', 1)"
    left_d = f"split_part({kept}, '.', 1)"
    norm = (f"(CASE WHEN {nc} > 0 AND {nd} > 0 THEN "
            f"CASE WHEN length({kept}) - strpos(reverse({kept}), ',') > length({kept}) - strpos(reverse({kept}), '.') "
            f"THEN replace(replace({kept}, '.', ''), ',', '.') ELSE replace({kept}, ',', '') END "
            f"WHEN {nc} = 1 AND {nd} = 0 THEN CASE WHEN length({right_c}) <= 2 THEN {left_c} || '.' || {right_c} ELSE {left_c} || {right_c} END "
            f"WHEN {nd} = 1 AND {nc} = 0 THEN CASE WHEN length({right_d}) <= 2 THEN {left_d} || '.' || {right_d} ELSE {left_d} || {right_d} END "
            f"ELSE {kept} END)")
    signed = (f"(CASE WHEN starts_with({s}, '(') AND ends_with({s}, ')') AND NOT starts_with({norm}, '-') "
              f"THEN '-' || {norm} ELSE {norm} END)")
    return f"(CASE WHEN regexp_matches({signed}, '{PLAIN_NUMBER}') THEN TRY_CAST({signed} AS DOUBLE) END)"


def date_sql(x: str) -> str:
    """Per-cell date reading: year-first forms, then day-first ones; offset applied."""
    t = f"trim({x})"
    tm = r"(?:[ T](\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?)?"
    off = r"\s*(Z|[+-]\d{2}:?\d{2})?"
    yf = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + tm + off + "$"
    df = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + tm + off + "$"

    def build(p, y, m, d):
        g = lambda i: f"nullif(regexp_extract({t}, '{p}', {i}), '')"
        secs = (f"CAST(coalesce({g(6)}, '0') AS DOUBLE) + "
                f"CAST('0.' || substr(rpad(coalesce({g(7)}, '0'), 6, '0'), 1, 6) AS DOUBLE)")
        base = (f"TRY_CAST(printf('%04d-%02d-%02d', CAST({g(y)} AS INTEGER), CAST({g(m)} AS INTEGER), CAST({g(d)} AS INTEGER)) AS DATE)")
        ts = (f"(CAST({base} AS TIMESTAMP) + to_hours(CAST(coalesce({g(4)}, '0') AS BIGINT)) "
              f"+ to_minutes(CAST(coalesce({g(5)}, '0') AS BIGINT)) + to_microseconds(CAST(round(({secs}) * 1000000) AS BIGINT)))")
        o = g(8)
        digits = f"replace({o}, ':', '')"
        shift = (f"(CASE WHEN {o} IS NULL OR {o} = 'Z' THEN 0 ELSE (CASE WHEN starts_with({digits}, '-') THEN -1 ELSE 1 END) * "
                 f"(CAST(substr({digits}, 2, 2) AS INTEGER) * 60 + CAST(substr({digits}, 4, 2) AS INTEGER)) END)")
        return f"({ts} - to_minutes({shift}))"

    return (f"(CASE WHEN regexp_matches({t}, '{yf}') THEN {build(yf, 1, 2, 3)} "
            f"WHEN regexp_matches({t}, '{df}') THEN {build(df, 3, 2, 1)} END)")
