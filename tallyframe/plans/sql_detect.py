"""DuckDB text of column detection over the driver tables (oracle side)."""

from __future__ import annotations

from tallyframe.functions.vocab import (
    CURRENCY_TOKENS, DATE_VALUE_PATTERNS, DIRECTION_KEYWORDS, DIRECTION_VALUE_KEYWORDS, GENERIC_AMOUNT_KEYWORDS,
    ROLE_KEYWORDS,
)

# (source table, columns) profiled by the detection queries: whole tables.
DETECT_TABLES = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm_sql(x: str) -> str:
    """Header normalisation with capture groups (RE2 has no look-behind)."""
    t = f"regexp_replace({x}, '([a-zа-яё0-9])([A-ZА-ЯЁ])', '\\1 \\2', 'g')"
    t = f"regexp_replace({t}, '([A-ZА-ЯЁ])([A-ZА-ЯЁ][a-zа-яё])', '\\1 \\2', 'g')"
    t = f"replace(lower({t}), 'ё', 'е')"
    t = f"regexp_replace({t}, '[_\\-/\\\\|:;.,()\\[\\]{{}}]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\s+', ' ', 'g')"
    return f"trim({t})"


def cells_sql() -> str:
    parts = []
    for table, cols in DETECT_TABLES.items():
        for i, c in enumerate(cols):
            parts.append(f"SELECT '{table}' AS source, {i}::BIGINT AS position, '{c}' AS \"column\", "
                         f"CAST({c} AS VARCHAR) AS value FROM {table}")
    return "cells AS (" + " UNION ALL ".join(parts) + ")"


def date_like(x: str) -> str:
    pat = "|".join(f"({p})" for p in DATE_VALUE_PATTERNS)
    return f"coalesce(regexp_matches(trim({x}), {q(pat)}), FALSE)"


def has_currency(x: str) -> str:
    """A currency token occurs in the lower-cased text: plain substring tests."""
    return "(" + " OR ".join(f"contains(lower({x}), {q(t)})" for t in CURRENCY_TOKENS) + ")"


def parse_ctes(src: str, col: str, p: str) -> tuple[str, str]:
    """CTE chain adding {p}_v (double or NULL), {p}_dec, {p}_norm for text ``col``."""
    ctes = f"""{p}1 AS (SELECT *, trim({col}) AS {p}_s, regexp_replace(trim({col}), '[^0-9,.+()-]', '', 'g') AS {p}_kept FROM {src}),
{p}2 AS (SELECT *, replace(replace({p}_kept, '(', ''), ')', '') AS {p}_nums FROM {p}1),
{p}3 AS (SELECT *, CASE WHEN strpos({p}_nums, ',') > 0 AND strpos({p}_nums, '.') > 0 THEN
            CASE WHEN length({p}_nums) - strpos(reverse({p}_nums), ',') > length({p}_nums) - strpos(reverse({p}_nums), '.') THEN ',' ELSE '.' END
          WHEN strpos({p}_nums, ',') > 0 THEN CASE WHEN strpos(reverse({p}_nums), ',') - 1 <= 2 THEN ',' ELSE '' END
          WHEN strpos({p}_nums, '.') > 0 THEN CASE WHEN strpos(reverse({p}_nums), '.') - 1 <= 2 THEN '.' ELSE '' END
          ELSE '' END AS {p}_sep FROM {p}2),
{p}4 AS (SELECT *, replace(CASE WHEN {p}_sep = ',' THEN replace(replace({p}_nums, '.', ''), ',', '.')
            WHEN {p}_sep = '.' THEN replace({p}_nums, ',', '') ELSE replace(replace({p}_nums, ',', ''), '.', '') END, '+', '') AS {p}_n0 FROM {p}3),
{p}5 AS (SELECT *, CASE WHEN starts_with({p}_kept, '(') AND ends_with({p}_kept, ')') AND NOT starts_with({p}_n0, '-')
            THEN '-' || {p}_n0 ELSE {p}_n0 END AS {p}_norm FROM {p}4),
{p}6 AS (SELECT *, CASE WHEN {p}_s = '' OR regexp_matches({p}_s, '[{{}}\\[\\]:]')
              OR (regexp_matches(lower({p}_s), '[a-zа-я]') AND NOT {has_currency(p + "_s")})
              OR NOT regexp_matches({p}_kept, '\\d') OR NOT regexp_matches({p}_norm, '^-?(\\d+\\.?\\d*|\\.\\d+)$')
            THEN NULL ELSE CAST({p}_norm AS DOUBLE) END AS {p}_v FROM {p}5),
{p}7 AS (SELECT *, {p}_v IS NOT NULL AND {p}_sep <> '' AS {p}_dec FROM {p}6)"""
    return ctes, f"{p}7"


def profile_ctes() -> str:
    """cells → pc (profile counts) → prof (ratios) per source, position, column."""
    has_direction = "(" + " OR ".join(f"contains(' ' || nv || ' ', {q(f' {w} ')})" for w in DIRECTION_VALUE_KEYWORDS) + ")"
    pv, last1 = parse_ctes("cv", "value", "pa")
    pn, last2 = parse_ctes(last1, "nv", "pb")
    return f"""{cells_sql()},
cv AS (SELECT *, {norm_sql('value')} AS nv FROM cells WHERE value IS NOT NULL AND value <> ''),
{pv},
{pn},
pc AS (SELECT source, position, "column", count(*) AS n_values,
         count(*) AS date_checked, count(*) FILTER (WHERE {date_like('value')}) AS date_hits,
         count(*) FILTER (WHERE pa_s <> '' AND NOT {date_like('value')}) AS checked_count,
         count(*) FILTER (WHERE pa_s <> '' AND NOT {date_like('value')} AND pa_v IS NOT NULL) AS numeric_count,
         count(*) FILTER (WHERE pa_s <> '' AND NOT {date_like('value')} AND pa_dec) AS decimal_count,
         count(*) FILTER (WHERE pa_s <> '' AND NOT {date_like('value')} AND pa_v IS NOT NULL
                          AND ({has_currency('value')} OR regexp_matches(lower(value), '(^|[\\s(])[+-]\\s*\\d'))) AS cur_count,
         count(*) FILTER (WHERE pa_s <> '' AND NOT {date_like('value')} AND pa_v IS NOT NULL AND NOT pa_dec
                          AND length(regexp_replace(pa_norm, '\\D', '', 'g')) >= 5) AS long_count,
         count(*) FILTER (WHERE pa_s <> '' AND NOT {date_like('value')} AND pa_v IS NOT NULL AND NOT pa_dec AND abs(pa_v) <= 20) AS small_count,
         count(*) FILTER (WHERE pa_s <> '' AND NOT {date_like('value')} AND pa_v IS NOT NULL AND pa_v = 0) AS zero_count,
         count(DISTINCT pa_norm) FILTER (WHERE pa_s <> '' AND NOT {date_like('value')} AND pa_v IS NOT NULL) AS unique_count,
         count(*) FILTER (WHERE pa_s <> '') AS direction_checked,
         count(*) FILTER (WHERE pa_s <> '' AND coalesce({has_direction}, FALSE)) AS direction_hits,
         count(*) FILTER (WHERE nv <> '') AS category_checked,
         count(DISTINCT nv) FILTER (WHERE nv <> '') AS category_unique,
         count(*) FILTER (WHERE nv <> '' AND NOT {date_like('nv')} AND NOT (pb_v IS NOT NULL AND trim(nv) <> '')) AS category_text
       FROM {last2} GROUP BY source, position, "column"),
hdr AS (SELECT DISTINCT source, position, "column", {norm_sql('"column"')} AS n FROM cells),
prof AS (SELECT h.source, h.position, h."column", h.n, coalesce(n_values, 0) AS n_values,
          CASE WHEN date_checked > 0 THEN date_hits / date_checked ELSE 0.0 END AS date_ratio,
          coalesce(checked_count, 0) AS checked_count,
          CASE WHEN checked_count > 0 THEN numeric_count / checked_count ELSE 0.0 END AS numeric_ratio,
          CASE WHEN numeric_count > 0 THEN decimal_count / numeric_count ELSE 0.0 END AS decimal_ratio,
          CASE WHEN numeric_count > 0 THEN cur_count / numeric_count ELSE 0.0 END AS currency_or_sign_ratio,
          CASE WHEN numeric_count > 0 THEN long_count / numeric_count ELSE 0.0 END AS long_integer_ratio,
          CASE WHEN numeric_count > 0 THEN small_count / numeric_count ELSE 0.0 END AS small_integer_ratio,
          CASE WHEN numeric_count > 0 THEN zero_count / numeric_count ELSE 0.0 END AS zero_ratio,
          CASE WHEN numeric_count > 0 THEN unique_count / numeric_count ELSE 0.0 END AS unique_ratio,
          coalesce(direction_checked, 0) AS direction_checked,
          CASE WHEN direction_checked > 0 THEN direction_hits / direction_checked ELSE 0.0 END AS direction_ratio,
          coalesce(category_checked, 0) AS category_checked, coalesce(category_unique, 0) AS category_unique,
          CASE WHEN category_checked > 0 THEN category_unique / category_checked ELSE 0.0 END AS category_unique_ratio,
          CASE WHEN category_checked > 0 THEN category_text / category_checked ELSE 0.0 END AS category_text_ratio
        FROM hdr h LEFT JOIN pc USING (source, position, "column"))"""


def _kw_values() -> str:
    rows = []
    lists = dict(ROLE_KEYWORDS)
    lists["generic"] = GENERIC_AMOUNT_KEYWORDS
    lists["direction"] = DIRECTION_KEYWORDS
    for role, words in lists.items():
        for i, w in enumerate(words):
            rows.append(f"({q(role)}, {i}, {q(w)}, {q(w)})")
    return "kwt AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(role, rk, kw, nkw))"


def keyword_ctes() -> str:
    """ks: keyword score/reason per source, column and list (5 roles, generic, direction)."""
    return f"""{_kw_values()},
lists AS (SELECT DISTINCT role FROM kwt),
kx AS (SELECT h.source, h.position, k.role, arg_min(k.kw, k.rk) AS kw FROM hdr h JOIN kwt k ON h.n = k.nkw GROUP BY ALL),
kp AS (SELECT h.source, h.position, k.role, arg_min(k.kw, k.rk) AS kw FROM hdr h JOIN kwt k
       ON strpos(' ' || h.n || ' ', ' ' || k.nkw || ' ') > 0 GROUP BY ALL),
kg AS (SELECT source, position, kw FROM kp WHERE role = 'generic'),
ks AS (SELECT h.source, h.position, h."column", l.role,
         CASE WHEN h.n = '' THEN 0.0 WHEN kx.kw IS NOT NULL THEN 1.0 WHEN kp.kw IS NOT NULL THEN 0.75
              WHEN kg.kw IS NOT NULL THEN 0.25 ELSE 0.0 END::DOUBLE AS ks,
         CASE WHEN h.n = '' THEN '' WHEN kx.kw IS NOT NULL THEN 'exact keyword: ' || kx.kw
              WHEN kp.kw IS NOT NULL THEN 'partial keyword: ' || kp.kw
              WHEN kg.kw IS NOT NULL THEN 'generic amount keyword: ' || kg.kw ELSE '' END AS kr
       FROM hdr h CROSS JOIN lists l
       LEFT JOIN kx ON kx.source = h.source AND kx.position = h.position AND kx.role = l.role
       LEFT JOIN kp ON kp.source = h.source AND kp.position = h.position AND kp.role = l.role
       LEFT JOIN kg ON kg.source = h.source AND kg.position = h.position)"""


def score_ctes() -> str:
    """rs: role scores (5 roles + money + direction) per source and column."""
    return f"""{profile_ctes()},
{keyword_ctes()},
kw AS (SELECT source, position,
         max(ks) FILTER (WHERE role = 'date') AS date_s, max(kr) FILTER (WHERE role = 'date') AS date_r,
         max(ks) FILTER (WHERE role = 'revenue') AS rev_s, max(kr) FILTER (WHERE role = 'revenue') AS rev_r,
         max(ks) FILTER (WHERE role = 'expense') AS exp_s, max(kr) FILTER (WHERE role = 'expense') AS exp_r,
         max(ks) FILTER (WHERE role = 'amount') AS amt_s, max(kr) FILTER (WHERE role = 'amount') AS amt_r,
         max(ks) FILTER (WHERE role = 'category') AS cat_s, max(kr) FILTER (WHERE role = 'category') AS cat_r,
         max(ks) FILTER (WHERE role = 'generic') AS gen_s, max(kr) FILTER (WHERE role = 'generic') AS gen_r,
         max(ks) FILTER (WHERE role = 'direction') AS dir_s, max(kr) FILTER (WHERE role = 'direction') AS dir_r
       FROM ks GROUP BY source, position),
pk AS (SELECT p.*, kw.* EXCLUDE (source, position),
         NOT (currency_or_sign_ratio > 0 OR decimal_ratio > 0) AND (long_integer_ratio >= 0.7 OR small_integer_ratio >= 0.9) AS id_like
       FROM prof p JOIN kw USING (source, position)),
pm AS (SELECT *, checked_count > 0 AND numeric_ratio >= 0.7 AND NOT id_like AS money_ok,
         CASE WHEN currency_or_sign_ratio >= 0.2 THEN 0.85 WHEN decimal_ratio >= 0.5 THEN 0.85
              WHEN decimal_ratio >= 0.2 THEN 0.75 ELSE 0.6 END AS tier_s,
         CASE WHEN currency_or_sign_ratio >= 0.2 THEN 'currency or signed numeric values'
              WHEN decimal_ratio >= 0.5 THEN 'decimal numeric values'
              WHEN decimal_ratio >= 0.2 THEN 'some decimal numeric values' ELSE 'numeric values' END AS tier_r
       FROM pk),
mm0 AS (SELECT *,
         CASE WHEN money_ok AND zero_ratio < 0.95 THEN CASE WHEN gen_s > 0 THEN least(tier_s + 0.15, 0.95) ELSE tier_s END ELSE gen_s END AS money_s,
         CASE WHEN money_ok AND zero_ratio < 0.95 THEN CASE WHEN gen_s > 0 THEN gen_r || ', ' || tier_r ELSE tier_r END ELSE gen_r END AS money_r,
         CASE WHEN n_values > 0 AND date_ratio >= 0.7 THEN 0.65 ELSE 0.0 END AS date_v,
         CASE WHEN n_values < 5 OR category_checked = 0 THEN 0.0
              WHEN category_text_ratio >= 0.9 AND category_unique <= 12 AND category_unique_ratio <= 0.5 THEN 0.7
              WHEN category_text_ratio >= 0.8 AND category_unique_ratio <= 0.7 THEN 0.55 ELSE 0.0 END AS cat_v
       FROM pm),
mm AS (SELECT * REPLACE (money_s::DOUBLE AS money_s, date_v::DOUBLE AS date_v, cat_v::DOUBLE AS cat_v) FROM mm0),
rs0 AS (
  SELECT source, position, "column", 'date' AS role,
         CASE WHEN date_s >= 0.7 THEN date_s WHEN date_v > date_s THEN date_v ELSE date_s END AS score,
         CASE WHEN date_s >= 0.7 THEN date_r WHEN date_v > date_s THEN 'date-like values' ELSE date_r END AS reason FROM mm
  UNION ALL
  SELECT source, position, "column", 'revenue',
         CASE WHEN rev_s > 0 AND checked_count > 0 AND numeric_ratio < 0.5 THEN least(rev_s, 0.5) WHEN rev_s >= 0.7 THEN rev_s
              WHEN rev_s > 0 AND money_ok THEN least(rev_s + 0.1, 0.9) ELSE rev_s END,
         CASE WHEN rev_s > 0 AND checked_count > 0 AND numeric_ratio < 0.5 THEN rev_r || ', but values are not money-like'
              WHEN rev_s >= 0.7 THEN rev_r WHEN rev_s > 0 AND money_ok THEN rev_r || ', money-like values' ELSE rev_r END FROM mm
  UNION ALL
  SELECT source, position, "column", 'expense',
         CASE WHEN exp_s > 0 AND checked_count > 0 AND numeric_ratio < 0.5 THEN least(exp_s, 0.5) WHEN exp_s >= 0.7 THEN exp_s
              WHEN exp_s > 0 AND money_ok THEN least(exp_s + 0.1, 0.9) ELSE exp_s END,
         CASE WHEN exp_s > 0 AND checked_count > 0 AND numeric_ratio < 0.5 THEN exp_r || ', but values are not money-like'
              WHEN exp_s >= 0.7 THEN exp_r WHEN exp_s > 0 AND money_ok THEN exp_r || ', money-like values' ELSE exp_r END FROM mm
  UNION ALL
  SELECT source, position, "column", 'amount', CASE WHEN money_s > amt_s THEN money_s ELSE amt_s END,
         CASE WHEN money_s > amt_s THEN money_r ELSE amt_r END FROM mm
  UNION ALL
  SELECT source, position, "column", 'category',
         CASE WHEN cat_s >= 0.7 THEN cat_s WHEN cat_v > cat_s THEN cat_v ELSE cat_s END,
         CASE WHEN cat_s >= 0.7 THEN cat_r WHEN cat_v > cat_s THEN 'repeated text values' ELSE cat_r END FROM mm
  UNION ALL
  SELECT source, position, "column", 'money', money_s, money_r FROM mm
  UNION ALL
  SELECT source, position, "column", 'direction',
         CASE WHEN direction_checked > 0 AND direction_ratio >= 0.5 THEN greatest(dir_s, 0.75) ELSE dir_s END,
         CASE WHEN direction_checked > 0 AND direction_ratio >= 0.5 THEN CASE WHEN dir_r <> '' THEN dir_r ELSE 'income/expense-like values' END
              ELSE dir_r END FROM mm),
rs AS (SELECT * REPLACE (score::DOUBLE AS score) FROM rs0)"""


def assignment_ctes() -> str:
    th = {"date": (0.6, 0.6), "revenue": (0.7, 0.8), "expense": (0.7, 0.8), "amount": (0.7, 0.75),
          "category": (0.7, 0.8)}
    weak = (f"wk AS (SELECT source, avg(CASE WHEN n = '' OR regexp_matches(n, '^((col|column|field|var|value|f|x)\\s*\\d+|\\d+)$') "
            f"OR starts_with(n, 'unnamed') THEN 1.0 ELSE 0.0 END) >= 0.6 AS weak FROM hdr GROUP BY source)")
    steps, prev = [], []
    for i, (role, (t, tw)) in enumerate(th.items(), 1):
        anti = " ".join(f"AND NOT EXISTS (SELECT 1 FROM a{j} WHERE a{j}.source = rs.source AND a{j}.\"column\" = rs.\"column\")"
                        for j in prev)
        steps.append(f"a{i} AS (SELECT rs.source, '{role}' AS role, rs.\"column\", rs.position, rs.score, rs.reason "
                     f"FROM rs JOIN wk USING (source) WHERE rs.role = '{role}' "
                     f"AND rs.score >= CASE WHEN wk.weak THEN {tw} ELSE {t} END {anti} "
                     f"QUALIFY row_number() OVER (PARTITION BY rs.source ORDER BY rs.score DESC, rs.position) = 1)")
        prev.append(i)
    picks = " UNION ALL ".join(f"SELECT * FROM a{i}" for i in prev)
    roles = ", ".join(f"('{r}')" for r in th)
    return (f"{score_ctes()},\n{weak},\n" + ",\n".join(steps) + f""",
picks AS ({picks}),
asg AS (SELECT wk.source, r.role, p."column", p.position, coalesce(round(p.score, 2), 0.0)::DOUBLE AS confidence,
          coalesce(p.reason, '') AS reason, wk.weak AS weak_headers
        FROM wk CROSS JOIN (VALUES {roles}) r(role) LEFT JOIN picks p ON p.source = wk.source AND p.role = r.role),
conf AS (SELECT source, bool_or(weak_headers) OR NOT bool_or("column" IS NOT NULL AND role IN ('revenue', 'expense', 'amount'))
           OR bool_or("column" IS NOT NULL AND role IN ('revenue', 'expense', 'amount') AND strpos(reason, 'keyword') = 0)
           OR bool_or("column" IS NOT NULL AND confidence < 0.8) AS needs_confirmation FROM asg GROUP BY source)""")
