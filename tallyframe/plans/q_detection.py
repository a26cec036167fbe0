"""Column detection queries over whole driver tables, keyed by source table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tallyframe.functions.text import normalize_header
from tallyframe.operators import detection as D
from tallyframe.operators import metrics
from tallyframe.plans import views
from tallyframe.plans.analyze import analyze
from tallyframe.plans.registry import query, r
from tallyframe.plans.sql_detect import DETECT_TABLES, assignment_ctes, norm_sql, profile_ctes, score_ctes
from tallyframe.roles import Roles

_RATIOS = ("unique_ratio", "date_ratio", "numeric_ratio", "decimal_ratio", "currency_or_sign_ratio", "long_integer_ratio",
           "small_integer_ratio", "zero_ratio")


def cells(spark, sf):
    """Long cells of every profiled table with ``source`` as the key (whole tables)."""
    parts = []
    for table, cols in DETECT_TABLES.items():
        t = views.table(spark, sf, table).select(*cols)
        parts.append(D.long_cells(t).select(F.lit(table).alias("source"), "*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def headers(spark, sf):
    """The column names of every profiled table, from the schemas alone."""
    rows = [(table, i, c) for table, cols in DETECT_TABLES.items()
            for i, c in enumerate(views.table(spark, sf, table).select(*cols).columns)]
    return spark.createDataFrame(rows, "source string, position long, column string")


def profile(spark, sf):
    return D.column_profile(cells(spark, sf), ["source"])


def scores(spark, sf):
    return D.role_scores(profile(spark, sf), ["source"])


@query("q_normalize_text", f"""SELECT p_partkey, {norm_sql('p_name')} AS name_norm, {norm_sql('p_type')} AS type_norm,
       {norm_sql("p_brand || 'TotalPrice' || p_type")} AS mixed_norm FROM part""")
def q_normalize_text(spark, sf):
    """D1 on part names/types and a camelCase-bearing composite."""
    p = views.table(spark, sf, "part")
    return p.select("p_partkey", normalize_header(F.col("p_name")).alias("name_norm"),
                    normalize_header(F.col("p_type")).alias("type_norm"),
                    normalize_header(F.concat("p_brand", F.lit("TotalPrice"), "p_type")).alias("mixed_norm"))


@query("q_weak_headers", f"""WITH {profile_ctes()}
SELECT source, count(*)::BIGINT AS n_columns,
       count(*) FILTER (WHERE n = '' OR regexp_matches(n, '^((col|column|field|var|value|f|x)\\s*\\d+|\\d+)$') OR starts_with(n, 'unnamed'))::BIGINT AS n_weak,
       avg(CASE WHEN n = '' OR regexp_matches(n, '^((col|column|field|var|value|f|x)\\s*\\d+|\\d+)$') OR starts_with(n, 'unnamed') THEN 1.0 ELSE 0.0 END) >= 0.6 AS weak_headers
FROM hdr GROUP BY source""")
def q_weak_headers(spark, sf):
    """D2 per source table."""
    return D.weak_headers(headers(spark, sf), ["source"]) \
        .select("source", "n_columns", "n_weak", "weak_headers")


@query("q_keyword_scores", f"""WITH {score_ctes()}
SELECT source, "column", role, ks AS score, kr AS reason FROM ks""")
def q_keyword_scores(spark, sf):
    """D3: header keyword scores for the five roles, generic amount and direction lists."""
    return D.keyword_scores(headers(spark, sf), ["source"]).select("source", "column", "role", "score", "reason")


@query("q_column_profile", f"""WITH {profile_ctes()}
SELECT source, "column", n_values::BIGINT AS n_values, checked_count::BIGINT AS checked_count,
       {', '.join(f'round({c}, 6) AS {c}' for c in _RATIOS)} FROM prof""")
def q_column_profile(spark, sf):
    """Date evidence and money profile of every column of five tables."""
    p = D.column_profile(cells(spark, sf), ["source"], unique_ratio=True)
    return p.select("source", "column", "n_values", "checked_count", *[r(c, 6) for c in _RATIOS])


@query("q_category_evidence", f"""WITH {score_ctes()}
SELECT source, "column", category_checked::BIGINT AS category_checked, category_unique::BIGINT AS category_unique,
       round(category_unique_ratio, 6) AS category_unique_ratio, round(category_text_ratio, 6) AS category_text_ratio,
       cat_v AS value_score FROM mm""")
def q_category_evidence(spark, sf):
    """Repeated-text evidence per column."""
    p = D.column_profile(cells(spark, sf), ["source"], unique="all")
    text, uniq, ur = F.col("category_text_ratio"), F.col("category_unique"), F.col("category_unique_ratio")
    score = (F.when((F.col("n_values") < 5) | (F.col("category_checked") == 0), F.lit(0.0))
             .when((text >= 0.9) & (uniq <= 12) & (ur <= 0.5), F.lit(0.7))
             .when((text >= 0.8) & (ur <= 0.7), F.lit(0.55)).otherwise(F.lit(0.0)))
    return p.select("source", "column", "category_checked", "category_unique", r("category_unique_ratio", 6),
                    r("category_text_ratio", 6), score.alias("value_score"))


@query("q_direction_candidates", f"""WITH {score_ctes()}
SELECT source, "column", round(score, 2) AS score, reason FROM rs WHERE role = 'direction' AND score > 0""")
def q_direction_candidates(spark, sf):
    """income/expense direction hints (header words or direction-like values)."""
    s = scores(spark, sf).where((F.col("role") == "direction") & (F.col("score") > 0))
    return s.select("source", "column", r("score", 2), "reason")


@query("q_money_candidates", f"""WITH {score_ctes()}
SELECT source, rank, "column", confidence, reason FROM (
  SELECT source, "column", round(score, 2) AS confidence, reason,
         row_number() OVER (PARTITION BY source ORDER BY round(score, 2) DESC, position)::BIGINT AS rank
  FROM rs WHERE role = 'money' AND score > 0) WHERE rank <= 5""")
def q_money_candidates(spark, sf):
    """D9 + D16: the five best money columns per table."""
    c = D.role_candidates(scores(spark, sf), ["source"]).where(F.col("role") == "money")
    return c.select("source", "rank", "column", "confidence", "reason")


@query("q_role_candidates", f"""WITH {score_ctes()}
SELECT source, role, rank, "column", confidence, reason FROM (
  SELECT source, role, "column", round(score, 2) AS confidence, reason,
         row_number() OVER (PARTITION BY source, role ORDER BY round(score, 2) DESC, position)::BIGINT AS rank
  FROM rs WHERE score > 0) WHERE rank <= 5""")
def q_role_candidates(spark, sf):
    """The five best columns per table for every role, money and direction."""
    c = D.role_candidates(scores(spark, sf), ["source"])
    return c.select("source", "role", "rank", "column", "confidence", "reason")


@query("q_role_scores", f"""WITH {score_ctes()}
SELECT source, "column", role, round(score, 4) AS score, reason FROM rs""")
def q_role_scores(spark, sf):
    """Every column scored for every role."""
    return scores(spark, sf).select("source", "column", "role", r("score", 4), "reason")


@query("q_role_assignment", f"""WITH {assignment_ctes()}
SELECT asg.source, role, "column", confidence, reason, weak_headers, needs_confirmation
FROM asg JOIN conf USING (source)""")
def q_role_assignment(spark, sf):
    """D14 + D15: greedy role assignment and the confirmation flag per table."""
    a = D.assign_roles(scores(spark, sf), D.weak_headers(headers(spark, sf), ["source"]), ["source"])
    return a.select("source", "role", "column", "confidence", "reason", "weak_headers", "needs_confirmation")


@query("q_auto_analysis", f"""WITH {assignment_ctes()},
r AS (SELECT string_agg(role || '=' || "column", ',' ORDER BY role) AS roles FROM asg
      WHERE source = 'orders' AND "column" IS NOT NULL)
SELECT count(*)::BIGINT AS transaction_count, round(sum(greatest(o_totalprice, 0.0)), 2) AS total_revenue,
       round(sum(abs(least(o_totalprice, 0.0))), 2) AS total_expenses, 0::BIGINT AS revenue_column_count,
       0::BIGINT AS expense_column_count, 1::BIGINT AS amount_column_count, 1::BIGINT AS category_column_count,
       (SELECT roles FROM r) AS roles
FROM orders""")
def q_auto_analysis(spark, sf):
    """O2: detect roles on the orders table rendered as text, then analyse it.

    The only driver round-trip is the role assignment (five rows)."""
    o = views.table(spark, sf, "orders")
    text = o.select(*[F.col(c).cast("string").alias(c) for c in o.columns])
    assign, _ = D.detect_roles(text)
    chosen = {row.role: row.column for row in assign.collect() if row.column}
    roles = Roles(**chosen)
    if not roles.has_money_column:
        return metrics.basic_metrics(analyze(text, Roles(amount="o_totalprice")).ledger)
    a = analyze(text, roles, grain="month")
    return a.basic.select("transaction_count", r("total_revenue"), r("total_expenses"), "revenue_column_count",
                          "expense_column_count", "amount_column_count", "category_column_count",
                          F.lit(",".join(f"{k}={v}" for k, v in sorted(chosen.items()))).alias("roles"))
