"""Raw ledgers aggregated in one pass, all column-wide decisions taken afterwards.

Two decisions need the whole column of a key: whether a text money column is dirty
(then every cell is cleaned, else read directly), and which selected date column is
the first with a valid date. ``partials`` therefore sums every money column in both
readings, for every date candidate, together with the facts that decide; ``resolve``
chooses on the aggregated rows. So a raw ledger is scanned and shuffled once, no
ledger row is joined, and partials of several batches add up to those of all rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tallyframe.functions import qcol
from tallyframe.functions.dates import unreadable, with_ledger_ts
from tallyframe.functions.money import direct_number, numeric_money, utrim, with_clean_money_text
from tallyframe.functions.text import combine_categories
from tallyframe.operators._keys import attach
from tallyframe.operators.series import period_start
from tallyframe.roles import Roles
from tallyframe.session import staged_table

READINGS = ("direct", "clean")


def _money(roles: Roles) -> list[str]:
    return list(dict.fromkeys(roles.revenue + roles.expense + roles.amount))


#: Usual cells that need none of the full parsers: a plain number is the same in both readings, one
#: with a decimal comma has none by the direct reader, and a date of four, two and two digits with
#: a month up to 12 is read by the cast.
PLAIN = r"^-?[0-9]+(\.[0-9]{1,2})?\z"
COMMA = r"^-?[0-9]+,[0-9]{1,2}\z"
YEAR_FIRST = r"^[0-9]{4}[-/.](0[1-9]|1[0-2])[-/.](0[1-9]|[12][0-9]|3[01])\z"
DAY_FIRST = r"^(0[1-9]|[12][0-9]|3[01])[-/.](0[1-9]|1[0-2])[-/.][0-9]{4}\z"


def _with_money(df: DataFrame, name: str, j: int) -> DataFrame:
    """``df`` with both readings of a text money column and whether its cell is dirty."""
    text, odd, quick, form = qcol(name).cast("string"), f"__odd{j}", f"__quick{j}", F.col(f"__form{j}")
    df = df.withColumn(f"__form{j}", F.when(text.rlike(PLAIN), 1).when(text.rlike(COMMA), 2).otherwise(0))
    df = df.withColumn(quick, F.when(form == 1, text).when(form == 2, F.replace(text, F.lit(","), F.lit("."))).try_cast("double"))
    df = with_clean_money_text(df.withColumn(odd, F.when(form == 0, text)), odd, f"__clean{j}")
    df = df.withColumn(f"__clean{j}", F.when(form > 0, F.col(quick)).otherwise(F.col(f"__clean{j}")))
    df = df.withColumn(f"__direct{j}", F.when(form == 1, F.col(quick)).when(form == 0, direct_number(F.col(odd))))
    return df.withColumn(f"__dirty{j}", F.when(form == 0, F.coalesce(
        F.col(f"__direct{j}").isNull() & (utrim(F.col(odd)) != ""), F.lit(False))).otherwise(form == 2))


def _with_ts(df: DataFrame, name: str, out: str) -> DataFrame:
    """``with_ledger_ts``, by a cast where a date has its usual form."""
    if not isinstance(df.schema[name].dataType, StringType):
        return with_ledger_ts(df, name, out)
    text, odd, day = qcol(name), out + "_odd", out + "_day"
    df = df.withColumn(day, F.when(text.rlike(YEAR_FIRST), F.translate(text, "/.", "--")).when(
        text.rlike(DAY_FIRST), F.concat_ws("-", text.substr(7, 4), text.substr(4, 2), text.substr(1, 2))))
    df = with_ledger_ts(df.withColumn(odd, F.when(F.col(day).isNull(), text)), odd, out)
    return df.withColumn(out, F.when(F.col(day).isNotNull(), F.col(day).try_cast("timestamp_ntz")).otherwise(F.col(out)))


def partials(df: DataFrame, roles: Roles, keys=(), grain: str = "day", week_start: str = "monday") -> DataFrame:
    """Rows ``keys…, level, candidate, category, period`` with counts and sums:
    ``level`` total, category, or period (of date ``candidate``)."""
    keys, r = list(keys), roles.require(df.columns)
    dates, base = list(r.date), _readings(df, r, keys, grain, week_start)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i in range(len(dates)):
        aggs += [F.min(f"__t{i}").alias(f"min{i}"), F.max(f"__t{i}").alias(f"max{i}"), F.count(f"__t{i}").alias(f"dated{i}"),
                 F.count_if(f"__bad{i}").alias(f"unreadable{i}")]
    for j, c in enumerate(_money(r)):
        aggs.append(F.bool_or(f"__dirty{j}").alias(f"dirty{j}"))
        for reading in READINGS:
            v = F.coalesce(F.col(f"__{reading}{j}"), F.lit(0.0))
            aggs.append(F.sum(v).alias(f"{reading}{j}"))
            if c in r.amount:
                aggs += [F.sum(F.greatest(v, F.lit(0.0))).alias(f"{reading}_in{j}"),
                         F.sum(F.abs(F.least(v, F.lit(0.0)))).alias(f"{reading}_out{j}")]
    grouped = keys + ["category"] + [f"__p{i}" for i in range(len(dates))]
    if len(dates) == 1:
        # every row is in three sums: the rows of a category and period are one before that
        base = base.groupBy(*[qcol(c) for c in grouped]).agg(*aggs)
        aggs = [_folded(c) for c in base.columns if c not in grouped]
    sets = [keys, keys + ["category"]] + [keys + [f"__p{i}"] for i in range(len(dates))]
    by = [F.grouping(c).alias(f"__g_{k}") for k, c in enumerate(grouped[len(keys):])]
    out = base.groupingSets([[qcol(c) for c in s] for s in sets], *[qcol(c) for c in grouped]).agg(*aggs, *by)
    candidate = F.coalesce(*[F.when(F.col(f"__g_{i + 1}") == 0, F.lit(i)) for i in range(len(dates))], F.lit(-1))
    level = F.when(F.col("__g_0") == 0, F.lit("category")).when(candidate >= 0, F.lit("period")).otherwise(F.lit("total"))
    period = F.coalesce(*[F.col(f"__p{i}") for i in range(len(dates))], F.lit(None).cast("timestamp_ntz"))
    names = [a for a in out.columns if a not in grouped and not a.startswith("__")]
    return out.select(*[qcol(k) for k in keys], level.alias("level"), candidate.alias("candidate"), "category",
                      period.alias("period"), *names)


def _readings(df: DataFrame, r: Roles, keys: list[str], grain: str, week_start: str) -> DataFrame:
    """A row of ``df`` as its keys, category, both readings of each money column and, of each
    date column, time and period."""
    base = df.select(*[qcol(c) for c in dict.fromkeys(keys + list(r.selected()))])
    dates = list(r.date)
    for i, c in enumerate(dates):
        base = _with_ts(base, c, f"__t{i}")
        base = base.withColumn(f"__bad{i}", unreadable(qcol(c).cast("string"), F.col(f"__t{i}")))
    for j, c in enumerate(_money(r)):
        if isinstance(base.schema[c].dataType, NumericType):
            value = numeric_money(qcol(c))
            base = (base.withColumn(f"__clean{j}", value).withColumn(f"__direct{j}", value)
                    .withColumn(f"__dirty{j}", F.lit(False)))
        else:
            base = _with_money(base, c, j)
    return base.select(
        *[qcol(k) for k in keys], *[F.col(f"__{x}{j}") for j in range(len(_money(r))) for x in (*READINGS, "dirty")],
        *[F.col(f"__{x}{i}") for i in range(len(dates)) for x in ("t", "bad")],
        (combine_categories([qcol(c) for c in r.category]) if r.category else F.lit(None).cast("string")).alias("category"),
        *[period_start(F.col(f"__t{i}"), grain, week_start).alias(f"__p{i}") for i in range(len(dates))])


def _folded(name: str) -> Column:
    """A partial result over the partial results of parts of the rows."""
    fold = {"min": F.min, "max": F.max, "dirty": F.bool_or}
    return fold.get(name.rstrip("0123456789"), F.sum)(name).alias(name)


def merged(parts: DataFrame, keys=()) -> DataFrame:
    """Partials of several batches as those of all their rows."""
    by = [*keys, "level", "candidate", "category", "period"]
    return parts.groupBy(*[qcol(c) for c in by]).agg(*[_folded(c) for c in parts.columns if c not in by])


def resolve(parts: DataFrame, roles: Roles, keys=()) -> DataFrame:
    """The rollup of the prepared ledger: ``keys…, category, period, level`` with counts,
    totals, date range, ``dated_rows`` and ``unreadable_dates``."""
    keys, money, n_dates = list(keys), _money(roles), len(roles.date)
    facts = [F.col(f"dirty{j}").alias(f"is_dirty{j}") for j in range(len(money))]
    chosen = F.coalesce(*[F.when(F.col(f"dated{i}") > 0, F.lit(i)) for i in range(n_dates)], F.lit(-1))
    decided = attach(parts, parts.where("level = 'total'").select(*[qcol(k) for k in keys], chosen.alias("use_date"), *facts),
                     keys)
    decided = decided.where((F.col("level") != "period") | (F.col("candidate") == F.col("use_date")))

    def total(role: str, part: str = "") -> Column:
        names = getattr(roles, role)
        return reduce(add, [F.when(F.col(f"is_dirty{j}"), F.col(f"clean{part}{j}")).otherwise(F.col(f"direct{part}{j}"))
                            for j in (money.index(c) for c in names)], F.lit(0.0)) if names else F.lit(0.0)

    def of_date(name: str, kind: str) -> Column:
        return F.coalesce(*[F.when(F.col("use_date") == i, F.col(f"{name}{i}")) for i in range(n_dates)],
                          F.lit(None).cast(kind))

    revenue, expenses = total("revenue") + total("amount", "_in"), total("expense") + total("amount", "_out")
    none = F.lit(None).cast("double")
    # a date column without any valid date has only unreadable or blank cells
    bad = reduce(add, [F.col(f"unreadable{i}") for i in range(n_dates)], F.lit(0).cast("bigint"))
    return decided.select(
        *[qcol(k) for k in keys], "category", "period", F.col("n").alias("transaction_count"),
        (revenue if roles.revenue or roles.amount else none).alias("total_revenue"),
        (expenses if roles.expense or roles.amount else none).alias("total_expenses"),
        of_date("min", "timestamp_ntz").alias("date_min"), of_date("max", "timestamp_ntz").alias("date_max"),
        revenue.alias("revenue"), expenses.alias("expenses"), (revenue - expenses).alias("profit"),
        total("amount").alias("amount"), "level", F.coalesce(of_date("dated", "bigint"), F.lit(0)).alias("dated_rows"),
        bad.alias("unreadable_dates"))


def raw_rollup(df: DataFrame, roles: Roles, keys=(), grain: str = "day", week_start: str = "monday",
               staged: bool = False) -> DataFrame:
    """``ledger_rollup`` of a raw ledger, from one scan and one shuffle of it. ``staged`` writes the
    partial sums, which are used twice (for the decisions of a key and for its rows) and would
    else be taken from the ledger twice."""
    used = roles.require(df.columns)
    parts = partials(df, used, keys, grain, week_start)
    return resolve(staged_table(parts, "partials") if staged else parts, used, keys)
