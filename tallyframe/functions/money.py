"""Money text as Column expressions.

Two readers exist, as in the reference behaviour:

* ``direct_number`` — a plain numeric literal (what a numeric cast accepts);
* ``clean_money_text`` — the forgiving per-cell cleaner (parentheses negative,
  NBSP, currency text, thousands/decimal separators) used when a column holds
  at least one non-blank cell the direct reader rejects.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import qcol

# Plain number: optional sign, digits with optional fraction, optional exponent,
# or inf/infinity/nan. Spark's cast also takes '1d' / '1f' / hex floats; the
# guard rejects them so only real numeric text is cast.
_PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_SPECIAL_NUMBER = r"(?i)^[+-]?(inf|infinity|nan)$"
# Unicode-aware trim (Python's str.strip also removes NBSP and other spaces).
_UTRIM = r"(?U)^\s+|\s+$"


def utrim(c: Column) -> Column:
    return F.regexp_replace(c, _UTRIM, "")


def finite_or_null(c: Column) -> Column:
    """NaN counts as missing (pandas semantics)."""
    return F.when(~F.isnan(c), c)


def direct_number(text: Column) -> Column:
    """Numeric literal → double, else null. NaN text → null (missing)."""
    t = utrim(text)
    ok = t.rlike(_PLAIN_NUMBER) | t.rlike(_SPECIAL_NUMBER)
    return finite_or_null(F.when(ok, t.try_cast("double")))


def is_dirty_cell(text: Column) -> Column:
    """Non-blank cell the direct reader cannot read: trips the column-wide switch."""
    t = utrim(text)
    return text.isNotNull() & (t != "") & direct_number(text).isNull()


def _tmp(prefix: str, name: str) -> str:
    return f"__{prefix}_{name}"


def with_clean_money_text(df: DataFrame, src: str, out: str) -> DataFrame:
    """Add ``out``: one money cell through the forgiving cleaner → double (null if unreadable).

    Steps: outer parentheses mean negative; keep only digits , . - + ; with both
    separators the right-most is the decimal one; a single , or . is decimal when
    at most two digits follow it, else a thousands mark; anything else is left
    as it is and usually fails the final cast. Built as staged projections so
    each intermediate is computed once per row.
    """
    s, kept, neg, norm = (_tmp(x, out) for x in ("s", "kept", "neg", "norm"))
    df = df.withColumn(s, utrim(qcol(src).cast("string")))
    df = df.withColumn(kept, F.regexp_replace(F.col(s), r"[^0-9,.\-+]", "")) \
           .withColumn(neg, F.col(s).startswith("(") & F.col(s).endswith(")"))
    k = F.col(kept)
    n_comma = F.length(k) - F.length(F.translate(k, ",", ""))
    n_dot = F.length(k) - F.length(F.translate(k, ".", ""))
    last_comma = F.length(k) - F.locate(",", F.reverse(k))
    last_dot = F.length(k) - F.locate(".", F.reverse(k))

    def single(sep: str) -> Column:
        left, right = F.substring_index(k, sep, 1), F.substring_index(k, sep, -1)
        return F.when(F.length(right) <= 2, F.concat(left, F.lit("."), right)).otherwise(F.concat(left, right))

    normalized = (
        F.when((n_comma > 0) & (n_dot > 0),
               F.when(last_comma > last_dot, F.translate(F.translate(k, ".", ""), ",", "."))
               .otherwise(F.translate(k, ",", "")))
        .when((n_comma == 1) & (n_dot == 0), single(","))
        .when((n_dot == 1) & (n_comma == 0), single("."))
        .otherwise(k))
    df = df.withColumn(norm, normalized)
    n = F.col(norm)
    signed = F.when(F.col(neg) & ~n.startswith("-"), F.concat(F.lit("-"), n)).otherwise(n)
    df = df.withColumn(norm, signed)
    value = F.when(F.col(norm).rlike(_PLAIN_NUMBER), F.col(norm).try_cast("double"))
    return df.withColumn(out, value).drop(s, kept, neg, norm)


def with_clean_money_column(df: DataFrame, src: str, out: str, dirty_flag: Column) -> DataFrame:
    """Column-wide switch: clean every cell when the column is dirty, else read
    it directly; unreadable and missing cells become 0 (not null)."""
    cleaned = _tmp("cleaned", out)
    df = with_clean_money_text(df, src, cleaned)
    value = F.when(dirty_flag, F.col(cleaned)).otherwise(direct_number(qcol(src).cast("string")))
    return df.withColumn(out, F.coalesce(value, F.lit(0.0))).drop(cleaned)


def numeric_money(c: Column) -> Column:
    """Already-numeric money column: missing and NaN become 0."""
    d = c.cast("double")
    return F.when(F.isnan(d), F.lit(0.0)).otherwise(F.coalesce(d, F.lit(0.0)))


def has_currency(text: Column) -> Column:
    """A currency token occurs anywhere in the lower-cased text (substring match)."""
    from tallyframe.functions.vocab import CURRENCY_TOKENS
    # a token that holds another one adds nothing
    least = [t for t in CURRENCY_TOKENS if not any(o in t for o in CURRENCY_TOKENS if o != t)]
    # plain searches in the text lowered once: one pattern of all tokens tries each of them
    # at every character
    held = F.transform(F.array(F.lower(text)), lambda low: reduce(or_, [F.contains(low, F.lit(t)) for t in least]))
    return F.coalesce(held[0], F.lit(False))


def has_currency_or_sign(text: Column) -> Column:
    """Currency token, or an explicit sign before a digit."""
    return has_currency(text) | F.coalesce(F.lower(text).rlike(r"(^|[\s(])[+-]\s*\d"), F.lit(False))


def with_profile_number(df: DataFrame, src: str, out: str) -> DataFrame:
    """Add ``out``: the profiling parser → ``struct(value double, has_decimal boolean,
    normalized string)`` or null when the text is not a number.

    Rejects ``{}[]:``; rejects letters unless a currency token is present; keeps
    ``digits , . - + ( )``; outer parentheses mean negative; with both separators
    the right-most is decimal, a single kind is decimal only with ≤2 digits after
    its last occurrence, otherwise every separator is a thousands mark.
    """
    s, kept, nums, sep, norm = (_tmp(x, out) for x in ("ps", "pkept", "pnums", "psep", "pnorm"))
    df = df.withColumn(s, utrim(qcol(src).cast("string")))
    df = df.withColumn(kept, F.regexp_replace(F.col(s), r"[^0-9,.\-+()]+", ""))
    df = df.withColumn(nums, F.translate(F.col(kept), "()", ""))
    n = F.col(nums)
    has_c, has_d = F.instr(n, ",") > 0, F.instr(n, ".") > 0
    last_c = F.length(n) - F.locate(",", F.reverse(n))
    last_d = F.length(n) - F.locate(".", F.reverse(n))
    after_c = F.locate(",", F.reverse(n)) - 1
    after_d = F.locate(".", F.reverse(n)) - 1
    separator = (F.when(has_c & has_d, F.when(last_c > last_d, F.lit(",")).otherwise(F.lit(".")))
                 .when(has_c, F.when(after_c <= 2, F.lit(",")).otherwise(F.lit("")))
                 .when(has_d, F.when(after_d <= 2, F.lit(".")).otherwise(F.lit("")))
                 .otherwise(F.lit("")))
    df = df.withColumn(sep, separator)
    sp = F.col(sep)
    normalized = (F.when(sp == ",", F.translate(F.translate(n, ".", ""), ",", "."))
                  .when(sp == ".", F.translate(n, ",", ""))
                  .otherwise(F.translate(n, ",.", "")))
    df = df.withColumn(norm, F.translate(normalized, "+", ""))
    k = F.col(kept)
    negative = k.startswith("(") & k.endswith(")")
    nm = F.col(norm)
    df = df.withColumn(norm, F.when(negative & ~nm.startswith("-"), F.concat(F.lit("-"), nm)).otherwise(nm))
    st = F.col(s)
    rejected = (st == "") | st.rlike(r"[{}\[\]:]") | (F.lower(st).rlike("[a-zа-я]") & ~has_currency(st))
    # the search for currency tokens comes last
    ok = F.col(norm).rlike(r"^-?(\d+\.?\d*|\.\d+)$") & k.rlike(r"\d") & ~rejected
    value = F.when(ok, F.struct(F.col(norm).cast("double").alias("value"), (sp != "").alias("has_decimal"),
                                F.col(norm).alias("normalized")))
    return df.withColumn(out, value).drop(s, kept, nums, sep, norm)
