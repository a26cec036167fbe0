"""Ledger views over the driver's parquet tables.

Money stays in whole cents: revenue is the 2-decimal list price; an expense
that is a price × discount product is computed in integer cents (truncated),
so sums are sums of exact 2-decimal values.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.prepare import from_prepared
from tallyframe.roles import Ledger


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def cents(c) -> F.Column:
    return F.round(c * 100).cast("bigint")


def sales_expense(price="l_extendedprice", discount="l_discount", flag="l_returnflag"):
    """Returned lines cost the whole price; others cost price × discount (cents)."""
    part = (F.expr(f"cast(round({price} * 100) as bigint) * cast(round({discount} * 100) as bigint) div 100")
            / F.lit(100.0))
    return F.when(F.col(flag) == "R", F.col(price)).otherwise(part)


def sales(spark: SparkSession, sf_dir: str, keyed: bool = False) -> Ledger:
    """lineitem: ship date, list price as revenue, returns/discounts as expenses,
    return flag as category; optional key = line status."""
    li = table(spark, sf_dir, "lineitem")
    keys = ["l_linestatus"] if keyed else []
    df = li.select(*keys, F.col("l_shipdate").alias("ts"),
                   F.col("l_extendedprice").alias("revenue"),
                   sales_expense().alias("expenses"),
                   F.lit(None).cast("double").alias("amount"),
                   F.col("l_returnflag").alias("category"))
    return from_prepared(df, keys, revenue=True, expenses=True, category=True)


def cash(spark: SparkSession, sf_dir: str) -> Ledger:
    """events: signed amount (errors are outflows), event type as category."""
    ev = table(spark, sf_dir, "events")
    amount = F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value"))
    df = ev.select(F.col("ts"), F.greatest(amount, F.lit(0.0)).alias("revenue"),
                   F.abs(F.least(amount, F.lit(0.0))).alias("expenses"), amount.alias("amount"),
                   F.col("event_type").alias("category"))
    return from_prepared(df, [], amount=True, category=True)


def orders(spark: SparkSession, sf_dir: str) -> Ledger:
    """orders: order date, total price as revenue, priority as category."""
    o = table(spark, sf_dir, "orders")
    df = o.select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("revenue"),
                  F.lit(None).cast("double").alias("expenses"), F.lit(None).cast("double").alias("amount"),
                  F.col("o_orderpriority").alias("category"))
    return from_prepared(df, [], revenue=True, category=True)


def balance(spark: SparkSession, sf_dir: str) -> Ledger:
    """customer: account balance as a signed amount, segment as category, no dates."""
    c = table(spark, sf_dir, "customer")
    amount = F.col("c_acctbal")
    df = c.select(F.lit(None).cast("timestamp_ntz").alias("ts"),
                  F.greatest(amount, F.lit(0.0)).alias("revenue"),
                  F.abs(F.least(amount, F.lit(0.0))).alias("expenses"), amount.alias("amount"),
                  F.col("c_mktsegment").alias("category"))
    return from_prepared(df, [], amount=True, category=True, dates=False)


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with money and dates rendered as text, the way exported ledgers look.

    Built from integer cents so the text is exact. ``money_kind = o_orderkey % 8``:
    0 plain ``12345.67``; 1 ``12 345.67 ₸``; 2 ``12.345,67``; 3 ``(12345.67)``;
    4 ``12345,6``; 5 blank; 6 ``n/a``; 7 ``12,345`` (several commas above a million).
    ``date_kind = (o_orderkey div 8) % 4``: ISO, ``dd.MM.yyyy``, ``dd/MM/yyyy``, and
    either a timestamp with offset or junk. ``clean_text`` is plain text or blank.
    ``alt_date`` is only valid for priority 1-URGENT.
    """
    o = table(spark, sf_dir, "orders")
    c = cents(F.col("o_totalprice"))
    units = (c / 100).cast("bigint")
    frac = F.lpad((c % 100).cast("string"), 2, "0")
    grouped = F.format_number(units, 0)
    k = F.col("o_orderkey") % 8
    money = (F.when(k == 0, F.concat(units.cast("string"), F.lit("."), frac))
             .when(k == 1, F.concat(F.regexp_replace(grouped, ",", " "), F.lit("."), frac, F.lit(" ₸")))
             .when(k == 2, F.concat(F.regexp_replace(grouped, ",", "."), F.lit(","), frac))
             .when(k == 3, F.concat(F.lit("("), units.cast("string"), F.lit("."), frac, F.lit(")")))
             .when(k == 4, F.concat(units.cast("string"), F.lit(","), F.substring(frac, 1, 1)))
             .when(k == 5, F.lit(""))
             .when(k == 6, F.lit("n/a"))
             .otherwise(grouped))
    d = F.col("o_orderdate")
    dk = (F.col("o_orderkey") / 8).cast("bigint") % 4
    half = (F.col("o_orderkey") / 32).cast("bigint") % 2
    date_text = (F.when(dk == 0, F.date_format(d, "yyyy-MM-dd"))
                 .when(dk == 1, F.date_format(d, "dd.MM.yyyy"))
                 .when(dk == 2, F.date_format(d, "dd/MM/yyyy"))
                 .when(half == 0, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 10:30:00.000000 +03:00")))
                 .otherwise(F.lit("n/d")))
    clean = F.when(k == 5, F.lit("")).otherwise(F.concat(units.cast("string"), F.lit("."), frac))
    alt = F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(d, "dd.MM.yyyy")).otherwise(F.lit("--"))
    return o.select("o_orderkey", "o_orderpriority", "o_orderstatus", k.alias("money_kind"),
                    dk.alias("date_kind"), money.alias("money_text"), clean.alias("clean_text"),
                    date_text.alias("date_text"), alt.alias("alt_date"))
