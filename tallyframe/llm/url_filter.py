"""URL rules by a blocked Bloom filter and an exact hash join.

A rule lists a host suffix and a path prefix (``example.org/es/``). The canonical
keys of a URL are its last labels, as many as some rule's host has, joined to each of
its path prefixes as long as some rule's path; so a host of any length has few keys. A blocked Bloom filter of the listed keys, one
row of eight 64-bit words per block, passes possible hits; an exact hash join with
the list removes the false positives; the longest rule left decides, and a URL that
no rule fits is allowed.

A key sets one bit in each of its block's eight words, so a probe reads one block.
The filter is sized from the exact count of the list; it and the list are broadcast
up to ``BROADCAST_RULES`` rules (64 bytes of filter per 8 keys), beyond that they are
joined by shuffle on the distinct keys of all URLs, so that a host of a third of all
rows is one row per task.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no
rule; an empty path fits no rule, whose paths start with ``/``; of fitting rules the
longest wins, on equal length the longer host, then block; repeated rows stay; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import staged

#: The rules that op2 judges by: (verdict, host suffix and path prefix).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/")]
KEYS_PER_BLOCK = 8
BROADCAST_RULES = 100_000
WORDS = 8


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule string")


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return _ascii_lower(host), path


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _masks(key: Column) -> list[Column]:
    """The bit that ``key`` sets in each word: eight 6-bit slices of a second hash."""
    h = F.xxhash64(F.lit("word"), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"),
                            F.shiftrightunsigned(h, 6 * w).bitwiseAND(F.lit(63)).cast("int")) for w in range(WORDS)]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, w0 ... w7) of the filter of ``keys`` (key)."""
    masks = keys.select(_block(F.col("key"), blocks).alias("block"),
                        *[m.alias(f"w{w}") for w, m in enumerate(_masks(F.col("key")))])
    return masks.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)])


def possible_hits(keys: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``keys`` (key, ...) that the filter passes."""
    hit = F.lit(True)
    for w, mask in enumerate(_masks(F.col("key"))):
        hit = hit & (F.col(f"w{w}").bitwiseAND(mask) == mask)
    return (keys.withColumn("_block", _block(F.col("key"), blocks))
            .join(bloom, F.col("_block") == F.col("block")).where(hit)
            .drop("block", "_block", *[f"w{w}" for w in range(WORDS)]))


def judge(pages: DataFrame, rules: DataFrame, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict: one row per row of ``pages``."""
    cut = F.instr("rule", "/")
    rules = (rules.where("rule is not null").select(
        F.concat(_ascii_lower(F.substring("rule", F.lit(1), cut - 1)),
                 F.substring("rule", cut, F.lit(2**31 - 1))).alias("key"),
        F.col("rule").alias("_rule"), F.col("verdict").alias("_verdict"),
        (cut - 1).alias("_host_chars"), (F.char_length("rule") - cut + 1).alias("_path_chars")).where(cut > 0)
        .groupBy("key", "_host_chars", "_path_chars")  # listed twice: one row; block before allow
        .agg(F.min("_rule").alias("_rule"), F.max("_verdict").alias("_verdict")))
    labels = F.size(F.split(F.expr("left(key, _host_chars)"), "[.]"))
    shape = rules.agg(F.count("*"), F.sort_array(F.collect_set("_path_chars")), F.sort_array(F.collect_set(labels))).first()
    n, lengths, depths = shape  # as many lengths and depths as the longest rule has characters at most
    blocks = max(1, -(-n // KEYS_PER_BLOCK))
    small = n <= broadcast_rules
    bounded = F.broadcast if small else (lambda df: df)
    bloom = bounded(bloom_filter(rules.select("key"), blocks))

    host, path = split_url(F.col("url"))
    urls = (pages.select("page_id", F.col("url").cast("string").alias("url"))
            .withColumn("host", host).withColumn("path", path))
    # a host of fewer labels than asked for is its own suffix
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -d) for d in depths])
                                ) if depths else F.array().cast("array<string>")
    prefixes = F.array(*[F.when(F.char_length("path") >= k, F.substring("path", 1, k)) for k in lengths]
                       ) if lengths else F.array().cast("array<string>")
    urls = urls.withColumn("_keys", F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(
        F.filter(prefixes, lambda p: p.isNotNull()), lambda p: F.concat(s, p))))))
    rank = F.struct((F.col("_host_chars") + F.col("_path_chars")).alias("chars"), F.col("_host_chars").alias("host_chars"),
                    (F.col("_verdict") == "block").alias("block"), F.col("_rule").alias("rule"))

    # distinct (host, keys) first: a hot host is judged once for each of its path heads
    shapes = urls.select("_keys").distinct()
    keys = shapes.select("_keys", F.explode("_keys").alias("key"))
    if small:
        hits = possible_hits(keys, bloom, blocks).join(bounded(rules), "key")
    else:
        listed = possible_hits(keys.select("key").distinct(), bloom, blocks).join(rules, "key")
        hits = keys.join(listed, "key")
    # written first: both sides of the last join are shuffled tables, so AQE splits a hot host
    best = staged(hits.groupBy("_keys").agg(F.max(rank).alias("_best")), "url-verdicts")
    return (urls.join(best.withColumnRenamed("_keys", "_of"), F.col("_keys") == F.col("_of"), "left")
            .select("page_id", "url", "host", "path", F.col("_best.rule").alias("rule"),
                    F.when(F.col("_best.block"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict")))
