"""Quality rules as a bitmask ledger.

Every rule is evaluated once. The ledger keeps one row per document: its measurements
and ``failures``, a 64-bit mask in which bit i tells that rule i fails. A policy is a
named, versioned mask of the rules that reject; judging a document is one bitwise
``and``, so policies change without reading texts again. Ablations group the ledger by
its mask (a partial aggregate: as many rows as there are different masks, whatever the
number of documents) and answer with bitwise tests what each rule rejects, what it
rejects alone, and what would be kept without it.

A rule's bit is its place in ``RULES``, so rules are only ever added at the end, and an
old ledger stays valid: ``extend`` evaluates rules that are new from the stored
measurements.

Defined cases: null or empty text has no words, one empty line, and fails
``few_words``; every row of the documents is a row of the ledger, repeated rows and
null ids included; an empty table gives an empty ledger; columns not asked for in
``keep`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.words import WHITE_SPACE, split_lines, split_words, steps

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"
BULLET = r"^[\x20\x09-\x0D]*[-*\x{2022}]"
ELLIPSIS = r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*$"
LETTER = r"\p{L}"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_alpha_words",
            "n_shout_words", "n_bullet_lines", "n_ellipsis_lines"]

#: (name, condition over the measurements under which a document fails); n_lines counts
#: the lines that hold a word. Bit i of a mask is rule i.
RULES = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("many_words", "n_words > 100000"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 10 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
    ("ellipsis_lines", "10 * n_ellipsis_lines > 3 * n_lines"),
    ("few_letters", "10 * n_alpha_words < 8 * n_words"),
    ("shouting", "2 * n_shout_words > n_words"),
]
BASE = ["few_words", "repeated_windows"]


class Policy(NamedTuple):
    """The rules that reject a document."""
    name: str
    version: int
    rules: list[str]


POLICIES = [
    Policy("base", 1, BASE),
    Policy("web", 1, [*BASE, "short_words", "long_words", "symbols", "bullet_lines", "ellipsis_lines", "few_letters"]),
    Policy("web", 2, [*BASE, "short_words", "long_words", "symbols", "bullet_lines", "ellipsis_lines", "few_letters",
                      "repeated_lines", "shouting"]),
    Policy("strict", 1, [name for name, _ in RULES]),
]


def policy(name: str, version: int | None = None, policies: list[Policy] = POLICIES) -> Policy:
    """The policy of that name, its newest version unless one is given."""
    found = [p for p in policies if p.name == name and version in (None, p.version)]
    if not found:
        raise ValueError(f"no policy {name} version {version}")
    return max(found, key=lambda p: p.version)


def mask(rules: list[str]) -> int:
    bits = {name: bit for bit, (name, _) in enumerate(RULES)}
    return sum(1 << bits[r] for r in set(rules))


def _windows_found_twice(ids: np.ndarray, text_no: np.ndarray, size: int) -> np.ndarray:
    """True for each word that lies in a window of ``size`` (a power of two) words that
    its text holds twice or more. Windows are numbered exactly, by numbering pairs of
    half windows, so no hash decides."""
    n = len(ids)
    covered = np.zeros(n + 1, np.int64)
    if n >= size:
        grams, half = ids.astype(np.int64), 1
        while half < size:
            grams, _ = pd.factorize(grams[:-half] * (int(grams.max()) + 1) + grams[half:])
            half *= 2
        at = np.flatnonzero(text_no[:n - size + 1] == text_no[size - 1:])
        owner, _ = pd.factorize(grams[at] * (int(text_no[-1]) + 1) + text_no[at])
        again = at[np.bincount(owner)[owner] > 1] if len(at) else at
        np.add.at(covered, again, 1)
        np.add.at(covered, again + size, -1)
    return np.cumsum(covered)[:n] > 0


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text of one step."""
    n = len(texts)

    def per_text(of: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        if values is None:
            return np.bincount(of, minlength=n).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        ends = np.searchsorted(of, np.arange(n + 1))
        return total[ends[1:]] - total[ends[:-1]]

    words, text_no, _ = split_words(texts, WHITE_SPACE)
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False)
    known = coded.dictionary.cast(pa.large_string())
    chars = pc.utf8_length(known).to_numpy(zero_copy_only=False)
    letters = pc.match_substring_regex(known, LETTER).to_numpy(zero_copy_only=False)
    shouted = pc.and_not(pc.match_substring_regex(known, "[A-Z]"), pc.match_substring_regex(known, "[a-z]")
                         ).to_numpy(zero_copy_only=False)

    lines, line_of = split_lines(texts)
    line_coded = lines.dictionary_encode()
    line_ids = line_coded.indices.to_numpy(zero_copy_only=False)

    def line_test(pattern: str) -> np.ndarray:
        return pc.match_substring_regex(line_coded.dictionary, pattern).to_numpy(zero_copy_only=False)[line_ids]

    full = line_test(HAS_WORD)
    again = pd.Series(line_ids.astype(np.int64) * n + line_of).duplicated().to_numpy()
    return {
        "n_words": per_text(text_no),
        "word_chars": per_text(text_no, chars[ids]),
        "n_symbols": pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64),
        "n_lines": per_text(line_of, full),
        "n_dup_lines": per_text(line_of, full & again),
        "n_repeat_words": per_text(text_no, _windows_found_twice(ids, text_no, WINDOW)),
        "n_alpha_words": per_text(text_no, letters[ids]),
        "n_shout_words": per_text(text_no, shouted[ids]),
        "n_bullet_lines": per_text(line_of, full & line_test(BULLET)),
        "n_ellipsis_lines": per_text(line_of, full & line_test(ELLIPSIS)),
    }


def _failures(first: int = 0) -> Column:
    out = F.lit(0).cast("long")
    for bit, (_, condition) in enumerate(RULES[first:], first):
        out = out.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` of each document, its measurements, and ``failures`` (long) with
    ``n_rules``, the number of rules that it covers. No shuffle."""
    kept = [docs.schema[c] for c in keep]
    schema = T.StructType([*kept, *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in steps(batch.column(batch.num_columns - 1)):
                found = measure(texts)
                own = [batch.column(i).slice(start, len(texts)) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(found[m], pa.int64()) for m in MEASURES)],
                                                 schema.names)

    measured = docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)
    return measured.withColumn("failures", _failures()).withColumn("n_rules", F.lit(len(RULES)))


def extend(old: DataFrame, rules: int) -> DataFrame:
    """A ledger of the first ``rules`` rules, with the later ones evaluated from its measurements."""
    return old.withColumn("failures", F.col("failures").bitwiseOR(_failures(rules))).withColumn("n_rules", F.lit(len(RULES)))


def fails(rules: list[str]) -> Column:
    """True where a rule of ``rules`` fails."""
    return F.col("failures").bitwiseAND(F.lit(mask(rules)).cast("long")) != 0


def judge(entries: DataFrame, by: Policy) -> DataFrame:
    """``entries`` with ``kept`` under a policy and ``sole_rule``, the rule that alone
    rejects the document (null if none or several do)."""
    hit = F.col("failures").bitwiseAND(F.lit(mask(by.rules)).cast("long"))
    sole = F.lit(None).cast("string")
    for bit, (name, _) in enumerate(RULES):
        sole = F.when(hit == F.lit(1 << bit).cast("long"), F.lit(name)).otherwise(sole)
    return entries.withColumn("kept", hit == 0).withColumn("sole_rule", sole)


def ablation(entries: DataFrame, policies: list[Policy] = POLICIES) -> DataFrame:
    """One row per policy version and rule of it: documents, kept by the policy,
    failing (the rule), alone (rejected by this rule only), kept_without (kept if the
    rule were dropped), words_alone (words of the documents in ``alone``), fails_with (bits
    of the policy's rules that fail together with it). An empty ledger gives no rows."""
    masks = entries.groupBy("failures").agg(F.count("*").alias("docs"), F.sum("n_words").alias("words"))
    bits = {name: bit for bit, (name, _) in enumerate(RULES)}
    # every mask answers every asked row: exploded from one array of the few policy rows
    asked = [F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r).alias("rule"),
                      F.lit(mask(p.rules)).cast("long").alias("pmask"), F.lit(1 << bits[r]).cast("long").alias("bit"))
             for p in policies for r in p.rules]
    each = masks.select("failures", "docs", "words", F.explode(F.array(*asked)).alias("a")
                        ).select("failures", "docs", "words", "a.*")
    hit = F.col("failures").bitwiseAND(F.col("pmask"))
    failing = F.col("failures").bitwiseAND(F.col("bit")) != 0

    def total(condition: Column, of: str = "docs") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(F.lit(0)))

    return each.groupBy("policy", "version", "rule").agg(
        F.sum("docs").alias("documents"), total(hit == 0).alias("kept"), total(failing).alias("failing"),
        total(hit == F.col("bit")).alias("alone"),
        total(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
        total(hit == F.col("bit"), "words").alias("words_alone"),
        F.bit_or(F.when(failing, hit)).alias("fails_with"))
