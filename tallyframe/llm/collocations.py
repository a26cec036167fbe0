"""Phrase collocations of a corpus, per language, counted in quotient filters.

1. Words are counted per language, and named by a 63-bit hash of (language, word) that
   is checked: no frequent word shares it with any other word (else another seed).
2. Words found ``min_count`` times or more get dense ids, by the order of their
   hashes; texts become sequences of ids with breaks at piece ends and at other words.
   A phrase of ``min_count`` occurrences has only such words, so nothing is lost. The
   dictionary reaches the tasks as sorted hashes, ``DICTIONARY_WORDS`` at a time; a
   larger one takes several passes over the sequences.
3. For each length, tasks pack the n-grams of their sequences, permute them, and emit
   one counting quotient filter per shard; the sorted filters of a shard are merged,
   and entries of ``min_count`` or more are unpacked. From length 3 on, n-grams whose
   first or last part is certainly too rare are left out: a bitmap of at most
   ``BITMAP_BITS`` bits holds the frequent n-grams of the length before; its false
   positives cost work, never change a count.
4. Scores, absorbed phrases and ranks are joins of the few frequent phrases.

Shards are sized by the bytes of text, and the permutation spreads n-grams evenly, so
that a shard's distinct n-grams fit a task; a very common n-gram is one entry per
filter.

Defined cases: a null text is empty, a null language ``und``; repeated rows count as
often as they occur; an empty table, or one without a frequent phrase, gives no rows;
columns other than text and lang are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import shuffle_width, staged
from tallyframe.llm.quotient_filter import Entries, Shape, decode, encode, mixed
from tallyframe.llm.words import byte_classes, split_words, steps

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: Words between ``[\x20\x09]``; a run of gaps with one of ``[.,;:!?\x0A-\x0D]`` ends a piece.
CLASSES = byte_classes(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")

#: Frequent words whose hashes are broadcast at once (8 bytes each).
DICTIONARY_WORDS = 8_000_000
#: Bits of the bitmap of frequent n-grams (64 MB), and bits for each of them below that.
BITMAP_BITS = 1 << 29
BITS_EACH = 16
#: Bytes of text for each shard: its n-grams of one length, all distinct, fit a task.
SHARD_BYTES = 16_000_000
#: Bits of a shard number that one shuffle deals by.
DEAL_BITS = 12
#: N-grams held by a task before its filters are emitted.
HELD = 2_000_000


# --- words ------------------------------------------------------------------------------

def _pairs(langs: pa.Array, texts: pa.Array):
    """Of one step: distinct (language, word) as lists, each word's pair, its piece."""
    words, text_no, piece = split_words(texts, CLASSES, lower=True)
    coded, lang = words.dictionary_encode(), langs.dictionary_encode()
    n_langs = max(1, len(lang.dictionary))
    of_text = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    both = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_langs + of_text[text_no]
    pair, known = pd.factorize(both)
    names = lang.dictionary.to_pylist()
    return ([names[i] for i in (known % n_langs).tolist()],
            coded.dictionary.take(pa.array(known // n_langs)).to_pylist(), pair, piece)


def _hashes(langs: list[str], words: list[bytes], seed: int) -> np.ndarray:
    heads = {name: name.encode() + b"\0" for name in set(langs)}
    return np.fromiter((xxhash.xxh64_intdigest(heads[g] + w, seed) >> 1 for g, w in zip(langs, words)),
                       np.int64, len(words))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("string").alias("text"))


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """h, lang, word, n: every word of every language (docs: lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in steps(batch.column(1)):
                langs, words, pair, _ = _pairs(batch.column(0).slice(start, len(texts)), texts)
                yield pa.RecordBatch.from_pydict({
                    "h": pa.array(_hashes(langs, words, seed)), "lang": pa.array(langs, pa.string()),
                    "word": pa.array(words, pa.binary()).cast(pa.string()),
                    "n": pa.array(np.bincount(pair, minlength=len(words)).astype(np.int64))})

    found = docs.mapInArrow(run, "h long, lang string, word string, n long")
    return (found.groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))
            .repartition(shuffle_width(docs.sparkSession), "h"))


def _checked_words(docs: DataFrame, min_count: int) -> tuple[DataFrame, int]:
    """The staged word table, and the seed under which no frequent word shares its hash."""
    for seed in range(16):
        words = staged(count_words(docs, seed), "phrase-words")
        shared = words.groupBy("h").agg(F.count("*").alias("words"), F.max("n").alias("most"))
        if shared.where((F.col("words") > 1) & (F.col("most") >= min_count)).isEmpty():
            return words, seed
    raise RuntimeError("no seed keeps the frequent words apart")


# --- sequences --------------------------------------------------------------------------

class Dictionary:
    """Sorted hashes of the frequent words in parts by hash range; a word's id is its place, from 1."""

    def __init__(self, frequent: DataFrame, total: int, part_words: int):
        spark = frequent.sparkSession
        n = max(1, -(-total // part_words))
        edges = [(1 << 63) * p // n for p in range(n + 1)]
        self.parts, first = [], 1
        for lo, hi in zip(edges, edges[1:]):
            own = frequent.where((F.col("h") >= lo) & (F.col("h") <= hi - 1)) if n > 1 else frequent
            hashes = np.sort(own.select("h").toArrow().column("h").to_numpy().astype(np.int64))
            self.parts.append((lo, hi, first, spark.sparkContext.broadcast(hashes)))
            first += len(hashes)

    def ids(self, frequent: DataFrame) -> DataFrame:
        """id, lang, word, n of the frequent words."""
        out = None
        for lo, hi, first, hashes in self.parts:
            def place(batches, first=first, hashes=hashes):
                for batch in batches:
                    at = np.searchsorted(hashes.value, batch.column(0).to_numpy()) + first
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), *batch.columns[1:]],
                                                     ["id", "lang", "word", "n"])
            own = frequent.where((F.col("h") >= lo) & (F.col("h") <= hi - 1))
            own = own.select("h", "lang", "word", "n").mapInArrow(place, "id long, lang string, word string, n long")
            out = own if out is None else out.unionByName(own)
        return out


def _translated(values: np.ndarray, part: tuple) -> np.ndarray:
    """``-h - 1`` of hashes in the part's range becomes their id, or 0 for other words."""
    lo, hi, first, hashes = part
    own = np.flatnonzero((values < 0) & (values <= -lo - 1) & (values >= -(hi - 1) - 1))
    h, known = -(values[own] + 1), hashes.value
    at = np.searchsorted(known, h)
    found = np.zeros(len(own), bool)
    inside = at < len(known)
    found[inside] = known[at[inside]] == h[inside]
    values[own] = np.where(found, at + first, 0)
    return values


def _without_loners(values: np.ndarray) -> np.ndarray:
    """Runs of zeros as one zero, and no word that stands alone between zeros."""
    full = np.concatenate([[False], values != 0, [False]])
    paired = full[1:-1] & (full[:-2] | full[2:])
    values = np.where(paired, values, 0)
    kept = paired.copy()
    kept[1:] |= paired[:-1]  # the first zero behind a run ends it
    return values[kept]


def sequences(docs: DataFrame, words: Dictionary, seed: int) -> DataFrame:
    """Rows (ids binary): 32-bit word ids of whole batches of texts, 0 between pieces."""
    def encoded(values: np.ndarray, last: bool) -> pa.RecordBatch:
        values = _without_loners(values)
        raw = values.astype("<u4" if last else "<i8").tobytes()
        return pa.RecordBatch.from_pydict({"ids": pa.array([raw], pa.binary())})

    parts = words.parts

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in steps(batch.column(1)):
                langs, known, pair, piece = _pairs(batch.column(0).slice(start, len(texts)), texts)
                if not len(pair):
                    continue
                named = _translated(-_hashes(langs, known, seed) - 1, parts[0])[pair]
                new = np.diff(piece, prepend=piece[0]) > 0
                values = np.zeros(len(named) + int(new.sum()), np.int64)
                values[np.arange(len(named)) + np.cumsum(new)] = named
                yield encoded(values, len(parts) == 1)

    out = staged(docs.mapInArrow(first_pass, "ids binary"), "phrase-ids")
    for number, part in enumerate(parts[1:], 1):
        def next_pass(batches, part=part, last=number == len(parts) - 1):
            for batch in batches:
                for raw in batch.column(0):
                    yield encoded(_translated(np.frombuffer(raw.as_buffer(), "<i8").copy(), part), last)
        out = staged(out.mapInArrow(next_pass, "ids binary"), "phrase-ids")
    return out


# --- n-grams ----------------------------------------------------------------------------

def _gram_hash(ids: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(ids[0]), len(ids), np.uint64)
    for x in ids:
        h = mixed(h ^ x.astype(np.uint64))
    return h


def _bitmap(frequent: DataFrame, k: int, count: int, most_bits: int = BITMAP_BITS):
    """(log2 of its bits, broadcast words) of the frequent n-grams of length ``k``."""
    bits = min(most_bits.bit_length() - 1, max(10, (BITS_EACH * count).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy().reshape(-1, k)
            at = _gram_hash([flat[:, j] for j in range(k)]) >> np.uint64(64 - bits)
            yield pa.RecordBatch.from_pydict({
                "word": pa.array((at >> np.uint64(6)).astype(np.int64)),
                "bit": pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))})

    words = (frequent.select("ids").mapInArrow(places, "word long, bit long")
             .groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow())  # 2^23 rows at most
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words.column("word").to_numpy()] = words.column("bit").to_numpy().view(np.uint64)
    return bits, frequent.sparkSession.sparkContext.broadcast(table)


def _emitted(entries: Entries, shape: Shape, bits: int) -> Iterator[pa.RecordBatch]:
    shards, filters, size = [], [], 0
    for shard, own in entries.shards(shape, bits):
        shards.append(shard)
        filters.append(encode(own, shape, bits))
        size += len(filters[-1])
        if size > 8_000_000:
            yield pa.RecordBatch.from_pydict({"shard": pa.array(shards, pa.int64()), "filter": pa.array(filters, pa.binary())})
            shards, filters, size = [], [], 0
    if shards:
        yield pa.RecordBatch.from_pydict({"shard": pa.array(shards, pa.int64()), "filter": pa.array(filters, pa.binary())})


class _Held:
    """Entries that a task holds; ``full`` parts are merged and handed on."""

    def __init__(self, limit: int):
        self.limit, self.done, self.loose, self.size = limit, [], [], 0

    def add(self, entries: Entries) -> Entries | None:
        self.loose.append(entries)
        self.size += len(entries)
        if self.size > self.limit:
            out = Entries.merged(self.loose)
            if 2 * len(out) > self.limit:  # merging no longer saves much: hand on
                self.loose, self.size = [], 0
                return out
            self.loose, self.size = [out], len(out)
        return None

    def rest(self) -> Entries | None:
        out = Entries.merged(self.loose) if self.loose else None
        self.loose, self.size = [], 0
        return out


def count_grams(texts: DataFrame, shape: Shape, shard_bits: int, min_count: int, prune=None, held: int = HELD,
                deal_bits: int = DEAL_BITS) -> DataFrame:
    """ids (array), a: the n-grams of ``shape.k`` words found ``min_count`` times or more."""
    k = shape.k
    shard_bits = min(shard_bits, shape.widths[0])
    near = min(shard_bits, deal_bits)

    def grams(ids: np.ndarray) -> list[np.ndarray]:
        n = len(ids) - k + 1
        if n < 1:
            return [ids[:0]] * k
        whole = ids != 0
        ok = whole[:n].copy()
        for j in range(1, k):
            ok &= whole[j:j + n]
        if prune is not None:
            bits, table = prune
            part = _gram_hash([ids[j:j + n + 1] for j in range(k - 1)]) >> np.uint64(64 - bits)
            often = (table.value[part >> np.uint64(6)] >> (part & np.uint64(63)) & np.uint64(1)).astype(bool)
            ok &= often[:n] & often[1:]
        at = np.flatnonzero(ok)
        return [ids[at + j] for j in range(k)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = _Held(held)
        for batch in batches:
            for raw in batch.column(0):
                ids = np.frombuffer(raw.as_buffer(), "<u4")
                for start in range(0, len(ids), held):  # n-grams across the cut belong to the earlier part
                    found = grams(ids[start:start + held + k - 1])
                    if len(found[0]):
                        out = mine.add(Entries.of(shape.permute(shape.pack(found))))
                        if out is not None:
                            yield from _emitted(out, shape, near)
        out = mine.rest()
        if out is not None:
            yield from _emitted(out, shape, near)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = _Held(held)
        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = mine.add(decode(raw.as_py(), shape, near, shard))
                if out is not None:
                    yield from _emitted(out, shape, shard_bits)
        out = mine.rest()
        if out is not None:
            yield from _emitted(out, shape, shard_bits)

    def frequent(entries: Entries) -> pa.RecordBatch:
        often = entries.counts >= min_count
        ids = shape.unpack(shape.restore([c[often] for c in entries.columns]))
        flat = pa.array(np.stack(ids, 1).reshape(-1).astype(np.int64))
        offsets = pa.array(np.arange(0, len(flat) + 1, k, dtype=np.int32))
        return pa.RecordBatch.from_pydict({"ids": pa.ListArray.from_arrays(offsets, flat),
                                           "a": pa.array(entries.counts[often])})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, _Held(held)
        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard != at and mine.loose:
                    yield frequent(mine.rest())
                at = shard
                mine.loose.append(decode(raw.as_py(), shape, shard_bits, shard))
                mine.size += len(mine.loose[-1])
                if mine.size > mine.limit:  # equal entries of a shard's filters become one
                    out = Entries.merged(mine.loose)
                    mine.loose, mine.size, mine.limit = [out], len(out), max(held, 2 * len(out))
        if mine.loose:
            yield frequent(mine.rest())

    filters = "shard long, filter binary"
    spark = texts.sparkSession
    parts = texts.mapInArrow(count, filters)
    if near < shard_bits:
        # too many shards for one shuffle: filters of a near shard meet in several tasks
        # (by the place they come from), which split them into the final shards
        parts = (parts.withColumn("from", F.expr(f"monotonically_increasing_id() % {1 << min(8, shard_bits - near)}"))
                 .repartition(shuffle_width(spark), "shard", "from").select("shard", "filter").mapInArrow(deal, filters))
    width = max(1, min(1 << shard_bits, 4 * shuffle_width(spark)))
    return (parts.repartition(width, "shard").sortWithinPartitions("shard")
            .mapInArrow(merge, "ids array<long>, a long"))


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, shard_bytes: int = SHARD_BYTES,
            part_words: int = DICTIONARY_WORDS, held: int = HELD, deal_bits: int = DEAL_BITS
            ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frequent n-grams of 2 words and more: ids, a; words: id, lang, word, n; languages: lang, n)."""
    spark, docs = docs.sparkSession, _texts(docs)
    words, seed = _checked_words(docs, min_count)
    languages = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= min_count)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    total = frequent.count()
    dictionary = Dictionary(frequent, total, part_words)
    named = staged(dictionary.ids(frequent), "phrase-dictionary")
    bits = max(1, total.bit_length())
    shard_bits = max(0, (max(1, -(-size // shard_bytes)) - 1).bit_length())
    texts = sequences(docs, dictionary, seed)
    out, prune = None, None
    for k in range(2, max_words + 1):
        found = staged(count_grams(texts, Shape(k, bits), shard_bits, min_count, prune, held, deal_bits), f"phrases-{k}")
        out = found if out is None else out.unionByName(found)
        many = found.count()
        if not many:
            break
        if k < max_words:
            prune = (*_bitmap(found, k, many),)
    return out, named, languages


# --- scores -----------------------------------------------------------------------------

def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int | None = TOP,
                 absorb_percent: int = 100, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best ``top`` phrases (None: all)."""
    grams, words, languages = phrases(docs, min_count, max_words, **how)
    counts = grams.select("ids", "a").unionByName(words.select(F.array("id").alias("ids"), F.col("n").alias("a")))

    # parts of every cut: the first k words, and the rest
    cuts = grams.select("ids", "a", F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k"))
    parts = cuts.select("ids", "a", "k", F.explode(F.expr(
        "array(struct(true as head, slice(ids, 1, k) as part), struct(false as head, slice(ids, k + 1, size(ids) - k) as part))"
    )).alias("p")).select("ids", "a", "k", "p.head", "p.part")
    # both sides are written tables, so AQE splits the many phrases that share a common word
    parts = staged(parts, "phrase-parts")
    counts = staged(counts.select(F.col("ids").alias("of"), F.col("a").alias("f")), "phrase-counts")
    scored = (parts.join(counts.hint("merge"), F.col("part") == F.col("of"))
              .groupBy("ids", "a", "k").agg(F.max(F.when(F.col("head"), F.col("f"))).alias("l"),
                                            F.max(F.when(~F.col("head"), F.col("f"))).alias("r")))

    # a phrase is absorbed by one a word longer that holds it and is as frequent; longer ones follow from that
    longer = (grams.where(F.size("ids") > 2)
              .select("a", F.explode(F.expr("array(slice(ids, 1, size(ids) - 1), slice(ids, 2, size(ids) - 1))")).alias("inner"))
              .groupBy("inner").agg(F.max("a").alias("longer")))
    words = staged(words.select("id", "lang", "word"), "phrase-words")
    kept = (grams.join(longer, F.col("ids") == F.col("inner"), "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < absorb_percent * F.col("a"))).select("ids"))
    spelled = (staged(kept.select("ids", F.posexplode("ids").alias("at", "id")), "phrase-spelled")
               .join(words.hint("merge"), "id").groupBy("ids")
               .agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelled"), F.min("lang").alias("lang"))
               .select(F.col("ids").alias("of"), "lang", F.expr("concat_ws(' ', spelled.word)").alias("phrase")))

    # exact in 38 digits: 1000 * a * n stays below 10^38 up to 10^17 words
    wide = "cast({} as decimal(38,0))".format
    best = (scored.join(spelled, F.col("ids") == F.col("of"))
            .join(languages.withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang"))
            .withColumn("score", F.expr(f"({wide('1000')} * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})"))
            .groupBy("ids", "lang", "phrase", "a", "n")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
            .select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
