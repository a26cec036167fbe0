"""Toxic passages by maximum-scoring segment search.

Model. Every token gets the log-odds of its word between toxic and other labelled
documents (a word counts once for a document), with an informative Dirichlet prior:
the share of all documents of the corpus that hold the word, over a flat floor.
Log-odds are shrunk by their standard error (``1 - (Z_SHRINK / z)^2`` of them stays, no
less than nothing), so that weak evidence weighs little however few labels there are,
and every token pays ``DRIFT``, so ordinary text scores negative. Words are counted one
by one, named by 63 bits of their hash; only those that keep a score reach the driver.

Search. One linear pass finds all maximal scoring segments of a text (each run of
tokens whose total cannot be raised by extending or shortening it).

Calibration. Scores of segments of ordinary text follow an extreme-value law: the
chance of one of at least ``s`` in ``n`` tokens is ``1 - exp(-K n exp(-lambda s))``,
with ``lambda`` solved from the token scores of the corpus and ``K`` fitted on
labelled documents that are not toxic. Segments with an expected count of at most
``E_MOST`` are passages; a document's evidence is the excess ``lambda s - ln(K n)``
of its best segment, its best ``lambda s``, the sums of ``lambda s`` over segments beyond
the fixed ``STEPS`` and its length, mapped to a probability by a logistic regression.
The regression is cross-fitted: it sees every labelled document as scored by the words
of the other folds, and what reaches the driver is one row of sums per label id.

Labels are learnt from a bounded sample (``TRAIN_ROWS``, smallest hashes of the id) of
the labelled rows that ``is_training`` admits. Labels, language, source and id are
never inputs of a score.

Defined cases: null or empty text has no tokens and no passage, and gets the
probability of no evidence; a document labelled more than once counts as toxic if any
label says so; null labels are ignored; without both labels among the training rows
all scores are the share of toxic ones (0 without any); repeated rows stay; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import worker_state

TRAIN_ROWS = 50_000
FOLDS = 3
#: Weight of the corpus frequencies, and the flat floor of each word, in documents.
PRIOR, FLOOR = 30.0, 0.5
#: Standard errors of a log-odds that shrinkage takes for noise.
Z_SHRINK = 2.0
#: Sums of segment scores (times lambda) are taken beyond each of these.
STEPS = (1.0, 3.0, 6.0)
DRIFT = 0.5
SCORE_MOST = 8.0
E_MOST = 0.05
#: Bytes of text per vectorised step, and words a worker remembers (memory only).
STEP_BYTES = 4_000_000
MEMO_WORDS = 400_000


def _name(word: str) -> int:
    """The word's name: 63 bits of its hash, without case and punctuation around it."""
    return xxhash.xxh64_intdigest(word.strip("\"'.,;:!?()[]{}<>*_-").lower().encode("utf-8", "surrogatepass"), 0) >> 1


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(name of every token, start of each text among them, and the end)."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    words = split.values.dictionary_encode()
    memo = worker_state("toxicity words", dict)
    if len(memo) > MEMO_WORDS:
        memo.clear()
    of = np.empty(len(words.dictionary) + 1, np.int64)
    for k, w in enumerate(words.dictionary.to_pylist()):
        b = memo.get(w)
        if b is None:
            b = memo[w] = _name(w) if w else -1
        of[k] = b
    flat = of[words.indices.to_numpy()]
    offsets = split.offsets.to_numpy().astype(np.int64)
    # leading and trailing white space leaves empty words
    real = flat >= 0
    return flat[real], np.concatenate([[0], np.cumsum(real)])[offsets]


def _steps(part: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < part.num_rows:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + STEP_BYTES, "right")))
        yield part.slice(start, stop - start)
        start = stop


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, after last, score) of a token sequence,
    in one pass over its positive scores."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    left: list[float] = []   # total before each candidate
    right: list[float] = []  # total after it
    span: list[tuple[int, int]] = []
    back: list[int] = []     # nearest candidate before it with a smaller left total
    for i in np.flatnonzero(scores > 0).tolist():
        lo, hi, first = total[i], total[i + 1], i
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = back[j]
            if j < 0 or right[j] >= hi:
                left.append(lo)
                right.append(hi)
                span.append((first, i + 1))
                back.append(j)
                break
            lo, first = left[j], span[j][0]
            del left[j:], right[j:], span[j:], back[j:]
    return [(a, b, r - x) for (a, b), x, r in zip(span, left, right)]


@dataclass
class Model:
    words: np.ndarray  # names of the words that keep a score, ascending
    scores: np.ndarray  # their scores; all other words score -DRIFT
    lam: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, ...] = (0.0,) * (4 + len(STEPS))
    constant: float | None = None

    def of(self, names: np.ndarray) -> np.ndarray:
        """Scores of tokens."""
        if not len(self.words):
            return np.full(len(names), -DRIFT)
        at = np.minimum(np.searchsorted(self.words, names), len(self.words) - 1)
        return np.where(self.words[at] == names, self.scores[at], -DRIFT)

    def excess(self, score: float, n: int) -> float:
        return self.lam * score - self.log_k - math.log(max(n, 1))

    def sums(self, scores: list[float]) -> list[float]:
        """A text's best ``lambda s``, and the sums beyond each of ``STEPS``."""
        raw = [self.lam * x for x in scores]
        return [max([0.0, *raw]), *(sum(x for x in raw if x > least) for least in STEPS)]

    def evidence(self, sums: list[float], n: int) -> list[float]:
        """What the regression sees of a text: from its sums and length."""
        length = math.log(max(n, 1))
        return [1.0, min(max(0.0, sums[0] - self.log_k - length), 50.0) / 10, min(sums[0], 100.0) / 10, length / 10,
                *(math.log1p(x) for x in sums[1:])]

    def judge(self, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        """(probability, passages) of a text, from the scores of its tokens."""
        n = len(scores)
        found = segments(scores)
        over = [(a, b, self.excess(x, n)) for a, b, x in found]
        sure = [x for x in over if x[2] >= -math.log(E_MOST)]
        if self.constant is not None:
            return self.constant, sure
        z = sum(w * x for w, x in zip(self.weights, self.evidence(self.sums([x for _, _, x in found]), n)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), sure


def log_odds(share: Column, toxic: Column, other: Column, n_toxic: int, n_other: int) -> Column:
    """A word's score, 0 where shrinkage leaves nothing: from the share of the corpus'
    documents that hold it, and how many toxic and other ones do, of ``n_toxic`` and
    ``n_other``."""
    prior = share * PRIOR + FLOOR
    odds = F.log((toxic + prior) / (n_toxic + PRIOR)) - F.log((other + prior) / (n_other + PRIOR))
    variance = 1 / (toxic + prior) + 1 / (other + prior)
    left = F.greatest(F.lit(0.0), 1 - Z_SHRINK ** 2 * variance / (odds * odds))
    kept = F.greatest(F.lit(-SCORE_MOST), F.least(F.lit(SCORE_MOST), odds * left))
    return F.when((toxic + other > 0) & (odds != 0), kept).otherwise(0.0)


def extreme_value_rate(scores: np.ndarray, weight: np.ndarray) -> float:
    """``lambda``: the positive root of E exp(lambda score) = 1 over the corpus."""
    p = weight / max(weight.sum(), 1e-12)
    if not (scores[p > 0] > 0).any() or (p * scores).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    mean = lambda x: float((p * np.exp(np.minimum(x * scores, 700))).sum())
    while mean(high) < 1:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, is_training: Column, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); ``is_training`` is
    a condition on ``doc_id``. One pass over all texts counts words and two over the
    labelled ones; what reaches the driver is the words that keep a score and one row
    per sampled label."""
    sample = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where(F.col("toxic").isNotNull() & is_training).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id", F.lit("train")), "doc_id").limit(train_rows))
    sample = F.broadcast(sample.select(  # at most TRAIN_ROWS rows of three numbers
        F.col("doc_id").alias("_id"), (F.col("toxic") > 0).cast("int").alias("toxic"),
        F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = marked.join(sample, F.col("doc_id") == F.col("_id"))
    kinds = [(fold, toxic) for fold in range(FOLDS) for toxic in (0, 1)]
    rows = {(r.fold, r.toxic): r["count"] for r in labelled.groupBy("fold", "toxic").count().collect()}
    n = {k: rows.get(k, 0) for k in kinds}
    total = sum(n.values())
    n_toxic = sum(n[k] for k in kinds if k[1])
    if n_toxic in (0, total):
        return Model(np.zeros(0, np.int64), np.zeros(0), constant=n_toxic / total if total else 0.0)

    corpus = marked.select("text").mapInArrow(_count, "word long, n long, docs long").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    held = (labelled.select("text", (2 * F.col("fold") + F.col("toxic")).alias("kind"))
            .mapInArrow(_count_kinds, "word long, kind int, docs long").groupBy("word")
            .agg(*(F.sum(F.when(F.col("kind") == 2 * f + t, F.col("docs")).otherwise(0)).alias(f"k{f}{t}") for f, t in kinds)))
    scored = corpus.join(held, "word", "left")
    share = F.col("docs") / marked.count()
    columns = []
    for left_out in [None, *range(FOLDS)]:
        own = [k for k in kinds if k[0] != left_out]
        toxic, other = (sum((F.coalesce(F.col(f"k{f}{t}"), F.lit(0)) for f, t in own if t == mark), F.lit(0)) for mark in (1, 0))
        columns.append(log_odds(share, toxic, other, *(sum(n[k] for k in own if k[1] == mark) for mark in (1, 0))))
    scored = scored.select("word", "n", F.array(*columns).alias("scores"))
    found = scored.where("word < 0 or exists(scores, x -> x <> 0)").toPandas()
    n_tokens = found["n"][found["word"] < 0].sum()
    found = found[found["word"] >= 0].sort_values("word")
    words, weight = found["word"].to_numpy(), found["n"].to_numpy()
    scores = np.array(found["scores"].tolist(), np.float64).reshape(-1, FOLDS + 1)
    models = []
    for k in range(FOLDS + 1):
        own = scores[:, k] != 0
        model = Model(words[own], scores[own, k] - DRIFT)
        rest = n_tokens - weight[own].sum()
        model.lam = extreme_value_rate(np.append(model.scores, -DRIFT), np.append(weight[own], rest).astype(float))
        models.append(model)
    model = models[0]
    seen = _segment_sums(labelled.select("_id", "toxic", "fold", "text"), models[1:])
    # one row for each label id, however often the id is repeated
    seen = seen.groupBy("_id").agg(F.max(F.struct("toxic", "n", "sums")).alias("r")).select("_id", "r.*").orderBy("_id").toPandas()
    y = seen["toxic"].to_numpy().astype(float)
    length = np.maximum(seen["n"].to_numpy(), 1)
    # K by moments of the extreme-value law: its mean is (ln(K n) + 0.5772) / lambda
    top = np.array([x[0] for x in seen["sums"]])
    model.log_k = float((top - np.log(length))[y == 0].mean()) - 0.5772
    x = np.array([model.evidence(list(own), k) for own, k in zip(seen["sums"], length.tolist())])
    model.weights = tuple(logistic(x, y).tolist())
    return model


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every word, step by step; word -1 holds all
    tokens of the step."""
    for part in parts:
        for step in _steps(part, 0):
            flat, ends = tokens(step.column(0))
            words, at, n = np.unique(flat, return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            docs = np.bincount(np.unique(row * max(len(words), 1) + at) % max(len(words), 1), minlength=len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([[-1], words]), pa.int64()), pa.array(np.concatenate([[len(flat)], n]), pa.int64()),
                 pa.array(np.concatenate([[step.num_rows], docs]), pa.int64())], ["word", "n", "docs"])


def _count_kinds(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each kind that hold a word, step by step."""
    for part in parts:
        for step in _steps(part, 0):
            flat, ends = tokens(step.column(0))
            kinds = step.column(1).to_numpy()
            for kind in np.unique(kinds).tolist():
                held = [np.unique(flat[ends[k]:ends[k + 1]]) for k in np.flatnonzero(kinds == kind).tolist()]
                words, docs = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.int64()), pa.array(np.full(len(words), kind), pa.int32()), pa.array(docs, pa.int64())],
                    ["word", "kind", "docs"])


def _segment_sums(docs: DataFrame, models: list[Model]) -> DataFrame:
    """_id, toxic, n (tokens), sums for docs (_id, toxic, fold, text), each scored by the
    model of its fold."""
    shared = docs.sparkSession.sparkContext.broadcast([vars(m) for m in models])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Model(**m) for m in shared.value]
        for part in parts:
            for step in _steps(part, 3):
                flat, ends = tokens(step.column(3))
                sums = []
                for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    m = own[step.column(2)[k].as_py()]
                    sums.append(m.sums([x for _, _, x in segments(m.of(flat[a:b]))]))
                yield pa.RecordBatch.from_arrays(
                    [step.column(0), step.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.list_(pa.float64()))],
                    ["_id", "toxic", "n", "sums"])

    return docs.mapInArrow(run, "_id long, toxic int, n long, sums array<double>")


#: A passage: its first token, the token after its last, and its excess.
PASSAGES = "array<struct<first:int,last:int,excess:double>>"


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``score`` (probability) and ``passages``."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # the words that keep a score
    chosen = docs.withColumn("text", F.col("text").cast("string")).select(
        *[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])
    at = chosen.columns.index("text")
    kept = chosen.schema.fields[:len(keep)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"score double, passages {PASSAGES}"])
    spans = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("excess", pa.float64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value)
        for part in parts:
            for step in _steps(part, at):
                flat, ends = tokens(step.column(at))
                each = m.of(flat)
                scores, found = [], []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    probability, sure = m.judge(each[a:b])
                    scores.append(probability)
                    found.append([{"first": i, "last": j, "excess": x} for i, j, x in sure])
                yield pa.RecordBatch.from_arrays(
                    [*(step.column(k) for k in range(len(keep))), pa.array(scores, pa.float64()), pa.array(found, spans)],
                    [*keep, "score", "passages"])

    return chosen.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is never learnt from: crc32 of the decimal id, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
