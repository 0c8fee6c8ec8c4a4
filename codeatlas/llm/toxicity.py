"""Toxicity by class-conditional Kneser-Ney models (operator 1).

Two letter models of words, one learned from toxic and one from ordinary
documents, each interpolated Kneser-Ney over ORDER letters: the top order has
absolute-discounted counts, lower orders continuation counts. Orders up to
SHARED are pooled over both classes, so a rare expression that a class has
hardly seen is smoothed by the same backoff counts in both models. A word's
weight is the log-likelihood ratio of its letters; a text's is the sum over its
length. The length-normalised ratio of the whole text and of its worst window,
and the share of strongly toxic words, go through a logistic curve fitted on
ratios that other thirds of the training rows' counts gave (cross-fitting).

Every labelled document of the learning folds teaches, whole texts: counts are
summed and the curve is fitted by Spark aggregations over all of them. All
letter windows of these texts are kept, so continuation counts are whole; what
reaches the driver and each worker is one number a distinct window, which grows
with the vocabulary, not with the texts; workers hold one model at a time.
Texts of the learning folds meet their labels by a join; scoring reads every
whole text in the scan and shuffles nothing.

Defined cases: a null text counts as empty, and a text without letters scores
0; labels of one id combine to toxic if any is; labels that are null, of null
ids or of missing documents teach nothing; without labels of both classes every
score is the share of toxic labels (0 without any); rows with a null id are
scored and not held out; rows with equal ids are scored one by one; an empty
table gives no rows; other columns are ignored (``drop_toxic`` carries them).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.common import bounded_batches, fold
from codeatlas.session import cut_table

ORDER = 6            # letters of the longest window, the predicted one included
SHARED = 2           # orders up to this pool both classes
DISCOUNT = 0.75
ALPHABET = 61        # most frequent letters; the others share one symbol
WINDOW = 24          # words of the window whose ratio counts on its own
STRONG = 3.0         # log ratio from which a word is strongly toxic
THRESHOLD = 0.3
PARTS = (0, 1, 3)    # remainders of crc32(id) mod 4 that teach
_BITS = 6
_MASK = np.int64((1 << _BITS) - 1)
_WORD = re.compile(r"[^\W\d_]+")
_KEPT = 300_000      # words whose ratios a worker keeps


def _symbols(words: list[str], letters: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The letter windows of all words as numbers (ORDER symbols of _BITS bits,
    the predicted letter lowest), and how many each word has (length + 1)."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    text = "\n".join(words) + "\n"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    table = np.full(int(points.max(initial=10)) + 1, ALPHABET + 1, np.int64)
    for c, k in letters.items():
        if ord(c) < len(table):
            table[ord(c)] = k
    table[10] = 0
    sym = table[points]
    place = np.arange(len(sym)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = sym.copy()
    for back in range(1, ORDER):
        earlier = np.zeros_like(sym)
        earlier[back:] = sym[:-back]
        earlier[place < back] = 0
        code |= earlier << np.int64(_BITS * back)
    return code, sizes


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    """By order: sorted windows with their log ratio, and sorted contexts with
    the log ratio of their backoff weights."""
    letters: dict[str, int]
    grams: list[np.ndarray]
    ratios: list[np.ndarray]
    contexts: list[np.ndarray]
    backoffs: list[np.ndarray]

    def word_ratios(self, words: list[str]) -> np.ndarray:
        code, sizes = _symbols(words, self.letters)
        total = np.zeros(len(code))
        left = np.arange(len(code))
        for k in range(len(self.grams) - 1, -1, -1):  # order k + 1
            part = code[left] & np.int64((1 << _BITS * (k + 1)) - 1)
            at, found = _lookup(self.grams[k], part)
            total[left[found]] += self.ratios[k][at[found]]
            left, part = left[~found], part[~found]
            at, found = _lookup(self.contexts[k], part >> np.int64(_BITS))
            total[left[found]] += self.backoffs[k][at[found]]
        return np.add.reduceat(total, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)


def fit(letters: dict[str, int], codes: np.ndarray, counts: np.ndarray) -> Model:
    """Kneser-Ney models from the windows' counts (2 x windows: ordinary, toxic)."""
    levels = [(codes, counts.astype(float))]
    for order in range(ORDER - 1, 0, -1):
        upper, c = levels[0]
        low, where = np.unique(upper & np.int64((1 << _BITS * order) - 1), return_inverse=True)
        kinds = np.zeros((2, len(low)))
        for k in (0, 1):
            np.add.at(kinds[k], where, c[k] > 0)
        levels.insert(0, (low, kinds))
    model = Model(letters, [], [], [], [])
    p = np.full((2, 1), 1 / (ALPHABET + 2))
    below = np.zeros(1, np.int64)
    for k, (gram, c) in enumerate(levels):
        if k < SHARED:
            c = np.broadcast_to(c.sum(axis=0), c.shape)
        context, where = np.unique(gram >> np.int64(_BITS), return_inverse=True)
        mass, kinds = np.zeros((2, len(context))), np.zeros((2, len(context)))
        for i in (0, 1):
            np.add.at(mass[i], where, c[i])
            np.add.at(kinds[i], where, c[i] > 0)
        back = np.where(mass > 0, DISCOUNT * kinds / np.maximum(mass, 1), 1.0)
        lower = p[:, _lookup(below, gram & np.int64((1 << _BITS * k) - 1))[0]]
        p = np.where(mass[:, where] > 0, np.maximum(c - DISCOUNT, 0) / np.maximum(mass[:, where], 1), 0) + back[:, where] * lower
        below = gram
        model.grams.append(gram)
        model.ratios.append(np.log(p[1] / p[0]).astype(np.float32))
        model.contexts.append(context)
        model.backoffs.append(np.log(back[1] / back[0]).astype(np.float32))
    return model


class Scorer:
    """Features of texts under one model; keeps the ratios of common words."""

    def __init__(self, model: Model):
        self.model = model
        self.kept: dict[str, float] = {}

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x 3 features, whether the text has a word)."""
        split = [_WORD.findall((t or "").lower()) for t in texts]
        need = set().union(*split)
        held = {w: self.kept[w] for w in need if w in self.kept}
        new = list(need - held.keys())
        fresh = dict(zip(new, self.model.word_ratios(new).tolist())) if new else {}
        held.update(fresh)
        if len(self.kept) + len(fresh) > _KEPT:
            self.kept.clear()
        self.kept.update((w, r) for w, r in fresh.items() if len(w) <= 32)
        out = np.zeros((len(texts), 3))
        for i, ws in enumerate(split):
            if not ws:
                continue
            ratio = np.fromiter(map(held.__getitem__, ws), float, len(ws))
            size = np.fromiter(map(len, ws), float, len(ws)) + 1
            out[i, 0] = ratio.sum() / size.sum()
            n = min(WINDOW, len(ws))
            a, b = (np.concatenate([[0], np.cumsum(x)]) for x in (ratio, size))
            out[i, 1] = ((a[n:] - a[:-n]) / (b[n:] - b[:-n])).max()
            out[i, 2] = np.sqrt((ratio > STRONG).mean())
        return out, np.array([bool(ws) for ws in split], bool)


@dataclass
class Classifier:
    """A model and the logistic curve over its features. Without a model every
    score is ``share``."""
    model: Model | None
    curve: np.ndarray
    share: float


def logistic(seen: DataFrame, features: list[str], target: str, penalty: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps, each of them one aggregation over all
    rows; columns are standardised inside. (Intercept, weights), rounded to nine
    places, so that the order of the sums does not show."""
    stats = seen.agg(*[F.avg(c) for c in features], *[F.stddev_pop(c) for c in features]).first()
    mean, sd = np.array(stats[:len(features)]), np.array(stats[len(features):]) + 1e-9
    z = [F.lit(1.0)] + [(F.col(c) - float(m)) / float(d) for c, m, d in zip(features, mean, sd)]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    w = np.zeros(len(z))
    for _ in range(50):
        at = sum(float(k) * x for k, x in zip(w[1:], z[1:])) + float(w[0])
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), at))))
        rows = seen.select(p.alias("p"), F.col(target).cast("double").alias("y"), *[x.alias(f"z{i}") for i, x in enumerate(z)])
        sums = rows.agg(*[F.sum((F.col("p") - F.col("y")) * F.col(f"z{i}")) for i in range(len(z))],
                        *[F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs]).first()
        grad = np.array(sums[:len(z)]) + penalty * w
        hess = penalty * np.eye(len(z))
        for (i, j), value in zip(pairs, sums[len(z):]):
            hess[i, j] += value
            hess[j, i] = hess[i, j]
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.round(np.concatenate([[w[0] - (w[1:] * mean / sd).sum()], w[1:] / sd]), 9)


def _count_windows(it: Iterator[pa.RecordBatch], letters: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """(code, ordinary and toxic counts of each third) of a task's texts."""
    tallies = {(part, toxic): Counter() for part in PARTS for toxic in (0, 1)}

    def flush() -> Iterator[pa.RecordBatch]:
        for (part, toxic), tally in tallies.items():
            words = list(tally)
            for lo in range(0, len(words), 100_000):
                some = words[lo:lo + 100_000]
                code, sizes = _symbols(some, letters)
                code, where = np.unique(code, return_inverse=True)
                n = np.bincount(where, np.repeat([tally[w] for w in some], sizes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.full(len(code), part, np.int32)), pa.array(np.full(len(code), toxic, np.int32)), pa.array(n)],
                                                 ["code", "part", "toxic", "n"])
            tally.clear()

    for batch in it:
        for text, part, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            tallies[part, toxic].update(_WORD.findall((text or "").lower()))
            if sum(map(len, tallies.values())) > 500_000:
                yield from flush()
    yield from flush()


def _count_letters(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally: Counter = Counter()
    for batch in it:
        for text in batch.column(0).to_pylist():
            tally.update((text or "").lower())
    got = [(c, n) for c, n in tally.items() if c.isalpha()]
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], ["letter", "n"])


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Learn from all labelled documents whose crc32(doc_id) mod 4 is not 2."""
    bounded_batches(docs)
    spark = docs.sparkSession
    known = (labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("l_id"))
             .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).withColumn("part", fold("l_id", 4).cast("int")).where("part <> 2"))
    teaching = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(fold("doc_id", 4) != 2)
    # neither side is bounded: a merge join at every size, so that disk and memory stay in proportion
    sample = cut_table(teaching.join(known.hint("merge"), F.col("doc_id") == F.col("l_id")).select("text", "part", "toxic"), "toxicity_sample")
    letters = {r["letter"]: k for k, r in enumerate(sample.select("text").mapInArrow(_count_letters, "letter string, n long").groupBy("letter")
               .agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "letter").limit(ALPHABET).collect(), 1)}
    each = [F.coalesce(F.sum(F.when((F.col("part") == p) & (F.col("toxic") == t), F.col("n"))), F.lit(0)).alias(f"n{p}_{t}") for p in PARTS for t in (0, 1)]
    counted = cut_table(sample.mapInArrow(lambda it: _count_windows(it, letters), "code long, part int, toxic int, n long")
                        .groupBy("code").agg(*each), "toxicity_windows")
    grams = counted.toArrow()
    share = sample.agg(F.avg("toxic"), F.min("toxic"), F.max("toxic")).first()
    if share[0] is None or share[1] == share[2] or not len(grams):
        return Classifier(None, np.zeros(4), float(share[0] or 0.0))
    codes = grams.column("code").to_numpy()
    order = np.argsort(codes)
    codes = codes[order]
    counts = {p: np.array([grams.column(f"n{p}_{t}").to_numpy()[order] for t in (0, 1)]) for p in PARTS}
    seen = []
    for p in PARTS:
        crossed = spark.sparkContext.broadcast(fit(letters, codes, sum(counts[q] for q in PARTS if q != p)))

        def measure(it: Iterator[pa.RecordBatch], crossed=crossed) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(crossed.value)
            for batch in it:
                for lo in range(0, batch.num_rows, 256):
                    some = batch.slice(lo, 256)
                    x, _ = scorer.features(some.column(0).to_pylist())
                    yield pa.RecordBatch.from_arrays([some.column(1), *map(pa.array, x.T)], ["toxic", "a", "b", "c"])

        seen.append(cut_table(sample.where(F.col("part") == p).select("text", "toxic").mapInArrow(measure, "toxic int, a double, b double, c double"), "toxicity_features"))
        crossed.destroy()
    curve = logistic(reduce(DataFrame.unionByName, seen), ["a", "b", "c"], "toxic")
    return Classifier(fit(letters, codes, sum(counts.values())), curve, float(share[0]))


def _scored(texts: list[str | None], scorer: Scorer | None, made: Classifier) -> np.ndarray:
    if scorer is None:
        return np.full(len(texts), made.share)
    x, has = scorer.features(texts)
    return np.where(has, 1 / (1 + np.exp(-np.clip(made.curve[0] + x @ made.curve[1:], -30, 30))), 0.0)


def _score_batches(made, columns_at: int):
    """A function over record batches that gives (batch, scores) pairs."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        have = made.value
        scorer = Scorer(have.model) if have.model is not None else None
        for batch in it:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield part, _scored(part.column(columns_at).to_pylist(), scorer, have)
    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    made = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores in _score_batches(made, 1)(it):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns kept; the
    verdict is taken in the scan, so equal ids need no join."""
    made = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores in _score_batches(made, at)(it):
            yield part.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
