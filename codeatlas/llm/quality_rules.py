"""Quality rules as a short-circuit cascade (operator 10).

Every whole text is measured once (numpy over Arrow buffers, no shuffle). The
verdict is a conjunction of rules; their order is chosen by a profile of a
bounded sample: rejections per second of cost, highest first. A text leaves the
cascade at its first failing rule, so later rules see survivors only. The order
changes the cost and never the verdict.

Defined cases: a null or blank text has no words and fails the base; rows with
a null id, repeated rows and ties are measured row by row; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.common import bounded_batches, ngrams, text_chunks, words

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 1000  # rows that the profile of the rules reads (in expectation)

_IS = {name: np.isin(np.arange(256), list(chars.encode())) for name, chars in {
    "symbol": SYMBOLS, "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "bang": "!", "space": " \t\n\v\f\r",
    "letter": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}.items()}
_LEAD = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point
_ALPHA = _IS["letter"] | (np.arange(256) >= 0x80)


class Texts:
    """A run of texts with their base measures."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.hashes, self.bounds = words(data, offsets)
        n = len(offsets) - 1
        self.n_words = np.diff(self.bounds).astype(np.int64)
        self.word_chars = self.per_text(_LEAD & ~_IS["space"])
        self.n_symbols = self.per_text(_IS["symbol"])
        self.n_lines, self.n_dup_lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.n_repeat_words = np.zeros(n, np.int64)
        raw = data.tobytes()
        for i in range(n):
            if self.n_words[i] == 0:
                continue
            lines = [x for x in raw[offsets[i]:offsets[i + 1]].split(b"\n") if x.strip(b" \t\n\v\f\r")]
            self.n_lines[i] = len(lines)
            self.n_dup_lines[i] = len(lines) - len(set(lines))
            self.n_repeat_words[i] = repeated(self.hashes[self.bounds[i]:self.bounds[i + 1]])

    def per_text(self, of: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(of[self.data], out=total[1:])
        return np.diff(total[self.offsets])

    def bytes_in(self, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.array([np.count_nonzero(of[self.data[self.offsets[i]:self.offsets[i + 1]]]) for i in rows], np.int64)

    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PCT * self.n_words)


def repeated(hashes: np.ndarray, size: int = 3) -> int:
    """Words in windows of ``size`` that occur twice or more in the text."""
    grams = ngrams(hashes, size)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(grams), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for k in range(size):
        covered[k:k + len(grams)] |= again
    return int(covered.sum())


def _word_share(t: Texts, rows: np.ndarray) -> np.ndarray:
    """Fails where under 80 % of the words hold a letter."""
    out = np.zeros(len(rows), bool)
    for k, i in enumerate(rows):
        part = t.data[t.offsets[i]:t.offsets[i + 1]]
        space = _IS["space"][part]
        word = np.cumsum(np.diff(space.astype(np.int8), prepend=1) == -1)
        lettered = len(np.unique(word[_ALPHA[part]]))
        out[k] = 100 * lettered < 80 * t.n_words[i]
    return out


@dataclass(frozen=True)
class Rule:
    """``fails(texts, rows)`` is true for the rows (indices) that break it."""
    name: str
    fails: Callable[[Texts, np.ndarray], np.ndarray]


RULES = (
    Rule("symbols", lambda t, r: 10 * t.n_symbols[r] > t.n_words[r]),
    Rule("dup_lines", lambda t, r: 10 * t.n_dup_lines[r] > 3 * t.n_lines[r]),
    Rule("word_length", lambda t, r: (t.word_chars[r] < 2 * t.n_words[r]) | (t.word_chars[r] > 14 * t.n_words[r])),
    Rule("shouting", lambda t, r: 2 * t.bytes_in(r, _IS["upper"]) > t.bytes_in(r, _IS["letter"])),
    Rule("exclamations", lambda t, r: 10 * t.bytes_in(r, _IS["bang"]) > 3 * t.n_words[r]),
    Rule("lettered_words", _word_share),
)


def cascade(t: Texts, rows: np.ndarray, rules: tuple[Rule, ...]) -> np.ndarray:
    """Rows that pass all rules; each rule sees the survivors of those before."""
    for rule in rules:
        if not len(rows):
            break
        rows = rows[~rule.fails(t, rows)]
    return rows


def profile(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a row, share rejected) on a random sample of about
    ``sample_rows`` rows; one row for each rule reaches the driver."""
    bounded_batches(docs)
    n = docs.count()
    if not n:
        return [(r.name, 0.0, 0.0) for r in rules]

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for _, data, offsets in text_chunks(batch.column(0)):
                t = Texts(data, offsets)
                rows = np.flatnonzero(~t.base_failed())
                out = []
                for rule in rules:
                    began = time.perf_counter()
                    bad = int(rule.fails(t, rows).sum()) if len(rows) else 0
                    out.append((rule.name, time.perf_counter() - began, bad, len(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["rule", "s", "bad", "n"])

    seen = (docs.select("text").sample(min(1.0, sample_rows / n), seed=7).mapInArrow(measure, "rule string, s double, bad long, n long")
            .groupBy("rule").agg(F.sum("s").alias("s"), F.sum("bad").alias("bad"), F.sum("n").alias("n")))
    got = {r["rule"]: r for r in seen.collect()}
    return [(r.name, got[r.name]["s"] / max(1, got[r.name]["n"]), got[r.name]["bad"] / max(1, got[r.name]["n"])) if r.name in got
            else (r.name, 0.0, 0.0) for r in rules]


def ordered(profiled: list[tuple[str, float, float]], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rules by rejections per cost, highest first (ties: declared order)."""
    worth = {name: share / max(cost, 1e-9) for name, cost, share in profiled}
    return tuple(sorted(rules, key=lambda r: -worth[r.name]))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept for every row of ``docs`` (doc_id, text, ...)."""
    order = ordered(profile(docs, rules), rules)

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, data, offsets in text_chunks(batch.column(1)):
                t = Texts(data, offsets)
                failed = t.base_failed()
                kept = np.zeros(len(failed), bool)
                kept[cascade(t, np.flatnonzero(~failed), order)] = True
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(failed)), *map(pa.array, (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept))],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        measure, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` whose text passes, all columns kept: the verdict is
    taken row by row in the scan, so equal ids need no join."""
    order = ordered(profile(docs, rules), rules)
    at = docs.columns.index("text")

    def pick(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, data, offsets in text_chunks(batch.column(at)):
                t = Texts(data, offsets)
                rows = cascade(t, np.flatnonzero(~t.base_failed()), order)
                if len(rows):
                    yield batch.take(pa.array(rows + lo))

    return docs.mapInArrow(pick, docs.schema)
