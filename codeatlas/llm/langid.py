"""Language identification by cross-parsing entropy (operator 9).

For each language a suffix automaton of labelled text is built. A text is cut
greedily into phrases, each the longest match that the automaton has from there.
A phrase costs the logarithm of its language's reference length (what it takes
to point into the reference), so that references of any length compare; the
language with the least cost a symbol wins. Automata lie in transition tables in
which a step that has no match ends the phrase and starts
the next one at the root, so parsing is one table look-up a symbol and language,
and all texts of a batch advance together as lanes of LANE symbols (a lane's end
ends a phrase for every language alike). Nothing is shuffled in scoring.

Text is lower-cased; letters are symbols, everything else between letters is one
separator. Bounds (documented parameters): excerpts of at most DOCS_PER_LANG
labelled documents a language, SYMBOLS letters in all. A language's bound is its
own: it learns from the same text whatever other values the column holds (only the
alphabet is common to all). Every language is learned: where the table would pass TABLE_SYMBOLS, languages are parsed in
groups, one scan each, so a table is at most about 150 MB.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and
so is every text if nothing can be learned; rows with a null id are predicted,
not held out, and teach nothing; ties go to the first language by name; rows
with equal ids are predicted one by one; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.llm.common import bounded_batches, fold
from codeatlas.session import cut_table

ALPHABET = 61  # most frequent letters; the others share a symbol
OTHER, PAD = 62, 63
LANE = 256
DOCS_PER_LANG, SYMBOLS, TABLE_SYMBOLS = 200, 30_000, 240_000
GROUP_CHARS = 1 << 20
GROUP_LANGS = 256   # languages of a table
UNKNOWN = "und"


def letter_table(letters: str) -> np.ndarray:
    """Symbol of every code point: 0 for what is no letter."""
    table = np.fromiter((OTHER if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint8, 0x110000)
    for k, c in enumerate(letters, 1):
        table[ord(c)] = k
    return table


def symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts end to end, and each text's offsets. Runs of
    separators are one, and none leads a text."""
    low = [t.lower() for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in low], dtype=np.int64)])
    sym = table[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
    before = np.zeros_like(sym)
    before[1:] = sym[:-1]
    before[ends[:-1][ends[:-1] < len(sym)]] = 0
    keep = (sym > 0) | (before > 0)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return sym[keep], kept[ends]


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the root."""
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        state = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = state
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] != length[p] + 1:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = clone
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                q = clone
            link[state] = q
        last = state
    return nexts


@dataclass
class Parser:
    """``steps[state * 64 + symbol]`` is four times the next state plus the phrases
    that the symbol ended: one before it where it has no match, and the symbol
    itself where no text of the language has it. ``roots``: each language's root;
    ``costs``: of each language's phrases."""
    langs: list[str]
    letters: str
    steps: np.ndarray
    roots: np.ndarray
    costs: np.ndarray

    def phrases(self, sym: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """languages x texts: phrases of each text."""
        sizes = np.diff(offsets)
        per_text = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(sizes)), per_text)
        start = np.repeat(offsets[:-1], per_text) + LANE * (np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text))
        stop = np.minimum(start + LANE, np.repeat(offsets[1:], per_text))
        out = np.zeros((len(self.langs), len(sizes)), np.int64)
        width = 8192 // max(1, len(self.langs))
        for lo in range(0, len(owner), width):
            a, b = start[lo:lo + width], stop[lo:lo + width]
            at = a[None, :] + np.arange(int((b - a).max()))[:, None]
            lane = np.where(at < b[None, :], sym[np.minimum(at, len(sym) - 1)], PAD).astype(np.int32)
            state = np.repeat(self.roots[:, None], len(a), axis=1)
            count = np.zeros(state.shape, np.int32)
            for row in lane:
                step = self.steps[(state << 6) + row]
                state = step >> 2
                count += step & 3
            count += state != self.roots[:, None]
            for k in range(len(self.langs)):
                out[k] += np.bincount(owner[lo:lo + width], count[k], len(sizes)).astype(np.int64)
        return out


def frequent_letters(samples: dict[str, str]) -> str:
    tally: Counter = Counter()
    for text in samples.values():
        tally.update(c for c in text.lower() if c.isalpha())
    return "".join(c for c, _ in sorted(tally.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET])


def build(samples: dict[str, str], letters: str | None = None) -> Parser:
    """Automata of each language's text, in one table."""
    letters = frequent_letters(samples) if letters is None else letters
    table = letter_table(letters)
    langs = sorted(samples)
    parts, roots, costs, base = [], [], [], 0
    for lang in langs:
        text = symbols([samples[lang]], table)[0]
        costs.append(np.log(max(2, len(text))))
        nexts = automaton(text)
        step = np.full((len(nexts), 64), -1, np.int64)
        for s, moves in enumerate(nexts):
            step[s, list(moves)] = list(moves.values())
        known = step[0] >= 0
        restart = np.where(known, 4 * (step[0] + base) + 1, 4 * base + 2)
        step[1:] = np.where(step[1:] >= 0, 4 * (step[1:] + base), restart[None, :])
        step[0] = np.where(known, 4 * (step[0] + base), 4 * base + 1)
        step[:, PAD] = 4 * (np.arange(len(nexts)) + base)
        parts.append(step.astype(np.int32))
        roots.append(base)
        base += len(nexts)
    return Parser(langs, letters, np.concatenate(parts).ravel(), np.array(roots, np.int32), np.array(costs))


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, share: int = SYMBOLS, total: int = TABLE_SYMBOLS) -> list[tuple[dict[str, str], str]]:
    """Learn from text and lang of documents whose crc32(doc_id) mod 5 is not 0:
    groups of languages' texts of at most ``total`` letters, with the alphabet
    that all groups share."""
    teach = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("lang is not null and doc_id is not null").where(fold("doc_id", 5) != 0)
    # ids first: the rank limit works before the shuffle and no text is moved
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (teach.select("doc_id", "lang").withColumn("rank", F.row_number().over(order))
           .where(F.col("rank") <= docs_per_lang).select(F.col("doc_id").alias("t_id"), F.col("lang").alias("t_lang")).distinct())
    take = max(40, 2 * share // docs_per_lang)
    text = F.coalesce("text", F.lit(""))
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.char_length(text) - take)).cast("int") + 1
    rows = (teach.join(F.broadcast(ids), (F.col("doc_id") == F.col("t_id")) & (F.col("lang") == F.col("t_lang")))
            .select("lang", "doc_id", F.substr(text, start, F.lit(take)).alias("part")).toArrow().to_pylist())
    if not rows:
        return []
    rows.sort(key=lambda r: (r["lang"], r["doc_id"], r["part"]))
    parts: dict[str, list[str]] = {}
    for r in rows:
        if any(map(str.isalpha, r["part"])):
            parts.setdefault(r["lang"], []).append(r["part"])
    samples = {lang: " ".join(p[:max(20, share // len(own))] for p in own) for lang, own in parts.items()}
    letters = frequent_letters(samples)
    groups: list[tuple[dict[str, str], str]] = []
    size = 0
    for lang, sample in samples.items():
        # some texts are longer than their share by the blanks between excerpts
        if not groups or size + len(sample) > total * 1.25 or len(groups[-1][0]) == GROUP_LANGS:
            groups.append(({}, letters))
            size = 0
        groups[-1][0][lang] = sample
        size += len(sample)
    return groups


def languages(docs: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``. The score
    is the runner-up's share of the cost against the winner's (0.5 to 1)."""
    bounded_batches(docs)
    groups = train(docs, **bounds)
    # best and second: costs of the two best languages of the groups so far
    kind = "doc_id long, text string, lang_pred string, best double, second double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(UNKNOWN).alias("lang_pred"),
                       F.lit(float("inf")).alias("best"), F.lit(float("inf")).alias("second"))
    for k, group in enumerate(groups):
        made = docs.sparkSession.sparkContext.broadcast(build(*group))
        last = k == len(groups) - 1

        def run(it: Iterator[pa.RecordBatch], made=made, last=last) -> Iterator[pa.RecordBatch]:
            parser = made.value
            table = letter_table(parser.letters)
            for batch in it:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                lo = 0
                while lo < len(texts):
                    hi, size = lo, 0
                    while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= GROUP_CHARS):
                        size += len(texts[hi])
                        hi += 1
                    part = batch.slice(lo, hi - lo)
                    found = better(texts[lo:hi], parser, table, part.column(2).to_pylist(), part.column(3).to_numpy(), part.column(4).to_numpy())
                    text = pa.nulls(hi - lo, pa.string()) if last else part.column(1)
                    yield pa.RecordBatch.from_arrays([part.column(0), text, *found], ["doc_id", "text", "lang_pred", "best", "second"])
                    lo = hi

        rows = rows.mapInArrow(run, kind)
        if not last:  # one group's table at a time in a worker
            rows = cut_table(rows, "languages")
    inf = F.lit(float("inf"))
    score = (F.when(F.col("best") == inf, 0.0).when(F.col("second") == inf, 1.0)
             .otherwise(F.col("second") / F.greatest(F.col("best") + F.col("second"), F.lit(1e-12))))
    return rows.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", score.alias("score"))


def better(texts: list[str], parser: Parser, table: np.ndarray, lang: list[str], best: np.ndarray, second: np.ndarray) -> list[pa.Array]:
    """lang_pred, best, second after this parser's languages; the earlier wins ties."""
    sym, offsets = symbols(texts, table)
    sizes = np.diff(offsets)
    found = np.vstack([best, second, np.where(sizes > 0, parser.phrases(sym, offsets) * parser.costs[:, None] / np.maximum(sizes, 1), np.inf)])
    own = found[2:].argmin(axis=0)
    won = found[2:].min(axis=0) < best
    ranked = np.sort(found, axis=0)
    return [pa.array([parser.langs[k] if w else old for k, w, old in zip(own, won, lang)], pa.string()), pa.array(ranked[0]), pa.array(ranked[1])]
