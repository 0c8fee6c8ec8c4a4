"""Source divergence audit over a minimal acyclic transducer vocabulary (operator 12).

1. One pass counts, for each language, the documents that hold a term; terms in
   at least ``least_docs`` of them are kept and numbered in UTF-8 order.
2. From the sorted kept terms, tasks build minimal acyclic automata of at most
   PIECE_TERMS terms each: states with equal continuations are one. Every edge
   carries the number of terms that come before those behind it, so the sum over
   a path is the term's ordinal (a transducer).
3. A second pass streams all texts through the transducers of their language,
   all tokens of a run of text one byte further at a time, and counts ordinals
   for each (language, source). Transducers are sent to the tasks in groups of at
   most GROUP_BYTES; a larger vocabulary takes one more pass for each group.
4. Shares are exact integers. Sums of differences between two sources are taken
   over blocks of ordinals times tiles of sources, as dense matrices of bounded
   size; a group's leading terms come from one ranked window, ties by ordinal.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, so runs of ASCII letters and of
bytes above 0x7F; A-Z alone are lower-cased. All counts cover all documents and
whole texts.

Defined cases: null text, language or source is the empty string; a language
without kept terms has pairs of value 0 and no terms; a group without terms
counts 0 of each; repeated rows count as often as they come; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.llm.common import bounded_batches, text_chunks
from codeatlas.operators.numbering import numbered
from codeatlas.session import cut_table

LEAST_DOCS, SCALE, PRIOR, TOP = 30, 1_000_000_000, 5, 50
PIECE_TERMS = 1 << 17      # terms of one transducer
GROUP_BYTES = 64 << 20     # transducers that are broadcast together
HELD_TERMS = 200_000       # distinct terms that a task counts before it hands them on
HELD_COUNTS = 4 << 20      # numbers that a task counts in before it hands them on
BLOCK, TILE = 4096, 128    # ordinals and sources of a matrix

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM_BYTES = bytes(int(_LOWER[b]) if _LETTER[b] else 32 for b in range(256))


def _groups(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


# --------------------------------------------------------------------------
# vocabulary
# --------------------------------------------------------------------------

def document_counts(texts: DataFrame) -> DataFrame:
    """(lang, term, docs): the documents of a language that hold a term."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())],
                                                 ["lang", "term", "docs"])
            held.clear()

        for batch in it:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                held[lang].update(set(text.as_py().translate(_TERM_BYTES).split()))
            if sum(map(len, held.values())) >= HELD_TERMS:
                yield from out()
        yield from out()

    return (texts.select("lang", "text").mapInArrow(run, "lang string, term string, docs long")
            .groupBy("lang", "term").agg(F.sum("docs").alias("docs")))


def automaton(terms: Iterable[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic transducer of sorted distinct terms: edges in order of
    ``keys`` (state * 256 + byte) with their targets and the terms that come
    before (``before``), and which states end a term. State 0 is the root."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []                    # frozen: (ends a term, ((byte, target), ...))
    path: list[list] = [[False, []]]            # open states of the last term
    last = b""

    def freeze(depth: int) -> None:
        while len(path) > depth + 1:
            ends, edges = path.pop()
            state = (ends, tuple(edges))
            if state not in register:
                register[state] = len(states)
                states.append(state)
            above = path[-1][1]
            above[-1] = (above[-1], register[state])

    for term in terms:
        common = 0
        for a, b in zip(last, term):
            if a != b:
                break
            common += 1
        freeze(common)
        for byte in term[common:]:
            path[-1][1].append(byte)
            path.append([False, []])
        path[-1][0] = True
        last = term
    freeze(0)
    states.append((path[0][0], tuple(path[0][1])))
    behind = np.zeros(len(states), np.int64)     # terms from a state on; targets come before their sources
    place = {i: len(states) - 1 - i for i in range(len(states))}   # the root is the last one frozen
    keys, targets, before = [], [], []
    for i, (ends, edges) in enumerate(states):
        n = int(ends)
        for byte, to in edges:
            keys.append(place[i] * 256 + byte)
            targets.append(place[to])
            before.append(n)
            n += int(behind[to])
        behind[i] = n
    order = np.argsort(np.array(keys, np.int64))
    final = np.zeros(len(states), bool)
    final[[place[i] for i, (ends, _) in enumerate(states) if ends]] = True
    return {"keys": np.array(keys, np.int64)[order], "targets": np.array(targets, np.int32)[order],
            "before": np.array(before, np.int32)[order], "final": final}


def ordinals(machine: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ordinal of each token (its bytes in ``data``), -1 outside the
    vocabulary. All tokens take their k-th byte at the same time."""
    out = np.full(len(starts), -1, np.int64)
    keys, targets, before, final = machine["keys"], machine["targets"], machine["before"], machine["final"]
    if not len(keys):
        return out
    token = np.arange(len(starts))
    at, state, total = starts.copy(), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    while len(token):
        key = (state << 8) | data[at]
        edge = np.searchsorted(keys, key)
        edge[edge == len(keys)] = 0
        met = keys[edge] == key
        token, at, edge, total = token[met], at[met] + 1, edge[met], total[met]
        state = targets[edge].astype(np.int64)
        total += before[edge]
        done = at == ends[token]
        found = done & final[state]
        out[token[found]] = total[found]
        token, at, state, total = token[~done], at[~done], state[~done], total[~done]
    return out


def transducers(kept: DataFrame) -> DataFrame:
    """(lang, base, terms, keys, targets, before, final) for runs of at most
    PIECE_TERMS kept terms (lang, term, nth), built in sorted order."""
    schema = "lang string, base long, terms long, keys binary, targets binary, before binary, final binary"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, base, terms = None, 0, []

        def built() -> pa.RecordBatch:
            made = automaton(terms)
            return pa.RecordBatch.from_pylist([{"lang": lang, "base": base, "terms": len(terms), **{k: v.tobytes() for k, v in made.items()}}],
                                              schema=pa.schema([("lang", pa.string()), ("base", pa.int64()), ("terms", pa.int64()), *[(k, pa.binary()) for k in ("keys", "targets", "before", "final")]]))

        for batch in it:
            for row_lang, term, nth in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                if terms and (row_lang != lang or len(terms) == PIECE_TERMS):
                    yield built()
                    terms = []
                if not terms:
                    lang, base = row_lang, nth - 1
                terms.append(term)
        if terms:
            yield built()

    parts = max(1, -(-kept.count() // PIECE_TERMS))
    return (kept.repartitionByRange(parts, "lang", "nth").sortWithinPartitions("lang", "nth").select("lang", "term", "nth")
            .mapInArrow(run, schema))


def machine_of(row) -> dict[str, np.ndarray]:
    return {"keys": np.frombuffer(row["keys"], np.int64), "targets": np.frombuffer(row["targets"], np.int32),
            "before": np.frombuffer(row["before"], np.int32), "final": np.frombuffer(row["final"], bool)}


def recounted(texts: DataFrame, pieces: DataFrame) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of kept terms, by streaming the
    texts through their language's transducers."""
    spark = texts.sparkSession
    sizes = pieces.select("lang", "base", (F.length("keys") + F.length("targets") + F.length("before") + F.length("final")).alias("size")).orderBy("lang", "base").collect()
    groups: list[list] = []
    room = 0
    for piece in sizes:
        if not groups or room + piece["size"] > GROUP_BYTES:
            groups.append([])
            room = 0
        groups[-1].append((piece["lang"], piece["base"]))
        room += piece["size"]

    def one(group: list) -> DataFrame:
        wanted = spark.createDataFrame(group, "lang string, base long")
        rows = pieces.join(F.broadcast(wanted), ["lang", "base"], "left_semi").collect()
        machines: dict[str, list] = defaultdict(list)
        for r in rows:
            machines[r["lang"]].append((r["base"], r["terms"], machine_of(r)))
        sent = spark.sparkContext.broadcast(dict(machines))
        langs = sorted(machines)
        return texts.where(F.col("lang").isin(langs)).mapInArrow(_counter(sent), "lang string, source string, ordinal long, n long")

    parts = [one(g) for g in groups]
    if not parts:
        return spark.createDataFrame([], "lang string, source string, ordinal long, n long")
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def _counter(sent):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = sent.value
        held: dict[tuple[str, str, int], np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source, base), counts in held.items():
                seen = np.flatnonzero(counts)
                if len(seen):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array([source] * len(seen), pa.string()), pa.array(seen + base), pa.array(counts[seen])],
                                                     ["lang", "source", "ordinal", "n"])
            held.clear()

        for batch in it:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                rows = [i for i, x in enumerate(langs) if x == lang]
                places = sorted({sources[i] for i in rows})
                number = {s: k for k, s in enumerate(places)}
                for lo, data, offsets in text_chunks(batch.column(2).take(pa.array(rows))):
                    n = len(offsets) - 1
                    letter = _LETTER[data]
                    begin, end = letter.copy(), letter.copy()
                    begin[1:] &= ~letter[:-1]
                    end[:-1] &= ~letter[1:]
                    inner = offsets[1:-1]
                    inner = inner[(inner > 0) & (inner < len(data))]
                    begin[inner], end[inner - 1] = letter[inner], letter[inner - 1]
                    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
                    low = _LOWER[data]
                    source = np.array([number[sources[rows[i]]] for i in range(lo, lo + n)], np.int64)[np.searchsorted(offsets, starts, "right") - 1]
                    for base, terms, machine in machines[lang]:
                        found = ordinals(machine, low, starts, ends)
                        known = found >= 0
                        at, counts = np.unique(source[known] * terms + found[known], return_counts=True)
                        edges = np.searchsorted(at, np.arange(len(places) + 1) * terms)
                        for k in np.flatnonzero(np.diff(edges)):
                            key = (lang, places[k], base)
                            if key not in held:
                                held[key] = np.zeros(terms, np.int64)
                            span = slice(edges[k], edges[k + 1])
                            held[key][at[span] - k * terms] += counts[span]
                    if sum(map(len, held.values())) >= HELD_COUNTS:
                        yield from out()
        yield from out()
    return run


# --------------------------------------------------------------------------
# shares
# --------------------------------------------------------------------------

def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)) of three columns, exactly."""
    return F.expr(f"1L + (cast({n} + {PRIOR} as decimal(20,0)) * {SCALE}) div cast({total} + {PRIOR} * {kept} as decimal(20,0))")


def _shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same for counts ``n`` of groups whose denominators are ``whole``: a
    long division by three digits at a time, exact up to 9e15 tokens."""
    rest, out = n + PRIOR, np.zeros(np.broadcast(n, whole).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def pair_sums(counts: DataFrame, groups: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, a, b, value): sums of absolute differences of shares between the
    sources numbered a < b of a language. ``counts`` (lang, number, ordinal, n),
    ``groups`` (lang, number, of, kept, whole) with the denominator ``whole``."""
    tiles = F.ceil(F.col("of") / tile).cast("long")
    own = F.floor((F.col("number") - 1) / tile)
    mates = F.transform(F.sequence(F.lit(0).cast("long"), tiles - 1), lambda t: F.named_struct(F.lit("i"), F.least(own, t), F.lit("j"), F.greatest(own, t)))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("kept") - 1) / block).cast("long"))
    zero = (groups.where("kept > 0").select("lang", "number", "whole", "kept", mates.alias("mates"), F.explode(blocks).alias("block"))
            .select("lang", "block", F.explode("mates").alias("m"), "number", "whole", "kept").select("lang", "block", "m.i", "m.j", "number", F.lit(-1).cast("long").alias("ordinal"), F.col("whole").alias("n"),
                    F.least(F.lit(block).cast("long"), F.col("kept") - F.col("block") * block).alias("width")))
    met = (counts.join(groups.select("lang", "number", "of"), ["lang", "number"])
           .select("lang", F.floor(F.col("ordinal") / block).alias("block"), F.explode(mates).alias("m"), "number", "ordinal", "n")
           .select("lang", "block", "m.i", "m.j", "number", "ordinal", "n", F.lit(None).cast("long").alias("width")))
    rows = zero.unionByName(met)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, numbers, ordinals_, values, width = None, [], [], [], 0

        def sums() -> pa.RecordBatch:
            number, ordinal, n = (np.concatenate(x) for x in (numbers, ordinals_, values))
            first = ordinal < 0
            source, whole = number[first], n[first]
            order = np.argsort(source)
            source, whole = source[order], whole[order]
            table = np.zeros((len(source), width), np.int64)
            table[np.searchsorted(source, number[~first]), ordinal[~first] % block] = n[~first]
            table = _shares(table, whole[:, None])
            of = (source - 1) // tile
            a, b, v = [], [], []
            for x in np.flatnonzero(of == key[2]):
                others = np.flatnonzero((of == key[3]) & (source > source[x]))
                a.append(np.full(len(others), source[x]))
                b.append(source[others])
                v.append(np.abs(table[others] - table[x]).sum(axis=1))
            a, b, v = (np.concatenate(x) for x in (a, b, v))
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(v)], ["lang", "a", "b", "value"])

        for batch in it:
            langs, *ids = (batch.column(i) for i in range(4))
            langs, ids = langs.dictionary_encode(), np.array([x.to_numpy() for x in ids])
            code = langs.indices.to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(ids) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                now = (langs.dictionary[int(code[lo])].as_py(), *ids[:, lo].tolist())
                if now != key and key is not None:
                    yield sums()
                    numbers, ordinals_, values, width = [], [], [], 0
                key = now
                number, ordinal, n = (batch.column(i).slice(lo, hi - lo).to_numpy() for i in (4, 5, 6))
                numbers.append(number)
                ordinals_.append(ordinal)
                values.append(n)
                width = max(width, batch.column(7).slice(lo, hi - lo).fill_null(0).to_numpy().max())
        if key is not None:
            yield sums()

    keys = ["lang", "block", "i", "j"]
    parts = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "lang string, a long, b long, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: for each group the other sources of
    its language by divergence (part ``pair``), and the ``top`` terms that it
    uses more than its language does (part ``term``)."""
    bounded_batches(docs)
    texts = _groups(docs)
    kept = cut_table(document_counts(texts).where(F.col("docs") >= least_docs), "audit_terms")
    kept = cut_table(numbered(kept, "lang", [F.col("term")], "audit_sorted"), "audit_vocabulary")
    counts = cut_table(recounted(texts, cut_table(transducers(kept), "audit_transducers")), "audit_counts")

    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    found = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_name = Window.partitionBy("lang").orderBy("source")
    groups = (texts.select("lang", "source").distinct().join(found, ["lang", "source"], "left").join(sizes, "lang", "left")
              .fillna(0, ["total", "kept"]).withColumn("number", F.row_number().over(by_name).cast("long"))
              .withColumn("of", F.count("*").over(Window.partitionBy("lang"))).withColumn("whole", F.col("total") + PRIOR * F.col("kept")))
    groups = cut_table(groups, "audit_groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    named = counts.join(groups.select("lang", "source", "number", "total", "kept"), ["lang", "source"])

    sums = cut_table(pair_sums(named.select("lang", "number", "ordinal", "n"), groups, block, tile), "audit_pairs")
    each = sums.union(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    mine = groups.select("lang", "source", F.col("number").alias("a"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("b"))
    pairs = (mine.join(other, "lang").where("a <> b").join(each, ["lang", "a", "b"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value")))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("lang_n"))
    ahead = (named.join(whole, ["lang", "ordinal"]).join(langs, "lang")
             .select("lang", "source", "ordinal", share("n", "total", "kept").alias("p"), share("lang_n", "lang_total", "kept").alias("q")).where("p > q")
             .select("lang", "source", "ordinal", (F.col("p") - F.col("q")).alias("value")))
    ahead = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top)
    terms = (ahead.join(kept.select("lang", (F.col("nth") - 1).alias("ordinal"), F.col("term").alias("item")), ["lang", "ordinal"])
             .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
    return pairs.unionByName(terms)
