"""Token counts by rank-synchronous array merging (operator 7).

Distinct pre-tokens of a batch lie end to end in one symbol array. A round finds
every sequence's lowest-rank adjacent pair and merges all its occurrences at
once; finished sequences leave the array, and the symbols that survive are
counted. The merge list of the tokenizer file is the only model. No shuffle.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); special strings
inside a text are one token each, as the library's default has it; rows with a
null id, repeated rows and ties are counted row by row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.common import bounded_batches
from codeatlas.llm.vocab import Pieces, tokenizer_path

# FIXED VALUES: the pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# END FIXED VALUES

SYMBOLS_AT_ONCE = 1 << 20


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level
    vocabulary: itself where printable in Latin-1, else the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Merger:
    """Merge rules as sorted arrays, and the count of symbols they leave."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.width = max(vocab.values()) + 1
        keys = left * self.width + right
        order = np.argsort(keys)
        self.keys, self.rank, self.into = keys[order], order, into
        self.byte = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.pattern = regex.compile(PATTERN)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def counts(self, pretokens: list[bytes]) -> np.ndarray:
        """Symbols that each non-empty byte string is left with."""
        out = np.zeros(len(pretokens), np.int64)
        if not pretokens:
            return out
        sym = self.byte[np.frombuffer(b"".join(pretokens), np.uint8)]
        seq = np.repeat(np.arange(len(pretokens)), [len(p) for p in pretokens])
        none = len(self.rank)
        while len(sym):
            key = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where((self.keys[at] == key) & (seq[:-1] == seq[1:]), self.rank[at], none)
            rank = np.append(rank, none)
            starts = np.flatnonzero(np.diff(seq, prepend=-1))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            done = lowest == none
            out[seq[starts[done]]] = sizes[done]
            live = np.repeat(~done, sizes)
            target = np.repeat(lowest, sizes)
            hit = live & (rank == target)
            # of overlapping hits (a a a) every second one counts, from the left
            run = hit & ~np.append(False, hit[:-1])
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit &= place % 2 == 0
            sym = np.where(hit, self.into[np.minimum(target, none - 1)], sym)
            keep = live & ~np.append(False, hit[:-1])
            sym, seq = sym[keep], seq[keep]
        return out

    def piece_counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece of text."""
        count = np.zeros(len(pieces), np.int64)
        owners: dict[bytes, list[int]] = {}
        size = 0
        for i, piece in enumerate(pieces):
            parts = self.special.split(piece) if self.special else [piece]
            count[i] += len(parts) - 1
            for part in parts:
                for pre in self.pattern.findall(part):
                    raw = pre.encode()
                    if raw not in owners:
                        owners[raw] = []
                        size += len(raw)
                    owners[raw].append(i)
            if size >= SYMBOLS_AT_ONCE:
                self._settle(owners, count)
                owners, size = {}, 0
        self._settle(owners, count)
        return count.tolist()

    def _settle(self, owners: dict[bytes, list[int]], count: np.ndarray) -> None:
        if owners:
            each = self.counts(list(owners))
            np.add.at(count, np.concatenate([np.array(v) for v in owners.values()]), np.repeat(each, [len(v) for v in owners.values()]))


_counters: dict[str, Pieces] = {}


def counter(path: str) -> Pieces:
    """Pieces whose values are token counts; one for each worker."""
    if path not in _counters:
        _counters[path] = Pieces(Merger(path).piece_counts, spaced=True)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(tokenizer_path(tokenizer))
        for batch in it:
            tokens = [sum(v) for v in pieces.all(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    bounded_batches(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
            .mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit))
