"""Packing into training sequences by best-fit decreasing (operator 6).

Each task tokenizes its own rows and packs them in shards of bounded size, so
nothing is shuffled and memory does not grow with the table. Overlong documents
are first cut into full windows. The rest goes, longest first, to the open
window with the least sufficient room, which a segment tree over remaining
capacities finds. Windows that stay emptier than MAX_WASTE are taken apart and
cut into full windows, which leaves one partly filled window a shard.

Defined cases: a null text is a document of its end id alone; each row is a
document of its own, so repeated rows and equal ids are all packed; a null id
stays null; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.common import batches, bounded_batches, released
from codeatlas.llm.vocab import encoder, tokenizer_path

WINDOW = 2048
END_ID = 1
SHARD_IDS = 1 << 22  # ids that are packed together
MAX_WASTE = 32       # unused places that a window may keep

Piece = tuple[int, int, int]  # document, start, length

SCHEMA = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "doc_tokens": pa.int64(),
          "sequence_id": pa.int64(), "offset": pa.int64(), "ids": pa.binary()}


class Room:
    """Open windows by remaining capacity; ``tightest(n)`` takes one with the
    least capacity that is at least ``n``."""

    def __init__(self, capacity: int):
        self.leaf = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaf)  # open windows below each node
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, capacity: int, by: int) -> None:
        node = self.leaf + capacity
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.windows[capacity].append(window)
            self._change(capacity, 1)

    def tightest(self, n: int) -> tuple[int, int] | None:
        tree, node = self.tree, self.leaf + n
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaf:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self.leaf
        self._change(capacity, -1)
        return capacity, self.windows[capacity].pop()


def pack_lengths(lengths: list[int], window: int = WINDOW, max_waste: int = MAX_WASTE) -> list[list[Piece]]:
    """Windows as lists of pieces; each id of each document is in one piece."""
    full: list[list[Piece]] = []
    rest: list[Piece] = []
    for doc, n in enumerate(lengths):
        cut = n - n % window
        full += [[(doc, at, window)] for at in range(0, cut, window)]
        if n > cut:
            rest.append((doc, cut, n - cut))
    rest.sort(key=lambda p: (-p[2], p[0]))
    room = Room(window)
    open_: list[list[Piece]] = []
    for piece in rest:
        found = room.tightest(piece[2])
        if found is None:
            found = (window, len(open_))
            open_.append([])
        open_[found[1]].append(piece)
        room.put(found[0] - piece[2], found[1])
    loose: list[Piece] = []
    for pieces in open_:
        used = sum(p[2] for p in pieces)
        if window - used > max_waste and used & (used - 1):
            loose += pieces
        else:
            full.append(pieces)
    current: list[Piece] = []
    space = window
    for doc, start, length in loose:
        while length:
            n = min(length, space)
            current.append((doc, start, n))
            start, length, space = start + n, length - n, space - n
            if not space:
                full.append(current)
                current, space = [], window
    return full + ([current] if current else [])


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, window: int = WINDOW,
         max_waste: int = MAX_WASTE, shard_ids: int = SHARD_IDS) -> DataFrame:
    """One row for each piece: doc_id, start and length (ids), doc_tokens,
    sequence_id, offset in the sequence, ids (little-endian 32-bit). Sequence
    ids are unique: the task's number and the sequence's number in it."""
    bounded_batches(docs)
    end = end_id.to_bytes(4, "little")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(tokenizer_path(tokenizer), spaced=True)
        sequence = TaskContext.get().partitionId() << 36
        names: list[int | None] = []
        held: list[bytes] = []

        def flush() -> Iterator[tuple]:
            nonlocal sequence
            for placed in pack_lengths([len(x) // 4 for x in held], window, max_waste):
                offset = 0
                for doc, start, length in placed:
                    yield names[doc], start, length, len(held[doc]) // 4, sequence, offset, held[doc][4 * start:4 * (start + length)]
                    offset += length
                sequence += 1
            names.clear()
            held.clear()

        def rows() -> Iterator[tuple]:
            size = 0
            for batch in it:
                ids = batch.column(0).to_pylist()
                for doc_id, got in zip(ids, pieces.column(batch.column(1))):
                    names.append(doc_id)
                    held.append(got + end)
                    size += len(held[-1]) // 4
                    if size >= shard_ids:
                        yield from flush()
                        size = 0
            yield from flush()

        gc.disable()  # texts, pieces and windows hold no cycles: counting references frees them
        try:
            yield from batches(SCHEMA, rows(), 2048)
        finally:
            gc.enable()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        released(run), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
