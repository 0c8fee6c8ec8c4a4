"""Exact top-k inner products by a three-phase uniform threshold (operator 5).

A vector's components are dealt into LISTS lists; a row's score is the sum of
its partial scores, one from each list.

1. Gather: for each query, each slice of rows takes the k best entries of every
   list; the other partial scores are added for these entries alone, and the k-th
   best sum of all is a safe cutoff.
2. Broadcast and collect: the cutoff goes back with the query. An entry whose
   partial scores all lie below cutoff / LISTS cannot reach the cutoff, so only
   entries at or above it in some list are collected. A row block whose lengths
   bound every score below a query's cutoff is passed over.
3. Resolve: the missing partial scores of the collected entries are added
   exactly, and what reaches the cutoff is ranked.

Query blocks meet row blocks by an equi-join on (query block, slice); work is
inherently queries x rows. A query block holds thousands of queries, so that a
row block is sent seldom; within a task QUERY_ROWS queries are looked up at a
time, and each task hands on k rows a query and slice.

Defined cases: vectors that are null, or hold a null or non-finite component,
and rows with a null id take no part; rows that repeat an id are rows of their
own, as candidates and as queries; vectors of unequal length are filled up with zeros; scores must fit
64 bits (components beyond +-2^62 are held there); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.llm.common import batches, bounded_batches
from codeatlas.session import cut_table

LISTS = 2
QUERY_BLOCK, QUERY_ROWS, ROW_BLOCK = 8192, 512, 4096
SLICE_BLOCKS = 64  # row blocks of a slice
NEVER = np.iinfo(np.int64).min


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(nth, vec_id, vec array<long>) of the rows that take part; ``nth`` tells
    rows with equal ids apart."""
    x = F.transform("embedding", lambda v: F.floor(F.greatest(F.lit(-2.0**62), F.least(F.lit(2.0**62), v.cast("double") * scale))))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound)
            .select(F.monotonically_increasing_id().alias("nth"), F.col("vec_id").cast("long"), x.alias("vec")))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(block, ids, nths, width, data[, cutoff]) with at most ``size`` rows each."""
    with_cut = "cutoff" in rows.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        for batch in it:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                vecs = part.column("vec").to_pylist()
                width = max(map(len, vecs))
                data = np.zeros((len(vecs), width), "<i8")
                for i, v in enumerate(vecs):
                    data[i, :len(v)] = v
                small = np.abs(data).max(initial=0) < 2**31
                row = {"block": block, "ids": np.array(part.column("vec_id"), "<i8").tobytes(), "nths": np.array(part.column("nth"), "<i8").tobytes(), "width": width, "small": bool(small),
                       "data": data.astype("<i4" if small else "<i8").tobytes()}
                if with_cut:
                    row["cutoff"] = np.array(part.column("cutoff").fill_null(NEVER), "<i8").tobytes()
                block += 1
                yield pa.RecordBatch.from_pylist([row])

    return rows.mapInArrow(run, "block long, ids binary, nths binary, width long, small boolean, data binary" + ", cutoff binary" * with_cut)


def _matrix(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[side + "ids"], "<i8")
    return ids, np.frombuffer(row[side + "nths"], "<i8"), np.frombuffer(row[side + "data"], "<i4" if row[side + "small"] else "<i8").reshape(len(ids), row[side + "width"])


def partial_scores(q: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Integer partial scores (queries x rows) of each list of components.
    Products go through float64 where every sum is below 2^53, so exact."""
    width = min(q.shape[1], x.shape[1])
    out = []
    for cols in np.array_split(np.arange(width), LISTS):
        a, b = q[:, cols], x[:, cols]
        top = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, len(cols))
        if top < 2**53:
            out.append((a.astype(float) @ b.T.astype(float)).astype(np.int64))
        else:
            out.append(a.astype(np.int64) @ b.T.astype(np.int64))
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best entries: score first, then smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _meet(queries: DataFrame, rows: DataFrame, phase, k: int) -> DataFrame:
    """Run ``phase(query row, row rows)`` -> entries per query over all blocks,
    merged to the k best for each (query block, slice)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[tuple]:
            key, held, ids = None, [], None
            for batch in it:
                for row in batch.to_pylist():
                    qid, own, q = _matrix(row, "q_")
                    xid, nth, x = _matrix(row, "")
                    if key != (row["q_block"], row["slice"]):
                        yield from out(ids, held)
                        key, ids, held = (row["q_block"], row["slice"]), (qid, own), [(np.zeros(0, np.int64),) * 2 for _ in qid]
                    cutoff = np.frombuffer(row["q_cutoff"], "<i8") if "q_cutoff" in row else None
                    for lo in range(0, len(qid), QUERY_ROWS):
                        some = slice(lo, lo + QUERY_ROWS)
                        for i, (new_ids, new_scores) in phase(own[some], q[some], nth, xid, x, None if cutoff is None else cutoff[some], k):
                            all_ids, all_scores = np.concatenate([held[lo + i][0], new_ids]), np.concatenate([held[lo + i][1], new_scores])
                            top = best(all_scores, all_ids, k)
                            held[lo + i] = (all_ids[top], all_scores[top])
            yield from out(ids, held)

        def out(ids, held) -> Iterator[tuple]:
            for i, (vec_ids, scores) in enumerate(held):
                for v, s in zip(vec_ids.tolist(), scores.tolist()):
                    yield int(ids[0][i]), int(ids[1][i]), v, s

        yield from batches({"query_id": pa.int64(), "query": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}, entries())

    return rows.join(queries.hint("merge"), ["q_block", "slice"]).mapInArrow(run, "query_id long, query long, vec_id long, score long")


def gather(own, q, nth, xid, x, _, k):
    """Phase 1: the k best of every list, and the sums of these entries alone."""
    lists = partial_scores(q, x)
    for i in range(len(own)):
        other = np.flatnonzero(nth != own[i])
        if len(other):
            seen = np.unique(np.concatenate([other[np.argpartition(-p[i, other], min(k, len(other)) - 1)[:k]] for p in lists]))
            yield i, (xid[seen], sum(p[i, seen] for p in lists))


def reachable(q: np.ndarray, x: np.ndarray, cutoff: np.ndarray) -> np.ndarray:
    """Queries whose cutoff some row may reach: a list's partial score is at most
    the product of the lengths there."""
    width = min(q.shape[1], x.shape[1])
    most = np.zeros(len(q))
    for cols in np.array_split(np.arange(width), LISTS):
        a, b = q[:, cols].astype(float), x[:, cols].astype(float)
        most += np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1).max(initial=0.0))
    return np.flatnonzero(most * (1 + 1e-9) + 1 >= cutoff.astype(float))


def collect_and_resolve(own, q, nth, xid, x, cutoff, k):
    """Phases 2 and 3: entries that reach the uniform share of the cutoff in
    some list, then those whose full score reaches the cutoff."""
    some = reachable(q, x, cutoff)
    if not len(some):
        return
    lists = partial_scores(q[some], x)
    for i, at in enumerate(some):
        share = NEVER if cutoff[at] == NEVER else -((-int(cutoff[at])) // LISTS)  # least integer share
        near = nth != own[at]
        near &= np.logical_or.reduce([p[i] >= share for p in lists])
        seen = np.flatnonzero(near)
        score = sum(p[i, seen] for p in lists)
        keep = score >= cutoff[at]
        if keep.any():
            yield at, (xid[seen[keep]], score[keep])


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (vec_id divisible by
    ``every``) its ``k`` best other rows, ties to the smaller id."""
    bounded_batches(vectors)
    rows = cut_table(quantized(vectors, scale), "vectors")
    x = cut_table(blocks(rows, ROW_BLOCK), "row_blocks")
    slices = max(1, -(-x.count() // SLICE_BLOCKS))
    queries = rows.where(F.col("vec_id") % every == 0)

    def placed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        q = cut_table(blocks(found, QUERY_BLOCK), "query_blocks")
        q = q.select(*[F.col(c).alias("q_" + c) for c in q.columns])
        # query blocks are numbered from 0 (a window over their numbers alone), so that row blocks can name all of them
        number = q.select("q_block", F.row_number().over(Window.orderBy("q_block")).alias("k"))
        q = q.join(number, "q_block").withColumn("q_block", F.col("k").cast("long")).drop("k")
        met = x.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int"))
        return (q.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")),
                met.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(max(1, q.count())).cast("long"))).alias("q_block")))

    best_first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = _meet(*placed(queries), gather, k)
    cutoffs = (lists.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
               .groupBy(F.col("query").alias("nth")).agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("cutoff")))
    found = _meet(*placed(queries.join(cutoffs, "nth", "left")), collect_and_resolve, k)
    return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
