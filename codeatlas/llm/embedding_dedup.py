"""Near-duplicate vectors by product quantisation (operator 11).

1. Equal vectors of a label collapse to one class with its number of rows.
2. On a bounded sample (SAMPLE classes with the smallest hashes) the driver fits
   up to MAX_CELLS coarse centres and, on the residuals, CODES centres in each of
   SUBSPACES subspaces. Both only steer the cost: bounds below hold for any
   centres, so no link is lost by a poor fit.
3. Index: every class goes to the inverted list of its nearest coarse centre,
   with the codes of its residual, the exact length of what the codes leave, and
   its vector. A list is dealt into blocks of about BLOCK entries.
4. Probes: two unit vectors with cosine >= c are at most r = sqrt(2 - 2c) apart.
   So a partner's list is one whose bisecting plane with the own centre is at
   most r away; all such lists are probed (each unordered pair of lists once).
5. Asymmetric table lookups give the distance of a query to an entry's
   quantised form; less the entry's left-over length it bounds the true distance
   from below. What stays within r is reranked by exact cosine in double precision.

A block's pairs are never emitted: a task hands on numbers of links for each
class and the edges of a spanning forest. Queries of a hot block are dealt into
slices of about SLICE. Components are smallest reachable ids.

Defined cases: vectors that are null, zero, or hold a null or non-finite
component, rows with a null label and rows with a null id link with nothing
(a null id has component null and is kept); vectors of unequal length are never
linked; rows that repeat an id are vectors of their own, and count as kept if
that id names the component; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.common import bounded_batches
from codeatlas.llm.near_dedup import components
from codeatlas.session import cut_table

SAMPLE = 16_384          # classes that the centres are fitted on, 16 a centre beyond 1,024 centres
MAX_CELLS = 4096
CELL_ROWS = 1024         # wanted classes a list, in the largest label
SUBSPACES, CODES = 8, 64
BLOCK, SLICE = 4096, 65_536
SLACK = 1e-6             # room for rounding in the bounds
_QUERIES = 256           # queries that are looked up together


# --------------------------------------------------------------------------
# vectors -> classes
# --------------------------------------------------------------------------

def _unit(values: list) -> np.ndarray | None:
    """The vector at length 1 in double precision, None if it takes no part."""
    x = np.array([math.nan if v is None else v for v in values], float)
    top = np.abs(x).max(initial=0.0)
    if not np.isfinite(x).all() or not top:
        return None
    x = x / top + 0.0
    return x / np.linalg.norm(x)


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, mark (fingerprint of the components, null if the row takes
    no part), dim, unit (little-endian doubles)."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            marks, dims, units = [], [], []
            for values, sound in zip(batch.column(2).to_pylist(), batch.column(0).is_valid().to_pylist()):
                unit = _unit(values) if values and sound else None
                marks.append(None if unit is None else hashlib.blake2b((np.array(values, "<f8") + 0.0).tobytes(), digest_size=16).digest())
                dims.append(None if unit is None else len(unit))
                units.append(None if unit is None else unit.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.binary()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())],
                                             ["vec_id", "label", "mark", "dim", "unit"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding").mapInArrow(run, "vec_id long, label string, mark binary, dim int, unit binary")


# --------------------------------------------------------------------------
# centres
# --------------------------------------------------------------------------

def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all rows of ``c``."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (x @ c.T), 0.0)


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """``k`` centres of the rows of ``x`` (Lloyd's steps from spread rows)."""
    c = x[np.random.default_rng(11).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin(squared(x, c), axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def fitted(classes: DataFrame, largest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Coarse centres and the centres of each subspace of the residuals, from a
    bounded sample. Fewer centres in wide vectors: at most 64 MB of them."""
    width = classes.agg(F.max("dim")).first()[0] or 1
    cells = max(1, min(MAX_CELLS, -(-largest // CELL_ROWS), (64 << 20) // (8 * width)))
    most = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if most is None:
        return np.zeros((1, 1)), [np.zeros((1, 1))]
    rows = (classes.where(F.col("dim") == most["dim"]).select("unit").orderBy(F.xxhash64("unit"))
            .limit(min(max(SAMPLE, 16 * cells), max(64, (256 << 20) // (8 * most["dim"])))).collect())
    x = np.array([np.frombuffer(r["unit"], "<f8") for r in rows])
    coarse = centres(x, cells)
    rest = x - coarse[np.argmin(squared(x, coarse), axis=1)]
    return coarse, [centres(np.ascontiguousarray(part), CODES) for part in np.array_split(rest, min(SUBSPACES, x.shape[1]), axis=1)]


class Index:
    """Centres fitted to vectors of a given length: cut off or filled with zeros."""

    def __init__(self, coarse: np.ndarray, subspaces: list[np.ndarray], dim: int):
        def fit(c: np.ndarray, n: int) -> np.ndarray:
            out = np.zeros((len(c), n))
            out[:, :min(n, c.shape[1])] = c[:, :n]
            return out
        self.coarse = fit(coarse, dim)
        edges = np.cumsum([0, *(c.shape[1] for c in subspaces)]).clip(max=dim)
        edges[-1] = dim
        self.spans = list(zip(edges[:-1], edges[1:]))
        self.codebooks = [fit(c, hi - lo) for c, (lo, hi) in zip(subspaces, self.spans)]
        self.apart = np.sqrt(squared(self.coarse, self.coarse))

    def cells(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each row's list, and the lists from it on that may hold a partner."""
        d = squared(x, self.coarse)
        own = np.argmin(d, axis=1)
        beyond = d - d[np.arange(len(x)), own][:, None]
        probed = beyond <= 2.0 * self.apart[own] * (radius + SLACK) + SLACK
        probed &= np.arange(len(self.coarse))[None, :] >= own[:, None]
        probed[np.arange(len(x)), own] = True
        return own, [np.flatnonzero(p) for p in probed]

    def codes(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length that the codes leave."""
        rest = x - self.coarse[own]
        out = np.zeros((len(x), len(self.spans)), np.uint8)
        left = np.zeros(len(x))
        for k, ((lo, hi), book) in enumerate(zip(self.spans, self.codebooks)):
            d = squared(rest[:, lo:hi], book)
            out[:, k] = np.argmin(d, axis=1)
            left += ((rest[:, lo:hi] - book[out[:, k]]) ** 2).sum(axis=1)
        return out, np.sqrt(left)

    def constants(self, codes: np.ndarray, cell: int) -> np.ndarray:
        """What an entry adds to every query's distance: |r|^2 + 2 c.r for its
        quantised residual r and its list's centre c."""
        total = np.zeros(len(codes))
        for k, ((lo, hi), book) in enumerate(zip(self.spans, self.codebooks)):
            total += ((book * book).sum(1) + 2.0 * (book @ self.coarse[cell, lo:hi]))[codes[:, k]]
        return total

    def distances(self, q: np.ndarray, cell: int, codes: np.ndarray, constant: np.ndarray) -> np.ndarray:
        """Distances of queries to quantised entries of a list, by one table a
        query and subspace: |q - c|^2 + constant - 2 q.r."""
        d = squared(q, self.coarse[cell:cell + 1]) + constant[None, :]
        for k, ((lo, hi), book) in enumerate(zip(self.spans, self.codebooks)):
            d -= 2.0 * (q[:, lo:hi] @ book.T)[:, codes[:, k]]
        return np.sqrt(np.maximum(d, 0.0))


# --------------------------------------------------------------------------
# lists and probes
# --------------------------------------------------------------------------

def indexed(classes: DataFrame, sent, radius: float) -> DataFrame:
    """classes with cell, codes, left and probes."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse, subspaces = sent.value
        for batch in it:
            dims = batch.column("dim").to_numpy()
            cell, codes, left, probes = np.zeros(len(dims), np.int32), [b""] * len(dims), np.zeros(len(dims)), [None] * len(dims)
            units = batch.column("unit").to_pylist()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                index = Index(coarse, subspaces, int(dim))
                x = np.array([np.frombuffer(units[i], "<f8") for i in rows])
                own, probed = index.cells(x, radius)
                made, rest = index.codes(x, own)
                cell[rows], left[rows] = own, rest
                for k, i in enumerate(rows):
                    codes[i], probes[i] = made[k].tobytes(), probed[k].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(codes, pa.binary()), pa.array(left), pa.array(probes, pa.list_(pa.int32()))],
                                             names=[*batch.schema.names, "cell", "codes", "left", "probes"])

    return classes.mapInArrow(run, "gid long, label string, dim int, n long, unit binary, cell int, codes binary, left double, probes array<int>")


def _linked(parent: dict[int, int], a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[i] and b[i] (each to the smaller root)."""
    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top
    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)


def _matcher(sent, cosine: float):
    radius = math.sqrt(2.0 - 2.0 * cosine)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse, subspaces = sent.value
        key, entries, parent, counts, held = None, [], {}, None, None

        def done() -> Iterator[pa.RecordBatch]:
            """Link counts of the entries and the forest of the block."""
            if held is None:
                return
            some = np.flatnonzero(counts)
            up = [(x, p) for x, p in parent.items() if x != p]
            a = pa.array(np.concatenate([held["gid"][some], np.array([x for x, _ in up], np.int64)]))
            b = pa.array([None] * len(some) + [p for _, p in up], pa.int64())
            yield pa.RecordBatch.from_arrays([a, b, pa.array(np.concatenate([counts[some], np.zeros(len(up), np.int64)]))], ["a", "b", "links"])

        for batch in it:
            labels = batch.column("label").to_pylist()
            ids = np.array([batch.column(c).to_numpy() for c in ("dim", "cell", "part", "slice", "asks")])
            change = np.flatnonzero((np.diff(ids) != 0).any(axis=0) | np.array([x != y for x, y in zip(labels, labels[1:])], bool)) + 1
            cuts = [0, *change.tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                now = (labels[lo], *ids[:4, lo].tolist())
                if now != key:
                    yield from done()
                    key, entries, parent, counts, held = now, [], {}, None, None
                rows = batch.slice(lo, hi - lo)
                if not ids[4, lo]:
                    entries.append(rows)
                    continue
                if held is None:
                    if not entries:
                        continue
                    whole = pa.Table.from_batches(entries).combine_chunks()
                    index = Index(coarse, subspaces, key[1])
                    codes = np.array([np.frombuffer(c, np.uint8) for c in whole.column("codes").to_pylist()])
                    held = {"gid": whole.column("gid").to_numpy(), "n": whole.column("n").to_numpy(), "codes": codes, "left": whole.column("left").to_numpy(),
                            "x": np.array([np.frombuffer(u, "<f8") for u in whole.column("unit").to_pylist()]), "constant": index.constants(codes, key[2])}
                    counts = np.zeros(len(held["gid"]), np.int64)
                for at in range(0, rows.num_rows, _QUERIES):
                    some = rows.slice(at, _QUERIES)
                    gid, n, own = some.column("gid").to_numpy(), some.column("n").to_numpy(), some.column("own").to_numpy()
                    q = np.array([np.frombuffer(u, "<f8") for u in some.column("unit").to_pylist()])
                    near = index.distances(q, key[2], held["codes"], held["constant"]) - held["left"][None, :] <= radius + SLACK
                    near &= (own != key[2])[:, None] | (gid[:, None] < held["gid"][None, :])  # inside a list each pair once
                    a, b = np.nonzero(near)
                    good = np.concatenate([np.einsum("ij,ij->i", q[a[k:k + 65536]], held["x"][b[k:k + 65536]]) >= cosine for k in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
                    a, b = a[good], b[good]
                    if not len(a):
                        continue
                    np.add.at(counts, b, n[a])
                    mine = np.zeros(len(gid), np.int64)
                    np.add.at(mine, a, held["n"][b])
                    _linked(parent, gid[a], held["gid"][b])
                    hit = np.flatnonzero(mine)
                    yield pa.RecordBatch.from_arrays([pa.array(gid[hit]), pa.array([None] * len(hit), pa.int64()), pa.array(mine[hit])], ["a", "b", "links"])
        yield from done()
    return run


def links(classes: DataFrame, cosine: float) -> DataFrame:
    """(a, b, links): numbers of linked rows of classes a (b null), and forest
    edges a - b, of ``classes`` (gid, label, dim, n, unit)."""
    largest = classes.groupBy("label", "dim").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    sent = classes.sparkSession.sparkContext.broadcast(fitted(classes, largest))
    index = cut_table(indexed(classes, sent, math.sqrt(2.0 - 2.0 * cosine)), "vector_index")
    place = ["label", "dim", "cell"]
    sizes = index.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    asked = index.select("label", "dim", F.explode("probes").alias("cell")).groupBy(*place).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    lists = cut_table(sizes.join(asked, place), "vector_lists")
    none = [F.lit(0).alias("asks"), F.lit(-1).alias("own")]
    deal = F.xxhash64("gid")
    entries = (index.join(lists, place).select(*place, F.pmod(deal, "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
                                               *none, "gid", "n", "codes", "left", "unit"))
    queries = (index.select("label", "dim", F.explode("probes").alias("cell"), F.col("cell").alias("own"), "gid", "n", "unit").join(lists, place)
               .select(*place, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(deal, "slices").cast("int").alias("slice"),
                       F.lit(1).alias("asks"), "own", "gid", "n", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("left"), "unit"))
    keys = [*place, "part", "slice"]
    return (entries.unionByName(queries).repartition(*keys).sortWithinPartitions(*keys, "asks")
            .mapInArrow(_matcher(sent, cosine), "a long, b long, links long"))


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``
    (vec_id, embedding, label, ...): links only between equal labels."""
    bounded_batches(vectors)
    rows = cut_table(prepared(vectors), "vector_rows")
    place = ["label", "dim", "mark"]
    classes = (rows.where("mark is not null and label is not null").groupBy(*place)
               .agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.min("unit").alias("unit")).withColumn("gid", F.monotonically_increasing_id()))
    classes = cut_table(classes, "vector_classes")
    found = cut_table(links(classes.select("gid", "label", "dim", "n", "unit"), cosine), "vector_links")
    numbers = found.where("b is null").groupBy(F.col("a").alias("gid")).agg(F.sum("links").alias("links"))
    group = cut_table(components(found.where("b is not null").select("a", "b")), "vector_groups").select(F.col("id").alias("gid"), "component")
    named = cut_table(classes.select(*place, "gid", "n", "low").join(numbers, "gid", "left").join(group, "gid", "left")
                      .withColumn("component", F.coalesce("component", "gid")), "vector_named")
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    known = named.join(lows, "component").select(*place, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    return (rows.select("vec_id", *place).join(known, place, "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id"))))
