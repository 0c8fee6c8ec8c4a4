"""Near-duplicate groups by one-permutation MinHash (operator 4).

1. One pass over whole texts: the set of distinct word shingles, its 128-bit
   fingerprint, and a one-permutation signature (the hash range is dealt into
   BINS bins, each keeps its smallest hash; an empty bin copies from the first
   filled bin that its own fixed random probe sequence meets: optimal
   densification). BANDS bands of ROWS bins give bucket keys.
2. Rows with equal sets collapse to their smallest id.
3. Buckets get star-shaped edges to one centre, never all pairs: the centre is
   the member that shares most buckets with others. Each edge is confirmed on
   the full sets, linked sets become components, and new stars join only what
   is still apart, until a round finds no link. Small buckets (at most SMALL
   members) are then settled pair by pair where components still differ, which
   is at most SMALL/2 pairs a row.
4. What larger buckets still hold apart is settled by an exact prefix-filter
   join: shingles are ordered from rare to common, and two sets that are similar
   enough share one of the first few of each (``prefixes``). Every such pair of
   two components is confirmed on the full sets; members of a shingle's largest
   component meet only the others.
5. Components are smallest reachable ids (large-star and small-star steps).

Hot buckets and hot groups never meet in one task as a list: minima and maxima
are combined before the shuffle, and joins read written tables on both sides, so
that AQE can split a skewed key. Intermediate tables lie in the shared
checkpoint folder.

A pair with similarity 0.8 escapes all BANDS buckets with probability
(1 - 0.8 ** ROWS) ** BANDS, about 3e-6.

Defined cases: a null, empty or blank text has no shingles, is linked with
nothing and is kept; a row with a null id is linked with nothing, its component
is null and it is kept; rows with equal ids are one document (``drop_near`` takes
them as rows of their own); an empty table
gives no rows; other columns are ignored (``drop_near`` carries them along).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.common import bounded_batches, mixed, released, shingle_set, text_chunks, words
from codeatlas.session import cut_table

BINS, BANDS, ROWS = 256, 42, 6
SMALL = 32        # buckets up to this size are settled pair by pair
MAX_ROUNDS = 12   # star rounds, if links keep appearing
ORDERED = 1 << 20  # commonest shingles that prefixes put last; the others come first, by hash
RUN_BYTES = 1 << 18  # text that a task holds as numpy arrays (about 60 bytes a byte) at a time
_PROBES = np.random.default_rng(4).integers(0, BINS, (4096, BINS))
_STEPS = ((0, 8), (8, 64), (64, 512), (512, 4096))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The densified smallest hash of each bin, for a sorted non-empty set."""
    bins = (shingles >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    sig, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    sig[bins[first]] = shingles[first]
    filled[bins[first]] = True
    empty = np.flatnonzero(~filled)
    for lo, hi in _STEPS:
        if not len(empty):
            break
        probes = _PROBES[lo:hi, empty]
        met = filled[probes]
        found = met.any(axis=0)
        donor = probes[met.argmax(axis=0), np.arange(len(empty))]
        sig[empty[found]] = sig[donor[found]]
        empty = empty[~found]
    if len(empty):
        sig[empty] = sig[bins[first[0]]]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band (the band's number is mixed in)."""
    rows = sig[:BANDS * ROWS].reshape(BANDS, ROWS)
    key = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9FB21C651E98DF25) + rows[:, k])
    return key


def signatures(docs: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id, fp1, fp2, n_shingles, bands of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, data, offsets in text_chunks(batch.column(1), RUN_BYTES):
                hashes, at = words(data, offsets, fold_case=True)
                n = len(offsets) - 1
                size, fp = np.zeros(n, np.int64), np.zeros((2, n), np.uint64)
                bands: list[np.ndarray | None] = [None] * n
                for i in range(n):
                    if at[i] == at[i + 1]:
                        continue
                    s = shingle_set(hashes[at[i]:at[i + 1]], shingle_words)
                    size[i] = len(s)
                    fp[0, i] = mixed(s * np.uint64(0xC2B2AE3D27D4EB4F)).sum()
                    fp[1, i] = mixed(s ^ np.uint64(0x165667B19E3779F9)).sum()
                    bands[i] = band_keys(signature(s)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), pa.array(size), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "fp1", "fp2", "n_shingles", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id long, fp1 long, fp2 long, n_shingles long, bands array<long>")


def similar(pairs: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))

        def sets(column: pa.Array) -> Iterator[np.ndarray]:
            for _, data, offsets in text_chunks(column, RUN_BYTES):
                hashes, at = words(data, offsets, fold_case=True)
                for i in range(len(offsets) - 1):
                    yield shingle_set(hashes[at[i]:at[i + 1]], shingle_words)

        for batch in it:
            centres, members = batch.column("b").to_pylist(), sets(batch.column("text_a"))
            good = []
            for i, a in enumerate(members):
                if held[0] != centres[i]:
                    held = (centres[i], next(sets(batch.column("text_b").slice(i, 1))))
                b = held[1]
                common = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)) if len(a) and len(b) else 0
                good.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(released(run), "a long, b long")


def shingle_counts(texts: DataFrame, shingle_words: int) -> DataFrame:
    """shingle, df: the texts that hold each shingle, where these are several."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for _, data, offsets in text_chunks(batch.column(0), RUN_BYTES):
                hashes, at = words(data, offsets, fold_case=True)
                found, n = np.unique(np.concatenate([shingle_set(hashes[at[i]:at[i + 1]], shingle_words) for i in range(len(offsets) - 1)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "df"])

    return texts.select("text").mapInArrow(released(run), "shingle long, df long").groupBy("shingle").agg(F.sum("df").alias("df")).where("df > 1")


def prefixes(texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """id, component, n, shingle, place (written): the first shingles of each set (id,
    component, text), rare ones first, of which two similar sets share one. The
    order decides the cost only, so it may know the ORDERED commonest alone;
    if these are all that repeat, the others need no row."""
    top = shingle_counts(texts, shingle_words).orderBy(F.desc("df"), "shingle").limit(ORDERED).toArrow()
    whole = top.num_rows < ORDERED
    keys, df = top.column("shingle").to_numpy().view(np.uint64), top.column("df").to_numpy()
    by_key = np.argsort(keys)
    order = texts.sparkSession.sparkContext.broadcast((keys[by_key], df[by_key]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, df = order.value
        for batch in it:
            for lo, data, offsets in text_chunks(batch.column(2), RUN_BYTES):
                hashes, at = words(data, offsets, fold_case=True)
                rows, sizes, found, places = [], [], [], []
                for i in range(len(offsets) - 1):
                    s = shingle_set(hashes[at[i]:at[i + 1]], shingle_words)
                    if not len(s) or not len(keys):
                        continue
                    near = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    known = keys[near] == s
                    first = np.lexsort((s, np.where(known, df[near], 1)))[:len(s) - -(-percent * len(s) // 100) + 1]
                    place = np.flatnonzero(known[first]) if whole else np.arange(len(first))
                    rows.append(np.full(len(place), lo + i))
                    sizes.append(np.full(len(place), len(s)))
                    found.append(s[first[place]])
                    places.append(place)
                if rows:
                    of = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(places))],
                                                     ["id", "component", "n", "shingle", "place"])

    made = cut_table(texts.select("id", "component", "text").mapInArrow(released(run), "id long, component long, n long, shingle long, place long"), "prefixes")
    order.destroy()
    return made


def prefix_pairs(first: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of two components that share a shingle of their prefixes
    early enough to be similar. The first shingle that two similar sets share
    leaves at least their common part behind it in both."""
    most = cut_table(first.groupBy("shingle", "component").agg(F.count("*").alias("k")).groupBy("shingle")
                     .agg(F.max_by("component", F.struct("k", "component")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1").select("shingle", "most"), "prefix_most")
    met = cut_table(first.join(most, "shingle"), "prefix_members")
    other = met.where("component <> most").select("shingle", F.col("id").alias("b"), F.col("component").alias("other"), F.col("n").alias("m"), F.col("place").alias("at"))
    return (met.join(other, "shingle").where("component <> other").where(f"100 * least(n, m) >= {percent} * greatest(n, m)")
            .where(f"{100 + percent} * least(n - place, m - at) >= {percent} * (n + m)")
            .select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (a, b), where component is
    the smallest id that it reaches. Each step rehangs edges to the smallest
    neighbour, over larger neighbours and then over smaller ones, until only
    stars are left."""
    mark = None
    now = cut_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        for larger in (True, False):
            ways = _both_ways(now)
            least = ways.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
            side = ways.where("u > v") if larger else now.select(F.col("a").alias("v"), F.col("b").alias("u"))
            lows = cut_table(least, "least")
            hung = side.join(lows, "v").select(F.col("u").alias("a"), F.col("m").alias("b"))
            if not larger:
                hung = hung.union(lows.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")))
            now = cut_table(hung.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``
    (doc_id, text, ...)."""
    bounded_batches(docs)
    sigs = cut_table(signatures(docs, shingle_words), "signatures")
    sets = cut_table(sigs.where("n_shingles > 0 and doc_id is not null").groupBy("fp1", "fp2", "n_shingles")
                     .agg(F.min(F.struct("doc_id", "bands")).alias("x"))
                     .select("fp1", "fp2", F.col("x.doc_id").alias("id"), F.col("n_shingles").alias("n"), F.col("x.bands").alias("bands")), "sets")
    rows = sets.select("id", "n", F.explode("bands").alias("key"))
    buckets = cut_table(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    shared = cut_table(rows.join(buckets, "key"), "shared")
    weight = cut_table(shared.groupBy("id").agg(F.sum("size").alias("weight")), "weights")
    texts = cut_table(docs.select(F.col("doc_id").cast("long").alias("id"), "text")
                      .join(weight.select("id"), "id", "left_semi"), "texts")
    members = cut_table(shared.join(weight, "id").select("key", "size", "id", "n", "weight"), "members")
    fits = F.expr(f"100 * least(n, c.n) >= {percent} * greatest(n, c.n)")

    def stars(of: DataFrame, order: list) -> DataFrame:
        """Edges from each bucket's members to its centre."""
        centre = cut_table(of.groupBy("key").agg(F.max(F.struct(*order, "id", "n")).alias("c")), "centres")
        return of.join(centre, "key").where(F.col("id") != F.col("c.id")).where(fits)

    # first star: each set to the weightiest centre of its buckets
    first = (stars(members, ["weight", (-F.col("id")).alias("low")])
             .groupBy(F.col("id").alias("a")).agg(F.max_by("c.id", F.struct("c.weight", "c.low")).alias("b")))
    tested = cut_table(first, "tested")
    links = cut_table(similar(tested, texts, shingle_words, percent), "links")
    label = cut_table(components(links), "labels")

    def apart() -> DataFrame:
        """Members of buckets in which components still differ."""
        now = members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
        split = cut_table(now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"), "split")
        return cut_table(now.join(split, "key"), "apart")

    def merge(pairs: DataFrame) -> int:
        """Test new pairs; hang what they link on the components."""
        nonlocal tested, links, label
        ordered = pairs.distinct()
        done = tested.union(tested.select("b", "a"))
        new = cut_table(ordered.join(done, ["a", "b"], "left_anti"), "pairs")
        if new.isEmpty():
            return 0
        found = cut_table(similar(new, texts, shingle_words, percent), "links")
        tested = tested.union(new)
        n = found.count()
        if n:
            links = links.union(found)
            # only component names take part: (old name of a, old name of b)
            named = (found.join(label.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
                     .join(label.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
                     .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
            up = cut_table(components(named), "names")
            old = label.union(found.select(F.col("a").alias("id"), F.col("a").alias("component"))
                              .union(found.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
                              .join(label, "id", "left_anti"))
            label = cut_table(old.join(up.select(F.col("id").alias("component"), F.col("component").alias("name")), "component", "left")
                              .select("id", F.coalesce("name", "component").alias("component")), "labels")
        return n

    for turn in range(MAX_ROUNDS):
        open_ = apart()
        if open_.isEmpty():
            break
        # one member speaks for its component in a bucket; another one each round
        pick = F.struct("weight", "id", "n") if turn == 0 else F.struct(F.xxhash64("id", F.lit(turn)).alias("weight"), "id", "n")
        speakers = (open_.groupBy("key", "component").agg(F.max(pick).alias("x"))
                    .select("key", F.col("x.weight").alias("weight"), F.col("x.id").alias("id"), F.col("x.n").alias("n")))
        if not merge(stars(cut_table(speakers, "speakers"), ["weight"]).select(F.col("id").alias("a"), F.col("c.id").alias("b"))) and turn:
            break
    rest = apart().where(F.col("size") <= SMALL)
    other = rest.select("key", F.col("id").alias("b"), F.struct("n").alias("c"), F.col("component").alias("other"))
    merge(rest.join(other, "key").where(F.col("id") < F.col("b")).where("component <> other").where(fits)
          .select(F.col("id").alias("a"), "b"))
    large = cut_table(apart().where(F.col("size") > SMALL).select("id", "component").distinct(), "large")
    if not large.isEmpty():
        merge(prefix_pairs(prefixes(cut_table(texts.join(large, "id"), "large_texts"), shingle_words, percent), percent))

    final = cut_table(sets.join(label, "id", "left").select("fp1", "fp2", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component")), "components")
    return (sigs.select("doc_id", "fp1", "fp2", "n_shingles").join(final, ["fp1", "fp2", "n_shingles"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))))


def drop_near(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns kept: the
    one with the smallest id. A row goes only if it is linked with the kept one.
    Rows that repeat an id are rows of their own: where there are any, groups are
    found over row numbers. Rows with a null id all stay."""
    ident = F.col("doc_id").cast("long")
    if docs.where("doc_id is not null").groupBy(ident.alias("doc_id")).count().where("count > 1").isEmpty():
        gone = cut_table(near_duplicates(docs, shingle_words, percent).where("not kept").select("doc_id"), "gone")
        return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
    # the columns travel as one struct, so that none can clash
    rows = cut_table(docs.select(F.monotonically_increasing_id().alias("nth"), ident.alias("id"), "text", F.struct(*docs.columns).alias("row")), "numbered_docs")
    found = near_duplicates(rows.select(F.when(F.col("id").isNotNull(), F.col("nth")).alias("doc_id"), "text"), shingle_words, percent)
    named = cut_table(found.where("doc_id is not null").select(F.col("doc_id").alias("nth"), "component_id").join(rows.select("nth", "id"), "nth"), "near_rows")
    stay = named.groupBy("component_id").agg(F.min(F.struct("id", "nth")).alias("first"))
    gone = cut_table(named.join(stay, "component_id").where("nth <> first.nth").select("nth"), "gone")
    return rows.join(gone, "nth", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
