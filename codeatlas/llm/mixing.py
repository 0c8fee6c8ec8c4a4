"""Mixing sources to target weights by Poisson replication (operator 2).

Every document of a source is repeated Poisson(rate) times, where the source's
rate is its target share of characters over its own share. The count comes from
inverting the distribution at a uniform number hashed from seed and document, so
any rerun or lost task gives the same copies. Copies are dealt over all
partitions by a hash of (document, copy) and sorted by it: a global shuffle.
DataFrame functions only.

A rate is split into equal parts of at most MAX_PART, each inverted by a hash of
its own (their sum is Poisson again), so a row's table of probabilities stays
short and ``exp`` never underflows.

Defined cases: a null or empty text weighs nothing and is repeated by its
source's rate; null sources are one source; a source without characters or
without target weight has rate 0; rows whose id is null or repeated draw each on
their own, by a digest of the whole row and, among equal rows, a number; a null
id hashes as the word null; an empty table gives no rows; other columns are
carried along (``copy``, ``shuffle_key`` must not be among them: they are
replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.session import cut_table

MAX_PART = 8.0    # largest mean that is inverted at once
TABLE_ROWS = 64   # entries of its distribution: P(Poisson(8) >= 64) < 1e-30
BROADCAST_SOURCES = 10_000
BROADCAST_BYTES = 16 << 20  # of ids that several rows have
NUMBERED = 1 << 16          # equal rows that are numbered at a time
SEED = "mix-1"


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from 52 bits of an md5 over the key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5) -> DataFrame:
    """source, parts, cdf: the mean repetitions as ``parts`` draws from the
    distribution ``cdf``. ``weights`` (source, weight) gives relative target
    shares; without it the shares are sizes to the power ``alpha``."""
    size = cut_table(docs.groupBy("source").agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0)).cast("double")).alias("chars")), "mix_sizes")
    if weights is None:
        target = size.withColumn("weight", F.pow("chars", F.lit(alpha)))
    else:
        target = (size.join(weights.groupBy(F.col("source").alias("w_source")).agg(F.sum("weight").alias("weight")),
                            F.col("source").eqNullSafe(F.col("w_source")), "left")
                  .select("source", "chars", F.coalesce(F.col("weight"), F.lit(0.0)).alias("weight")))
    chars, weight = target.agg(F.coalesce(F.sum("chars"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("chars") > 0, F.col("weight"))), F.lit(0.0))).first()
    rate = F.lit(chars) * F.col("weight") / F.lit(weight or 1.0) / F.col("chars")
    parts = target.where("chars > 0 and weight > 0").withColumn("rate", rate).withColumn("parts", F.ceil(F.col("rate") / MAX_PART).cast("int"))
    mean = F.col("rate") / F.col("parts")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TABLE_ROWS - 1)), start, step, lambda acc: acc["cdf"])
    return parts.select(F.col("source").alias("r_source"), "parts", cdf.alias("cdf"))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as (source, key, row), with a key of its own for every row: the
    id where one row has it; else id, digest of the row and the row's number
    among equal rows. Only the ids are shuffled, and rows that share one; equal
    rows are counted where they are read, and made again after it."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # the input's columns travel as one struct, so that none can clash
    rows = docs.select(F.col("source"), ident.alias("key"), F.struct(*docs.columns).alias("row"))
    several = cut_table(docs.select(ident.alias("again")).groupBy("again").agg(F.count("*").alias("n")).where("n > 1").select("again"), "mix_again")
    ids, size = several.agg(F.count("*"), F.sum(F.octet_length("again") + 16)).first()
    if not ids:
        return rows
    several = F.broadcast(several) if size <= BROADCAST_BYTES else several
    # a field is its length and its text, or 0 for null, so unlike rows have unlike digests
    text = [F.col(f"row.`{c.replace('`', '``')}`").cast("string") for c in docs.columns]
    digest = F.md5(F.concat(*[F.coalesce(F.concat(F.lit("1"), F.char_length(t).cast("string"), F.lit(":"), t), F.lit("0")) for t in text]))
    same = F.col("key") == F.col("again")
    alike = (rows.join(several, same, "left_semi").withColumn("digest", digest).groupBy("key", "digest")
             .agg(F.first("source").alias("source"), F.first("row").alias("row"), F.count("*").alias("n")))
    # many equal rows are numbered in blocks that are dealt over all tasks
    blocks = cut_table(alike.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / NUMBERED))).alias("block"))
                       .repartition("key", "digest", "block"), "mix_alike")
    first = F.col("block") * NUMBERED + 1
    numbered = blocks.select("source", "key", "digest", "row", F.explode(F.sequence(first, F.least(F.col("n"), first + NUMBERED - 1))).alias("nth"))
    each = numbered.select("source", F.concat_ws(":", "key", "digest", F.col("nth").cast("string")).alias("key"), "row")
    return rows.join(several, same, "left_anti").unionByName(each)


def mix(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) repeated to the target weights, with
    ``copy`` (from 1) and ``shuffle_key``, dealt and sorted by the latter."""
    rates = cut_table(source_rates(docs.select("source", "text"), weights, alpha), "mix_rates")
    small = rates.count() <= BROADCAST_SOURCES  # beyond it, a shuffled join whose hot source AQE splits
    rows = keyed(docs)
    chances = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda k: uniform(F.lit(seed), F.col("key"), k.cast("string")))
    n = F.aggregate(chances, F.lit(0), lambda a, u: a + F.size(F.filter(F.col("cdf"), lambda c: c <= u)))
    drawn = rows.join(F.broadcast(rates) if small else rates, F.col("source").eqNullSafe(F.col("r_source"))).select("row", "key", n.alias("n")).where("n > 0")
    copies = drawn.select("row", "key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    dealt = copies.select("row", "copy", F.md5(F.concat_ws(":", F.lit(seed), F.col("key"), F.col("copy").cast("string"), F.lit("order"))).alias("shuffle_key"))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("copy", "shuffle_key")]
    return dealt.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select(*kept, "copy", "shuffle_key")
