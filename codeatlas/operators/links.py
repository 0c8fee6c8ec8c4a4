"""Cross-script connections as edge joins.

Import and file edges are equi joins on ``project_id`` plus a key (module stem,
file path); launch edges come from one search of each description for all paths.
Scripts are never compared pair by pair, and file edges are stored by file:
pairs of writers and readers are made only where they are asked for.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.operators.numbering import numbered
from codeatlas.session import cut_table

try:  # workers need no install of the package
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # pragma: no cover
    pass

PATH_MAX = 256           # longer strings are not taken as file paths


def file_stem(path: Column) -> Column:
    """PurePath(path).stem: last component without its last suffix."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]+$", "$1")


def module_map(scripts: DataFrame) -> DataFrame:
    """D1. (project_id, stem, target): duplicate stems -> last path (sorted) wins."""
    return (scripts.select("project_id", "path", file_stem(F.col("path")).alias("stem"))
            .groupBy("project_id", "stem").agg(F.max("path").alias("target")))


def import_edges(scripts: DataFrame, imports_df: DataFrame) -> DataFrame:
    """D2. Internal import's top segment -> script with that stem; no self edge."""
    internal = (imports_df.where(F.col("is_internal"))
                .select("project_id", F.col("path").alias("source"), "import",
                        F.split_part("import", F.lit("."), F.lit(1)).alias("stem")))
    e = internal.join(module_map(scripts), ["project_id", "stem"]).where(F.col("source") != F.col("target"))
    return e.select("project_id", "source", "target", F.lit("import").alias("type"),
                    F.concat("source", F.lit(" imports from "), "target").alias("detail"),
                    F.struct(F.lit(0).alias("k"), F.col("import").alias("a"), F.lit(0).alias("b"),
                             F.col("target").alias("c")).alias("ord"))


def looks_like_file_path(p: Column, longest: int = PATH_MAX) -> Column:
    """D3. Not a URL, at most ``longest`` chars, ends in '.' + 1-6 alphanumerics."""
    return (~p.startswith("http")) & (F.length(p) <= longest) & p.rlike(r"(?sU)^.*\.[\p{L}\p{N}]{1,6}\z")


def file_sets(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D4. (project_id, path, file) reads and writes from file_io steps.

    Fallback when a step has neither inputs nor outputs and its description
    holds ``open(``: the text between the first and last single quote is a read.
    """
    fio = steps.where(F.col("type") == "file_io")
    reads = fio.select("project_id", "path", F.explode("inputs").alias("file")) \
        .where(looks_like_file_path(F.col("file")))
    writes = fio.select("project_id", "path", F.explode("outputs").alias("file")) \
        .where(looks_like_file_path(F.col("file")))
    bare = fio.where((F.size("inputs") == 0) & (F.size("outputs") == 0)
                     & F.col("description").contains("open(")
                     & (F.instr("description", "'") > 0)
                     & (F.length("description") - F.instr(F.reverse("description"), "'") + 1
                        > F.instr("description", "'")))
    fallback = bare.select("project_id", "path",
                           F.regexp_extract("description", r"(?s)'(.*)'", 1).alias("file"))
    return reads.unionByName(fallback).distinct(), writes.distinct()


def factored_file_edges(steps: DataFrame) -> DataFrame:
    """D5, stored form: (project_id, file, path, side), one row for each script
    that writes (side ``w``) or reads (``r``) a file which some script reads and
    some script writes. As many rows as uses of files, not pairs of scripts."""
    reads, writes = file_sets(steps)
    uses = (writes.select("project_id", "file", "path", F.lit("w").alias("side"))
            .unionByName(reads.select("project_id", "file", "path", F.lit("r").alias("side"))))
    both = uses.groupBy("project_id", "file").agg((F.min("side") != F.max("side")).alias("both")).where("both").select("project_id", "file")
    return uses.join(both, ["project_id", "file"], "left_semi")


def file_nodes(factored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scripts that write the same files and read the same files are one node:
    (project_id, path, node), and (project_id, node, writes, reads, n) with the
    node's number of scripts."""
    def files(side: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("file"))))

    per_script = (factored.groupBy("project_id", "path").agg(files("w").alias("writes"), files("r").alias("reads"))
                  .withColumn("node", F.sha2(F.to_json(F.struct("writes", "reads")), 256)))
    per_script = cut_table(per_script, "file_nodes")
    nodes = per_script.groupBy("project_id", "node").agg(F.any_value("writes").alias("writes"), F.any_value("reads").alias("reads"), F.count("*").alias("n"))
    return per_script.select("project_id", "path", "node"), nodes


def node_pairs(nodes: DataFrame) -> DataFrame:
    """(project_id, writer, reader, file): nodes of which one writes what the
    other reads, and the smallest such file."""
    writers = nodes.select("project_id", F.col("node").alias("writer"), F.explode("writes").alias("file"))
    readers = nodes.select("project_id", F.col("node").alias("reader"), F.explode("reads").alias("file"))
    return writers.join(readers, ["project_id", "file"]).groupBy("project_id", "writer", "reader").agg(F.min("file").alias("file"))


def file_degrees(steps: DataFrame, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(project_id, path, degree): file edges that touch each script, counted
    between nodes by their sizes; no pair of single scripts is made. ``known``:
    the steps' ``file_nodes``, if they are at hand."""
    members, nodes = known or file_nodes(factored_file_edges(steps))
    size = nodes.select("project_id", "node", "n")
    pairs = cut_table(node_pairs(nodes), "node_pairs")

    def side(mine: str, other: str) -> DataFrame:
        """A script's partners are all scripts of the other nodes, itself left out."""
        partners = F.sum(F.col("n") - (F.col("writer") == F.col("reader")).cast("int"))
        return (pairs.join(size.withColumnRenamed("node", other), ["project_id", other])
                .groupBy("project_id", F.col(mine).alias("node")).agg(partners.alias("degree")))

    per_node = side("writer", "reader").unionByName(side("reader", "writer")).groupBy("project_id", "node").agg(F.sum("degree").alias("degree"))
    return members.join(per_node, ["project_id", "node"]).select("project_id", "path", "degree")


def file_edges(steps: DataFrame, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """D5, expanded: writer -> reader of the same file string; the kept detail
    names the smallest shared file, found once for each pair of nodes."""
    members, nodes = known or file_nodes(factored_file_edges(steps))
    sources = members.select("project_id", F.col("node").alias("writer"), F.col("path").alias("source"))
    targets = members.select("project_id", F.col("node").alias("reader"), F.col("path").alias("target"))
    e = (node_pairs(nodes).join(sources, ["project_id", "writer"]).join(targets, ["project_id", "reader"])
         .where(F.col("source") != F.col("target")))
    return e.select("project_id", "source", "target", F.lit("file_io").alias("type"),
                    F.concat("source", F.lit(" writes "), "file").alias("detail"),
                    F.struct(F.lit(1).alias("k"), F.col("target").alias("a"), F.lit(0).alias("b"),
                             F.col("file").alias("c")).alias("ord"))


SHARD_PATHS = 65_536     # paths of one automaton
SLICE_TEXTS = 100_000    # descriptions that one task searches for a shard

_HITS = "project_id string, source string, target string, pos int"


def _searched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (project_id, shard, slice, asks): a shard's paths, then the
    descriptions to search. Each description is read once."""
    import ahocorasick
    key, paths = None, None
    for batch in it:
        out = []
        for project, shard, part, asks, text, source, pos in zip(*(c.to_pylist() for c in batch.columns)):
            if (project, shard, part) != key:
                key, paths = (project, shard, part), ahocorasick.Automaton()
            if not asks:
                paths.add_word(text, text)
            elif len(paths):
                if paths.kind != ahocorasick.AHOCORASICK:
                    paths.make_automaton()
                out.extend((project, source, target, pos) for target in {found for _, found in paths.iter(text)})
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int32()))],
                                             names=["project_id", "source", "target", "pos"])


def launch_edges(scripts: DataFrame, steps: DataFrame) -> DataFrame:
    """D6. api_call step whose description contains a script path -> subprocess edge.

    The paths of a project form automata of at most about SHARD_PATHS paths each;
    a description runs through each of them once, in time linear in its length.
    Descriptions of a project are dealt into slices of about SLICE_TEXTS, so a
    project of any size spreads over tasks, each with one automaton at a time.
    """
    api = steps.where((F.col("type") == "api_call") & (F.col("description") != "")).select(
        "project_id", F.col("path").alias("source"), "pos", "description")
    targets = scripts.select("project_id", F.col("path").alias("target")).where(F.col("target") != "")
    shards = targets.groupBy("project_id").agg(F.ceil(F.count("*") / SHARD_PATHS).cast("int").alias("shards"))
    slices = api.groupBy("project_id").agg(F.ceil(F.count("*") / SLICE_TEXTS).cast("int").alias("slices"))
    sizes = shards.join(slices, "project_id")

    def numbers(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    key = ["project_id", "shard", "slice"]
    patterns = (targets.join(sizes, "project_id").select("project_id", F.pmod(F.xxhash64("target"), "shards").cast("int").alias("shard"), numbers("slices").alias("slice"),
                                                         F.lit(False).alias("asks"), F.col("target").alias("text"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("pos")))
    texts = (api.join(sizes, "project_id").select("project_id", numbers("shards").alias("shard"), F.pmod(F.xxhash64("source", "pos"), "slices").cast("int").alias("slice"),
                                                  F.lit(True).alias("asks"), F.col("description").alias("text"), "source", F.col("pos").cast("int").alias("pos")))
    hits = patterns.unionByName(texts).repartition(*key).sortWithinPartitions(*key, "asks").mapInArrow(_searched, _HITS)
    return hits.groupBy("project_id", "source", "target").agg(F.min("pos").alias("pos")).select(
        "project_id", "source", "target", F.lit("subprocess").alias("type"),
        F.concat("source", F.lit(" runs "), "target", F.lit(" via subprocess")).alias("detail"),
        F.struct(F.lit(2).alias("k"), F.lit("").alias("a"), F.col("pos").alias("b"),
                 F.col("target").alias("c")).alias("ord"))


def degrees(scripts: DataFrame, imports_df: DataFrame, steps: DataFrame, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(project_id, path, degree): how many connections (D7) touch each script, a
    self edge twice, without the pairs of writers and readers."""
    pairs = (import_edges(scripts, imports_df).select("project_id", "source", "target", "type")
             .unionByName(launch_edges(scripts, steps).select("project_id", "source", "target", "type")).distinct())
    return (edge_degrees(pairs).unionByName(file_degrees(steps, known)).groupBy("project_id", "path").agg(F.sum("degree").alias("degree")))


def edge_degrees(edges: DataFrame) -> DataFrame:
    """(project_id, path, degree) of an edge table (project_id, source, target)."""
    return (edges.select("project_id", F.explode(F.array("source", "target")).alias("path"))
            .groupBy("project_id", "path").agg(F.count(F.lit(1)).alias("degree")))


def connections(scripts: DataFrame, imports_df: DataFrame, steps: DataFrame, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """D7. Union of edge kinds, first per (source, target, type), numbered in the
    order they are discovered (per source script: imports, files, launches)."""
    allv = (import_edges(scripts, imports_df)
            .unionByName(file_edges(steps, known))
            .unionByName(launch_edges(scripts, steps)))
    first = (allv.groupBy("project_id", "source", "target", "type")
             .agg(F.min_by("detail", "ord").alias("detail"), F.min("ord").alias("ord")))
    order = [F.col("source"), F.col("ord"), F.col("target"), F.col("type")]
    return numbered(first, "project_id", order, "connections").select(
        "project_id", "source", "target", "type", "detail", (F.col("nth") - 1).cast("int").alias("pos"))
