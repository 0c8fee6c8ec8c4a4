"""A1, A2, A5: source trees on any file system that ``pyarrow.fs`` opens.

Layout: ``<root>/<project_id>/<relative path>`` (files directly under the root
form the project ``''``). Folders are listed level by level in tasks, each once
and with hidden and ``_`` names, into a table with one row a file; a folder that
must not be read becomes a row with an ``error``. Contents are read in the tasks
that parse them: the listed rows are dealt into bins of about the bytes that
Spark would read in a task, so many small files spread and a large one has a
task of its own. Only listings are shuffled.
"""

from __future__ import annotations

import hashlib
import os
import sys
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas import rules as R
from codeatlas.operators.numbering import in_bins
from codeatlas.session import cut_table

try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # pragma: no cover
    pass

ENTRIES = "uri string, project_id string, path string, is_dir boolean, length long, error string"
_READ_BYTES = 16 << 20  # contents that a task holds at a time, or one larger file


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a place named as Spark names it."""
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri.removeprefix("file:")


def _kept_folder(store: pafs.FileSystem, path: str, name: str, in_project: bool) -> bool:
    if in_project and (name in R.SKIP_DIRS or name.startswith(".")):
        return False
    # a link to a folder above itself would be listed without end
    return not (isinstance(store, pafs.LocalFileSystem) and os.path.islink(path)
                and (os.path.realpath(os.path.dirname(path)) + "/").startswith(os.path.realpath(path) + "/"))


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["uri", "project_id", "path", "is_dir", "length", "error"])


def _children(root: str):
    """Entries of each listed folder: subfolders to list next and ``.py`` files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(root)
        for batch in batches:
            for folder in batch.to_pylist():
                try:
                    found = store.get_file_info(pafs.FileSelector(folder["uri"]))
                except (PermissionError, FileNotFoundError, NotADirectoryError) as exc:
                    # lasting; any other failure of the storage stops the task, which is tried again
                    yield _entries([(folder["uri"], folder["project_id"] or "", folder["path"], False, None, type(exc).__name__)])
                    continue
                rows = []
                for e in sorted(found, key=lambda e: e.base_name):
                    if e.type == pafs.FileType.Directory:
                        if _kept_folder(store, e.path, e.base_name, folder["project_id"] is not None):
                            project = e.base_name if folder["project_id"] is None else folder["project_id"]
                            rows.append((e.path, project, "" if folder["project_id"] is None else folder["path"] + e.base_name + "/", True, None, None))
                    elif e.type == pafs.FileType.File and os.path.splitext(e.base_name)[1] == ".py":
                        rows.append((e.path, folder["project_id"] or "", folder["path"] + e.base_name, False, e.size, None))
                if rows:
                    yield _entries(rows)
    return run


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(uri, project_id, path, length, error) of every ``.py`` file under ``root``
    but for skipped and hidden folders (empty ``__init__.py`` included; see
    ``scan``). A folder that can't be read is one row with its ``error`` and the
    folder as path (ending in ``/``), without length. A missing root has no files; a root that can't be reached raises.
    A single ``.py`` file is listed with its folder as the project."""
    store, path = filesystem(root.rstrip("/"))
    info = store.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        return spark.createDataFrame([], ENTRIES).drop("is_dir")
    if info.type == pafs.FileType.File:
        project = os.path.basename(os.path.dirname(path))
        return spark.createDataFrame([(path, project, info.base_name, False, info.size, None)], ENTRIES).drop("is_dir")
    return _listed(spark, root, [(path, None, "", True, None, None)])


def _listed(spark: SparkSession, root: str, start: list[tuple]) -> DataFrame:
    level, n, levels = spark.createDataFrame(start, ENTRIES), len(start), []
    while n:
        # listing waits for the storage, not for bytes: many folders to a level are many tasks
        tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
        found = cut_table(level.repartition(tasks, "uri").mapInArrow(_children(root), ENTRIES), "listing")
        levels.append(found.where(~F.col("is_dir")))
        level = found.where("is_dir")
        n = level.count()
    return reduce(DataFrame.unionByName, levels).drop("is_dir")


def module_scope(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """Files whose names are local modules: the listing itself, and for a single
    file all of its folder."""
    if not root.endswith(".py"):
        return files.where("error is null")
    _, path = filesystem(root)
    folder = os.path.dirname(path)
    return _listed(spark, root, [(folder, os.path.basename(folder), "", True, None, None)]).where("error is null")


def scan(spark: SparkSession, root: str, files: DataFrame | None = None, max_file_size: int | None = R.MAX_FILE_SIZE) -> DataFrame:
    """A1 + A2. Scripts to analyse: the listing without empty ``__init__.py``,
    with an admission status: ``unreadable`` for a folder that can't be read,
    ``too_large`` above ``max_file_size`` bytes (None: no limit), else ``ok``
    (decode and syntax errors surface as error facts)."""
    lst = listing(spark, root) if files is None else files
    name = F.substring_index("path", "/", -1)
    lst = lst.where(~((name == "__init__.py") & F.coalesce(F.col("length") == 0, F.lit(False))))
    large = F.lit(False) if max_file_size is None else F.col("length") > max_file_size
    return lst.withColumn("status", F.when(F.col("error").isNotNull(), F.lit("unreadable")).when(large, F.lit("too_large")).otherwise(F.lit("ok")))


def _read(store: pafs.FileSystem, uri: str) -> bytes | None:
    """Bytes of a file; None where it can't be read for good (any other failure
    of the storage stops the task, which is tried again)."""
    try:
        with store.open_input_stream(uri, compression=None) as f:
            return f.read()
    except (PermissionError, FileNotFoundError, IsADirectoryError):
        return None


def _digests(root: str):
    """Listed files with the SHA-256 of their content (``none`` if unreadable)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(root)
        for batch in batches:
            marks = ["none" if data is None else hashlib.sha256(data).hexdigest() for data in map(partial(_read, store), batch.column("uri").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.string())], names=[*batch.schema.names, "digest"])
    return run


def _contents(root: str):
    """(digest, content) of the listed files; at most about _READ_BYTES are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(root)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            a, b = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.binary())], ["digest", "content"])

        held, size = [], 0
        for batch in batches:
            for digest, uri in zip(batch.column("digest").to_pylist(), batch.column("uri").to_pylist()):
                data = _read(store, uri)
                held.append((digest, data))
                size += len(data or b"")
                if size >= _READ_BYTES:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)
    return run


def _byte_setting(spark: SparkSession, name: str) -> int:
    """A size setting of the session in bytes (b, k, m, g, t units)."""
    text = spark.conf.get(name).strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(text[-1:], 0)
    return int(text[:-1] if unit else text) << unit


def dealt(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``files`` (..., length) in partitions of about equal bytes, sized as Spark
    sizes its own file tasks: ``spark.sql.files.maxPartitionBytes``, less where
    all cores would not be busy; each file also counts for
    ``spark.sql.files.openCostInBytes``, a larger one is alone. The number of
    partitions is explicit, so adaptive execution leaves them as they are."""
    most, opening = (_byte_setting(spark, f"spark.sql.files.{n}") for n in ("maxPartitionBytes", "openCostInBytes"))
    weight = F.coalesce("length", F.lit(0)) + F.lit(opening)
    total = files.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    target = max(1, min(most, max(opening, -(-total // spark.sparkContext.defaultParallelism))))
    placed, n = in_bins(files, weight, target, "files")
    return placed.repartitionById(n, "bin").drop("bin")


def hashed(spark: SparkSession, root: str, scanned: DataFrame) -> DataFrame:
    """(uri, project_id, path, length, digest) of the admitted scripts, written:
    one pass that reads every file, dealt over the tasks by bytes."""
    files = scanned.where("status = 'ok'").select("uri", "project_id", "path", "length")
    schema = "uri string, project_id string, path string, length long, digest string"
    return cut_table(dealt(spark, files).select("uri", "project_id", "path", "length").mapInArrow(_digests(root), schema), "hashed")


def distinct_contents(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(digest, content), each content of ``hashed`` files once: representatives
    are dealt by bytes and read where they are parsed."""
    once = files.groupBy("digest").agg(F.min(F.struct("uri", "length")).alias("x")).select("digest", "x.uri", "x.length")
    return dealt(spark, once).select("digest", "uri").mapInArrow(_contents(root), "digest string, content binary")


def modules_from_listing(lst: DataFrame) -> DataFrame:
    """A5 over a pruned listing (empty ``__init__.py`` included)."""
    from codeatlas.operators.extract import local_modules
    return local_modules(lst.where("error is null").select("project_id", "path"))


# --------------------------------------------------------------------------
# writing a source tree (tests and the events-derived corpus)
# --------------------------------------------------------------------------

def _write_rows(root: str):
    def write(rows):
        store, base = filesystem(root)
        for r in rows:
            target = f"{base}/{r['project_id']}/{r['path']}"
            store.create_dir(os.path.dirname(target), recursive=True)
            with store.open_output_stream(target, compression=None) as f:
                f.write(r["content"].encode("utf-8"))
    return write


def write_tree(files: DataFrame, root: str) -> None:
    """Write ``(project_id, path, content)`` rows as files under ``root``, a
    folder that all executors share."""
    files.select("project_id", "path", "content").foreachPartition(_write_rows(root))


TREE_EXTRAS = (("d0/__init__.py", ""), ("pkg/__init__.py", "VERSION = 1\n"),
               ("__pycache__/cached.py", "x = 1\n"), (".hidden/secret.py", "x = 1\n"),
               ("build/gen.py", "x = 1\n"), ("d1/.venv/lib.py", "x = 1\n"), ("notes.txt", "not python\n"))


def tree_extras(projects: DataFrame) -> DataFrame:
    """Per project, files that exercise the listing rules: an empty package
    marker (module name only), a package with code, and files that pruning
    or the glob must drop."""
    items = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in TREE_EXTRAS])
    return (projects.select("project_id").distinct()
            .select("project_id", F.explode(items).alias("x"))
            .select("project_id", F.col("x.path").alias("path"), F.col("x.content").alias("content")))
