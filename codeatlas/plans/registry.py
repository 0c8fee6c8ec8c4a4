"""Tables derived from input files, kept as long as the inputs stay the same.

An entry is keyed by what was asked for and carries a manifest of its inputs:
number of files, bytes, latest modification and a sum over (name, size, time).
The manifest is taken anew at every use, by listing alone; where it differs, the
entry is built again and the tables that the old one had written are removed.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_ENTRIES: dict[tuple, tuple[tuple, Any]] = {}


def manifest(spark: SparkSession, *paths: str) -> tuple:
    """(files, bytes, latest change, sum over names, sizes and times), by one job
    over the listing; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length", "modificationTime")
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return tuple(files.agg(F.count("*"), F.sum("length"), F.max(F.col("modificationTime").cast("double")), F.sum(mark)).first())


def derived(spark: SparkSession, name: str, paths: list[str], build: Callable[[], Any]) -> Any:
    """What ``build`` made of the files under ``paths``, built again if they have
    changed. It may have ``tables``, folders that it wrote: these go with it."""
    key = (spark.sparkContext.applicationId, name, *paths)
    now = manifest(spark, *paths)
    held = _ENTRIES.get(key)
    if held is None or held[0] != now:
        if held is not None:
            remove(spark, getattr(held[1], "tables", []))
        held = _ENTRIES[key] = (now, build())
    return held[1]


def remove(spark: SparkSession, tables: list[str]) -> None:
    """Delete written tables: folders on any file system, or catalog tables."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    for table in tables:
        if "/" not in table:
            found = [r.col_name for r in spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Location'").selectExpr("data_type AS col_name").collect()]
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            remove(spark, found)
            continue
        path = hadoop(table)
        path.getFileSystem(conf).delete(path, True)
    tables.clear()


def clear(spark: SparkSession) -> None:
    """Remove all derived tables of the session."""
    for key in [k for k in _ENTRIES if k[0] == spark.sparkContext.applicationId]:
        remove(spark, getattr(_ENTRIES.pop(key)[1], "tables", []))
