"""Project rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def project_services(services: DataFrame) -> DataFrame:
    """C4. One row per (project, service name): ordered by the first script
    (path order) that uses it; name/library/icon from the last such script."""
    g = services.groupBy("project_id", "name").agg(
        F.min(F.struct("path", "pos")).alias("first"),
        F.max_by(F.struct("library", "icon"), F.struct("path", "pos")).alias("last"))
    w = Window.partitionBy("project_id").orderBy("first")
    return g.select("project_id", (F.row_number().over(w) - 1).cast("int").alias("pos"), "name",
                    F.col("last.library").alias("library"), F.col("last.icon").alias("icon"))


def project_secrets(secrets: DataFrame) -> DataFrame:
    """C5. Sorted distinct secrets per project."""
    return secrets.select("project_id", "secret").distinct()


def project_entry_points(scripts: DataFrame) -> DataFrame:
    """C6. (project_id, path) of scripts with a main guard."""
    return scripts.where(F.col("is_entry_point")).select("project_id", "path")


def project_inventory(scripts: DataFrame, services: DataFrame, secrets: DataFrame,
                      connections: DataFrame | None = None) -> DataFrame:
    """C7. Header counts per project: scripts, services, secrets, entry points."""
    sc = scripts.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_scripts"),
        F.count_if(F.col("is_entry_point")).alias("n_entry_points"))
    sv = project_services(services).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_services"))
    se = project_secrets(secrets).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_secrets"))
    out = sc.join(sv, "project_id", "left").join(se, "project_id", "left")
    if connections is not None:
        cn = connections.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_connections"))
        out = out.join(cn, "project_id", "left")
    return out.fillna(0)
