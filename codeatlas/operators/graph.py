"""H1–H8: importance, ranking, and node/edge datasets for project and script graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas import rules as R
from codeatlas.functions import labels as L
from codeatlas.operators.numbering import numbered

EM = "—"


def importance(scripts: DataFrame, services: DataFrame, steps: DataFrame, degrees: DataFrame) -> DataFrame:
    """H1. edges touching the script (a self edge counts twice) + 2 if entry
    point + services + min(steps // 20, 5). ``degrees`` (project_id, path,
    degree) comes from ``links.degrees`` or ``links.edge_degrees``."""
    deg = degrees.select("project_id", "path", "degree")
    nsv = services.groupBy("project_id", "path").agg(F.count(F.lit(1)).alias("n_services"))
    nst = steps.groupBy("project_id", "path").agg(F.count(F.lit(1)).alias("n_steps"))
    s = (scripts.select("project_id", "path", "is_entry_point")
         .join(deg, ["project_id", "path"], "left")
         .join(nsv, ["project_id", "path"], "left")
         .join(nst, ["project_id", "path"], "left")
         .fillna(0, ["degree", "n_services", "n_steps"]))
    score = (F.col("degree") + F.when(F.col("is_entry_point"), 2).otherwise(0) + F.col("n_services")
             + F.least(F.floor(F.col("n_steps") / R.STEP_BONUS_PER), F.lit(R.STEP_BONUS_CAP)))
    return s.select("project_id", "path", F.col("degree").cast("long").alias("degree"),
                    F.col("n_services").cast("long").alias("n_services"),
                    F.col("n_steps").cast("long").alias("n_steps"), "is_entry_point",
                    score.cast("long").alias("score"))


def ranking(importance_df: DataFrame) -> DataFrame:
    """H2. Rank by score desc (ties in path order); the top max(1, n // 3) are key."""
    ranked = numbered(importance_df, "project_id", [F.desc("score"), F.asc("path")], "ranking")
    return ranked.select(
        "project_id", "path", "score", F.col("nth").cast("long").alias("rank"),
        (F.col("nth") <= F.greatest(F.lit(1), F.floor(F.col("of") / R.KEY_SCRIPT_DIVISOR))).alias("is_key"))


def graph_nodes(scripts: DataFrame) -> DataFrame:
    """H3. One node per script: file name, directory group (kept when the
    directory is not the root and the project spans more than one directory),
    entry flag."""
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    s = scripts.select("project_id", "path", "is_entry_point", parent.alias("dir"))
    dirs = s.groupBy("project_id").agg((F.min("dir") != F.max("dir")).alias("several"))
    return (s.join(dirs, "project_id")
            .select("project_id", "path", F.substring_index("path", "/", -1).alias("name"),
                    F.when((F.col("dir") != "") & F.col("several"), F.col("dir")).alias("group"),
                    "is_entry_point"))


def graph_edges(conns: DataFrame) -> DataFrame:
    """H4. Edges with technical type and business verb."""
    return conns.select("project_id", "source", "target", "type",
                        L.translate_connection(F.col("type")).alias("verb"), "pos")


def _prefix(step_type: Column) -> Column:
    out = F.lit("")
    for typ, _b, _t, _s, prefix, _c in R.TYPE_LABELS:
        out = F.when(step_type == typ, F.lit(prefix)).otherwise(out)
    return out


def flow_nodes(steps: DataFrame) -> DataFrame:
    """H5. One node per step, grouped by function (``_module_`` at top level),
    technical label (type prefix + description) and business label (E1), both
    in full: cutting them is up to what renders them."""
    s = L.with_label(steps)
    return s.select("project_id", "path", "pos", "line_number", "type",
                    F.coalesce("function_name", F.lit("_module_")).alias("function"),
                    F.concat(_prefix(F.col("type")), F.col("description")).alias("label_tech"),
                    F.col("label").alias("label_biz"))


def flow_edges(steps: DataFrame) -> DataFrame:
    """H6. Consecutive steps within the same function."""
    fn = F.coalesce("function_name", F.lit("_module_"))
    w = Window.partitionBy("project_id", "path", "function").orderBy("pos")
    s = steps.select("project_id", "path", "pos", fn.alias("function"))
    return (s.withColumn("next_pos", F.lead("pos").over(w)).where(F.col("next_pos").isNotNull())
            .select("project_id", "path", "function", F.col("pos").alias("src_pos"),
                    F.col("next_pos").alias("dst_pos")))


def flow_compact(steps: DataFrame, threshold: int = R.COMPACT_THRESHOLD) -> DataFrame:
    """H7. Named functions with more than ``threshold`` steps collapse into one
    node labelled with the top four step types by count (ties: first seen)."""
    named = steps.where(F.col("function_name").isNotNull())
    per_type = named.groupBy("project_id", "path", "function_name", "type").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    wf = Window.partitionBy("project_id", "path", "function_name")
    ranked = (per_type
              .withColumn("total", F.sum("n").over(wf))
              .withColumn("n_types", F.count(F.lit(1)).over(wf))
              .withColumn("rk", F.row_number().over(wf.orderBy(F.desc("n"), F.asc("first_pos"))))
              .where(F.col("total") > threshold))
    tech, biz = F.col("type"), F.col("type")
    for typ, b, _t, _s, _p, compact in R.TYPE_LABELS:
        tech = F.when(F.col("type") == typ, F.lit(compact)).otherwise(tech)
        biz = F.when(F.col("type") == typ, F.lit(b)).otherwise(biz)
    top = ranked.where(F.col("rk") <= R.COMPACT_TOP_TYPES)
    g = top.groupBy("project_id", "path", "function_name", "total", "n_types").agg(
        F.array_sort(F.collect_list(F.struct("rk", F.concat(F.col("n").cast("string"), F.lit(" "), tech).alias("t"),
                                             F.concat(F.col("n").cast("string"), F.lit(" "), biz).alias("b"))))
        .alias("parts"))
    more = F.when(F.col("n_types") > R.COMPACT_TOP_TYPES,
                  F.concat(F.lit(", +"), (F.col("n_types") - R.COMPACT_TOP_TYPES).cast("string"), F.lit(" more"))) \
        .otherwise(F.lit(""))
    summary_t = F.concat(F.array_join(F.transform("parts", lambda p: p["t"]), ", "), more)
    summary_b = F.concat(F.array_join(F.transform("parts", lambda p: p["b"]), ", "), more)
    head = F.concat(F.lit(f" {EM} "), F.col("total").cast("string"), F.lit(" steps ("))
    return g.select("project_id", "path", F.col("function_name").alias("function"),
                    F.col("total").cast("long").alias("n_steps"),
                    F.concat(F.col("function_name"), F.lit("()"), head, summary_t, F.lit(")")).alias("label_tech"),
                    F.concat(F.col("function_name"), head, summary_b, F.lit(")")).alias("label_biz"))


def _outside_collapsed(steps: DataFrame, threshold: int) -> DataFrame:
    """Steps that are not inside a function that collapses."""
    long = (steps.where(F.col("function_name").isNotNull()).groupBy("project_id", "path", "function_name")
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > threshold).drop("n"))
    return steps.join(long, ["project_id", "path", "function_name"], "left_anti").select(*steps.columns)


def compact_nodes(steps: DataFrame, threshold: int = R.COMPACT_THRESHOLD) -> DataFrame:
    """H7. Nodes of the compact view: one for each collapsed function (``pos``
    null) and one for each step outside them."""
    folded = flow_compact(steps, threshold).select(
        "project_id", "path", "function", F.lit(None).cast("int").alias("pos"), "n_steps", "label_tech", "label_biz")
    single = flow_nodes(_outside_collapsed(steps, threshold)).select(
        "project_id", "path", "function", "pos", F.lit(1).cast("long").alias("n_steps"), "label_tech", "label_biz")
    return folded.unionByName(single)


def compact_edges(steps: DataFrame, threshold: int = R.COMPACT_THRESHOLD) -> DataFrame:
    """H7. Edges of the compact view: those inside functions that stay open."""
    return flow_edges(_outside_collapsed(steps, threshold))


def phase_pipeline(steps: DataFrame) -> DataFrame:
    """H8. Phases present, in order, with counts and the next present phase."""
    s = L.with_phase(steps)
    g = s.groupBy("project_id", "path", "phase", "phase_label", "phase_ord").agg(F.count(F.lit(1)).alias("n_steps"))
    w = Window.partitionBy("project_id", "path").orderBy("phase_ord")
    return g.select("project_id", "path", "phase", "phase_label", "phase_ord",
                    F.col("n_steps").cast("long").alias("n_steps"),
                    F.concat(F.col("n_steps").cast("string"),
                             F.when(F.col("n_steps") == 1, F.lit(" step")).otherwise(F.lit(" steps"))).alias("caption"),
                    F.lead("phase").over(w).alias("next_phase"))
