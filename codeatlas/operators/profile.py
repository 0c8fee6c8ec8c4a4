"""F1–F8: phase grouping, dedupe groups, pattern insights, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas import rules as R
from codeatlas.functions import labels as L

EM = "—"
RSQUO = "’"


def phase_groups(steps: DataFrame) -> DataFrame:
    """F1 + F4 + F5. One row per (script, phase present): label, order, count,
    integer share ``count*100 // total``, whether the share is shown (>40) and
    the short chip label (first word of the phase label)."""
    s = L.with_phase(steps)
    g = s.groupBy("project_id", "path", "phase", "phase_label", "phase_ord").agg(
        F.count(F.lit(1)).alias("n_steps"), F.min("pos").alias("first_pos"))
    total = F.sum("n_steps").over(Window.partitionBy("project_id", "path"))
    chip = F.split_part(F.split_part("phase_label", F.lit(" & "), F.lit(1)), F.lit(" "), F.lit(1))
    return g.select("project_id", "path", "phase", "phase_label", "phase_ord", "n_steps", "first_pos",
                    total.alias("total"),
                    F.floor(F.col("n_steps") * 100 / total).cast("long").alias("pct"),
                    chip.alias("chip")) \
        .withColumn("pct_shown", F.col("pct") > R.PHASE_SHARE_SHOWN)


def dedupe_groups(steps: DataFrame, by_phase: bool = False) -> DataFrame:
    """F2. Steps grouped by translated text, in first-occurrence order.

    (project_id, path[, phase], label, n, first_pos, first_type, lines) — ``lines``
    is the comma-joined line numbers in step order.
    """
    s = L.with_labels(steps) if by_phase else L.with_label(steps)
    keys = ["project_id", "path"] + (["phase", "phase_ord"] if by_phase else []) + ["label"]
    return s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"),
        F.min_by("type", "pos").alias("first_type"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line_number"))),
                                 lambda x: x["line_number"].cast("string")), ",").alias("lines"))


def explain_pattern(label: Column, n: Column, first_type: Column) -> Column:
    """F3. Teaching insight for a dedupe group with n > 1."""
    dl = F.lower(label)
    ns = n.cast("string")

    def after_first(sep: str) -> Column:
        return F.substring(label, F.instr(label, sep) + len(sep), 1 << 30)

    low = F.lower(label)
    svc_from = F.when(label.contains("from "), after_first("from ")).otherwise(F.lit("service"))
    svc_upd = (F.when(low.contains("to "), F.when(label.contains("to "), after_first("to ")).otherwise(label))
               .when(low.contains("on "), F.when(label.contains("on "), after_first("on ")).otherwise(label))
               .otherwise(F.lit("service")))
    fallback_label = F.coalesce(L.business_label(first_type), L.capitalize(F.translate(first_type, "_", " ")))
    return (
        F.when(dl.contains("displays message") & (n > R.PRINT_EXCESS),
               F.concat(F.lit(f"Excessive output {EM} "), ns,
                        F.lit(f" print() calls; consider Python{RSQUO}s logging module for structured output")))
        .when(dl.contains("displays message"),
              F.concat(F.lit(f"Status logging {EM} tracks workflow progress across "), ns, F.lit(" checkpoints")))
        .when(dl.contains("records activity") | dl.contains("records a warning") | dl.contains("records an error")
              | dl.contains("produces output"),
              F.concat(F.lit(f"Status logging {EM} tracks workflow progress across "), ns, F.lit(" checkpoints")))
        .when(dl.contains("sends notification"),
              F.concat(F.lit(f"Notification system {EM} alerts stakeholders at "), ns, F.lit(" different stages")))
        .when(dl.contains("handles potential errors") & (n > R.TRY_EXCESS),
              F.concat(F.lit(f"Repetitive error handling {EM} "), ns,
                       F.lit(" identical try/except blocks suggest extracting a shared helper")))
        .when(dl.contains("handles potential errors"),
              F.lit(f"Defensive coding {EM} each operation is protected so one failure doesn{RSQUO}t crash the script"))
        .when(dl.contains("fetches data from"),
              F.concat(F.lit(f"Batch data gathering {EM} collects data from "),
                       svc_from,
                       F.lit(" in "), ns, F.lit(" requests")))
        .when(dl.contains("sends data to") | dl.contains("updates data on"),
              F.concat(F.lit(f"Batch updates {EM} pushes data to "), svc_upd, F.lit(" in "), ns, F.lit(" operations")))
        .when(dl.contains("authenticates with"),
              F.concat(F.lit(f"Multi-service authentication {EM} connects to "), ns, F.lit(" different services")))
        .when(dl.contains("saves to database"),
              F.concat(F.lit(f"Incremental storage {EM} saves results in "), ns,
                       F.lit(f" operations as they{RSQUO}re processed")))
        .when(dl.contains("queries database"),
              F.concat(F.lit(f"Multi-query retrieval {EM} retrieves different data sets in "), ns, F.lit(" queries")))
        .when(dl.contains("saves data to file"),
              F.concat(F.lit(f"Progressive file output {EM} writes data across "), ns, F.lit(" save operations")))
        .when(dl.contains("reads data from file"),
              F.concat(F.lit(f"Multi-source input {EM} loads data from "), ns, F.lit(" different reads")))
        .when(dl.contains("processes each") | dl.contains("repeats for each"),
              F.concat(F.lit(f"Iteration pattern {EM} "), ns, F.lit(" loops process data through multiple stages")))
        .when(dl.contains("checks:"),
              F.concat(F.lit(f"Validation logic {EM} verifies "), ns, F.lit(" conditions to ensure correct behavior")))
        .when(dl.contains("processes data") | dl.contains("builds a collection") | dl.contains("cleans up text")
              | dl.contains("sorts data") | dl.contains("converts data") | dl.contains("counts items")
              | dl.contains("splits text") | dl.contains("joins text"),
              F.concat(F.lit(f"Data pipeline {EM} transforms data through "), ns, F.lit(" processing steps")))
        .otherwise(F.concat(F.lit("Repeated "), fallback_label, F.lit(f" {EM} this pattern appears "), ns,
                            F.lit(" times across the script"))))


def pattern_insights(steps: DataFrame) -> DataFrame:
    """F3 on the script page grain: dedupe groups inside each phase with n > 1."""
    g = dedupe_groups(steps, by_phase=True).where(F.col("n") > 1)
    return g.select("project_id", "path", "phase", "label", "n", "first_pos",
                    explain_pattern(F.col("label"), F.col("n"), F.col("first_type")).alias("insight"))


def first_types(steps: DataFrame) -> DataFrame:
    """F6. First four distinct step types per script, in first-seen order."""
    firsts = steps.groupBy("project_id", "path", "type").agg(F.min("pos").alias("first_pos"))
    w = Window.partitionBy("project_id", "path").orderBy("first_pos")
    ranked = firsts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= R.FIRST_TYPES_SHOWN)
    short = F.col("type")
    for typ, _biz, _tech, sh, *_ in R.TYPE_LABELS:
        short = F.when(F.col("type") == typ, F.lit(sh)).otherwise(short)
    return ranked.select("project_id", "path", F.col("rank").cast("int").alias("rank"), "type",
                         short.alias("short"))


def credential_labels(project_secrets: DataFrame) -> DataFrame:
    """F7. Business labels of a project's secrets, deduplicated, first-seen over
    the sorted secret names."""
    lab = project_secrets.select("project_id", "secret", L.translate_secret(F.col("secret")).alias("label"))
    return lab.groupBy("project_id", "label").agg(F.min("secret").alias("first_secret"))


def step_display(steps: DataFrame, contextual: DataFrame | None = None) -> DataFrame:
    """F8. Display text per step: model-written text for its line if any, else E1."""
    s = L.with_label(steps)
    if contextual is not None:
        ctx = contextual.select("project_id", "path", F.col("line").alias("line_number"), F.col("text").alias("ctx"))
        s = s.join(ctx, ["project_id", "path", "line_number"], "left")
    else:
        s = s.withColumn("ctx", F.lit(None).cast("string"))
    return s.select("project_id", "path", "pos", "line_number", "type", "label",
                    F.coalesce("ctx", "label").alias("display"), F.col("ctx").isNotNull().alias("is_contextual"))
