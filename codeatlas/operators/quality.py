"""Quality findings and health, one aggregation pass per script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas import rules as R
from codeatlas.functions import labels as L
from codeatlas.operators.profile import dedupe_groups, phase_groups

RSQUO = "’"


def _counters() -> list[Column]:
    dl = F.lower(F.col("description"))
    out = F.col("type") == "output"
    is_try = (F.col("type") == "decision") & F.col("description").startswith("try/except")
    return [F.count(F.lit(1)).alias("total"),
            F.count_if(out & dl.contains("print")).alias("n_print"),
            F.count_if(out & (dl.contains("logger") | dl.contains("logging"))).alias("n_logger"),
            F.count_if(is_try).alias("n_try"),
            F.count_if(F.col("type").isin("api_call", "file_io", "db_op")).alias("n_io")]


def script_counts(steps: DataFrame) -> DataFrame:
    """Per-script counters used by G1, G3, G4 (one grouped pass)."""
    return steps.groupBy("project_id", "path").agg(*_counters())


def _finding(rule: int, sub: Column, fid: str, severity: str, title: Column, detail: Column, phase: Column, count: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), sub.cast("long").alias("sub"), F.lit(fid).alias("id"),
                    F.lit(severity).alias("severity"), title.alias("title"), detail.alias("detail"),
                    phase.cast("string").alias("phase"), count.cast("long").alias("count"))


def _emit(df: DataFrame, finding: Column) -> DataFrame:
    """Rows of the findings that are not null."""
    return df.select("project_id", "path", finding.alias("f")).where("f is not null").select("project_id", "path", "f.*")


def _print_spam() -> Column:
    detail = F.concat(F.col("n_print").cast("string"),
                      F.lit(f" print() calls found. Python{RSQUO}s logging module provides log levels, "
                            "timestamps, and configurable output."))
    return F.when((F.col("n_print") > R.PRINT_SPAM_MIN) & (F.col("n_logger") == 0), _finding(
        0, F.lit(0), "print_spam", "warning", F.lit("No logging framework"), detail, F.lit(None), F.col("n_print")))


def _dominant(phase: Column, label: Column, ord_: Column, n: Column, total: Column) -> Column:
    pct = F.floor(n / total * 100).cast("long")
    detail = F.concat(label, F.lit(" accounts for "), pct.cast("string"), F.lit("% of all steps ("), n.cast("string"),
                      F.lit("/"), total.cast("string"), F.lit("). This phase may be doing too much."))
    return F.when(n / total > R.PHASE_DOMINANCE, _finding(
        1, ord_, "phase_imbalance", "info", F.concat(label, F.lit(" dominates")), detail, phase, n))


def _error_bulk() -> Column:
    detail = F.concat(F.col("n_try").cast("string"),
                      F.lit(" try/except blocks. Consider extracting a retry/error-handling helper function."))
    return F.when(F.col("n_try") > R.TRY_BULK_MIN, _finding(
        2, F.lit(0), "error_handling_bulk", "warning", F.lit("Repetitive error handling"), detail, F.lit(None), F.col("n_try")))


def _no_error_handling() -> Column:
    detail = F.lit("This script has no try/except blocks. External service calls "
                   "and file operations should be wrapped in error handling.")
    return F.when((F.col("total") > R.NO_ERROR_MIN_STEPS) & (F.col("n_try") == 0) & (F.col("n_io") > 0), _finding(
        3, F.lit(0), "no_error_handling", "concern", F.lit("No error handling"), detail, F.lit(None), F.lit(0)))


def _transform_heavy(label: Column, n: Column, first_pos: Column) -> Column:
    detail = F.concat(F.lit('"'), label, F.lit('" appears '), n.cast("string"),
                      F.lit(" times. Complex transform chains may benefit from a data pipeline library "
                            "(pandas, etc.)."))
    return _finding(4, first_pos, "transform_heavy", "info", F.lit("Heavy data manipulation"), detail, F.lit(None), n)


def print_spam(counts: DataFrame) -> DataFrame:
    """G1."""
    return _emit(counts, _print_spam())


def phase_imbalance(steps: DataFrame) -> DataFrame:
    """G2. Each phase holding more than half of the script's steps."""
    return _emit(phase_groups(steps), _dominant(*map(F.col, ("phase", "phase_label", "phase_ord", "n_steps", "total"))))


def error_bulk(counts: DataFrame) -> DataFrame:
    """G3."""
    return _emit(counts, _error_bulk())


def no_error_handling(counts: DataFrame) -> DataFrame:
    """G4."""
    return _emit(counts, _no_error_handling())


def transform_heavy(steps: DataFrame) -> DataFrame:
    """G5. Dedupe groups of transform steps with more than 15 members."""
    g = dedupe_groups(steps.where(F.col("type") == "transform")).where(F.col("n") > R.TRANSFORM_HEAVY_MIN)
    return _emit(g, _transform_heavy(F.col("label"), F.col("n"), F.col("first_pos")))


def findings(steps: DataFrame) -> DataFrame:
    """G6. All findings; ``rule``/``sub`` give the order within a script.

    One scan and two aggregations: counts for each text of a script, then one
    row a script, from which all five rules are read. The collected texts are
    those with more than 15 steps each, so the list is bounded by one file.
    """
    s = L.with_label(steps).withColumn("phase", L.infer_phase(F.col("type"), F.col("description")))
    in_phase = [F.count_if(F.col("phase") == key).alias(f"n_{key}") for key, _label in R.PHASES]
    texts = (s.withColumn("transform", F.col("type") == "transform").groupBy("project_id", "path", "transform", "label")
             .agg(*_counters(), F.min("pos").alias("first_pos"), *in_phase))
    sums = ["total", "n_print", "n_logger", "n_try", "n_io", *(f"n_{key}" for key, _label in R.PHASES)]
    heavy = F.when(F.col("transform") & (F.col("total") > R.TRANSFORM_HEAVY_MIN),
                   F.struct("label", F.col("total").alias("n"), "first_pos"))
    scripts = texts.groupBy("project_id", "path").agg(
        F.collect_list(heavy).alias("heavy"), *(F.sum(c).alias(c) for c in sums))
    fixed = F.array(_print_spam(), _error_bulk(), _no_error_handling(),
                    *(_dominant(F.lit(key), F.lit(label), F.lit(i), F.col(f"n_{key}"), F.col("total"))
                      for i, (key, label) in enumerate(R.PHASES)))
    repeated = F.transform("heavy", lambda h: _transform_heavy(h["label"], h["n"], h["first_pos"]))
    return _emit(scripts.select("project_id", "path", F.explode(F.concat(fixed, repeated)).alias("finding")), F.col("finding"))


def health(scripts: DataFrame, findings_df: DataFrame) -> DataFrame:
    """G7. (project_id, path, score, color, n_findings, n_warnings, n_concerns)."""
    agg = findings_df.groupBy("project_id", "path").agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"),
        F.count_if(F.col("severity") == "concern").alias("n_concerns"))
    h = scripts.select("project_id", "path").join(agg, ["project_id", "path"], "left").fillna(
        0, ["n_findings", "n_warnings", "n_concerns"])
    score = (F.when(F.col("n_concerns") > 0, F.lit("needs attention"))
             .when(F.col("n_warnings") >= 2, F.lit("has issues"))
             .when(F.col("n_warnings") == 1, F.lit("minor issues"))
             .otherwise(F.lit("clean")))
    color = (F.when(F.col("n_concerns") > 0, F.lit("red"))
             .when(F.col("n_warnings") >= 2, F.lit("amber"))
             .when(F.col("n_warnings") == 1, F.lit("yellow"))
             .otherwise(F.lit("green")))
    return h.select("project_id", "path", score.alias("score"), color.alias("color"),
                    F.col("n_findings").cast("long").alias("n_findings"),
                    F.col("n_warnings").cast("long").alias("n_warnings"),
                    F.col("n_concerns").cast("long").alias("n_concerns"))
