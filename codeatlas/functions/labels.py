"""Plain-English labels as Column -> Column expressions.

Every function here builds a JVM expression (``when`` chains, ``contains``,
``regexp_*``, higher-order array functions) so labels stay inside whole-stage
codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas import rules as R


def any_of_pattern(needles) -> str:
    """Java regex matching any of the literal needles (quoted with \\Q..\\E)."""
    return "|".join(r"\Q" + n + r"\E" for n in needles)


def _any(c: Column, needles) -> Column:
    """Substring test for any needle: one regex instead of a deep OR tree, so
    the generated code stays small enough to compile."""
    needles = list(needles)
    if len(needles) == 1:
        return c.contains(needles[0])
    return c.rlike(any_of_pattern(needles))


def capitalize(c: Column) -> Column:
    """Python str.capitalize: first char upper, rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def title_case(c: Column) -> Column:
    """Python str.title: a letter after a non-letter is upper-cased, others lower."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda t: F.when(t.rlike(r"^\p{L}"), capitalize(t)).otherwise(t)), "")


def business_label(step_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for typ, biz, *_ in R.TYPE_LABELS:
        out = F.when(step_type == typ, F.lit(biz)).otherwise(out)
    return out


# --------------------------------------------------------------------------
# conditions
# --------------------------------------------------------------------------

def clean_var(name: Column) -> Column:
    """E10."""
    v = F.regexp_replace(F.regexp_replace(name, r"^self\.", ""), r"^_+", "")
    return F.when(v == "", F.lit("value")).otherwise(v)


def humanize_tokens(cond: Column) -> Column:
    """E9, first part: dict/get access to words, drop parens, underscores in
    word tokens to spaces."""
    r = F.regexp_replace(cond, r"(?U)(\w+)\['(\w+)'\]|(\w+)\[\"(\w+)\"\]", "$1$3 $2$4")
    r = F.regexp_replace(r, r"(?U)(\w+)\.get\('(\w+)'\)|(\w+)\.get\(\"(\w+)\"\)", "$1$3 $2$4")
    r = F.replace(r, F.lit(" and (not "), F.lit(" and not "))
    r = F.regexp_replace(r, r"[()]", "")
    tokens = F.regexp_extract_all(r, F.lit(r"(?U)(\w+|\W+)"), 1)
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"(?U)^\w+_\w+$"), F.translate(t, "_", " "))
                                    .otherwise(t)), "")


def humanize_finish(r: Column) -> Column:
    """E9, second part: code-looking leftovers fall back to a generic phrase."""
    return F.when(r.rlike(r"[.\[\]{}]") | (F.trim(r) == ""), F.lit("data meets conditions")).otherwise(F.trim(r))


def humanize_condition(cond: Column) -> Column:
    """E9."""
    return humanize_finish(humanize_tokens(cond))


def simplify_condition(cond: Column, human: Column | None = None) -> Column:
    """E8. ``human`` may carry a precomputed ``humanize_condition(cond)``."""
    subject = F.trim(F.substring(cond, 5, 1 << 30))
    before_none = F.trim(F.substring_index(cond, " is None", 1))
    human = humanize_condition(cond) if human is None else human
    return (F.when(cond.startswith("not ") & (subject.contains("os.path.exists") | subject.contains("Path(")),
                   F.lit("file doesn't exist"))
            .when(cond.startswith("not "), F.concat(clean_var(subject), F.lit(" is missing")))
            .when(cond.contains(" is None"), F.concat(clean_var(before_none), F.lit(" is empty")))
            .when(F.length(human) > R.CONDITION_MAX, F.concat(F.substring(human, 1, R.CONDITION_MAX - 3),
                                                              F.lit("...")))
            .otherwise(human))


# --------------------------------------------------------------------------
# Step text
# --------------------------------------------------------------------------

def translate_step(step_type: Column, desc: Column, service_name: Column,
                   dl: Column | None = None, checks: Column | None = None) -> Column:
    """E1 with E2–E7. ``dl`` (lowered description) and ``checks`` (E8 of the
    if-condition) may be passed precomputed to keep generated code small."""
    dl = F.lower(desc) if dl is None else dl
    if checks is None:
        checks = simplify_condition(F.trim(F.substring(desc, 4, 1 << 30)))
    target = F.coalesce(service_name, F.lit("external service"))
    api = F.concat(F.lit("Fetches data from "), target)
    for needle, verb in reversed(R.API_VERBS):
        api = F.when(desc.contains(needle), F.concat(F.lit(verb + " "), target)).otherwise(api)
    file_ = (F.when(_any(dl, R.FILE_WRITE_SIGNALS), F.lit("Saves data to file"))
             .when(_any(dl, R.FILE_READ_SIGNALS), F.lit("Reads data from file"))
             .when(dl.contains("open("), F.lit("Opens file"))
             .otherwise(F.lit("Reads/writes file")))
    db = F.when(_any(dl, R.DB_WRITE_SIGNALS), F.lit("Saves to database")).otherwise(F.lit("Queries database"))
    loop_var = F.regexp_extract(desc, r"(?U)^for\s+\(?(\w+)", 1)
    decision = (F.when(desc.startswith("try/except"), F.lit("Handles potential errors"))
                .when(desc.startswith("for ") & (loop_var != ""), F.concat(F.lit("Processes each "), loop_var))
                .when(desc.startswith("for "), F.lit("Repeats for each item"))
                .when(desc.startswith("while "), F.lit("Repeats while condition is met"))
                .when(desc.startswith("if "), F.concat(F.lit("Checks: "), checks))
                .otherwise(F.lit("Checks a condition")))
    output = (F.when((dl.contains("logger.") | dl.contains("logging.")) & dl.contains("error"),
                     F.lit("Records an error"))
              .when((dl.contains("logger.") | dl.contains("logging.")) & dl.contains("warning"),
                    F.lit("Records a warning"))
              .when(dl.contains("logger.") | dl.contains("logging."), F.lit("Records activity"))
              .when(dl.contains("print("), F.lit("Displays message"))
              .when(dl.contains("send"), F.lit("Sends notification"))
              .otherwise(F.lit("Produces output")))
    transform = F.lit("Processes data")
    for needles, label in reversed(R.TRANSFORM_RULES):
        transform = F.when(_any(dl, needles), F.lit(label)).otherwise(transform)
    fallback = F.coalesce(business_label(step_type), capitalize(F.translate(step_type, "_", " ")))
    return (F.when(step_type == "api_call", api)
            .when(step_type == "file_io", file_)
            .when(step_type == "db_op", db)
            .when(step_type == "decision", decision)
            .when(step_type == "output", output)
            .when(step_type == "transform", transform)
            .otherwise(fallback))


# --------------------------------------------------------------------------
# triggers
# --------------------------------------------------------------------------

def translate_trigger(ttype: Column, detail: Column) -> Column:
    t = F.lower(ttype)
    cron = F.when(F.regexp_extract(detail, r"^\*/(\d+)\s", 1) != "",
                  F.concat(F.lit("Runs every "),
                           F.regexp_extract(detail, r"^\*/(\d+)\s", 1).try_cast("decimal(38,0)").cast("string"),
                           F.lit(" minutes"))) \
        .otherwise(F.lit("Runs on a schedule"))
    for pattern, human in reversed(R.CRON_PATTERNS):
        cron = F.when(detail.contains(pattern), F.lit(human)).otherwise(cron)
    after_first_colon = F.trim(F.regexp_extract(detail, r"(?s)^[^:]*:(.*)$", 1))
    dlow = F.lower(detail)
    cli = (F.when(detail.contains("__main__"), F.lit("Can be run directly"))
           .when(detail.contains("argparse"), F.lit("Accepts command-line options"))
           .when((detail.contains("click") | detail.contains("typer"))
                 & (dlow.contains("click:") | dlow.contains("typer:")) & (after_first_colon != ""),
                 F.concat(F.lit("Command: "), after_first_colon))
           .otherwise(F.lit("Run from command line")))
    upper = F.upper(detail)
    path = detail
    for m in reversed(R.WEBHOOK_METHOD_PREFIXES):
        path = F.when(upper.startswith(m), F.trim(F.substring(detail, len(m) + 1, 1 << 30))).otherwise(path)
    modal_name = F.when(detail.contains(":"), after_first_colon).otherwise(detail)
    webhook = (F.when(dlow.contains("modal"), F.concat(F.lit("Cloud function: "), modal_name))
               .when(path != "", F.concat(F.lit("Triggered by web request to "), path))
               .otherwise(F.lit("Triggered by web request")))
    return (F.when(t.isin("cron", "schedule"), cron)
            .when(t == "cli", cli)
            .when(t == "webhook", webhook)
            .when(t == "import", F.lit("Used by other scripts"))
            .when(t == "manual", F.lit("Run manually"))
            .otherwise(capitalize(ttype)))


# --------------------------------------------------------------------------
# E15–E18
# --------------------------------------------------------------------------

def translate_secret(secret: Column) -> Column:
    upper = F.upper(secret)
    out = F.concat(F.lit("Configuration: "), secret)
    for suffix in reversed(R.SECRET_SUFFIXES):
        stem = F.trim(F.translate(F.substring(secret, F.lit(1), F.length(secret) - len(suffix)), "_", " "))
        named = F.when(stem != "", F.concat(title_case(stem), F.lit(" credentials"))).otherwise(
            F.lit("API credentials"))
        out = F.when(upper.endswith(suffix), named).otherwise(out)
    for prefix, label in reversed(R.SECRET_PREFIXES):
        out = F.when(upper.startswith(prefix), F.lit(f"{label} credentials")).otherwise(out)
    return out


def translate_connection(conn_type: Column) -> Column:
    """E16."""
    out = conn_type
    for typ, verb in R.CONNECTION_VERBS:
        out = F.when(conn_type == typ, F.lit(verb)).otherwise(out)
    return out


def type_labels_df(spark: SparkSession) -> DataFrame:
    """E17 as a dimension: (type, business, technical, short, prefix, compact)."""
    return spark.createDataFrame(list(R.TYPE_LABELS),
                                 "type string, business string, technical string, short string, "
                                 "prefix string, compact string")


def phase_dim(spark: SparkSession) -> DataFrame:
    """(phase, label, ord) in display order."""
    return spark.createDataFrame([(p, label, i) for i, (p, label) in enumerate(R.PHASES)],
                                 "phase string, label string, ord int")


def infer_phase(step_type: Column, desc: Column, dl: Column | None = None) -> Column:
    """E18."""
    d = F.lower(F.coalesce(desc, F.lit(""))) if dl is None else F.coalesce(dl, F.lit(""))
    return (F.when((step_type == "decision") & d.startswith("try/except"), F.lit("error_handling"))
            .when((step_type == "decision") & (d.startswith("for ") | d.startswith("while ")), F.lit("processing"))
            .when(step_type == "output", F.lit("reporting"))
            .when(step_type == "transform", F.lit("processing"))
            .when(_any(d, R.STORAGE_KEYWORDS), F.lit("storage"))
            .when(_any(d, R.SETUP_KEYWORDS), F.lit("setup"))
            .when(step_type == "decision", F.lit("processing"))
            .when(step_type.isin("api_call", "file_io", "db_op"), F.lit("setup"))
            .otherwise(F.lit("processing")))


def phase_label(phase: Column) -> Column:
    out = capitalize(F.translate(phase, "_", " "))
    for p, label in R.PHASES:
        out = F.when(phase == p, F.lit(label)).otherwise(out)
    return out


def phase_ord(phase: Column) -> Column:
    out = F.lit(len(R.PHASES))
    for i, (p, _label) in enumerate(R.PHASES):
        out = F.when(phase == p, F.lit(i)).otherwise(out)
    return out


def with_phase(steps: DataFrame) -> DataFrame:
    """Adds ``phase`` (E18) plus ``phase_label`` / ``phase_ord`` looked up in the
    five-row phase dimension (fixed size, broadcast)."""
    s = steps.withColumn("phase", infer_phase(F.col("type"), F.col("description")))
    dim = F.broadcast(phase_dim(steps.sparkSession).withColumnRenamed("label", "phase_label")
                      .withColumnRenamed("ord", "phase_ord"))
    return s.join(dim, "phase", "left")


def with_label(steps: DataFrame) -> DataFrame:
    """Adds ``label``.

    Shared pieces (lowered text, condition text, humanized condition) are
    projected once as helper columns, so the CASE tree references them
    instead of repeating them (keeps whole-stage codegen under its limits).
    """
    typ, desc = F.col("type"), F.col("description")
    is_if = (typ == "decision") & desc.startswith("if ")
    s = (steps
         .withColumn("_dl", F.lower(desc))
         .withColumn("_cond", F.when(is_if, F.trim(F.substring(desc, 4, 1 << 30))))
         .withColumn("_h1", humanize_tokens(F.col("_cond")))
         .withColumn("_human", humanize_finish(F.col("_h1")))
         .withColumn("_checks", simplify_condition(F.col("_cond"), F.col("_human"))))
    s = s.withColumn("label", translate_step(typ, desc, F.col("service.name"), F.col("_dl"), F.col("_checks")))
    return s.drop("_dl", "_cond", "_h1", "_human", "_checks")


def with_labels(steps: DataFrame) -> DataFrame:
    """Adds ``label`` (E1), ``phase`` (E18), ``phase_label`` and ``phase_ord``."""
    return with_label(with_phase(steps))
