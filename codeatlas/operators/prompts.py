"""Batch-inference datasets — prompt rows built from the analysis
tables, and parsing/merging of model responses.

The model call itself is a service outside the engine; these operators build
one prompt row per script / phase (ordered aggregations bounded by script size),
project prompts in parts of bounded size, and parse and merge the replies.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas import rules as R
from codeatlas.functions import labels as L
from codeatlas.operators.numbering import running
from codeatlas.session import cut_table

try:  # workers need no install of the package
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # pragma: no cover
    pass

# ----------------------------------------------------------------------------
# FIXED VALUES (prompt wording; must match the analysed tool's prompts)
# ----------------------------------------------------------------------------
SYSTEM_PROMPT = (
    "You are a technical writer who explains software to non-technical business "
    "stakeholders. You write clear, jargon-free summaries. You never mention "
    "programming concepts like functions, variables, loops, or imports. Instead, "
    "describe what the script accomplishes in business terms."
)
SCRIPT_OBJECTIVE = ("Objective: Write a 1-2 sentence plain-English summary of what this "
                    "automation script does.\n\n")
SCRIPT_INSTRUCTIONS = ("Instructions:\n"
                       "- Describe what this script accomplishes, not how it works\n"
                       "- Mention the key services and data sources by name\n"
                       "- Keep it under 2 sentences\n"
                       "- Write for someone who has never seen code before\n\n"
                       "Expected Output: A 1-2 sentence plain-English description.")
PROJECT_OBJECTIVE = "Objective: Write a 2-3 sentence executive summary of this automation project.\n\n"
PROJECT_INSTRUCTIONS = ("Instructions:\n"
                        "- Describe the overall purpose of this project as a system\n"
                        "- Mention how the scripts work together\n"
                        "- Highlight the main services and data flows\n"
                        "- Keep it under 3 sentences\n"
                        "- Write for a business stakeholder, not a developer\n\n"
                        "Expected Output: A 2-3 sentence executive summary.")
FLOW_OBJECTIVE = ("Objective: Write a single sentence describing how data flows through "
                  "this automation script.\n\n")
FLOW_INSTRUCTIONS = ("Instructions:\n"
                     "- Use arrow notation: \"Source → verb via Service → Destination\"\n"
                     "- Name specific services (Google Sheets, Slack, etc.) not \"external service\"\n"
                     "- Describe the data transformation, not just the endpoints\n"
                     "- One sentence maximum\n"
                     "- Write for someone who has never seen code before\n\n"
                     "Expected Output: A single sentence like "
                     "\"Reads customer leads from Google Sheets → enriches with email "
                     "addresses via AnyMailFinder → updates the sheet with results\"")
PHASE_INSTRUCTIONS = (
    "Instructions:\n"
    "- Write a 1-2 sentence summary of what this phase accomplishes as a whole\n"
    "- For EACH step (by line number), write a unique 1-sentence description\n"
    "- Do NOT use generic phrases like \"Handles potential errors\" or "
    "\"Fetches data from external service\"\n"
    "- For error handling: name WHAT error is being caught and HOW it is handled\n"
    "- For API calls: name the SPECIFIC service and what data is being exchanged\n"
    "- For file operations: name the SPECIFIC file type and purpose\n"
    "- Mention specific service names (Google Sheets, Slack, etc.) not \"external service\"\n"
    "- Write for someone who has never seen code before\n"
    "- Identify the main risk or failure mode in this phase "
    "(rate limits, auth expiry, timeout, missing data, etc.)\n"
    "- If no significant risk exists, use an empty string for \"risk\"\n\n"
    "Expected Output (JSON):\n"
    "{\n"
    "  \"phase_summary\": \"1-2 sentence phase summary\",\n"
    "  \"steps\": {\n"
    "    \"<line_number>\": \"Unique description for this step\"\n"
    "  },\n"
    "  \"risk\": \"One sentence about what could go wrong in this phase\"\n"
    "}"
)
NO_SUMMARY = "No summary available"
PROJECT_NAME = "Project: "
PROJECT_SCRIPTS = "\nScripts: "
PROJECT_SERVICES = "\nServices: "
PROJECT_ENTRIES = "\nEntry points: "
PROJECT_SUMMARIES = "\n\nScript summaries:\n"
PROJECT_CONNECTIONS = "\n\nConnections between scripts:\n"
FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"  # the first fenced block of a reply
# ----------------------------------------------------------------------------
# END FIXED VALUES
# ----------------------------------------------------------------------------


def _or_none(c: Column, none: str = "None") -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(none)).otherwise(c)


def _ordered_join(pairs: Column, sep: str) -> Column:
    """array<struct<o, v>> -> v joined in o order."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["v"]), sep)


def script_lists(scripts: DataFrame, services: DataFrame, secrets: DataFrame, triggers: DataFrame) -> DataFrame:
    """Per script: comma lists of triggers, service names, secrets (each may be '')."""
    tr = triggers.groupBy("project_id", "path").agg(_ordered_join(F.collect_list(F.struct(
        F.col("pos").alias("o"), F.concat("type", F.lit(": "), "detail").alias("v"))), ", ").alias("triggers_txt"))
    sv = services.groupBy("project_id", "path").agg(_ordered_join(F.collect_list(F.struct(
        F.col("pos").alias("o"), F.col("name").alias("v"))), ", ").alias("services_txt"))
    se = secrets.groupBy("project_id", "path").agg(
        F.array_join(F.array_sort(F.collect_set("secret")), ", ").alias("secrets_txt"))
    return (scripts.select("project_id", "path", "is_entry_point")
            .join(tr, ["project_id", "path"], "left")
            .join(sv, ["project_id", "path"], "left")
            .join(se, ["project_id", "path"], "left"))


def script_prompts(scripts: DataFrame, services: DataFrame, secrets: DataFrame, triggers: DataFrame,
                   steps: DataFrame) -> DataFrame:
    """I1. (project_id, path, system, user) per script."""
    fn = F.coalesce("function_name", F.lit("(top-level)"))
    per_func = (steps.groupBy("project_id", "path", fn.alias("func"))
                .agg(F.min("pos").alias("first_pos"),
                     _ordered_join(F.collect_list(F.struct(
                         F.col("pos").alias("o"),
                         F.concat(F.lit("- ["), "type", F.lit("] "), "description").alias("v"))), "\n").alias("body")))
    blocks = (per_func.groupBy("project_id", "path")
              .agg(_ordered_join(F.collect_list(F.struct(
                  F.col("first_pos").alias("o"),
                  F.concat(F.lit("\nIn "), "func", F.lit(":\n"), "body", F.lit("\n")).alias("v"))), "")
                  .alias("steps_txt")))
    s = script_lists(scripts, services, secrets, triggers).join(blocks, ["project_id", "path"], "left")
    user = F.concat(
        F.lit(SCRIPT_OBJECTIVE),
        F.lit("Script: "), "path", F.lit("\n"),
        F.lit("Entry point: "), F.when(F.col("is_entry_point"), F.lit("Yes")).otherwise(F.lit("No")), F.lit("\n"),
        F.lit("Triggers: "), _or_none(F.col("triggers_txt")), F.lit("\n"),
        F.lit("Services used: "), _or_none(F.col("services_txt")), F.lit("\n"),
        F.lit("Secrets/API keys needed: "), _or_none(F.col("secrets_txt")), F.lit("\n\n"),
        F.lit("Steps (in execution order):\n"), _or_none(F.col("steps_txt"), "No steps detected."), F.lit("\n"),
        F.lit(SCRIPT_INSTRUCTIONS))
    return s.select("project_id", "path", F.lit(SYSTEM_PROMPT).alias("system"), user.alias("user"))


PART_BYTES = 1 << 20  # of a project prompt


def project_prompt_parts(scripts: DataFrame, proj_services: DataFrame, conns: DataFrame, summaries: DataFrame | None = None,
                         part_bytes: int = PART_BYTES) -> DataFrame:
    """I2. (project_id, part_no, text): the project's prompt in consecutive parts
    of about ``part_bytes``, cut between lines (or entry points of their list);
    no part is a whole project unless that is small. ``summaries`` (project_id,
    path, summary). Lines are placed by running sums of their bytes over ranges."""
    key = "project_id"
    sc = scripts.select(key, "path", "is_entry_point")
    sc = sc.join(summaries.select(key, "path", "summary"), [key, "path"], "left") if summaries is not None else sc.withColumn("summary", F.lit(None).cast("string"))
    told = F.when(F.coalesce("summary", F.lit("")) == "", F.lit(NO_SUMMARY)).otherwise(F.col("summary"))
    entry = F.when(F.col("is_entry_point"), F.col("path"))
    heads = sc.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"), F.min(entry).alias("first_entry"))
    svc = proj_services.groupBy(key).agg(_ordered_join(F.collect_list(F.struct(F.col("pos").alias("o"), F.col("name").alias("v"))), ", ").alias("services_txt"))
    linked = conns.select(key).distinct().withColumn("linked", F.lit(True))
    heads = heads.join(svc, key, "left").join(linked, key, "left")

    def lines(df: DataFrame, section: int, text: Column, nth: Column | None = None, name: Column | None = None) -> DataFrame:
        return df.select(key, F.lit(section).alias("section"), (F.lit(0) if nth is None else nth).cast("long").alias("nth"),
                         (F.lit("") if name is None else name).alias("name"), text.alias("text"))

    def after(is_first: Column, mark: str) -> Column:
        return F.when(is_first, F.lit("")).otherwise(F.lit(mark))

    path, first = F.col("path"), heads.select(key, "first", "first_entry")
    each = sc.join(first, key)
    every = [
        lines(heads, 0, F.concat(F.lit(PROJECT_OBJECTIVE + PROJECT_NAME), F.col(key), F.lit(PROJECT_SCRIPTS), F.col("n").cast("string"), F.lit(PROJECT_SERVICES),
                                 _or_none(F.col("services_txt")), F.lit(PROJECT_ENTRIES), F.when(F.col("first_entry").isNull(), F.lit("None")).otherwise(F.lit("")))),
        lines(each.where("is_entry_point"), 1, F.concat(after(path == F.col("first_entry"), ", "), path), name=path),
        lines(heads, 2, F.lit(PROJECT_SUMMARIES)),
        lines(each, 3, F.concat(after(path == F.col("first"), "\n"), F.lit("- "), path, F.lit(": "), told), name=path),
        lines(heads, 4, F.concat(F.lit(PROJECT_CONNECTIONS), F.when(F.col("linked"), F.lit("")).otherwise(F.lit("No connections.")))),
        lines(conns, 5, F.concat(after(F.col("pos") == 0, "\n"), F.lit("- "), "source", F.lit(" -> "), "target", F.lit(": "), "detail"), nth=F.col("pos")),
        lines(heads, 6, F.lit("\n\n" + PROJECT_INSTRUCTIONS))]
    rows = reduce(DataFrame.unionByName, every).withColumn("size", F.octet_length("text").cast("long"))
    order = [F.col("section"), F.col("nth"), F.col("name")]
    placed = running(rows, key, order, "size", "prompt_lines").withColumn("part_no", F.floor(F.col("before") / part_bytes).cast("long"))
    return (placed.groupBy(key, "part_no").agg(F.array_sort(F.collect_list(F.struct("section", "nth", "name", "text"))).alias("lines"))
            .select(key, "part_no", F.array_join(F.transform("lines", lambda x: x["text"]), "").alias("text")))


def project_prompts(scripts: DataFrame, proj_services: DataFrame, conns: DataFrame,
                    summaries: DataFrame | None = None) -> DataFrame:
    """I2, exported: one row per project from its parts."""
    parts = project_prompt_parts(scripts, proj_services, conns, summaries)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "text"))), lambda x: x["text"]), "")
    return parts.groupBy("project_id").agg(whole.alias("user")).select("project_id", F.lit(SYSTEM_PROMPT).alias("system"), "user")


def dataflow_prompts(services: DataFrame, steps: DataFrame) -> DataFrame:
    """I3. Data-flow prompt per script with steps: phase lines of ``type (n)``
    in first-seen order, up to ten sorted distinct inputs and outputs."""
    s = L.with_phase(steps)
    per_type = s.groupBy("project_id", "path", "phase", "phase_label", "phase_ord", "type").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    per_phase = per_type.groupBy("project_id", "path", "phase_ord", "phase_label").agg(
        _ordered_join(F.collect_list(F.struct(
            F.col("first_pos").alias("o"),
            F.concat("type", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("v"))), ", ").alias("types"))
    phases = per_phase.groupBy("project_id", "path").agg(_ordered_join(F.collect_list(F.struct(
        F.col("phase_ord").alias("o"),
        F.concat(F.lit("- "), "phase_label", F.lit(": "), "types").alias("v"))), "\n").alias("phases_txt"))
    io = steps.groupBy("project_id", "path").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("inputs")))), 1, R.PROMPT_IO_MAX).alias("ins"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("outputs")))), 1, R.PROMPT_IO_MAX)
        .alias("outs"))
    svc = services.groupBy("project_id", "path").agg(_ordered_join(F.collect_list(F.struct(
        F.col("pos").alias("o"), F.col("name").alias("v"))), ", ").alias("services_txt"))
    p = phases.join(io, ["project_id", "path"]).join(svc, ["project_id", "path"], "left")
    io_txt = F.concat(
        F.when(F.size("ins") > 0, F.concat(F.lit("Key inputs: "), F.array_join("ins", ", "), F.lit("\n")))
        .otherwise(F.lit("")),
        F.when(F.size("outs") > 0, F.concat(F.lit("Key outputs: "), F.array_join("outs", ", "), F.lit("\n")))
        .otherwise(F.lit("")))
    user = F.concat(
        F.lit(FLOW_OBJECTIVE),
        F.lit("Script: "), "path", F.lit("\n"),
        F.lit("Services used: "), _or_none(F.col("services_txt")), F.lit("\n"),
        io_txt, F.lit("\n"),
        F.lit("Phases:\n"), _or_none(F.col("phases_txt"), "No phases."), F.lit("\n\n"),
        F.lit(FLOW_INSTRUCTIONS))
    return p.select("project_id", "path", F.lit(SYSTEM_PROMPT).alias("system"), user.alias("user"))


def phase_prompts(services: DataFrame, steps: DataFrame) -> DataFrame:
    """I4. One prompt per (script, phase present) listing the phase's steps."""
    s = L.with_phase(steps)

    def lst(c):
        return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(F.lit("none"))

    line = F.concat(F.lit("- Line "), F.col("line_number").cast("string"), F.lit(" ["), "type", F.lit("]: "),
                    "description", F.lit("\n  Service: "), F.coalesce(F.col("service.name"), F.lit("none")),
                    F.lit(" | Inputs: "), lst(F.col("inputs")), F.lit(" | Outputs: "), lst(F.col("outputs")))
    per_phase = s.groupBy("project_id", "path", "phase", "phase_label", "phase_ord").agg(
        F.count(F.lit(1)).alias("n"),
        _ordered_join(F.collect_list(F.struct(F.col("pos").alias("o"), line.alias("v"))), "\n").alias("steps_txt"))
    svc = services.groupBy("project_id", "path").agg(_ordered_join(F.collect_list(F.struct(
        F.col("pos").alias("o"), F.col("name").alias("v"))), ", ").alias("services_txt"))
    p = per_phase.join(svc, ["project_id", "path"], "left")
    user = F.concat(
        F.lit("Objective: Explain the \""), "phase_label", F.lit("\" phase of this automation script.\n\n"),
        F.lit("Script: "), "path", F.lit("\n"),
        F.lit("Services used: "), _or_none(F.col("services_txt")), F.lit("\n"),
        F.lit("This phase contains "), F.col("n").cast("string"), F.lit(" steps:\n\n"),
        _or_none(F.col("steps_txt"), "No steps."), F.lit("\n\n"),
        F.lit(PHASE_INSTRUCTIONS))
    return p.select("project_id", "path", "phase", F.lit(SYSTEM_PROMPT).alias("system"), user.alias("user"))


# --------------------------------------------------------------------------
# responses
# --------------------------------------------------------------------------

_MEMBERS = "project_id string, path string, phase string, kind string, nth int, line int, text string"


def _whole_number(key: str) -> int | None:
    """A step key as Python reads integers (signs, spaces, underscores, any
    decimal digits), within the range of line numbers."""
    try:
        n = int(key)
    except ValueError:
        return None
    return n if 0 < n < 1 << 31 else None


def _body(raw: str | None) -> str:
    """What a reply's JSON object can be: of the first fenced block (if any, else
    of the whole) the text from the first ``{`` to the last ``}``."""
    fenced = re.search(FENCE, raw or "", re.ASCII)
    text = fenced[1] if fenced else raw or ""
    first, last = text.find("{"), text.rfind("}")
    return text[first:last + 1] if last > first >= 0 else ""


def _string_members(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The string members of each reply's JSON object, in order: an object keeps
    the first place and the last value of a repeated key. Replies without one
    JSON object have none."""
    types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
    for batch in it:
        rows = []
        for project, path, phase, raw in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                found = json.loads(_body(raw))
            except (ValueError, RecursionError):
                continue
            members = [(kind, None, found.get(name)) for kind, name in (("summary", "phase_summary"), ("risk", "risk"))]
            steps = found.get("steps")
            members += [("step", _whole_number(k), v) for k, v in steps.items()] if isinstance(steps, dict) else []
            rows += [(project, path, phase, kind, nth, line, text.strip().encode("utf-8", "backslashreplace").decode())
                     for nth, (kind, line, text) in enumerate(members) if isinstance(text, str)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["project_id", "path", "phase", "kind", "nth", "line", "text"])


def parse_responses(responses: DataFrame, steps: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """I5. ``responses(project_id, path, phase, raw)`` -> flat rows
    (project_id, path, phase, kind, line, text), kind in summary/step/risk.

    The first fenced block (if any) is taken, then the text from the first
    ``{`` to the last ``}``; it must be one JSON object as Python's ``json``
    reads it (NaN included). Strings only, stripped; blank ones dropped; step
    keys must be integers naming a line of a step in that phase; of several
    keys for one line the last one with a text counts. Replies are parsed once:
    their members are written before the two kinds part (``tables`` takes the
    folder down).
    """
    members = cut_table(responses.select("project_id", "path", "phase", "raw").mapInArrow(_string_members, _MEMBERS).where("text <> ''"), "reply_members", tables=tables)
    lines = L.with_phase(steps).select("project_id", "path", "phase", F.col("line_number").alias("line")).distinct()
    told = (members.where("kind = 'step'").join(lines, ["project_id", "path", "phase", "line"])
            .groupBy("project_id", "path", "phase", "kind", "line").agg(F.max_by("text", "nth").alias("text")))
    return members.where("kind <> 'step'").select("project_id", "path", "phase", "kind", "line", "text").unionByName(told)


def merge_responses(parsed: DataFrame) -> DataFrame:
    """I6. Per script: phase summaries and risks by phase; contextual step text
    per line, later phases (display order) overwriting earlier ones (several
    texts of one phase and line: the greatest).
    Flat rows (project_id, path, kind, key, text)."""
    p = parsed.withColumn("phase_ord", L.phase_ord(F.col("phase")))
    maps = p.where(F.col("kind") != "step").select("project_id", "path", "kind",
                                                   F.col("phase").alias("key"), "text")
    steps = (p.where(F.col("kind") == "step").groupBy("project_id", "path", "line")
             .agg(F.max_by("text", F.struct("phase_ord", "text")).alias("text"))
             .select("project_id", "path", F.lit("step").alias("kind"), F.col("line").cast("string").alias("key"),
                     "text"))
    return maps.unionByName(steps)


def reply_texts(replies: DataFrame) -> DataFrame:
    """Plain replies (project_id, path, kind, raw) -> (..., text): stripped, blank
    ones and nulls dropped. Kinds: script, data_flow, project (path ``''``)."""
    stripped = F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")
    return replies.select("project_id", "path", "kind", stripped.alias("text")).where("text <> ''")


def script_fields(scripts: DataFrame, merged: DataFrame, texts: DataFrame) -> DataFrame:
    """I6. What the replies add to each script: summary, data_flow, and the maps
    phase_summaries, contextual_steps (by line) and phase_risks, which are null
    together where no phase gave anything, else empty where they have nothing."""
    key = ["project_id", "path"]

    def entries(kind: str, k: Column) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(k.alias("k"), F.col("text").alias("t"))))))

    maps = merged.groupBy(*key).agg(entries("summary", F.col("key")).alias("phase_summaries"), entries("step", F.col("key").try_cast("int")).alias("contextual_steps"),
                                    entries("risk", F.col("key")).alias("phase_risks"))
    plain = texts.groupBy(*key).agg(F.max(F.when(F.col("kind") == "script", F.col("text"))).alias("summary"), F.max(F.when(F.col("kind") == "data_flow", F.col("text"))).alias("data_flow"))
    return (scripts.select(*key).join(plain, key, "left").join(maps, key, "left")
            .select(*key, "summary", "data_flow", "phase_summaries", "contextual_steps", "phase_risks"))


def reply_progress(fields: DataFrame, texts: DataFrame) -> DataFrame:
    """I6. (project_id, summaries, phases): scripts with a summary, one more for
    the project's own, and scripts with phase summaries."""
    own = texts.where("kind = 'project'").select("project_id").distinct().withColumn("own", F.lit(1))
    counts = fields.groupBy("project_id").agg(F.count("summary").alias("summaries"), F.count(F.when(F.size("phase_summaries") > 0, 1)).alias("phases"))
    return counts.join(own, "project_id", "left").select("project_id", (F.col("summaries") + F.coalesce("own", F.lit(0))).alias("summaries"), "phases")
