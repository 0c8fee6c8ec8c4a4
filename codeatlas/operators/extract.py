"""Imports, secrets, triggers, signature, services and steps.

All rules are column expressions or joins over the ``facts`` table; the
only per-script state (service keys, decouple flag, local modules) is joined
in by ``(project_id, path)`` keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeatlas import rules as R

SERVICE_STRUCT = "struct<name:string,library:string,icon:string>"


def _isin(c: Column, values) -> Column:
    return c.isin(list(values))


def _contains_any(c: Column, needles) -> Column:
    from codeatlas.functions.labels import any_of_pattern
    return c.rlike(any_of_pattern(needles))


# --------------------------------------------------------------------------
# A5 / B2: local modules and imports
# --------------------------------------------------------------------------

def local_modules(listing: DataFrame) -> DataFrame:
    """A5. ``listing(project_id, path)`` (relative paths, pruned) -> (project_id, module).

    File stem of each ``.py``; for ``__init__.py`` its directory name unless it
    sits at the project root.
    """
    fname = F.substring_index("path", "/", -1)
    parent = F.when(F.col("path").contains("/"),
                    F.substring_index(F.substring_index("path", "/", -2), "/", 1))
    module = F.when(fname == "__init__.py", parent).otherwise(F.regexp_replace(fname, r"\.py$", ""))
    return (listing.select("project_id", module.alias("module"))
            .where(F.col("module").isNotNull()).distinct())


def imports(facts: DataFrame, modules: DataFrame) -> DataFrame:
    """B2. (project_id, path, import, is_internal); internal iff the top-level
    segment is a local module of the project."""
    imp = (facts.where(F.col("kind") == "import")
           .select("project_id", "path", F.explode("names").alias("import"))
           .distinct()
           .withColumn("module", F.split_part(F.col("import"), F.lit("."), F.lit(1))))
    mods = modules.select("project_id", "module", F.lit(True).alias("is_internal"))
    return (imp.join(mods, ["project_id", "module"], "left")
            .select("project_id", "path", "import",
                    F.coalesce("is_internal", F.lit(False)).alias("is_internal")))


# --------------------------------------------------------------------------
# services
# --------------------------------------------------------------------------

def service_map_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, n, i) for p, n, i in R.SERVICE_MAP],
                                 "prefix string, name string, icon string")


def script_services(spark: SparkSession, imports_df: DataFrame) -> DataFrame:
    """C1+C2. (project_id, path, pos, name, library, icon).

    Each external import is expanded to its dotted prefixes so the rule match
    is an equi join against the fixed 47-row rule table (broadcast); the
    longest matching prefix wins; per script the first import (sorted) of a
    service name supplies its library.
    """
    ext = imports_df.where(~F.col("is_internal")).select("project_id", "path", "import")
    parts = F.split("import", r"\.")
    expanded = ext.select(
        "project_id", "path", "import",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)),
                              lambda k: F.array_join(F.slice(parts, 1, k), "."))).alias("prefix"))
    matched = (expanded.join(F.broadcast(service_map_df(spark)), "prefix")
               .groupBy("project_id", "path", "import")
               .agg(F.max_by(F.struct("prefix", "name", "icon"), F.length("prefix")).alias("m")))
    first = (matched.groupBy("project_id", "path", F.col("m.name").alias("name"))
             .agg(F.min_by(F.struct(F.col("m.prefix").alias("library"), F.col("m.icon").alias("icon")),
                           F.col("import")).alias("s"), F.min("import").alias("first_import")))
    w = Window.partitionBy("project_id", "path").orderBy("first_import")
    return first.select("project_id", "path", (F.row_number().over(w) - 1).cast("int").alias("pos"),
                        "name", F.col("s.library").alias("library"), F.col("s.icon").alias("icon"))


def service_keys(services: DataFrame) -> DataFrame:
    """Object names that identify a script's services: the library and, for a
    dotted library, its last segment. Each key resolves to the first service
    (by position) whose library equals it or ends with ``.key``."""
    keys = services.select(
        "project_id", "path", "pos", "name", "library", "icon",
        F.explode(F.array_distinct(F.array(
            F.col("library"),
            F.when(F.col("library").contains("."), F.substring_index("library", ".", -1))))).alias("key"))
    keys = keys.where(F.col("key").isNotNull())
    return (keys.groupBy("project_id", "path", "key")
            .agg(F.min_by(F.struct("name", "library", "icon"), F.col("pos")).alias("service")))


# --------------------------------------------------------------------------
# secrets
# --------------------------------------------------------------------------

def decouple_scripts(imports_df: DataFrame) -> DataFrame:
    imp = F.col("import")
    return (imports_df.where((imp == "decouple") | imp.startswith("decouple."))
            .select("project_id", "path").distinct())


def secrets(facts: DataFrame, imports_df: DataFrame) -> DataFrame:
    """B3. (project_id, path, secret) — env and config keys given as literals."""
    lit_arg = F.col("arg0_str").isNotNull()
    call = F.col("kind") == "call"
    direct = facts.where(
        lit_arg & (
            (call & (F.col("method") == "getenv") & (F.col("chain") == "os"))
            | (call & (F.col("method") == "get") & (F.col("chain") == "os.environ"))
            | (call & (F.col("method") == "config") & (F.col("chain") == "decouple"))
            | ((F.col("kind") == "subscript") & (F.col("chain") == "os.environ"))))
    bare = (facts.where(call & lit_arg & (F.col("name") == "config"))
            .join(decouple_scripts(imports_df), ["project_id", "path"], "left_semi"))
    return (direct.unionByName(bare)
            .select("project_id", "path", F.col("arg0_str").alias("secret")).distinct())


# --------------------------------------------------------------------------
# Triggers and entry points
# --------------------------------------------------------------------------

def triggers(facts: DataFrame) -> DataFrame:
    """B4. (project_id, path, pos, type, detail); first occurrence in walk order."""
    def trig(cond, typ, detail, rule):
        return F.when(cond, F.struct(F.lit(typ).alias("type"), detail.alias("detail"),
                                     F.lit(rule).alias("rule")))

    kind, method, name, text = F.col("kind"), F.col("method"), F.col("name"), F.col("text")
    call = kind == "call"
    route_method = F.coalesce(*[F.when(text.contains(f".{m}("), F.lit(m.upper())) for m in R.ROUTE_METHODS],
                              F.lit("ANY"))
    route = F.coalesce(F.col("arg0_str"), F.lit("<dynamic>"))
    guard = (kind == "if") & F.col("flag")
    parser = call & (((method == "ArgumentParser") & (F.col("chain") == "argparse")) | (name == "ArgumentParser"))
    cands = F.array(
        trig(guard, "cli", F.lit("__main__ guard"), 0),
        trig(parser, "cli", F.lit("argparse"), 1),
        trig(call & (method == "do"), "cron", F.lit("schedule job"), 2),
        trig(call & (method == "add_job"), "cron", F.lit("apscheduler job"), 3),
        trig((kind == "decorator") & (text.contains("click.command") | text.contains("typer.command")
                                      | text.startswith("app.command") | text.startswith("cli.command")),
             "cli", F.concat(F.lit("click/typer: "), name), 4),
        trig((kind == "decorator") & _contains_any(text, R.ROUTE_MARKERS),
             "webhook", F.concat(route_method, F.lit(" "), route), 5),
        trig((kind == "decorator") & (text.contains("modal.web_endpoint") | text.contains("modal.asgi_app")),
             "webhook", F.concat(F.lit("modal endpoint: "), name), 6),
        trig((kind == "decorator") & (text.contains("modal.function") | text.contains("modal.method")),
             "webhook", F.concat(F.lit("modal function: "), name), 7),
    )
    # most calls and conditions trigger nothing: they go before candidates are made
    relevant = facts.where(kind.isin("if", "call", "decorator")).where(guard | parser | (call & method.isin("do", "add_job")) | (kind == "decorator"))
    t = (relevant.select("project_id", "path", "bfs", F.coalesce("value_line", F.lit(0)).alias("dec_ix"),
                         F.explode(F.array_compact(cands)).alias("t"))
         .select("project_id", "path", "t.type", "t.detail",
                 F.struct("bfs", "dec_ix", F.col("t.rule").alias("rule")).alias("ord")))
    first = t.groupBy("project_id", "path", "type", "detail").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy("project_id", "path").orderBy("ord")
    return first.select("project_id", "path", (F.row_number().over(w) - 1).cast("int").alias("pos"),
                        "type", "detail")


def entry_points(files: DataFrame, triggers_df: DataFrame) -> DataFrame:
    """B5. (project_id, path, is_entry_point) for every script row in ``files``."""
    flagged = (triggers_df.where(F.col("detail") == "__main__ guard")
               .select("project_id", "path").distinct().withColumn("is_entry_point", F.lit(True)))
    return (files.select("project_id", "path").join(flagged, ["project_id", "path"], "left")
            .select("project_id", "path", F.coalesce("is_entry_point", F.lit(False)).alias("is_entry_point")))


# --------------------------------------------------------------------------
# main() signature
# --------------------------------------------------------------------------

def main_signature(facts: DataFrame) -> DataFrame:
    """B6. (project_id, path, ord, param, annotation, default_json) of the first
    synchronous ``def main`` in walk order; ``self`` skipped; none if no params."""
    mains = (facts.where((F.col("kind") == "funcdef") & (F.col("name") == "main") & ~F.col("flag"))
             .groupBy("project_id", "path").agg(F.min("bfs").alias("bfs")))
    params = facts.where(F.col("kind") == "param").select(
        "project_id", "path", "bfs", F.col("value_line").alias("ord"), F.col("name").alias("param"),
        F.col("text").alias("annotation"), F.col("text2").alias("default_json"))
    return (params.join(mains, ["project_id", "path", "bfs"], "left_semi")
            .where(F.col("param") != "self")
            .select("project_id", "path", "ord", "param", "annotation", "default_json"))


# --------------------------------------------------------------------------
# Step classification
# --------------------------------------------------------------------------

STEP_KINDS = ("call", "if", "for", "while", "try", "listcomp", "dictcomp", "setcomp", "assign")


def classified(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """B7–B10 + C3. The facts that can be or touch a step, with ``step`` (type,
    description, service) where they are one. ``keys`` is ``service_keys(...)``:
    a script's service object names, looked up in one map a script."""
    per_script = keys.groupBy("project_id", "path").agg(F.map_from_entries(F.collect_list(F.struct("key", "service"))).alias("services"))
    obj, method, name, kind = F.col("obj"), F.col("method"), F.col("name"), F.col("kind")
    rows = (facts.where(kind.isin(*STEP_KINDS)).join(per_script, ["project_id", "path"], "left")
            .withColumn("service", F.when(kind == "call", F.try_element_at("services", obj))).drop("services"))
    om = F.concat(obj, F.lit("."), method, F.lit("()"))
    has_svc = F.col("service").isNotNull()
    attr = method.isNotNull()
    step_type = F.when(kind == "call", (
        F.when(attr & _isin(method, R.API_METHODS) & _isin(obj, R.API_OBJECTS), F.lit("api_call"))
        .when(attr & _isin(method, R.SERIALIZATION_METHODS) & _isin(obj, R.FILE_IO_MODULES), F.lit("file_io"))
        .when(attr & _isin(method, R.PATHLIB_IO_METHODS), F.lit("file_io#"))
        .when(attr & _isin(method, R.DB_METHODS) & _isin(obj, R.DB_OBJECTS), F.lit("db_op"))
        .when(attr & _isin(method, R.LOGGING_METHODS) & _isin(obj, R.LOGGING_OBJECTS), F.lit("output"))
        .when(attr & has_svc, F.lit("api_call"))
        .when(attr & _isin(method, R.TRANSFORM_METHODS), F.lit("transform#"))
        .when(_isin(name, R.OUTPUT_NAMES), F.lit("output"))
        .when(_isin(name, R.FILE_IO_NAMES), F.lit("file_io!"))
        .when(_isin(name, R.TRANSFORM_BUILTINS), F.lit("transform"))
    ))
    desc = (F.when(F.col("st").endswith("#"), F.concat(F.lit("."), method, F.lit("()")))
            .when(F.col("st") == "file_io!",
                  F.when(F.col("text").isNotNull(), F.concat(F.lit("open("), F.col("text"), F.lit(")")))
                  .otherwise(F.lit("open()")))
            .when(attr, om)
            .otherwise(F.concat(name, F.lit("()"))))
    text, text2 = F.col("text"), F.col("text2")
    flow_desc = (
        F.when((kind == "if") & ~(text.contains("__name__") & text.contains("__main__")),
               F.concat(F.lit("if "), text))
        .when(kind == "for", F.concat(F.lit("for "), text, F.lit(" in "), text2))
        .when(kind == "while", F.concat(F.lit("while "), text))
        .when(kind == "try", F.lit("try/except block"))
        .when(kind == "listcomp", F.concat(F.lit("list comprehension: ["), text, F.lit(" for ...]")))
        .when(kind == "dictcomp", F.concat(F.lit("dict comprehension: {"), text, F.lit(": "), text2,
                                           F.lit(" for ...}")))
        .when(kind == "setcomp", F.concat(F.lit("set comprehension: {"), text, F.lit(" for ...}")))
    )
    plain = F.regexp_replace("st", "[#!]$", "")
    none = F.lit(None).cast(SERVICE_STRUCT)
    call_step = F.struct(plain.alias("type"), desc.alias("description"), F.when(F.col("st") == "api_call", F.col("service")).otherwise(none).cast(SERVICE_STRUCT).alias("service"))
    flow_step = F.struct(F.when(kind.endswith("comp"), F.lit("transform")).otherwise(F.lit("decision")).alias("type"), F.col("flow").alias("description"), none.alias("service"))
    return (rows.withColumn("st", step_type).withColumn("flow", flow_desc)
            .withColumn("step", F.when(F.col("st").isNotNull(), call_step).when(F.col("flow").isNotNull(), flow_step)))


def script_steps(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """B7–B11. Steps ordered per script by (line, visit order), with ``inputs``
    and ``outputs`` from assignments, open() calls and conditions on their line,
    reproducing walk-order side effects:

    * outputs: targets of the first (walk order) matching assignment with a
      non-empty target list, unless a write-mode open() path of that line
      landed earlier; write paths are then appended without duplicates;
    * file_io inputs: read-mode open() paths of the line, in walk order;
    * decision inputs: names of the first if/while/for on the line with any.
    An assignment matches the steps of its first line that has steps, else its
    end line, else the line of its value.

    All in one pass: every row stands on its line (an assignment on each of its
    candidate lines), and windows over a line bring steps and what touches them
    together. All keys begin with (project_id, path), so clustered facts need no
    exchange and others need one.
    """
    kind = F.col("kind")
    is_assign = kind == "assign"
    opened = (kind == "call") & (F.col("name") == "open") & (F.col("arg0_str") != "")
    asks = kind.isin("if", "while", "for") & (F.size("names") > 0)
    rows = classified(facts, keys)
    # a row that is no step and touches none stands on no line; as a filter this would classify each row a second time
    lines = (F.when(is_assign & (F.size("names") > 0), F.when((F.col("line") == F.col("end_line")) & (F.col("line") == F.col("value_line")), F.array("line"))
                    .otherwise(F.array_distinct(F.array("line", "end_line", "value_line"))))
             .when(F.col("step").isNotNull() | opened | asks, F.array("line")))
    mode = F.col("open_mode")
    writes = mode.isNull() | mode.contains("w") | mode.contains("a")
    reads = mode.isNull() | ~(mode.contains("w") | mode.contains("a"))
    path_at = F.struct("bfs", F.col("arg0_str").alias("p"))
    placed = rows.select("project_id", "path", "dfs", "bfs", "func_name", "step", F.when(is_assign, F.struct("bfs", F.col("names").alias("targets"))).alias("assign"),
                         F.when(opened & writes, path_at).alias("write"), F.when(opened & reads, path_at).alias("read"),
                         F.when(asks, F.struct("bfs", "names")).alias("cond"), F.posexplode(lines).alias("o", "l")).where("l is not null")
    on_line = Window.partitionBy("project_id", "path", "l")
    met = F.col("assign").isNotNull() & F.max(F.col("step").isNotNull()).over(on_line)
    placed = placed.withColumn("met", met)
    chosen = F.min(F.when(F.col("met"), F.col("o"))).over(Window.partitionBy("project_id", "path", "bfs"))
    placed = placed.withColumn("used", F.col("met") & (F.col("o") == chosen))
    placed = placed.select("project_id", "path", "dfs", "func_name", "step", "l",
                           F.min(F.when(F.col("used"), F.col("assign"))).over(on_line).alias("assign"),
                           F.array_sort(F.collect_list("write").over(on_line)).alias("w"), F.array_sort(F.collect_list("read").over(on_line)).alias("r"),
                           F.min("cond").over(on_line).alias("cond")).where(F.col("step").isNotNull())
    typ = F.col("step.type")
    is_file = typ == "file_io"
    none = F.array().cast("array<struct<bfs:int,p:string>>")
    written, read = F.when(is_file, F.col("w")).otherwise(none), F.when(is_file, F.col("r")).otherwise(none)
    w_paths = F.array_distinct(F.transform(written, lambda x: x["p"]))
    targets = F.col("assign.targets")
    early_write = F.exists(written, lambda x: x["bfs"] < F.col("assign.bfs"))
    outputs = (F.when(targets.isNotNull() & ~early_write, F.concat(targets, F.filter(w_paths, lambda p: ~F.array_contains(targets, p))))
               .otherwise(w_paths))
    empty = F.array().cast("array<string>")
    inputs = (F.when(is_file, F.array_distinct(F.transform(read, lambda x: x["p"])))
              .when(typ == "decision", F.coalesce(F.col("cond.names"), empty)).otherwise(empty))
    nth = F.row_number().over(Window.partitionBy("project_id", "path").orderBy("l", "dfs"))
    return placed.select("project_id", "path", (nth - 1).cast("int").alias("pos"), F.col("l").alias("line_number"), typ.alias("type"),
                         F.col("step.description").alias("description"), F.col("func_name").alias("function_name"), F.col("step.service").alias("service"),
                         inputs.alias("inputs"), outputs.cast("array<string>").alias("outputs"))


def analyze_facts(spark: SparkSession, facts: DataFrame, modules: DataFrame) -> dict[str, DataFrame]:
    """Run B2–B11 and C1–C3 over a facts table; returns the named tables."""
    imps = imports(facts, modules)
    svcs = script_services(spark, imps)
    keys = service_keys(svcs)
    steps = script_steps(facts, keys)
    trig = triggers(facts)
    return {
        "imports": imps,
        "services": svcs,
        "secrets": secrets(facts, imps),
        "triggers": trig,
        "signature": main_signature(facts),
        "steps": steps,
    }
