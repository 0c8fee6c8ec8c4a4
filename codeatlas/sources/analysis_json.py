"""A3, A4: analysis documents written as JSON and read back.

Written form: a folder of JSON lines, ``projects`` (header records), ``scripts``
(the script object with its nested steps, services, triggers, signature and
summaries, so no larger than a script) and ``connections``; no record grows with
the size of a project. Read form: such a folder, or documents that nest a whole
project in one object (``path``, ``scripts``, ``connections``, ...).

Reading is by record: optional keys that are absent become empty arrays, nulls
or false, ``contextual_steps`` keys become integers, and a record that is not an
object of the right form or lacks a required key goes to ``rejects`` with the
reason, alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERVICE = "struct<name:string,library:string,icon:string>"
STEP = f"struct<line_number:bigint,type:string,description:string,function_name:string,service:{SERVICE},inputs:array<string>,outputs:array<string>>"
TRIGGER = "struct<type:string,detail:string>"
TEXTS = "map<string,string>"
SCRIPT = (f"project_id string, path string, is_entry_point boolean, steps array<{STEP}>, imports_internal array<string>, imports_external array<string>, "
          f"services array<{SERVICE}>, secrets array<string>, triggers array<{TRIGGER}>, signature string, summary string, phase_summaries {TEXTS}, "
          f"contextual_steps {TEXTS}, phase_risks {TEXTS}, data_flow string, _corrupt_record string")
CONNECTION = "project_id string, source string, target string, type string, detail string, pos bigint, _corrupt_record string"
PROJECT = f"path string, services array<{SERVICE}>, secrets array<string>, entry_points array<string>, summary string, _corrupt_record string"
# in a nested document children stay text until each is read on its own
DOCUMENT = "path string, scripts array<string>, connections array<string>, services string, secrets string, entry_points string, summary string, _corrupt_record string"
SCRIPT_LISTS = ("steps", "imports_internal", "imports_external", "services", "secrets", "triggers")


# --------------------------------------------------------------------------
# writing
# --------------------------------------------------------------------------

def _ordered(col: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(col)), lambda x: x["v"])


def signatures(params: DataFrame) -> DataFrame:
    """(project_id, path, signature): parameter -> type and default, in order;
    a default is JSON of any form."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "param", "annotation", "default_json")))
    member = F.transform(listed, lambda p: F.struct(p["param"], F.named_struct(F.lit("type"), p["annotation"], F.lit("default"), F.try_parse_json(p["default_json"]))))
    return params.groupBy("project_id", "path").agg(F.map_from_entries(member).alias("signature"))


def script_documents(scripts: DataFrame, steps: DataFrame, imports_df: DataFrame, services: DataFrame,
                     secrets: DataFrame, triggers: DataFrame, params: DataFrame | None = None, fields: DataFrame | None = None) -> DataFrame:
    """A3. One nested record per script; child lists are ordered and bounded by
    the script's own size. ``params``: main() parameters (B6); ``fields``:
    summaries of the replies (I6)."""
    k = ["project_id", "path"]
    st = steps.groupBy(*k).agg(_ordered(F.struct(F.col("pos"), F.struct(
        F.col("line_number").cast("long").alias("line_number"), "type", "description", "function_name", "service",
        "inputs", "outputs").alias("v"))).alias("steps"))
    im = imports_df.groupBy(*k).agg(
        F.array_sort(F.collect_list(F.when(F.col("is_internal"), F.col("import")))).alias("imports_internal"),
        F.array_sort(F.collect_list(F.when(~F.col("is_internal"), F.col("import")))).alias("imports_external"))
    sv = services.groupBy(*k).agg(_ordered(F.struct("pos", F.struct("name", "library", "icon").alias("v")))
                                  .alias("services"))
    se = secrets.groupBy(*k).agg(F.array_sort(F.collect_set("secret")).alias("secrets"))
    tr = triggers.groupBy(*k).agg(_ordered(F.struct("pos", F.struct("type", "detail").alias("v"))).alias("triggers"))
    doc = (scripts.select(*k, "is_entry_point").join(st, k, "left").join(im, k, "left").join(sv, k, "left")
           .join(se, k, "left").join(tr, k, "left"))
    if params is not None:
        doc = doc.join(signatures(params), k, "left")
    return doc if fields is None else doc.join(fields, k, "left")


def project_documents(scripts: DataFrame, proj_services: DataFrame, proj_secrets: DataFrame, entry_points: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """A3. Header records: path, services, secrets, entry_points, summary."""
    k = "project_id"
    sv = proj_services.groupBy(k).agg(_ordered(F.struct("pos", F.struct("name", "library", "icon").alias("v"))).alias("services"))
    se = proj_secrets.groupBy(k).agg(F.array_sort(F.collect_set("secret")).alias("secrets"))
    en = entry_points.groupBy(k).agg(F.array_sort(F.collect_set("path")).alias("entry_points"))
    doc = scripts.select(k).distinct().join(sv, k, "left").join(se, k, "left").join(en, k, "left")
    if summaries is not None:
        doc = doc.join(summaries.select(k, "summary"), k, "left")
    return doc.withColumnRenamed(k, "path")


def write_documents(docs: DataFrame, conns: DataFrame, folder: str, projects: DataFrame | None = None) -> None:
    if projects is None:
        projects = docs.select(F.col("project_id").alias("path")).distinct()
    for name, df in (("projects", projects), ("scripts", docs), ("connections", conns)):
        df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(f"{folder}/{name}")


# --------------------------------------------------------------------------
# reading
# --------------------------------------------------------------------------

def _lacking(items: str, *keys: str, within: str = "") -> Column:
    """Places of required keys that the objects of a list lack."""
    def of(x: Column, i: Column) -> list[Column]:
        whole = x[within] if within else x
        found = [F.when(whole.isNotNull() if within else F.lit(True), F.when(whole[k].isNull(), F.concat(F.lit(f"{items}["), i.cast("string"), F.lit(f"].{within + '.' if within else ''}{k}")))) for k in keys]
        return found
    return F.flatten(F.transform(F.coalesce(F.col(items), F.array()), lambda x, i: F.array(*of(x, i))))


def _parsed(raw: DataFrame, schema: str, problems) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of ``raw`` (project_id, json); ``problems()`` lists the
    reasons as an array column, nulls left out."""
    read = raw.select(F.col("project_id").alias("of"), "json", F.from_json("json", schema, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("x")).select("of", "json", "x.*")
    own = F.coalesce("project_id", "of") if "project_id" in read.columns else F.col("of")
    read = read.withColumn("project_id", own).drop("of")
    broken = F.col("_corrupt_record").isNotNull() & F.forall(F.array(*[F.col(c).isNull() for c in read.columns if c not in ("json", "project_id", "_corrupt_record")]), lambda n: n)
    reasons = F.when(F.col("json").isNull() | broken, F.array(F.lit("malformed"))).otherwise(F.array_compact(F.concat(*problems())))
    checked = read.withColumn("reasons", reasons)
    good = checked.where(F.size("reasons") == 0).drop("json", "reasons", "_corrupt_record")
    return good, checked.where(F.size("reasons") > 0).select("project_id", F.array_join("reasons", ", ").alias("reason"), "json")


def _required(*keys: str) -> Column:
    return F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in keys])


def _scripts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    numbers = F.transform(F.map_keys("contextual_steps"), lambda k: F.when(F.trim(k).try_cast("int").isNull(), F.concat(F.lit("contextual_steps."), k)))
    good, bad = _parsed(raw, SCRIPT, lambda: [
        _required("path"), _lacking("steps", "line_number", "type", "description"), _lacking("steps", "name", "library", within="service"),
        _lacking("services", "name", "library"), _lacking("triggers", "type", "detail"), F.coalesce(numbers, F.array().cast("array<string>"))])
    types = {f.name: f.dataType for f in good.schema.fields}
    for c in SCRIPT_LISTS:
        good = good.withColumn(c, F.coalesce(F.col(c), F.array().cast(types[c])))
    empty = F.array().cast("array<string>")
    good = good.withColumn("steps", F.transform("steps", lambda s: s.withField("inputs", F.coalesce(s["inputs"], empty)).withField("outputs", F.coalesce(s["outputs"], empty))))
    lines = F.when(F.size("contextual_steps") > 0, F.transform_keys("contextual_steps", lambda k, v: F.trim(k).cast("int")))
    return good.withColumn("is_entry_point", F.coalesce("is_entry_point", F.lit(False))).withColumn("contextual_steps", lines), bad


def _connections(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _parsed(raw, CONNECTION, lambda: [_required("source", "target", "type", "detail")])


def _projects(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    good, bad = _parsed(raw, PROJECT, lambda: [_required("path"), _lacking("services", "name", "library")])
    types = {f.name: f.dataType for f in good.schema.fields}
    for c in ("services", "secrets", "entry_points"):
        good = good.withColumn(c, F.coalesce(F.col(c), F.array().cast(types[c])))
    return good.withColumn("project_id", F.col("path")), bad


def _analysis(projects: DataFrame, scripts: DataFrame, connections: DataFrame) -> dict[str, DataFrame]:
    parts = {"projects": _projects(projects), "scripts": _scripts(scripts), "connections": _connections(connections)}
    rejects = [bad.select(F.lit(name).alias("kind"), "project_id", "reason", "json") for name, (_, bad) in parts.items()]
    return {name: good for name, (good, _) in parts.items()} | {"rejects": rejects[0].unionByName(rejects[1]).unionByName(rejects[2])}


def read_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A4. projects, scripts, connections and rejects of a written folder."""
    def lines(name: str) -> DataFrame:
        return spark.read.text(f"{folder}/{name}").select(F.lit(None).cast("string").alias("project_id"), F.col("value").alias("json"))
    return _analysis(lines("projects"), lines("scripts"), lines("connections"))


def read_nested(spark: SparkSession, *paths: str) -> dict[str, DataFrame]:
    """A4. The same of documents that nest a whole project each. A document
    without a path (or that is no object) is rejected with all that it holds."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(list(paths))
    sound = docs.where("path is not null")
    def raw(c: str) -> Column:
        return F.from_json(c, "variant")
    header = F.to_json(F.struct("path", raw("services").alias("services"), raw("secrets").alias("secrets"), raw("entry_points").alias("entry_points"), "summary"))
    children = {c: sound.select(F.col("path").alias("project_id"), F.explode(c).alias("json")) for c in ("scripts", "connections")}
    found = _analysis(sound.select(F.col("path").alias("project_id"), header.alias("json")), children["scripts"], children["connections"])
    lost = docs.where("path is null").select(F.lit("document").alias("kind"), F.lit(None).cast("string").alias("project_id"),
                                             F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed")).otherwise(F.lit("path")).alias("reason"), F.col("_corrupt_record").alias("json"))
    return found | {"rejects": found["rejects"].unionByName(lost)}


def read_scripts(spark: SparkSession, folder: str) -> DataFrame:
    return read_folder(spark, folder)["scripts"]


def read_connections(spark: SparkSession, folder: str) -> DataFrame:
    return read_folder(spark, folder)["connections"]
