"""Test corpus derived from the driver's ``events`` table.

The test tables hold no source code, so a corpus of Python scripts is derived
from ``events`` by arithmetic only (no hashing), so that the same rows can be
derived by plain SQL in the oracle:

* one script per ``(user_id, chunk)``; ``chunk = slot div SLOTS_PER_FILE`` bounds
  every file even when one user holds a third of all events;
* ``slot`` = dense rank of ``event_id`` inside the user, computed without a
  window over the whole (possibly huge) user: counts per ``(user, event_id
  bucket)`` are prefix-summed, then ranked inside a bucket (a bucket holds at
  most ``EVENT_BUCKET`` events);
* each event picks one code template; a file is a header of imports followed
  by three physical lines per slot (def-or-comment, code, tail).

The templates also list what a correct analysis must find on their line
(steps, triggers, secrets, main() parameters); those expected rows feed the
downstream queries and the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS_PER_FILE = 120
SLOTS_PER_BLOCK = 12
EVENT_BUCKET = 1 << 16

# Import headers, chosen by user_id % 6. Tokens are substituted per user.
HEADERS = (
    ("import os", "import json", "import requests"),
    ("import os", "import openai", "from decouple import config"),
    ("import httpx", "import requests", "from google.cloud import storage"),
    ("import logging", "import sqlite3", "import m{p}c0", "from . import helpers"),
    ("import argparse", "import boto3", "from slack_sdk import WebClient", "import schedule"),
    ("import csv", "import sqlalchemy.orm", "from pymongo import MongoClient",
     "from pathlib import Path", "from m{p2}c0 import run"),
)
# Imports each header yields (module names, before internal/external split).
HEADER_IMPORTS = (
    ("json", "os", "requests"),
    ("decouple", "openai", "os"),
    ("google.cloud", "google.cloud.storage", "httpx", "requests"),
    ("logging", "m{p}c0", "sqlite3"),
    ("argparse", "boto3", "schedule", "slack_sdk"),
    ("csv", "m{p2}c0", "pathlib", "pymongo", "sqlalchemy.orm"),
)
SECRET_NAMES = ("OPENAI_API_KEY", "DB_PASSWORD", "SHEET_ID", "slack_bot_token", "my_service_api_key")

# Template: code line, tail line (None -> comment), expected steps, triggers,
# secrets, main() params.
#   step    = (type, description, service object or None, cond, inputs, outputs)
#             cond 'svc': the step exists only when the object is a service key
#             of the script (import-dependent SDK call); inputs/outputs '|'-joined
#   trigger = (type, detail, depth below the statement node)
#   secret  = (name, cond) cond 'decouple': only when the file imports decouple
#   param   = (name, annotation or None, default as JSON text or None)
TEMPLATES = (
    ("n = len(items)", None, [("transform", "len()", None, None, "", "n")], [], [], []),
    ("total = int(value)", None, [("transform", "int()", None, None, "", "total")], [], [], []),
    ("label = str(code)", None, [("transform", "str()", None, None, "", "label")], [], [], []),
    ("ratio = float(raw)", None, [("transform", "float()", None, None, "", "ratio")], [], [], []),
    ("parts = line.split(',')", None, [("transform", ".split()", None, None, "", "parts")], [], [], []),
    ("print('row', {s})", None, [("output", "print()", None, None, "", "")], [], [], []),
    ("keys = [k.strip() for k in names]", None,
     [("transform", "list comprehension: [k.strip() for ...]", None, None, "", "keys"),
      ("transform", ".strip()", None, None, "", "keys")], [], [], []),
    ("total = sum(int(v) for v in vals)", None,
     [("transform", "sum()", None, None, "", "total"), ("transform", "int()", None, None, "", "total")],
     [], [], []),
    ("if count_{m} > limit: pass", None,
     [("decision", "if count_{m} > limit", None, None, "count_{m}|limit", "")], [], [], []),
    ("print(f'done {n}')", None, [("output", "print()", None, None, "", "")], [], [], []),
    ("for row in rows: pass", None, [("decision", "for row in rows", None, None, "rows", "")], [], [], []),
    ("out = sorted(set(keys))", None,
     [("transform", "sorted()", None, None, "", "out"), ("transform", "set()", None, None, "", "out")],
     [], [], []),
    ("r = requests.get(url_{m})", None, [("api_call", "requests.get()", "requests", None, "", "r")], [], [], []),
    ("requests.post(api, json=body)", None, [("api_call", "requests.post()", "requests", None, "", "")],
     [], [], []),
    ("client.delete(item_{s})", None, [("api_call", "client.delete()", "client", None, "", "")], [], [], []),
    ("data = json.load(fh)", None, [("file_io", "json.load()", None, None, "", "data")], [], [], []),
    ("json.dump(rows, fh)", None, [("file_io", "json.dump()", None, None, "", "")], [], [], []),
    ("with open('data_{u}.csv', 'w') as fh: pass", None,
     [("file_io", "open('data_{u}.csv')", None, None, "", "data_{u}.csv")], [], [], []),
    ("rows = open('data_{q}.csv').read()", None,
     [("file_io", "open('data_{q}.csv')", None, None, "data_{q}.csv", "rows")], [], [], []),
    ("text = Path('notes.txt').read_text()", None, [("file_io", ".read_text()", None, None, "", "text")],
     [], [], []),
    ("cursor.execute(query)", None, [("db_op", "cursor.execute()", None, None, "", "")], [], [], []),
    ("conn.commit()", None, [("db_op", "conn.commit()", None, None, "", "")], [], [], []),
    ("openai.chat(prompt)", None, [("api_call", "openai.chat()", "openai", "svc", "", "")], [], [], []),
    ("storage.upload(blob)", None, [("api_call", "storage.upload()", "storage", "svc", "", "")], [], [], []),
    ("schedule.every(5).minutes.do(job)", None,
     [("api_call", "schedule.every()", "schedule", "svc", "", "")], [("cron", "schedule job", 1)], [], []),
    ("db.query(User)", None, [("db_op", "db.query()", None, None, "", "")], [], [], []),
    ("session.add(item)", None, [("db_op", "session.add()", None, None, "", "")], [], [], []),
    ("session.get(key)", None, [("api_call", "session.get()", "session", None, "", "")], [], [], []),
    ("name = ', '.join(parts)", None, [("transform", ".join()", None, None, "", "name")], [], [], []),
    ("msg = text.lower().replace('a', 'b')", None,
     [("transform", ".replace()", None, None, "", "msg"), ("transform", ".lower()", None, None, "", "msg")],
     [], [], []),
    ("buf = payload.encode()", None, [("transform", ".encode()", None, None, "", "buf")], [], [], []),
    ("obj = json.loads(raw)", None, [("transform", ".loads()", None, None, "", "obj")], [], [], []),
    ("while retries < 3: pass", None, [("decision", "while retries < 3", None, None, "retries", "")],
     [], [], []),
    ("if not os.path.exists(path_{m}): pass", None,
     [("decision", "if not os.path.exists(path_{m})", None, None, "os|path_{m}", "")], [], [], []),
    ("if config.get('enabled'): pass", None,
     [("decision", "if config.get('enabled')", None, None, "config", "")], [], [], []),
    ("if user is None: pass", None, [("decision", "if user is None", None, None, "user", "")], [], [], []),
    ("key = os.getenv('{sec}')", None, [], [], [("{sec}", None)], []),
    ("token = os.environ['GITHUB_TOKEN']", None, [], [], [("GITHUB_TOKEN", None)], []),
    ("region = os.environ.get('AWS_REGION', 'x')", None, [], [], [("AWS_REGION", None)], []),
    ("api = config('STRIPE_KEY_{m}')", None, [], [], [("STRIPE_KEY_{m}", "decouple")], []),
    ("parser = argparse.ArgumentParser()", None, [], [("cli", "argparse", 1)], [], []),
    ("@app.get('/items/{s}')", "def h{s}(): pass", [], [("webhook", "GET /items/{s}", 0)], [], []),
    ("@click.command()", "def c{s}(): pass", [], [("cli", "click/typer: c{s}", 0)], [], []),
    ("@modal.function()", "def mf{s}(): pass", [], [("webhook", "modal function: mf{s}", 0)], [], []),
    ("if __name__ == '__main__': pass", None, [], [("cli", "__main__ guard", 0)], [], []),
    ("def main(src: str, limit=10): pass", None, [], [], [],
     [("src", "str", None), ("limit", None, "10")]),
    ("rows.append(item)", None, [("transform", ".append()", None, None, "", "")], [], [], []),
    ("scheduler.add_job(job, 'cron')", None, [], [("cron", "apscheduler job", 1)], [], []),
    ("subprocess.run(cmd_{s})", None, [], [], [], []),
    ("try: pass", "except Exception: pass", [("decision", "try/except block", None, None, "", "")], [], [], []),
    ("try: x = int(raw)", "except ValueError: pass",
     [("decision", "try/except block", None, None, "", "x"), ("transform", "int()", None, None, "", "x")],
     [], [], []),
    ("try: data = requests.get(url)", "except Exception: pass",
     [("decision", "try/except block", None, None, "", "data"),
      ("api_call", "requests.get()", "requests", None, "", "data")], [], [], []),
    ("logger.info('step {s}')", None, [("output", "logger.info()", None, None, "", "")], [], [], []),
    ("logging.error('failed')", None, [("output", "logging.error()", None, None, "", "")], [], [], []),
    ("logger.warning('slow')", None, [("output", "logger.warning()", None, None, "", "")], [], [], []),
    ("log.debug('x')", None, [("output", "log.debug()", None, None, "", "")], [], [], []),
    ("uniq = {k.lower() for k in names}", None,
     [("transform", "set comprehension: {k.lower() for ...}", None, None, "", "uniq"),
      ("transform", ".lower()", None, None, "", "uniq")], [], [], []),
    ("index = {k: v for k, v in pairs_{m}}", None,
     [("transform", "dict comprehension: {k: v for ...}", None, None, "", "index")], [], [], []),
)
N_TEMPLATES = len(TEMPLATES)
# Template index whose line also carries a launch step (an api_call naming a
# script path, as an imported analysis can hold; never produced by parsing).
LAUNCH_TEMPLATE = 48
LAUNCH_DESCRIPTION = "subprocess.run('d{pd}/m{p}c0.py')"
# Users draw from a prefix of the template list by flavour (user_id % 4):
# all, no logging, no logging and no try blocks, first twelve only.
FLAVOUR_MODULI = (N_TEMPLATES, N_TEMPLATES - 4, N_TEMPLATES - 7, 12)


# --------------------------------------------------------------------------
# small dimension tables (fixed size, safe to broadcast)
# --------------------------------------------------------------------------

def _templates_df(spark: SparkSession) -> DataFrame:
    rows = [(i, code, tail or "# end") for i, (code, tail, *_rest) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template int, code string, tail string")


def template_steps_df(spark: SparkSession) -> DataFrame:
    rows = []
    for i, t in enumerate(TEMPLATES):
        for k, (typ, desc, obj, cond, ins, outs) in enumerate(t[2]):
            rows.append((i, k, typ, desc, obj, cond, ins, outs, "code"))
    rows.append((LAUNCH_TEMPLATE, 0, "api_call", LAUNCH_DESCRIPTION, None, None, "", "", "launch"))
    return spark.createDataFrame(
        rows, "template int, k int, type string, description string, obj string, cond string, "
              "inputs string, outputs string, src string")


def template_triggers_df(spark: SparkSession) -> DataFrame:
    rows = [(i, typ, det, d) for i, t in enumerate(TEMPLATES) for (typ, det, d) in t[3]]
    return spark.createDataFrame(rows, "template int, type string, detail string, depth_add int")


def template_secrets_df(spark: SparkSession) -> DataFrame:
    rows = [(i, name, cond) for i, t in enumerate(TEMPLATES) for (name, cond) in t[4]]
    return spark.createDataFrame(rows, "template int, name string, cond string")


def template_params_df(spark: SparkSession) -> DataFrame:
    rows = [(i, j, p, a, d) for i, t in enumerate(TEMPLATES) for j, (p, a, d) in enumerate(t[5])]
    return spark.createDataFrame(rows, "template int, ord int, param string, annotation string, "
                                       "default_json string")


def header_imports_df(spark: SparkSession) -> DataFrame:
    rows = [(h, imp) for h, imps in enumerate(HEADER_IMPORTS) for imp in imps]
    return spark.createDataFrame(rows, "hdr int, import string")


def _headers_df(spark: SparkSession) -> DataFrame:
    rows = [(h, "\n".join(lines) + "\n", len(lines)) for h, lines in enumerate(HEADERS)]
    return spark.createDataFrame(rows, "hdr int, header string, header_lines int")


# --------------------------------------------------------------------------
# token substitution
# --------------------------------------------------------------------------

FILE_TOKENS = ("{sec}", "{pd}", "{p2}", "{p}", "{q}", "{u}", "{m}")  # the same in a whole file
SLOT_TOKEN = "{s}"


def subst(c: Column, tokens: tuple[str, ...] | None = None) -> Column:
    """Replace the per-user / per-slot tokens of a template string, or only ``tokens``."""
    u = F.col("user_id")
    secret = F.element_at(F.array(*[F.lit(s) for s in SECRET_NAMES]), (u % 5 + 1).cast("int"))
    values = (
        ("{sec}", secret),
        ("{pd}", ((u + 7) % 3).cast("string")),
        ("{p2}", (u + 14).cast("string")),
        ("{p}", (u + 7).cast("string")),
        ("{q}", (u - 7).cast("string")),
        ("{u}", u.cast("string")),
        ("{m}", (u % 5).cast("string")),
        (SLOT_TOKEN, F.col("sif").cast("string")),
    )
    out = c
    for token, value in values:
        if tokens is None or token in tokens:
            out = F.replace(out, F.lit(token), value)
    return out


# --------------------------------------------------------------------------
# corpus derivation
# --------------------------------------------------------------------------

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dense_slots(events: DataFrame) -> DataFrame:
    """(event_id, user_id, slot): dense 0-based rank of event_id within user_id.

    No window spans a whole user: a hot user is split into event_id buckets
    whose sizes are prefix-summed (one small row per bucket), then each bucket
    (at most EVENT_BUCKET rows) is ranked on its own.
    """
    ev = events.select("event_id", "user_id").withColumn(
        "bucket", F.floor(F.col("event_id") / F.lit(EVENT_BUCKET)))
    counts = ev.groupBy("user_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    w_prev = Window.partitionBy("user_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(w_prev), F.lit(0))).drop("n")
    w_in = Window.partitionBy("user_id", "bucket").orderBy("event_id")
    return (ev.join(offsets, ["user_id", "bucket"])
              .withColumn("slot", (F.col("offset") + F.row_number().over(w_in) - 1).cast("long"))
              .drop("bucket", "offset"))


def corpus_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event placed in the corpus: file, slot, line, template."""
    ev = dense_slots(read_table(spark, sf_dir, "events"))
    u = F.col("user_id")
    flavour_mod = F.element_at(F.array(*[F.lit(m) for m in FLAVOUR_MODULI]), (u % 4 + 1).cast("int"))
    headers = F.broadcast(_headers_df(spark).select("hdr", "header_lines"))
    df = (ev
          .withColumn("chunk", F.floor(F.col("slot") / SLOTS_PER_FILE))
          .withColumn("sif", (F.col("slot") % SLOTS_PER_FILE).cast("int"))
          .withColumn("block", (F.col("sif") / SLOTS_PER_BLOCK).cast("int"))
          .withColumn("in_func", F.col("block") % 3 != 2)
          .withColumn("hdr", (u % 6).cast("int"))
          .withColumn("template", ((F.col("event_id") * 31 + u) % flavour_mod).cast("int"))
          .withColumn("project_id", F.concat(F.lit("p"), (u % 7).cast("string")))
          .withColumn("path", F.concat(F.lit("d"), (u % 3).cast("string"), F.lit("/m"), u.cast("string"),
                                       F.lit("c"), F.col("chunk").cast("string"), F.lit(".py")))
          .join(headers, "hdr")
          .withColumn("line", (F.col("header_lines") + 3 * F.col("sif") + 2).cast("int"))
          .withColumn("function_name",
                      F.when(F.col("in_func"), F.concat(F.lit("f"), F.col("block").cast("string")))))
    return df


def corpus_files(spark: SparkSession, sf_dir: str, ce: DataFrame | None = None) -> DataFrame:
    """(project_id, path, user_id, hdr): one row per derived script."""
    return ((corpus_events(spark, sf_dir) if ce is None else ce)
            .groupBy("project_id", "path", "user_id", "hdr").agg(F.count(F.lit(1)).alias("n_slots")))


def source_files(spark: SparkSession, sf_dir: str, ce: DataFrame | None = None) -> DataFrame:
    """(project_id, path, length, content) of the derived corpus.

    A file is assembled from at most SLOTS_PER_FILE slots, so the ordered
    collect per file is bounded whatever the skew of user_id. Only the slot's own
    token is replaced slot by slot, the others once in the whole file.
    """
    ce = (corpus_events(spark, sf_dir) if ce is None else ce).join(F.broadcast(_templates_df(spark)), "template")
    ind = F.when(F.col("in_func"), F.lit("    ")).otherwise(F.lit(""))
    first = F.when(F.col("in_func") & (F.col("sif") % SLOTS_PER_BLOCK == 0),
                   F.concat(F.lit("def f"), F.col("block").cast("string"), F.lit("():"))) \
             .otherwise(F.concat(F.lit("# "), F.col("sif").cast("string")))
    text = subst(F.concat(first, F.lit("\n"), ind, F.col("code"), F.lit("\n"), ind, F.col("tail"), F.lit("\n")), (SLOT_TOKEN,))
    per_file = (ce.withColumn("text", text)
                  .groupBy("project_id", "path", "user_id", "hdr")
                  .agg(F.array_sort(F.collect_list(F.struct("sif", "text"))).alias("slots")))
    headers = F.broadcast(_headers_df(spark).select("hdr", "header"))
    return (per_file.join(headers, "hdr")
            .withColumn("content", subst(F.concat("header", F.array_join(F.transform("slots", lambda s: s["text"]), "")), FILE_TOKENS))
            .select("project_id", "path", F.length("content").cast("long").alias("length"), "content"))


def corpus_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, path, import) expected from the headers, before the split."""
    files = corpus_files(spark, sf_dir).withColumn("sif", F.lit(0))
    return (files.join(F.broadcast(header_imports_df(spark)), "hdr")
            .select("project_id", "path", subst(F.col("import")).alias("import")))


# --------------------------------------------------------------------------
# expected analysis of the corpus (what a correct parse must yield)
# --------------------------------------------------------------------------

def corpus_listing(spark: SparkSession, sf_dir: str, ce: DataFrame | None = None) -> DataFrame:
    """(project_id, path) of every derived script."""
    return corpus_files(spark, sf_dir, ce).select("project_id", "path")


def expected_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeatlas.operators.extract import local_modules
    mods = local_modules(corpus_listing(spark, sf_dir)).select("project_id", "module",
                                                               F.lit(True).alias("is_internal"))
    imp = corpus_imports(spark, sf_dir).withColumn("module", F.split_part("import", F.lit("."), F.lit(1)))
    return (imp.join(mods, ["project_id", "module"], "left")
            .select("project_id", "path", "import", F.coalesce("is_internal", F.lit(False)).alias("is_internal")))


def corpus_steps(spark: SparkSession, sf_dir: str, include_launch: bool = True) -> DataFrame:
    """Expected ``steps`` of the corpus (B7–B11 + C3 semantics from templates).

    With ``include_launch`` the launch rows (api_call steps naming a script, as
    imported analyses carry) are added; downstream queries start from here.
    """
    from codeatlas.operators.extract import script_services, service_keys, SERVICE_STRUCT
    keys = service_keys(script_services(spark, expected_imports(spark, sf_dir)))
    ts = template_steps_df(spark)
    if not include_launch:
        ts = ts.where(F.col("src") == "code")
    ev = corpus_events(spark, sf_dir).select("project_id", "path", "user_id", "sif", "line", "template",
                                             "function_name")
    joined = (ev.join(F.broadcast(ts), "template")
              .join(keys.withColumnRenamed("key", "obj"), ["project_id", "path", "obj"], "left")
              .where(F.col("cond").isNull() | F.col("service").isNotNull()))

    def arr(c):
        return F.filter(F.split(subst(c), r"\|"), lambda x: x != "")

    w = Window.partitionBy("project_id", "path").orderBy("line", "k")
    return joined.select(
        "project_id", "path", (F.row_number().over(w) - 1).cast("int").alias("pos"),
        F.col("line").alias("line_number"), "type", subst(F.col("description")).alias("description"),
        "function_name",
        F.when(F.col("type") == "api_call", F.col("service")).cast(SERVICE_STRUCT).alias("service"),
        arr(F.col("inputs")).alias("inputs"), arr(F.col("outputs")).alias("outputs"))


def _stmt_depth() -> Column:
    return F.when(F.col("in_func"), F.lit(2)).otherwise(F.lit(1))


def corpus_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected triggers: first per (type, detail) in walk order (depth, line)."""
    ev = corpus_events(spark, sf_dir)
    t = (ev.join(F.broadcast(template_triggers_df(spark)), "template")
         .select("project_id", "path", "type", subst(F.col("detail")).alias("detail"),
                 F.struct((_stmt_depth() + F.col("depth_add")).alias("d"), F.col("line").alias("l")).alias("o")))
    first = t.groupBy("project_id", "path", "type", "detail").agg(F.min("o").alias("o"))
    w = Window.partitionBy("project_id", "path").orderBy("o")
    return first.select("project_id", "path", (F.row_number().over(w) - 1).cast("int").alias("pos"),
                        "type", "detail")


def corpus_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = corpus_events(spark, sf_dir)
    return (ev.join(F.broadcast(template_secrets_df(spark)), "template")
            .where(F.col("cond").isNull() | (F.col("hdr") == 1))
            .select("project_id", "path", subst(F.col("name")).alias("secret")).distinct())


def corpus_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, path, is_entry_point) for every derived script."""
    from codeatlas.operators.extract import entry_points
    return entry_points(corpus_listing(spark, sf_dir), corpus_triggers(spark, sf_dir))


def corpus_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeatlas.operators.extract import script_services
    return script_services(spark, expected_imports(spark, sf_dir))


# --------------------------------------------------------------------------
# model replies, from the texts of ``conversations``
# --------------------------------------------------------------------------

REPLY_KEYS = 40         # step entries of a phase reply
REPLY_LINES = 125       # lines that they name
ASCII_DIGITS, OTHER_DIGITS = "0123456789", "٠١٢٣٤٥٦٧٨٩"


def _json_text(c: Column) -> Column:
    """A string as a JSON string."""
    array = F.to_json(F.array(c))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def _conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation ``conv_id`` speaks of the first script of user ``conv_id``."""
    user = F.col("conv_id").cast("string")
    return read_table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("p"), (F.col("conv_id") % 7).cast("string")).alias("project_id"),
        F.concat(F.lit("d"), (F.col("conv_id") % 3).cast("string"), F.lit("/m"), user, F.lit("c0.py")).alias("path"),
        "conv_id", "turn", "role", "text")


def phase_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, path, phase, raw): turns 0-4 answer the five phase prompts of
    a script, in eight shapes by ``(conv_id + turn) % 8``: JSON, fenced JSON, JSON
    between chatter, truncated, inside an array, two objects, repeated members
    with NaN, and fenced with a blank risk. Step keys name arithmetic lines,
    plain, signed, spaced, with an underscore, in other digits, or as decimals;
    their values are words of the text, NaN or null.

    Rows are dealt evenly before the replies are made: a reply is much more work
    than its row's bytes, by which a scan is split. A text is split once."""
    from codeatlas import rules as R
    rows = _conversation_rows(spark, sf_dir).where("turn between 0 and 4").repartition(4 * spark.sparkContext.defaultParallelism)
    rows = rows.withColumn("words", F.split("text", " "))
    words = F.col("words")

    def entry(k: Column) -> Column:
        n = (2 + (F.col("conv_id") * 7 + F.col("turn") * 3 + k * k) % REPLY_LINES).cast("string")
        key = (F.when(k % 6 == 1, F.concat(F.lit("+"), n)).when(k % 6 == 2, F.concat(F.lit(" "), n, F.lit(" ")))
               .when((k % 6 == 3) & (F.length(n) > 1), F.concat(F.substring(n, 1, 1), F.lit("_"), F.substring(n, 2, 9)))
               .when(k % 6 == 4, F.translate(n, ASCII_DIGITS, OTHER_DIGITS)).when(k % 6 == 5, F.concat(n, F.lit(".0"))).otherwise(n))
        word = F.element_at(words, ((k * 3) % F.size(words) + 1).cast("int"))
        value = F.when(k % 7 == 3, F.lit("NaN")).when(k % 7 == 5, F.lit("null")).otherwise(_json_text(word))
        return F.concat(F.lit('"'), key, F.lit('": '), value)

    v = (F.col("conv_id") + F.col("turn")) % 8
    steps = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(REPLY_KEYS - 1)), entry), ", ")
    risk = F.when(v == 6, F.lit("NaN")).when(v == 7, F.lit('"  "')).otherwise(_json_text(F.col("role")))
    body = F.concat(F.when(v == 6, F.lit('{"phase_summary": 1, ')).otherwise(F.lit("{")), F.lit('"phase_summary": '), _json_text(F.col("text")),
                    F.lit(', "steps": {'), steps, F.lit('}, "risk": '), risk, F.lit("}"))
    b = F.col("body")
    raw = (F.when(F.col("v") == 1, F.concat(F.lit("```json\n"), b, F.lit("\n```")))
           .when(F.col("v") == 2, F.concat(F.lit("Thinking about it.\n"), b, F.lit("\nHope this helps!")))
           .when(F.col("v") == 3, F.substring(b, F.lit(1), F.length(b) - 1)).when(F.col("v") == 4, F.concat(F.lit("["), b, F.lit("]")))
           .when(F.col("v") == 5, F.concat(b, F.lit("\n"), b)).when(F.col("v") == 7, F.concat(F.lit("```\n"), b, F.lit("\n```"))).otherwise(b))
    phase = F.element_at(F.array(*[F.lit(p) for p, _ in R.PHASES]), (F.col("turn") + 1).cast("int"))
    return rows.select("project_id", "path", phase.alias("phase"), v.alias("v"), body.alias("body")).select("project_id", "path", "phase", raw.alias("raw"))


def summary_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, path, kind, raw): turn 5 answers a script's prompt, turn 6 its
    data-flow prompt, turn 7 of a project's first such conversation the project's
    (path ``''``)."""
    rows = _conversation_rows(spark, sf_dir)
    script = rows.where("turn in (5, 6)").select("project_id", "path", F.when(F.col("turn") == 5, F.lit("script")).otherwise(F.lit("data_flow")).alias("kind"), F.col("text").alias("raw"))
    project = (rows.where("turn = 7").groupBy("project_id").agg(F.min_by("text", "conv_id").alias("raw"))
               .select("project_id", F.lit("").alias("path"), F.lit("project").alias("kind"), "raw"))
    return script.unionByName(project)
