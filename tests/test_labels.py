"""Plain-English labels, phases, trigger/secret/edge labels."""

from pyspark.sql import functions as F

from codeatlas.functions import labels as L
from helpers import steps_df


def _labels(spark, rows):
    s = L.with_labels(steps_df(spark, rows))
    return [(r.label, r.phase) for r in s.orderBy("pos").collect()]


def test_step_labels_and_phases(spark):
    rows = [
        ("api_call", "requests.get()", "HTTP Client"),
        ("api_call", "client.post()"),
        ("api_call", "x.patch()", "Slack"),
        ("api_call", "gc.authorize()", "Google Auth"),
        ("file_io", "json.dump()"),
        ("file_io", "json.load()"),
        ("file_io", "open('a.csv')"),
        ("file_io", "p.stat()"),
        ("db_op", "session.add()"),
        ("db_op", "cursor.execute()"),
        ("decision", "try/except block"),
        ("decision", "for (k, v) in d.items()"),
        ("decision", "while x"),
        ("decision", "if d.get('x')"),
        ("decision", "if not os.path.exists(p)"),
        ("decision", "if not self._token"),
        ("decision", "if user is None"),
        ("decision", "if item['needs_review'] and (not done)"),
        ("decision", "if a.b.c"),
        ("output", "logger.error()"),
        ("output", "logging.warning()"),
        ("output", "log.info()"),
        ("output", "print()"),
        ("transform", "list comprehension: [x for ...]"),
        ("transform", "int()"),
        ("transform", ".loads()"),
        ("transform", "sum()"),
        ("weird_type", "x"),
    ]
    assert _labels(spark, rows) == [
        ("Fetches data from HTTP Client", "setup"),
        ("Sends data to external service", "storage"),
        ("Updates data on Slack", "storage"),
        ("Authenticates with Google Auth", "setup"),
        ("Saves data to file", "storage"),
        ("Reads data from file", "setup"),
        ("Opens file", "setup"),
        ("Reads/writes file", "setup"),
        ("Saves to database", "storage"),
        ("Queries database", "setup"),
        ("Handles potential errors", "error_handling"),
        ("Processes each k", "processing"),
        ("Repeats while condition is met", "processing"),
        ("Checks: d x", "setup"),
        ("Checks: file doesn't exist", "processing"),
        ("Checks: token is missing", "processing"),
        ("Checks: user is empty", "processing"),
        ("Checks: item needs review and not done", "processing"),
        ("Checks: data meets conditions", "processing"),
        ("Records an error", "reporting"),
        ("Records a warning", "reporting"),
        ("Produces output", "reporting"),
        ("Displays message", "reporting"),
        ("Builds a collection of items", "processing"),
        ("Converts data type", "processing"),
        ("Converts data format", "processing"),
        ("Processes data", "processing"),
        ("Weird type", "processing"),
    ]


def test_condition_truncation(spark):
    long_cond = "if " + " and ".join(f"flag_{i}" for i in range(12))
    got = _labels(spark, [("decision", long_cond)])[0][0]
    assert got.startswith("Checks: flag 0 and flag 1") and got.endswith("...")
    assert len(got) == len("Checks: ") + 60


def test_trigger_labels(spark):
    rows = [("cron", "*/30 * * * *"), ("cron", "*/5 * * * *"), ("cron", "0 0 * * 0"), ("schedule", "weird"),
            ("cli", "__main__ guard"), ("cli", "argparse"), ("cli", "click/typer: sync"), ("cli", "other"),
            ("webhook", "POST /items"), ("webhook", "modal endpoint: run"), ("webhook", "GET "),
            ("import", "x"), ("manual", "x"), ("queue", "x")]
    df = spark.createDataFrame(rows, "type string, detail string")
    got = [r.l for r in df.select(L.translate_trigger(F.col("type"), F.col("detail")).alias("l")).collect()]
    assert got == ["Runs every hour", "Runs every 5 minutes", "Runs weekly on Sunday", "Runs on a schedule",
                   "Can be run directly", "Accepts command-line options", "Command: sync",
                   "Run from command line", "Triggered by web request to /items", "Cloud function: run",
                   "Triggered by web request", "Used by other scripts", "Run manually", "Queue"]


def test_secret_labels(spark):
    rows = ["AWS_REGION", "openai_api_key", "MY_SERVICE_API_KEY", "DB_PASSWORD", "_TOKEN", "x2y_SECRET", "SHEET_ID"]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    got = [r.l for r in df.select(L.translate_secret(F.col("s")).alias("l")).collect()]
    assert got == ["AWS credentials", "OpenAI credentials", "My Service credentials", "Db credentials",
                   "API credentials", "X2Y credentials", "Configuration: SHEET_ID"]


def test_connection_verbs(spark):
    df = spark.createDataFrame([("import",), ("file_io",), ("subprocess",), ("trigger",), ("other",)], "t string")
    got = [r.v for r in df.select(L.translate_connection(F.col("t")).alias("v")).collect()]
    assert got == ["uses", "shares data with", "launches", "triggers", "other"]


def test_condition_length_boundary(spark):
    sixty = "x" * 60
    sixty_one = "y" * 61
    got = _labels(spark, [("decision", f"if {sixty}"), ("decision", f"if {sixty_one}")])
    assert got[0][0] == f"Checks: {sixty}"
    assert got[1][0] == "Checks: " + "y" * 57 + "..."
