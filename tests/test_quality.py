"""Findings and health at every threshold boundary (G1–G7), profiles."""

from pyspark.sql import functions as F

from codeatlas.operators import profile as P
from codeatlas.operators import quality as G
from helpers import steps_df


def _ids(spark, rows):
    s = steps_df(spark, rows)
    return sorted((r.id, r["count"]) for r in G.findings(s).collect())


def test_print_spam_boundary(spark):
    assert ("print_spam", 4) in _ids(spark, [("output", "print()")] * 4)
    assert not any(i == "print_spam" for i, _ in _ids(spark, [("output", "print()")] * 3))
    # a logger step suppresses it; log.info() is not a logger
    assert not any(i == "print_spam" for i, _ in _ids(spark, [("output", "print()")] * 5 + [("output", "logger.info()")]))
    assert any(i == "print_spam" for i, _ in _ids(spark, [("output", "print()")] * 5 + [("output", "log.info()")]))


def test_try_bulk_and_no_error_boundaries(spark):
    assert ("error_handling_bulk", 6) in _ids(spark, [("decision", "try/except block")] * 6)
    assert not any(i == "error_handling_bulk" for i, _ in _ids(spark, [("decision", "try/except block")] * 5))
    eleven = [("api_call", "requests.get()")] + [("transform", "len()")] * 10
    assert ("no_error_handling", 0) in _ids(spark, eleven)
    assert not any(i == "no_error_handling" for i, _ in _ids(spark, eleven[:10]))
    assert not any(i == "no_error_handling" for i, _ in _ids(spark, [("transform", "len()")] * 11))


def test_transform_heavy_and_imbalance(spark):
    f = _ids(spark, [("transform", "int()")] * 16)
    assert ("transform_heavy", 16) in f and ("phase_imbalance", 16) in f
    assert not any(i == "transform_heavy" for i, _ in _ids(spark, [("transform", "int()")] * 15))
    # exactly half is not dominance
    half = [("transform", "int()")] * 2 + [("api_call", "requests.get()")] * 2
    assert not any(i == "phase_imbalance" for i, _ in _ids(spark, half))


def test_imbalance_detail_and_health(spark):
    rows = [("transform", "len()")] * 4 + [("api_call", "requests.get()")] * 3
    s = steps_df(spark, rows)
    f = G.findings(s).collect()
    assert [r.detail for r in f] == ["Data Processing accounts for 57% of all steps (4/7). "
                                     "This phase may be doing too much."]
    scripts = s.select("project_id", "path").distinct()
    h = G.health(scripts, G.findings(s)).collect()[0]
    assert (h.score, h.color) == ("clean", "green")
    s2 = steps_df(spark, [("output", "print()")] * 4 + [("decision", "try/except block")] * 6)
    h2 = G.health(s2.select("project_id", "path").distinct(), G.findings(s2)).collect()[0]
    assert (h2.score, h2.color, h2.n_warnings) == ("has issues", "amber", 2)


def test_phase_profile_and_first_types(spark):
    s = steps_df(spark, [("api_call", "requests.get()"), ("transform", "len()"), ("transform", "int()"),
                         ("output", "print()"), ("db_op", "db.query()"), ("file_io", "json.dump()")])
    g = {r.phase: (r.n_steps, r.pct, r.pct_shown, r.chip) for r in P.phase_groups(s).collect()}
    assert g["setup"] == (2, 33, False, "Setup") and g["processing"] == (2, 33, False, "Data")
    assert g["storage"] == (1, 16, False, "Storage") and g["reporting"] == (1, 16, False, "Reporting")
    ft = [(r.rank, r.type) for r in P.first_types(s).orderBy("rank").collect()]
    assert ft == [(1, "api_call"), (2, "transform"), (3, "output"), (4, "db_op")]


def test_pattern_insights(spark):
    s = steps_df(spark, [("output", "print()")] * 11 + [("decision", "try/except block")] * 3
                 + [("api_call", "x.post()", "Slack")] * 2 + [("api_call", "x.get()", "HTTP Client")] * 2)
    got = {r.label: r.insight for r in P.pattern_insights(s).collect()}
    assert got["Displays message"].startswith("Excessive output — 11 print() calls")
    assert got["Handles potential errors"].startswith("Defensive coding")
    assert got["Sends data to Slack"] == "Batch updates — pushes data to Slack in 2 operations"
    assert got["Fetches data from HTTP Client"] == "Batch data gathering — collects data from HTTP Client in 2 requests"
