"""Numbers within groups when a group is dealt into several ranges."""

from pyspark.sql import functions as F

from codeatlas.operators import quality as G
from codeatlas.operators.numbering import numbered
from helpers import steps_df


def test_numbers_across_ranges(spark):
    # one group holds almost all rows; scores tie, names decide
    rows = [("hot", i % 7, f"f{i:04d}") for i in range(3000)] + [("b", 1, "x"), ("b", 2, "x"), ("one", 5, "y")]
    df = spark.createDataFrame(rows, "project_id string, score int, path string").repartition(6)
    out = numbered(df, "project_id", [F.desc("score"), F.asc("path")], "t")
    assert out.columns == ["project_id", "score", "path", "nth", "of"]
    got = sorted((r.project_id, r.nth, r.score, r.path, r.of) for r in out.collect())
    want = []
    for key in ("b", "hot", "one"):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        want += [(key, i + 1, r[1], r[2], len(mine)) for i, r in enumerate(mine)]
    assert got == want


def test_numbers_of_no_rows(spark):
    df = spark.createDataFrame([], "project_id string, path string")
    assert numbered(df, "project_id", [F.col("path")], "t").collect() == []


def test_findings_equal_their_rules(spark):
    s = steps_df(spark, [("transform", "int()")] * 20 + [("output", "print()")] * 5 + [("decision", "try/except block")] * 6
                 + [("api_call", "requests.get()")])
    counts = G.script_counts(s)
    parts = [G.print_spam(counts), G.phase_imbalance(s), G.error_bulk(counts), G.no_error_handling(counts), G.transform_heavy(s)]
    apart = sorted(str(r.asDict()) for p in parts for r in p.collect())
    assert len(apart) == 4 and sorted(str(r.asDict()) for r in G.findings(s).collect()) == apart


def test_findings_take_two_shuffles_of_steps(spark):
    s = steps_df(spark, [("transform", "int()")])
    plan = G.findings(s)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
