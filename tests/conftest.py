import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]").appName("codeatlas-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         # one session runs all tests: its history of jobs and plans must not fill the heap
         .config("spark.driver.memory", "6g")
         .config("spark.sql.ui.retainedExecutions", "5")
         .config("spark.ui.retainedJobs", "50")
         .config("spark.ui.retainedStages", "50")
         .config("spark.ui.retainedTasks", "500")
         .config("spark.sql.maxPlanStringLength", "20000")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


def analyze(spark, files, project="p"):
    """Analysis of inline sources: ``files`` maps relative path -> source."""
    from codeatlas.plans.analysis import Analysis
    rows = [(project, path, src) for path, src in files.items()]
    src = spark.createDataFrame(rows, "project_id string, path string, content string")
    return Analysis(spark, src, src.select("project_id", "path"), materialize=False)


def steps_of(an, path):
    rows = an.steps.where(f"path = '{path}'").orderBy("pos").collect()
    return [(r.line_number, r.type, r.description) for r in rows]
