"""Derived tables follow their inputs."""

import os
import shutil
import tempfile


def test_changed_input_gives_new_answers_and_old_tables_are_gone(spark):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from codeatlas.plans.analysis import Analysis
    folder = tempfile.mkdtemp(prefix="codeatlas-input-")
    for name in ("events", "conversations"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", f"{folder}/{name}.parquet")
    an = Analysis.from_testdata(spark, folder)
    steps, facts = an.steps.count(), an.tables[2]
    assert Analysis.from_testdata(spark, folder + "/") is an
    kept = list(an.tables)
    assert "/" not in facts and spark.catalog.tableExists(facts) and all(os.path.isdir(t) for t in kept if "/" in t)
    events = pq.read_table(f"{folder}/events.parquet")
    pq.write_table(pa.Table.from_batches(events.slice(0, 40).to_batches()), f"{folder}/events.parquet")
    new = Analysis.from_testdata(spark, folder)
    assert new is not an and 0 < new.steps.count() < steps
    assert not spark.catalog.tableExists(facts) and not any(os.path.exists(t) for t in kept if "/" in t)
