"""Benchmark: end-to-end corpus analysis and headline queries.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1), runs on
``local[$BENCH_CPUS]`` and prints one JSON line. ``corpus`` derives the test
corpus from ``events``; ``analyze`` is the full pipeline from those source
files to the materialized analysis (parse job, imports, services, step rules,
enrichment); the other entries are
queries over that analysis, each forced to completion through the ``noop``
sink (no collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("steps_classified", "steps_io", "connections", "phase_profile", "findings", "health",
            "ranking", "flow_compact", "prompt_script", "prompt_phase", "responses_merged", "scorecard")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from codeatlas.session import get_spark
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    from codeatlas.plans.analysis import Analysis
    from codeatlas.plans.queries import QUERIES

    times: dict[str, float] = {}
    t0 = time.time()
    an = Analysis.from_testdata(spark, sf_dir)  # events -> corpus tables (test scaffolding)
    times["corpus"] = round(time.time() - t0, 3)
    t0 = time.time()
    an.facts  # source files -> parse job (materialized)
    an.steps  # step rules + enrichment (materialized)
    times["analyze"] = round(time.time() - t0, 3)
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    total = round(sum(times.values()), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "corpus_analysis_total", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
