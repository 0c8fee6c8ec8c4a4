"""codeatlas: analytics over large corpora of Python source files on Spark.

One Arrow-batched parse job turns ``source_files`` into a flat ``facts`` table;
everything else (classification, services, secrets, triggers, cross-script
links, phases, labels, findings, health, ranking, graph and prompt datasets)
is plain DataFrame work keyed by ``(project_id, path)``.
"""

from codeatlas.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
