"""End-to-end analysis of a corpus: source files -> all analysis tables.

``Analysis`` wires the operators together lazily; every attribute is a
DataFrame plan, nothing is collected. ``from_testdata`` derives the corpus from
the driver's ``events`` table (see ``sources.corpus``).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeatlas import rules as R
from codeatlas.operators import extract as X
from codeatlas.operators import links as D
from codeatlas.operators.facts import content_facts, facts_of_files, syntax_facts
from codeatlas.plans.registry import derived
from codeatlas.session import clustered_table, cut_table
from codeatlas.sources import corpus as C


class Analysis:
    """Analysis tables of one corpus.

    ``source_files``: (project_id, path, content) of admitted files, or
    ``raw_facts``: their facts;
    ``listing``: (project_id, path) of every script (local-module scope);
    ``extra_steps``: optional steps from imported analyses (same schema as
    ``steps`` minus ``pos``, plus ``k``: order inside the line).
    """

    def __init__(self, spark: SparkSession, source_files: DataFrame | None, listing: DataFrame,
                 extra_steps: DataFrame | None = None, materialize: bool = True, raw_facts: DataFrame | None = None):
        self.spark = spark
        self.tables: list[str] = []  # written tables
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # of the clustered ones
        self.raw_facts = raw_facts
        self.dealt = raw_facts is None  # facts made here come dealt by file
        self.materialize = materialize
        self.source_files = source_files
        self.listing = listing
        self.extra_steps = extra_steps

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str) -> "Analysis":
        """Analysis of the corpus derived from ``sf_dir``, shared by the registered
        queries as long as its inputs stay the same (see ``registry``)."""
        at = sf_dir.rstrip("/")

        def build() -> "Analysis":
            tables: list[str] = []
            ce = cut_table(C.corpus_events(spark, sf_dir), "corpus_events", tables=tables)
            an = cls(spark, C.source_files(spark, sf_dir, ce), cut_table(C.corpus_listing(spark, sf_dir, ce), "listing", tables=tables),
                     launch_steps(spark, sf_dir, ce))
            an.sf_dir, an.tables = sf_dir, tables
            return an

        return derived(spark, "analysis", [f"{at}/events.parquet", f"{at}/conversations.parquet"], build)

    @classmethod
    def from_tree(cls, spark: SparkSession, root: str, materialize: bool = True, max_file_size: int | None = R.MAX_FILE_SIZE) -> "Analysis":
        """Analysis of a source tree ``<root>/<project_id>/...``: every scanned
        script keeps a row (oversized, undecodable or unparsable files get no
        steps) and its status in ``status``; only admitted files are read and
        parsed. ``max_file_size`` in bytes, None for no limit."""
        from codeatlas.sources import files as FS
        files = FS.listing(spark, root)
        scanned = FS.scan(spark, root, files, max_file_size)
        hashed = FS.hashed(spark, root, scanned)
        an = cls(spark, None, scanned.where("status <> 'unreadable'").select("project_id", "path"), materialize=materialize)
        an.raw_facts = facts_of_files(content_facts(FS.distinct_contents(spark, root, hashed)), hashed, an.buckets if materialize else None)
        an.status = scanned.select("project_id", "path", "length", "status")
        an.__dict__["modules"] = X.local_modules(FS.module_scope(spark, root, files).select("project_id", "path"))
        return an

    @cached_property
    def modules(self) -> DataFrame:
        return X.local_modules(self.listing)

    @cached_property
    def facts(self) -> DataFrame:
        f = self.raw_facts
        if f is None:
            f = syntax_facts(self.source_files, 2 * self.spark.sparkContext.defaultParallelism, self.buckets if self.materialize else None)
        return clustered_table(f, "facts", ["project_id", "path"], "kind", self.buckets, self.tables, self.dealt) if self.materialize else f

    @cached_property
    def parsed(self) -> dict[str, DataFrame]:
        return X.analyze_facts(self.spark, self.facts, self.modules)

    @property
    def imports(self) -> DataFrame:
        return self.parsed["imports"]

    @property
    def services(self) -> DataFrame:
        return self.parsed["services"]

    @property
    def secrets(self) -> DataFrame:
        return self.parsed["secrets"]

    @property
    def triggers(self) -> DataFrame:
        return self.parsed["triggers"]

    @property
    def signature(self) -> DataFrame:
        return self.parsed["signature"]

    @cached_property
    def parsed_steps(self) -> DataFrame:
        return self._stepped(self.parsed["steps"], "parsed_steps")

    @cached_property
    def steps(self) -> DataFrame:
        """Parsed steps plus imported ones, renumbered by (line, order in line)."""
        return self.parsed_steps if self.extra_steps is None else self._stepped(self.numbered_steps(), "steps")

    def numbered_steps(self) -> DataFrame:
        """``steps`` as they are numbered. The imported ones are dealt as the
        clustered facts are, so that both meet without another exchange."""
        # parsed steps are not written on their own unless they were asked for: then they are read
        parsed = self.__dict__.get("parsed_steps", self.parsed["steps"]).withColumn("k", F.col("pos"))
        # keys that still carry a table's name hide from a union that its sides are dealt alike; an alias without metadata is optimized away
        parsed = parsed.withColumns({c: F.col(c).alias(c, metadata={"buckets": self.buckets}) for c in ("project_id", "path")})
        extra = self.extra_steps.repartition(self.buckets, "project_id", "path") if self.materialize else self.extra_steps
        allv = parsed.drop("pos").unionByName(extra)
        w = Window.partitionBy("project_id", "path").orderBy("line_number", "k")
        return allv.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).drop("k")

    def _stepped(self, st: DataFrame, name: str) -> DataFrame:
        return clustered_table(st, name, ["project_id", "path"], buckets=self.buckets, tables=self.tables, dealt=True) if self.materialize else st

    @cached_property
    def scripts(self) -> DataFrame:
        """(project_id, path, is_entry_point) for every script."""
        return X.entry_points(self.listing, self.triggers)

    @cached_property
    def file_nodes(self) -> tuple[DataFrame, DataFrame]:
        return D.file_nodes(D.factored_file_edges(self.steps))

    @cached_property
    def degrees(self) -> DataFrame:
        d = D.degrees(self.listing, self.imports, self.steps, self.file_nodes)
        return cut_table(d, "degrees", tables=self.tables) if self.materialize else d

    @cached_property
    def connections(self) -> DataFrame:
        return D.connections(self.listing, self.imports, self.steps, self.file_nodes)


def launch_steps(spark: SparkSession, sf_dir: str, ce: DataFrame | None = None) -> DataFrame:
    """Imported-analysis rows of the corpus: api_call steps naming a script."""
    ev = (C.corpus_events(spark, sf_dir) if ce is None else ce).where(F.col("template") == C.LAUNCH_TEMPLATE)
    return ev.select("project_id", "path", F.col("line").alias("line_number"), F.lit("api_call").alias("type"),
                     C.subst(F.lit(C.LAUNCH_DESCRIPTION)).alias("description"), "function_name",
                     F.lit(None).cast(X.SERVICE_STRUCT).alias("service"),
                     F.array().cast("array<string>").alias("inputs"),
                     F.array().cast("array<string>").alias("outputs"),
                     F.lit(0).cast("int").alias("k"))
