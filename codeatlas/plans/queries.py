"""Registered queries: one per operator (or tight family) of the inventory.

Each query takes ``(spark, sf_dir)``, derives the corpus from the tables in
``sf_dir`` and returns a DataFrame whose column names and types match the
DuckDB oracle in ``plans.oracle`` (integers as BIGINT, lists joined to text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.functions import labels as L
from codeatlas.operators import graph as H
from codeatlas.operators import links as D
from codeatlas.operators import profile as P
from codeatlas.operators import prompts as I
from codeatlas.operators import quality as G
from codeatlas.operators import rollup as RU
from codeatlas.plans.analysis import Analysis
from codeatlas.session import cut_table
from codeatlas.sources import corpus as C

QueryFn = Callable[[SparkSession, str], DataFrame]


def _an(spark: SparkSession, sf_dir: str) -> Analysis:
    return Analysis.from_testdata(spark, sf_dir)


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


def _join(c, sep="|"):
    return F.array_join(c, sep)


# ---------------------------------------------------------------- B: extraction

def syntax_facts(spark, sf_dir):
    """All kinds, all columns but the visit orders (which the steps depend on)."""
    f = _an(spark, sf_dir).facts
    return f.select("project_id", "path", "kind", *_long("line", "end_line", "value_line", "depth"), "func_name", "obj", "method", "name", "chain",
                    "arg0_str", "open_mode", "text", "text2", _join(F.col("names")).alias("names"), "flag")


def imports_split(spark, sf_dir):
    return _an(spark, sf_dir).imports.select("project_id", "path", "import", "is_internal")


def secrets(spark, sf_dir):
    return _an(spark, sf_dir).secrets.select("project_id", "path", "secret")


def triggers(spark, sf_dir):
    a = _an(spark, sf_dir)
    return (a.triggers.join(a.scripts, ["project_id", "path"])
            .select("project_id", "path", *_long("pos"), "type", "detail", "is_entry_point"))


def main_signature(spark, sf_dir):
    return _an(spark, sf_dir).signature.select("project_id", "path", *_long("ord"), "param", "annotation",
                                               "default_json")


def steps_classified(spark, sf_dir):
    return _an(spark, sf_dir).parsed_steps.select(
        "project_id", "path", *_long("pos", "line_number"), "type", "description", "function_name",
        F.col("service.name").alias("service_name"), F.col("service.library").alias("service_library"),
        F.col("service.icon").alias("service_icon"))


def steps_io(spark, sf_dir):
    return _an(spark, sf_dir).parsed_steps.select(
        "project_id", "path", *_long("pos"), _join(F.col("inputs")).alias("inputs"),
        _join(F.col("outputs")).alias("outputs"))


def script_services(spark, sf_dir):
    return _an(spark, sf_dir).services.select("project_id", "path", *_long("pos"), "name", "library", "icon")


# ---------------------------------------------------------------- C: rollups

def project_services(spark, sf_dir):
    return RU.project_services(_an(spark, sf_dir).services).select(
        "project_id", *_long("pos"), "name", "library", "icon")


def project_secrets(spark, sf_dir):
    return RU.project_secrets(_an(spark, sf_dir).secrets).select("project_id", "secret")


def project_entry_points(spark, sf_dir):
    return RU.project_entry_points(_an(spark, sf_dir).scripts).select("project_id", "path")


def project_inventory(spark, sf_dir):
    a = _an(spark, sf_dir)
    inv = RU.project_inventory(a.scripts, a.services, a.secrets)
    return inv.select("project_id", *_long("n_scripts", "n_services", "n_secrets", "n_entry_points"))


# ---------------------------------------------------------------- D: links

def import_edges(spark, sf_dir):
    a = _an(spark, sf_dir)
    return D.import_edges(a.listing, a.imports).select("project_id", "source", "target", "detail").distinct()


def file_sets(spark, sf_dir):
    reads, writes = D.file_sets(_an(spark, sf_dir).steps)
    return (reads.withColumn("mode", F.lit("read"))
            .unionByName(writes.withColumn("mode", F.lit("write")))
            .select("project_id", "path", "file", "mode"))


def file_edges(spark, sf_dir):
    return D.file_edges(_an(spark, sf_dir).steps).select("project_id", "source", "target", "detail")


def launch_edges(spark, sf_dir):
    a = _an(spark, sf_dir)
    return D.launch_edges(a.listing, a.steps).select("project_id", "source", "target", "detail")


def connections(spark, sf_dir):
    return _an(spark, sf_dir).connections.select("project_id", "source", "target", "type", "detail",
                                                 *_long("pos"))


# ---------------------------------------------------------------- E: labels

def step_labels(spark, sf_dir):
    s = L.with_label(_an(spark, sf_dir).steps)
    dims = F.broadcast(L.type_labels_df(spark).select("type", "business", "technical", "short"))
    return s.join(dims, "type", "left").select("project_id", "path", *_long("pos"), "type", "label",
                                               "business", "technical", "short")


def condition_text(spark, sf_dir):
    s = _an(spark, sf_dir).steps.where((F.col("type") == "decision") & F.col("description").startswith("if "))
    cond = F.trim(F.substring("description", 4, 1 << 30))
    return s.select("project_id", "path", *_long("pos"), cond.alias("condition"),
                    L.simplify_condition(cond).alias("simplified"))


def trigger_labels(spark, sf_dir):
    t = _an(spark, sf_dir).triggers
    return t.select("project_id", "path", *_long("pos"), "type", "detail",
                    L.translate_trigger(F.col("type"), F.col("detail")).alias("label"))


def secret_labels(spark, sf_dir):
    ps = RU.project_secrets(_an(spark, sf_dir).secrets)
    lab = ps.select("project_id", "secret", L.translate_secret(F.col("secret")).alias("label"))
    firsts = P.credential_labels(ps).select("project_id", F.col("first_secret").alias("secret"),
                                            F.lit(True).alias("is_first"))
    return (lab.join(firsts, ["project_id", "secret"], "left")
            .select("project_id", "secret", "label", F.coalesce("is_first", F.lit(False)).alias("is_first")))


def edge_labels(spark, sf_dir):
    return H.graph_edges(_an(spark, sf_dir).connections).select("project_id", "source", "target", "type", "verb")


def phases(spark, sf_dir):
    s = L.with_phase(_an(spark, sf_dir).steps)
    return s.select("project_id", "path", *_long("pos"), "phase", "phase_label")


# ---------------------------------------------------------------- F: profiles

def phase_profile(spark, sf_dir):
    g = P.phase_groups(_an(spark, sf_dir).steps)
    return g.select("project_id", "path", "phase", "phase_label", *_long("phase_ord", "n_steps", "pct"),
                    "pct_shown", "chip")


def step_groups(spark, sf_dir):
    g = P.dedupe_groups(_an(spark, sf_dir).steps)
    return g.select("project_id", "path", "label", *_long("n", "first_pos"), "first_type", "lines")


def pattern_insights(spark, sf_dir):
    g = P.pattern_insights(_an(spark, sf_dir).steps)
    return g.select("project_id", "path", "phase", "label", *_long("n", "first_pos"), "insight")


def top_types(spark, sf_dir):
    return P.first_types(_an(spark, sf_dir).steps).select("project_id", "path", *_long("rank"), "type", "short")


def _kept(a: Analysis, name: str, made: Callable[[], DataFrame]) -> DataFrame:
    """A table of the analysis that several queries read, written once."""
    if name not in a.__dict__:
        a.__dict__[name] = cut_table(made(), name, tables=a.tables)
    return a.__dict__[name]


def _responses(a: Analysis) -> DataFrame:
    """Replies to the phase prompts: from the conversations, for phases that
    scripts have."""
    def made() -> DataFrame:
        asked = L.with_phase(a.steps).select("project_id", "path", "phase").distinct()
        return C.phase_replies(a.spark, a.sf_dir).join(asked, ["project_id", "path", "phase"], "left_semi")
    return _kept(a, "responses", made)


def _parsed_responses(a: Analysis) -> DataFrame:
    return _kept(a, "parsed_responses", lambda: I.parse_responses(_responses(a), a.steps, a.tables))


def _texts(a: Analysis) -> DataFrame:
    """Replies to script, data-flow and project prompts, of projects and scripts that exist."""
    def made() -> DataFrame:
        there = a.listing.select("project_id", "path").unionByName(a.listing.select("project_id", F.lit("").alias("path"))).distinct()
        return I.reply_texts(C.summary_replies(a.spark, a.sf_dir)).join(there, ["project_id", "path"], "left_semi")
    return _kept(a, "reply_texts", made)


def _merged(a: Analysis) -> DataFrame:
    return I.merge_responses(_parsed_responses(a))


def _fields(a: Analysis) -> DataFrame:
    return I.script_fields(a.listing, _merged(a), _texts(a))


def _project_texts(a: Analysis) -> DataFrame:
    return _texts(a).where("kind = 'project'").select("project_id", F.col("text").alias("summary"))


def step_display(spark, sf_dir):
    a = _an(spark, sf_dir)
    ctx = _merged(a).where(F.col("kind") == "step").select(
        "project_id", "path", F.col("key").cast("int").alias("line"), "text")
    d = P.step_display(a.steps, ctx)
    return d.select("project_id", "path", *_long("pos"), "display", "is_contextual")


# ---------------------------------------------------------------- G: findings

def _findings_out(df):
    return df.select("project_id", "path", "id", "severity", "title", "detail", "phase", *_long("count"))


def finding_print_spam(spark, sf_dir):
    return _findings_out(G.print_spam(G.script_counts(_an(spark, sf_dir).steps)))


def finding_phase_imbalance(spark, sf_dir):
    return _findings_out(G.phase_imbalance(_an(spark, sf_dir).steps))


def finding_error_bulk(spark, sf_dir):
    return _findings_out(G.error_bulk(G.script_counts(_an(spark, sf_dir).steps)))


def finding_no_errors(spark, sf_dir):
    return _findings_out(G.no_error_handling(G.script_counts(_an(spark, sf_dir).steps)))


def finding_transform_heavy(spark, sf_dir):
    return _findings_out(G.transform_heavy(_an(spark, sf_dir).steps))


def findings(spark, sf_dir):
    from pyspark.sql import Window
    f = G.findings(_an(spark, sf_dir).steps)
    w = Window.partitionBy("project_id", "path").orderBy("rule", "sub")
    return f.select("project_id", "path", (F.row_number().over(w) - 1).cast("long").alias("pos"), "id",
                    "severity", "title", "detail", "phase", *_long("count"))


def health(spark, sf_dir):
    a = _an(spark, sf_dir)
    return G.health(a.scripts, G.findings(a.steps))


# ---------------------------------------------------------------- H: graph

def _importance(a: Analysis) -> DataFrame:
    return H.importance(a.scripts, a.services, a.steps, a.degrees)


def importance(spark, sf_dir):
    return _importance(_an(spark, sf_dir))


def ranking(spark, sf_dir):
    return H.ranking(_importance(_an(spark, sf_dir)))


def graph_nodes(spark, sf_dir):
    return H.graph_nodes(_an(spark, sf_dir).scripts)


def graph_edges(spark, sf_dir):
    return H.graph_edges(_an(spark, sf_dir).connections).select(
        "project_id", "source", "target", "type", "verb", *_long("pos"))


def flow_nodes(spark, sf_dir):
    return H.flow_nodes(_an(spark, sf_dir).steps).select(
        "project_id", "path", *_long("pos", "line_number"), "type", "function", "label_tech", "label_biz")


def flow_edges(spark, sf_dir):
    return H.flow_edges(_an(spark, sf_dir).steps).select(
        "project_id", "path", "function", *_long("src_pos", "dst_pos"))


def flow_compact(spark, sf_dir):
    return H.flow_compact(_an(spark, sf_dir).steps)


def compact_nodes(spark, sf_dir):
    return H.compact_nodes(_an(spark, sf_dir).steps).select(
        "project_id", "path", "function", *_long("pos", "n_steps"), "label_tech", "label_biz")


def compact_edges(spark, sf_dir):
    return H.compact_edges(_an(spark, sf_dir).steps).select(
        "project_id", "path", "function", *_long("src_pos", "dst_pos"))


def phase_pipeline(spark, sf_dir):
    return H.phase_pipeline(_an(spark, sf_dir).steps).select(
        "project_id", "path", "phase", "phase_label", *_long("phase_ord", "n_steps"), "caption", "next_phase")


# ---------------------------------------------------------------- I: prompts

def prompt_script(spark, sf_dir):
    a = _an(spark, sf_dir)
    return I.script_prompts(a.scripts, a.services, a.secrets, a.triggers, a.steps)


def prompt_project(spark, sf_dir):
    a = _an(spark, sf_dir)
    summaries = _texts(a).where("kind = 'script'").select("project_id", "path", F.col("text").alias("summary"))
    return I.project_prompts(a.scripts, RU.project_services(a.services), a.connections, summaries)


def prompt_dataflow(spark, sf_dir):
    a = _an(spark, sf_dir)
    return I.dataflow_prompts(a.services, a.steps)


def prompt_phase(spark, sf_dir):
    a = _an(spark, sf_dir)
    return I.phase_prompts(a.services, a.steps)


def responses_parsed(spark, sf_dir):
    a = _an(spark, sf_dir)
    p = _parsed_responses(a)
    return p.select("project_id", "path", "phase", "kind",
                    F.coalesce(F.col("line").cast("long"), F.lit(-1).cast("long")).alias("line"), "text")


def responses_merged(spark, sf_dir):
    a = _an(spark, sf_dir)
    merged, texts = _merged(a), _texts(a)
    fields = cut_table(I.script_fields(a.listing, merged, texts), "script_fields")
    none = F.lit("")
    plain = texts.select("project_id", "path", F.concat(F.col("kind"), F.lit("_text")).alias("kind"), none.alias("key"), "text")
    maps = fields.select("project_id", "path", F.lit("maps").alias("kind"), none.alias("key"),
                         F.when(F.col("phase_summaries").isNull(), F.lit("null")).otherwise(F.concat_ws("/", F.size("phase_summaries"), F.size("contextual_steps"), F.size("phase_risks"))).alias("text"))
    done = I.reply_progress(fields, texts).select("project_id", none.alias("path"), F.lit("progress").alias("kind"), none.alias("key"), F.concat_ws("/", "summaries", "phases").alias("text"))
    return merged.select("project_id", "path", "kind", "key", "text").unionByName(plain).unionByName(maps).unionByName(done)


# ---------------------------------------------------------------- A: sources

def _tree(spark, sf_dir) -> str:
    """The corpus written as a source tree (plus per-project files that the
    listing rules must prune) under the checkpoint folder; once per analysis."""
    import uuid
    from codeatlas.session import checkpoint_dir
    from codeatlas.sources import files as FS
    a = _an(spark, sf_dir)
    if "tree" not in a.__dict__:
        root = f"{checkpoint_dir(spark)}/trees/{uuid.uuid4().hex}"
        FS.write_tree(a.source_files.select("project_id", "path", "content")
                      .unionByName(FS.tree_extras(a.listing)), root)
        a.tables.append(root)
        a.__dict__["tree"] = root
    return a.__dict__["tree"]


def scan_sources(spark, sf_dir):
    from codeatlas.sources import files as FS
    return FS.scan(spark, _tree(spark, sf_dir)).select("project_id", "path", *_long("length"), "status")


def local_modules(spark, sf_dir):
    from codeatlas.sources import files as FS
    return FS.modules_from_listing(FS.listing(spark, _tree(spark, sf_dir)))


def analysis_roundtrip(spark, sf_dir):
    """Every field of every record that is written and read again, as text."""
    import uuid
    from codeatlas.session import checkpoint_dir
    from codeatlas.sources import analysis_json as AJ
    a = _an(spark, sf_dir)
    docs = AJ.script_documents(a.scripts, a.steps, a.imports, a.services, a.secrets, a.triggers, a.signature, _fields(a))
    heads = AJ.project_documents(a.scripts, RU.project_services(a.services), RU.project_secrets(a.secrets), RU.project_entry_points(a.scripts), _project_texts(a))
    folder = f"{checkpoint_dir(spark)}/analysis/{uuid.uuid4().hex}"
    AJ.write_documents(docs, a.connections, folder, heads)
    got = AJ.read_folder(spark, folder)

    def plain(c):
        return F.coalesce(c, F.lit(""))

    def lines(c, text):
        return F.array_join(F.transform(c, text), "\n")

    def service(x):
        return F.concat_ws("|", plain(x["name"]), plain(x["library"]), plain(x["icon"]))

    def step(x):
        return F.concat_ws("|", x["line_number"].cast("string"), x["type"], x["description"], plain(x["function_name"]), service(x["service"]), _join(x["inputs"], ","), _join(x["outputs"], ","))

    def texts(c):
        return F.when(F.col(c).isNotNull(), lines(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])))

    params = F.map_entries(F.from_json("signature", "map<string,struct<type:string,default:variant>>"))
    fields = {"is_entry_point": F.col("is_entry_point").cast("string"), "steps": lines("steps", step), "imports_internal": _join(F.col("imports_internal")),
              "imports_external": _join(F.col("imports_external")), "services": lines("services", service), "secrets": _join(F.col("secrets")),
              "triggers": lines("triggers", lambda t: F.concat_ws("|", t["type"], t["detail"])), "summary": F.col("summary"), "data_flow": F.col("data_flow"),
              "signature": lines(params, lambda e: F.concat_ws("|", e["key"], plain(e["value"]["type"]), plain(F.to_json(e["value"]["default"])))),
              "phase_summaries": texts("phase_summaries"), "contextual_steps": texts("contextual_steps"), "phase_risks": texts("phase_risks")}
    of_project = {"services": fields["services"], "secrets": fields["secrets"], "entry_points": _join(F.col("entry_points")), "summary": F.col("summary")}

    def rows(df, path, named):
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in named.items()]))
        return df.select("project_id", path.alias("path"), each.alias("x")).select("project_id", "path", "x.field", "x.value").where("value is not null")

    edges = {"connection": F.concat_ws("|", "target", "type", "detail", F.col("pos").cast("string"))}
    lost = {"rejected": F.concat_ws("|", "kind", "reason")}
    return (rows(got["scripts"], F.col("path"), fields).unionByName(rows(got["projects"], F.lit(""), of_project))
            .unionByName(rows(got["connections"], F.col("source"), edges)).unionByName(rows(got["rejects"], F.lit(""), lost)))


QUERIES: dict[str, QueryFn] = {
    "scan_sources": scan_sources,
    "local_modules": local_modules,
    "analysis_roundtrip": analysis_roundtrip,
    "syntax_facts": syntax_facts,
    "imports_split": imports_split,
    "secrets": secrets,
    "triggers": triggers,
    "main_signature": main_signature,
    "steps_classified": steps_classified,
    "steps_io": steps_io,
    "script_services": script_services,
    "project_services": project_services,
    "project_secrets": project_secrets,
    "project_entry_points": project_entry_points,
    "project_inventory": project_inventory,
    "import_edges": import_edges,
    "file_sets": file_sets,
    "file_edges": file_edges,
    "launch_edges": launch_edges,
    "connections": connections,
    "step_labels": step_labels,
    "condition_text": condition_text,
    "trigger_labels": trigger_labels,
    "secret_labels": secret_labels,
    "edge_labels": edge_labels,
    "phases": phases,
    "phase_profile": phase_profile,
    "step_groups": step_groups,
    "pattern_insights": pattern_insights,
    "top_types": top_types,
    "step_display": step_display,
    "finding_print_spam": finding_print_spam,
    "finding_phase_imbalance": finding_phase_imbalance,
    "finding_error_bulk": finding_error_bulk,
    "finding_no_errors": finding_no_errors,
    "finding_transform_heavy": finding_transform_heavy,
    "findings": findings,
    "health": health,
    "importance": importance,
    "ranking": ranking,
    "graph_nodes": graph_nodes,
    "graph_edges": graph_edges,
    "flow_nodes": flow_nodes,
    "flow_edges": flow_edges,
    "flow_compact": flow_compact,
    "compact_nodes": compact_nodes,
    "compact_edges": compact_edges,
    "phase_pipeline": phase_pipeline,
    "prompt_script": prompt_script,
    "prompt_project": prompt_project,
    "prompt_dataflow": prompt_dataflow,
    "prompt_phase": prompt_phase,
    "responses_parsed": responses_parsed,
    "responses_merged": responses_merged,
}


def scorecard(spark, sf_dir):
    """Flagship: per script rank, key flag, importance score, health and findings."""
    a = _an(spark, sf_dir)
    rk = H.ranking(_importance(a))
    hl = G.health(a.scripts, G.findings(a.steps)).withColumnRenamed("score", "health")
    return rk.join(hl, ["project_id", "path"]).select(
        "project_id", "path", "rank", "is_key", "score", "health", "color", "n_findings")


QUERIES["scorecard"] = scorecard
