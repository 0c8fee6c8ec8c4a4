"""Source trees: listing rules, quarantine, local modules, JSON round trip."""

import os
import tempfile

import pytest

from codeatlas.plans.analysis import Analysis
from codeatlas.sources import analysis_json as AJ
from codeatlas.sources import files as FS


def _tree():
    root = tempfile.mkdtemp(prefix="codeatlas-tree-")
    files = {
        "p1/main.py": "import helper\nimport _util\nr = requests.get(u)\nif __name__ == '__main__':\n    run()\n",
        "p1/helper.py": "print('x')\n",
        "p1/_util.py": "print('u')\n",
        "p1/pkg/__init__.py": "",
        "p1/pkg/mod.py": "import pkg\n",
        "p1/broken.py": "def (:\n",
        "p1/.venv/x.py": "print(1)\n",
        "p1/build/y.py": "print(1)\n",
        "p1/__pycache__/z.py": "print(1)\n",
        "p1/readme.txt": "hi\n",
    }
    for rel, text in files.items():
        os.makedirs(os.path.dirname(f"{root}/{rel}"), exist_ok=True)
        with open(f"{root}/{rel}", "w") as fh:
            fh.write(text)
    with open(f"{root}/p1/latin.py", "wb") as fh:
        fh.write(b"x = '\xe9'\n")
    return root


def test_scan_listing_and_modules(spark):
    root = _tree()
    scanned = sorted(r.path for r in FS.scan(spark, root).collect())
    assert scanned == ["_util.py", "broken.py", "helper.py", "latin.py", "main.py", "pkg/mod.py"]
    mods = sorted(r.module for r in FS.modules_from_listing(FS.listing(spark, root)).collect())
    assert mods == ["_util", "broken", "helper", "latin", "main", "mod", "pkg"]


def test_tree_analysis_quarantine(spark):
    root = _tree()
    an = Analysis.from_tree(spark, root, materialize=False)
    errors = sorted(r.path for r in an.facts.where("kind = 'error'").collect())
    assert errors == ["broken.py", "latin.py"]
    scripts = {r.path: r.is_entry_point for r in an.scripts.collect()}
    assert set(scripts) == {"_util.py", "broken.py", "helper.py", "latin.py", "main.py", "pkg/mod.py"}
    assert scripts["main.py"] is True
    imps = sorted((r.path, r["import"], r.is_internal) for r in an.imports.collect())
    assert ("main.py", "_util", True) in imps and ("main.py", "helper", True) in imps
    assert ("pkg/mod.py", "pkg", True) in imps
    edges = sorted((r.source, r.target, r.type) for r in an.connections.collect())
    assert edges == [("main.py", "_util.py", "import"), ("main.py", "helper.py", "import")]


def test_analysis_json_round_trip(spark):
    root = _tree()
    an = Analysis.from_tree(spark, root, materialize=False)
    folder = tempfile.mkdtemp(prefix="codeatlas-json-")
    docs = AJ.script_documents(an.scripts, an.steps, an.imports, an.services, an.secrets, an.triggers)
    AJ.write_documents(docs, an.connections, folder)
    back = {r.path: r for r in AJ.read_scripts(spark, folder).collect()}
    assert back["main.py"].is_entry_point is True
    assert [s.description for s in back["main.py"].steps] == ["requests.get()"]
    assert back["broken.py"].steps == [] and back["broken.py"].secrets == []
    assert AJ.read_connections(spark, folder).count() == 2


def test_single_file_and_missing_root(spark):
    root = _tree()
    one = FS.scan(spark, f"{root}/p1/main.py").collect()
    assert [(r.project_id, r.path) for r in one] == [("p1", "main.py")]
    an = Analysis.from_tree(spark, f"{root}/p1/main.py", materialize=False)
    assert [r.description for r in an.steps.collect()] == ["requests.get()"]
    assert FS.scan(spark, f"{root}/nowhere").count() == 0


def test_listing_keeps_every_name_once_and_any_uri(spark):
    root = tempfile.mkdtemp(prefix="codeatlas-tree-")
    for rel in ("p/.hid.py", "p/_a=b.py", "p/sub/_x.py", "p/.hidden/no.py", "q/__main__.py", "q/notes.py.txt"):
        os.makedirs(os.path.dirname(f"{root}/{rel}"), exist_ok=True)
        with open(f"{root}/{rel}", "w") as fh:
            fh.write("print(1)\n")
    os.symlink(root + "/p", root + "/p/sub/loop")
    want = [("p", ".hid.py"), ("p", "_a=b.py"), ("p", "sub/_x.py"), ("q", "__main__.py")]
    for name in (root, "file://" + root, "file:" + root):
        assert sorted((r.project_id, r.path) for r in FS.scan(spark, name).collect()) == want
    assert sorted(r.path for r in Analysis.from_tree(spark, "file://" + root, materialize=False).steps.collect()) == sorted(p for _, p in want)
    assert {r.status for r in FS.scan(spark, root, max_file_size=3).collect()} == {"too_large"}
    assert {r.status for r in FS.scan(spark, root, max_file_size=None).collect()} == {"ok"}


def test_unreachable_root_raises(spark):
    with pytest.raises(Exception):
        FS.listing(spark, "nosuchscheme://host/tree")


def test_single_file_sees_its_siblings(spark):
    root = _tree()
    an = Analysis.from_tree(spark, f"{root}/p1/main.py", materialize=False)
    assert {r["import"] for r in an.imports.where("is_internal").collect()} == {"helper", "_util"}


def test_bad_files_stay_alone(spark):
    rows = [("p", "a.py", "import os\nk = os.getenv('\\ud800')\nprint(1)\n"), ("p", "b.py", "def main(x=" + "+".join(["1"] * 3000) + "):\n    pass\n"),
            ("p", "c.py", "def main(x=[1, {'a': y}], z={None: 2}):\n    (a, *b), c.d, e = f = open(p, mode='a')\n"), ("p", "d.py", None)]
    from codeatlas.operators.facts import syntax_facts
    facts = syntax_facts(spark.createDataFrame(rows, "project_id string, path string, content string")).collect()
    by = {p: [r for r in facts if r.path == p] for p in ("a.py", "b.py", "c.py", "d.py")}
    assert [r.arg0_str for r in by["a.py"] if r.kind == "call" and r.method == "getenv"] == ["\\ud800"]
    assert by["b.py"] and by["d.py"][0].kind == "error"
    assert [r.text2 for r in sorted(by["c.py"], key=lambda r: r.value_line or 0) if r.kind == "param"] == ['[1, {"a": "y"}]', '{"null": 2}']
    call, = [r for r in by["c.py"] if r.kind == "call"]
    assert call.open_mode == "a" and call.flag is False and call.arg0_str is None
    assert [r.names for r in by["c.py"] if r.kind == "assign"] == [["e", "f"]]


def test_small_files_spread_and_a_large_one_is_alone(spark):
    """5,000 listed files of 1 MB: at least 40 tasks; one of 300 MB has its own."""
    files = spark.range(5000).selectExpr("concat('/t/', id, '.py') AS uri", "'p' AS project_id", "concat(id, '.py') AS path", "1000000L AS length")
    files = files.union(spark.createDataFrame([("/t/big.py", "p", "big.py", 300_000_000)], files.schema))
    tasks = FS.dealt(spark, files)
    sizes = [(sum(r.length for r in part), len(part)) for part in tasks.rdd.glom().collect()]
    assert len(sizes) >= 40 and sum(n for _, n in sizes) == 5001
    assert (300_000_000, 1) in sizes and sorted(sizes)[-2][0] <= 2 * 128 << 20
    assert tasks.rdd.getNumPartitions() == len(sizes)
    # adaptive execution leaves the bins of a small listing alone, too
    few = FS.dealt(spark, files.where("length < 2000000 and cast(substring(path, 1, 1) as int) < 3").limit(64))
    assert few.selectExpr("spark_partition_id() AS part").distinct().count() >= 8


def test_bins_equal_prefix_sums(spark):
    from pyspark.sql import functions as F

    from codeatlas.operators.numbering import in_bins, running
    rows = spark.range(500).selectExpr("id", "pmod(hash(id), 90) + 1 AS w", "id % 3 AS k").repartition(7)
    placed, n = in_bins(rows, F.col("w"), 60, "bins")
    bins = {}
    for r in placed.collect():
        bins.setdefault(r.bin, []).append(r.w)
    assert sum(map(len, bins.values())) == 500 and max(bins) < n
    assert all(len(b) == 1 if max(b) >= 60 else sum(b) < 120 for b in bins.values())
    sums, by = {}, sorted(rows.collect(), key=lambda r: r.id)
    for r in by:
        sums[r.id] = sum(x.w for x in by if x.k == r.k and x.id < r.id)
    assert {r.id: r.before for r in running(rows, "k", [F.col("id")], "w", "running").collect()} == sums
    assert in_bins(rows.limit(0), F.col("w"), 60, "bins")[0].count() == 0


def test_unreadable_folder_is_listed_with_its_error(spark, monkeypatch):
    root = _tree()
    real = FS._children

    def children(of):
        run = real(of)

        def denied(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    if row.column("path")[0].as_py() == "pkg/":
                        yield FS._entries([(row.column("uri")[0].as_py(), "p1", "pkg/", False, None, "PermissionError")])
                    else:
                        yield from run(iter([row]))
        return denied
    monkeypatch.setattr(FS, "_children", children)
    status = {r.path: r.status for r in FS.scan(spark, root).collect()}
    assert status["pkg/"] == "unreadable" and status["main.py"] == "ok" and "pkg/mod.py" not in status
    an = Analysis.from_tree(spark, root, materialize=False)
    assert "pkg/" not in {r.path for r in an.scripts.collect()}
    # a folder that is gone becomes a row; any other failure of the storage stops the task
    batch = FS._entries([(root + "/gone", "p1", "gone/", True, None, None)])
    assert [b.column("error").to_pylist() for b in real(root)(iter([batch]))] == [["FileNotFoundError"]]

    class Broken:
        def get_file_info(self, _):
            raise OSError("connection reset")
    monkeypatch.setattr(FS, "filesystem", lambda _: (Broken(), ""))
    with pytest.raises(OSError):
        list(real(root)(iter([batch])))


def test_copies_are_parsed_once(spark):
    root = tempfile.mkdtemp(prefix="codeatlas-tree-")
    for k in range(10):
        for i in range(4):
            os.makedirs(f"{root}/p{k}/vendored", exist_ok=True)
            with open(f"{root}/p{k}/vendored/m{i}.py", "w") as fh:
                fh.write(f"import requests\nrequests.get('u{i}')\n")
    scanned = FS.scan(spark, root)
    hashed = FS.hashed(spark, root, scanned)
    assert hashed.count() == 40
    assert FS.distinct_contents(spark, root, hashed).count() == 4
    an = Analysis.from_tree(spark, root, materialize=False)
    assert sorted((r.project_id, r.path, r.description) for r in an.steps.collect()) == sorted((f"p{k}", f"vendored/m{i}.py", "requests.get()") for k in range(10) for i in range(4))


def test_steps_of_clustered_facts_need_no_exchange_of_their_own(spark):
    import re
    an = Analysis.from_testdata(spark, "/root/testdata/sf0.001")
    plan = an.parsed["steps"]._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange (?:hash|range|round|single)", plan)) <= 5
    facts = an.facts._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan, facts


NESTED = {
    "path": "/x/proj", "services": [{"name": "HTTP", "library": "requests", "icon": None}], "secrets": ["K"], "entry_points": ["a.py"], "summary": None,
    "connections": [{"source": "a.py", "target": "b.py", "type": "import", "detail": "d"}, {"source": "a.py"}],
    "scripts": [
        {"path": "a.py", "is_entry_point": True, "imports_internal": [], "imports_external": ["requests"], "secrets": ["K"], "summary": "S",
         "steps": [{"line_number": 3, "type": "api_call", "description": "requests.get()", "function_name": None, "inputs": ["a"], "outputs": [],
                    "service": {"name": "HTTP", "library": "requests", "icon": None}}],
         "services": [{"name": "HTTP", "library": "requests", "icon": None}], "triggers": [{"type": "cli", "detail": "__main__ guard"}],
         "signature": {"z": {"type": "int", "default": [1, {"a": None}]}, "b": {}}, "phase_summaries": {"setup": "p"}, "contextual_steps": {"3": "three"},
         "phase_risks": {}, "data_flow": None},
        {"path": "b.py"}, {"steps": []}, {"path": "c.py", "steps": [{"line_number": 1, "type": "t"}], "contextual_steps": {"x": "y"}},
        {"path": "d.py", "contextual_steps": {}}, "text", {"path": "e.py", "steps": [{"line_number": "nine", "type": "t", "description": "d"}]}]}


def test_nested_documents_and_rejects(spark):
    import json
    folder = tempfile.mkdtemp(prefix="codeatlas-json-")
    for name, text in (("n", json.dumps(NESTED, indent=2)), ("bad", '{"scripts": ['), ("nopath", '{"scripts": [{"path": "z.py"}]}')):
        with open(f"{folder}/{name}.json", "w") as fh:
            fh.write(text)
    got = AJ.read_nested(spark, folder)
    scripts = {r.path: r for r in got["scripts"].collect()}
    assert set(scripts) == {"a.py", "b.py", "d.py"} and {r.project_id for r in scripts.values()} == {"/x/proj"}
    a = scripts["a.py"]
    assert (a.steps[0].line_number, a.steps[0].service.name, a.steps[0].inputs, a.contextual_steps, a.phase_risks) == (3, "HTTP", ["a"], {3: "three"}, {})
    assert json.loads(a.signature) == NESTED["scripts"][0]["signature"]
    assert scripts["b.py"].steps == [] and scripts["b.py"].is_entry_point is False and scripts["d.py"].contextual_steps is None
    assert [(r.path, r.services[0].library, r.entry_points) for r in got["projects"].collect()] == [("/x/proj", "requests", ["a.py"])]
    assert [(r.source, r.target) for r in got["connections"].collect()] == [("a.py", "b.py")]
    assert sorted((r.kind, r.reason) for r in got["rejects"].collect()) == [
        ("connections", "target, type, detail"), ("document", "malformed"), ("document", "path"), ("scripts", "malformed"), ("scripts", "path"),
        ("scripts", "steps[0].description, contextual_steps.x"), ("scripts", "steps[0].line_number")]


def test_signature_keeps_its_order_and_defaults(spark):
    root = tempfile.mkdtemp(prefix="codeatlas-tree-")
    os.makedirs(f"{root}/p")
    with open(f"{root}/p/m.py", "w") as fh:
        fh.write("def main(zeta, src: str, limit=10, opts={'k': [1, None]}, *, kw=3):\n    pass\n")
    an = Analysis.from_tree(spark, root, materialize=False)
    folder = tempfile.mkdtemp(prefix="codeatlas-json-")
    AJ.write_documents(AJ.script_documents(an.scripts, an.steps, an.imports, an.services, an.secrets, an.triggers, an.signature), an.connections, folder)
    text, = [r.signature for r in AJ.read_scripts(spark, folder).collect()]
    assert text == '{"zeta":{},"src":{"type":"str"},"limit":{"default":10},"opts":{"default":{"k":[1,null]}}}'


def test_replies_are_made_in_tasks_of_their_own(spark):
    """A reply is much more work than its row's bytes: one small file makes one scan task."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from codeatlas.sources import corpus as C
    folder = tempfile.mkdtemp(prefix="codeatlas-replies-")
    rows = [(i % 50 if i % 7 else None, i % 9, "user", f"alpha beta {i}" if i % 11 else None) for i in range(400)]
    rows += rows[:20]
    names = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    pq.write_table(pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*rows), names)], names=[n for n, _ in names]), f"{folder}/conversations.parquet")
    made = C.phase_replies(spark, folder)
    assert made.count() == sum(r[1] <= 4 for r in rows)
    assert made.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1


def _written(spark):
    """An analysis that writes its tables, of four small files and one imported step."""
    code = "import requests\nfor u in urls:\n    r = requests.get(u)\n\nif __name__ == '__main__':\n    print(r)\n"
    src = spark.createDataFrame([(f"p{k % 2}", f"m{k}.py", code + f"print({k % 3})\n") for k in range(4)], "project_id string, path string, content string")
    extra = spark.createDataFrame([("p0", "m0.py", 4, "api_call", "launch", None, None, [], [], 0)],
                                  "project_id string, path string, line_number int, type string, description string, function_name string, "
                                  "service struct<name:string,library:string,icon:string>, inputs array<string>, outputs array<string>, k int")
    return Analysis(spark, src, src.select("project_id", "path"), extra)


def test_steps_are_numbered_without_an_exchange_or_a_table_of_their_own(spark):
    an = _written(spark)
    plan = an.numbered_steps()._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "Exchange" not in plan.split("Union")[0]
    got = sorted(tuple(r) for r in an.steps.select("project_id", "path", "pos", "line_number", "description").collect())
    assert not any("parsed_steps" in t for t in an.tables)
    assert [r[2:] for r in got if r[1] == "m0.py"] == [(0, 2, "for u in urls"), (1, 3, "requests.get()"), (2, 4, "launch"), (3, 6, "print()"), (4, 7, "print()")]
    assert [r[2:] for r in got if r[1] == "m1.py"] == [(0, 2, "for u in urls"), (1, 3, "requests.get()"), (2, 6, "print()"), (3, 7, "print()")]
    # in the other order the parsed steps are written, read again, and give the same
    other = _written(spark)
    assert other.parsed_steps.count() == 16
    assert sorted(tuple(r) for r in other.steps.select("project_id", "path", "pos", "line_number", "description").collect()) == got


def test_facts_are_written_as_one_file_a_bucket(spark):
    an = _written(spark)
    files = an.facts.inputFiles()
    assert 0 < len(files) <= an.buckets
    assert {r.kind for r in an.facts.select("kind").distinct().collect()} == {"import", "for", "call", "assign", "if"}
    assert sorted((r.project_id, r.path) for r in an.scripts.where("is_entry_point").collect()) == [(f"p{k % 2}", f"m{k}.py") for k in (0, 2, 1, 3)]
