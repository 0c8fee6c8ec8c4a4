"""Cross-script edges (D1–D7) and graph nodes (H3) on hand-built tables."""

from codeatlas.operators import graph as H
from codeatlas.operators import links as D
from helpers import STEP_SCHEMA


def _steps(spark, rows):
    """rows: (path, pos, type, description, inputs, outputs)."""
    return spark.createDataFrame(
        [("p", path, pos, pos + 1, typ, desc, None, None, ins, outs) for path, pos, typ, desc, ins, outs in rows],
        STEP_SCHEMA)


def _scripts(spark, paths):
    return spark.createDataFrame([("p", x) for x in paths], "project_id string, path string")


def test_file_sets_and_fallback(spark):
    st = _steps(spark, [
        ("a.py", 0, "file_io", "open('out.csv')", [], ["out.csv", "rows"]),
        ("a.py", 1, "file_io", "open('http://x/y.csv')", ["http://x/y.csv"], []),
        ("b.py", 0, "file_io", "open('weird_name')", [], []),          # fallback: read, no extension check
        ("b.py", 1, "file_io", "json.load()", ["out.csv"], []),
        ("c.py", 0, "api_call", "open('z.csv')", [], []),              # not file_io
    ])
    reads, writes = D.file_sets(st)
    assert sorted((r.path, r.file) for r in reads.collect()) == [("b.py", "out.csv"), ("b.py", "weird_name")]
    assert sorted((r.path, r.file) for r in writes.collect()) == [("a.py", "out.csv")]


def test_file_edge_keeps_smallest_shared_file(spark):
    st = _steps(spark, [
        ("w.py", 0, "file_io", "x", [], ["b.csv", "a.csv"]),
        ("r.py", 0, "file_io", "y", ["a.csv", "b.csv"], []),
        ("w.py", 1, "file_io", "z", ["a.csv"], []),                    # own read: no self edge
    ])
    got = [(r.source, r.target, r.detail) for r in D.file_edges(st).collect()]
    assert got == [("w.py", "r.py", "w.py writes a.csv")]


def test_launch_edges_py_and_other_paths(spark):
    scripts = _scripts(spark, ["jobs/run.py", "run.py", "deploy.sh", "a.py"])
    st = _steps(spark, [
        ("a.py", 0, "api_call", "subprocess.run('python jobs/run.py --x')", [], []),
        ("a.py", 1, "api_call", "os.system('bash deploy.sh')", [], []),
        ("a.py", 2, "api_call", "exec a.py", [], []),                  # self edge allowed
        ("a.py", 3, "transform", "jobs/run.py", [], []),               # not an api_call
    ])
    got = sorted((r.source, r.target) for r in D.launch_edges(scripts, st).collect())
    # 'jobs/run.py' also contains 'run.py' as a substring, as in the tool
    assert got == [("a.py", "a.py"), ("a.py", "deploy.sh"), ("a.py", "jobs/run.py"), ("a.py", "run.py")]


def test_launch_edges_short_paths_and_other_projects(spark):
    scripts = spark.createDataFrame([("p", "x"), ("p", "run"), ("q", "b.py"), ("p", "long/way/to/b.py")], "project_id string, path string")
    st = _steps(spark, [("a.py", 0, "api_call", "run x", [], []), ("a.py", 1, "api_call", "b.py", [], []), ("a.py", 2, "api_call", "", [], [])])
    got = sorted((r.project_id, r.source, r.target) for r in D.launch_edges(scripts, st).collect())
    assert got == [("p", "a.py", "run"), ("p", "a.py", "x")]


def test_import_edges_last_path_wins_and_no_self(spark):
    scripts = _scripts(spark, ["a/util.py", "b/util.py", "main.py"])
    imps = spark.createDataFrame([("p", "main.py", "util.helpers", True), ("p", "b/util.py", "util", True),
                                  ("p", "main.py", "os", False)],
                                 "project_id string, path string, import string, is_internal boolean")
    got = sorted((r.source, r.target) for r in D.import_edges(scripts, imps).collect())
    assert got == [("main.py", "b/util.py")]


def test_graph_node_groups(spark):
    one_dir = spark.createDataFrame([("p", "x.py", False), ("p", "y.py", True)],
                                    "project_id string, path string, is_entry_point boolean")
    assert [r.group for r in H.graph_nodes(one_dir).collect()] == [None, None]
    two = spark.createDataFrame([("q", "x.py", False), ("q", "lib/y.py", False), ("q", "lib/sub/z.py", False)],
                                "project_id string, path string, is_entry_point boolean")
    got = sorted((r.path, r.name, r.group) for r in H.graph_nodes(two).collect())
    assert got == [("lib/sub/z.py", "z.py", "lib/sub"), ("lib/y.py", "y.py", "lib"), ("x.py", "x.py", None)]


def _pairs_by_hand(uses):
    """(writer, reader, smallest file) of uses {path: (writes, reads)}, by all pairs."""
    return sorted((w, r, min(set(ws) & set(rs))) for w, (ws, _) in uses.items() for r, (_, rs) in uses.items() if w != r and set(ws) & set(rs))


def test_file_edges_and_degrees_over_nodes_equal_all_pairs(spark):
    import random
    rng = random.Random(3)
    files = [f"f{i}.csv" for i in range(6)]
    uses = {f"s{i:02}.py": (rng.sample(files, rng.randrange(3)), rng.sample(files, rng.randrange(3))) for i in range(40)}
    uses |= {f"own{i}.py": ([f"only{i}.csv", "log.txt"], ["log.txt"]) for i in range(10)}
    st = _steps(spark, [(p, 0, "file_io", "x", rs, ws) for p, (ws, rs) in uses.items()])
    want = _pairs_by_hand(uses)
    assert sorted((r.source, r.target, r.detail) for r in D.file_edges(st).collect()) == [(w, r, f"{w} writes {f}") for w, r, f in want]
    degree = {p: sum(p in pair[:2] for pair in want) for p in uses}
    assert {r.path: r.degree for r in D.file_degrees(st).collect() if r.degree} == {p: n for p, n in degree.items() if n}


def test_one_file_shared_by_thousands_of_scripts(spark):
    """4,000 stored rows and one node in place of 3,998,000 pairs."""
    st = spark.range(2000).selectExpr("'p' AS project_id", "concat('s', id, '.py') AS path", "0 AS pos", "1 AS line_number", "'file_io' AS type", "'x' AS description",
                                      "array('log.txt') AS inputs", "array('log.txt', concat('own', id, '.txt')) AS outputs")
    assert D.factored_file_edges(st).count() == 4000
    members, nodes = D.file_nodes(D.factored_file_edges(st))
    assert nodes.count() == 1 and members.count() == 2000
    assert {r.degree for r in D.file_degrees(st).collect()} == {2 * 1999}


def test_launch_search_is_linear_and_shards_agree(spark, monkeypatch):
    import time
    paths = [f"jobs/run{i}.py" for i in range(50)] + ["run1.py", "ru", "n"]
    scripts = _scripts(spark, paths)
    long = "x" * 10_000_000 + "jobs/run7.py" + "run" * 1000
    rows = [("a.py", i, "api_call", t, [], []) for i, t in enumerate(["call jobs/run1.py", "jobs/run12.py&jobs/run3.py", long, "none", "é/run1.py"])]
    want = sorted({("a.py", p, min(i for i, r in enumerate(rows) if p in r[3])) for p in paths if any(p in r[3] for r in rows)})
    st = _steps(spark, rows)
    t0 = time.time()
    for shard, part in ((65_536, 100_000), (4, 2)):
        monkeypatch.setattr(D, "SHARD_PATHS", shard)
        monkeypatch.setattr(D, "SLICE_TEXTS", part)
        got = sorted((r.source, r.target, r.ord.b) for r in D.launch_edges(scripts, st).collect())
        assert got == want
    assert time.time() - t0 < 120


def test_degrees_join_no_single_writers_with_readers(spark, monkeypatch):
    """Pairs exist between nodes only, whatever the number of scripts."""
    made = []
    real = D.cut_table
    monkeypatch.setattr(D, "cut_table", lambda df, name: made.append((name, real(df, name))) or made[-1][1])
    st = spark.range(300).selectExpr("'p' AS project_id", "concat('s', id, '.py') AS path", "0 AS pos", "1 AS line_number", "'file_io' AS type", "'x' AS description",
                                     "array(concat('f', id % 3, '.csv')) AS inputs", "array(concat('f', (id + 1) % 3, '.csv')) AS outputs")
    assert {r.degree for r in D.file_degrees(st).collect()} == {200}
    assert {name: df.count() for name, df in made} == {"file_nodes": 300, "node_pairs": 3}
