"""Graph datasets (H1–H8) and response parsing."""

from codeatlas.operators import graph as H
from codeatlas.operators import links as D
from codeatlas.operators import prompts as I
from helpers import steps_df


def test_compact_boundary(spark):
    eight = [("transform", "len()", None, "f")] * 8
    nine = [("transform", "len()", None, "g")] * 6 + [("api_call", "requests.get()", None, "g")] * 2 \
        + [("output", "print()", None, "g")]
    assert H.flow_compact(steps_df(spark, eight)).count() == 0
    r = H.flow_compact(steps_df(spark, nine)).collect()[0]
    assert r.label_tech == "g() — 9 steps (6 Transform, 2 API, 1 Output)"
    assert r.label_biz == "g — 9 steps (6 Data Processing, 2 External Service, 1 Log/Notify)"


def test_compact_view_keeps_open_functions(spark):
    s = steps_df(spark, [("transform", "len()", None, "long")] * 9 + [("transform", "int()", None, "short")] * 2
                 + [("output", "print()")] * 10)
    nodes = H.compact_nodes(s).collect()
    assert [(n.function, n.n_steps) for n in nodes if n.pos is None] == [("long", 9)]
    assert sorted(n.pos for n in nodes if n.pos is not None) == list(range(9, 21))
    got = sorted((e.function, e.src_pos, e.dst_pos) for e in H.compact_edges(s).collect())
    assert got == [("_module_", k, k + 1) for k in range(11, 20)] + [("short", 9, 10)]


def test_flow_edges_stay_in_function(spark):
    s = steps_df(spark, [("transform", "len()", None, "a"), ("transform", "int()", None, "b"),
                         ("transform", "str()", None, "a"), ("output", "print()")])
    got = sorted((r.function, r.src_pos, r.dst_pos) for r in H.flow_edges(s).collect())
    assert got == [("a", 0, 2)]


def test_ranking_key_scripts(spark):
    imp = spark.createDataFrame([("p", f"s{i}.py", 10 - i) for i in range(7)], "project_id string, path string, score long")
    got = [(r.path, r.rank, r.is_key) for r in H.ranking(imp).orderBy("rank").collect()]
    assert [g[2] for g in got] == [True, True, False, False, False, False, False]


def test_response_parsing(spark):
    s = steps_df(spark, [("transform", "len()"), ("transform", "int()")])
    raws = [
        ("processing", '```json\n{"phase_summary": " Sums ", "steps": {"1": "a", "x": "b", "9": "c"}, "risk": ""}\n```'),
        ("processing", 'Sure! {"phase_summary": "S2", "steps": {"2": "two"}, "risk": "R"} Hope it helps'),
        ("processing", '{"phase_summary": "S3"} trailing {"x": 1}'),
        ("processing", '{"phase_summary": 5, "steps": {"1": 7}}'),
        ("processing", "no json here"),
    ]
    resp = spark.createDataFrame([("p", "s.py", ph, raw) for ph, raw in raws],
                                 "project_id string, path string, phase string, raw string")
    got = sorted((r.kind, r.line, r.text) for r in I.parse_responses(resp, s).collect())
    assert got == sorted([("summary", None, "Sums"), ("step", 1, "a"), ("summary", None, "S2"),
                          ("step", 2, "two"), ("risk", None, "R")])


def test_several_keys_for_one_line(spark):
    s = steps_df(spark, [("transform", "len()"), ("transform", "int()")])
    raw = '{"steps": {"+1": "signed", "1": "plain", " 2": "spaced", "+3": "none"}}'
    resp = spark.createDataFrame([("p", "s.py", "processing", raw)], "project_id string, path string, phase string, raw string")
    parsed = I.parse_responses(resp, s)
    assert sorted((r.line, r.text) for r in parsed.collect()) == [(1, "plain"), (2, "spaced")]
    assert sorted((r.key, r.text) for r in I.merge_responses(parsed).collect()) == [("1", "plain"), ("2", "spaced")]


def test_importance_step_bonus_capped(spark):
    scripts = spark.createDataFrame([("p", "a.py", True), ("p", "b.py", False)],
                                    "project_id string, path string, is_entry_point boolean")
    many = steps_df(spark, [("transform", "len()")] * 130, path="a.py")
    few = steps_df(spark, [("transform", "len()")] * 39, path="b.py")
    services = spark.createDataFrame([("p", "a.py", 0, "OpenAI", "openai", "openai")],
                                     "project_id string, path string, pos int, name string, library string, icon string")
    conns = spark.createDataFrame([("p", "a.py", "a.py", "subprocess", "x", 0), ("p", "b.py", "a.py", "import", "y", 1)],
                                  "project_id string, source string, target string, type string, detail string, pos int")
    got = {r.path: (r.degree, r.score) for r in H.importance(scripts, services, many.unionByName(few), D.edge_degrees(conns)).collect()}
    # a.py: self edge counts twice + one incoming = 3, entry 2, one service, 130 // 20 = 6 capped at 5
    assert got["a.py"] == (3, 11)
    # b.py: one outgoing edge, 39 // 20 = 1
    assert got["b.py"] == (1, 2)


def _python_reading(raw, lines):
    """What a strict reader of one reply finds: (summary, {line: text}, risk)."""
    import json
    import re
    fence = re.search(r"```(?:json)?\s*\n?(.*?)\n?\s*```", raw, re.S)
    text = fence.group(1) if fence else raw
    try:
        obj = json.loads(text[text.index("{"):text.rindex("}") + 1])
    except (ValueError, RecursionError):
        return []
    out = [(k, None, obj[n].strip()) for k, n in (("summary", "phase_summary"), ("risk", "risk")) if isinstance(obj.get(n), str) and obj[n].strip()]
    told = {}
    for key, value in (obj["steps"].items() if isinstance(obj.get("steps"), dict) else ()):
        try:
            n = int(key)
        except ValueError:
            continue
        if n in lines and isinstance(value, str) and value.strip():
            told[n] = value.strip()
    return sorted(out + [("step", n, t) for n, t in told.items()], key=str)


def test_reply_grammar_is_exact(spark):
    s = steps_df(spark, [("transform", "len()")] * 12)
    raws = ['{"steps": {"1_1": "under", "+2": "a", "2": "b", "+2": "c", " 3 ": "sp", "٤": "arabic", "5.0": "no", "6": 7, "7": NaN, "8": " ", "-9": "neg", "١٢": "twelve"}}',
            '{"phase_summary": "x", "phase_summary": 1, "risk": NaN, "risk": "r"}', '{"phase_summary": "a"} {"phase_summary": "b"}', '[{"phase_summary": "in list"}]',
            '{"phase_summary": "\\u00e9\\ud83d\\ude00\\ud800"}', "{'phase_summary': 'quotes'}", '{"steps": [1], "risk": "\\u00a0 tail \\u00a0"}', "}{", "{", "",
            '```\n{"phase_summary": "fenced"}\n``` {"phase_summary": "later"}', '{"phase_summary": "tab\there"}', '{"steps": {"1": "one", "1": null}}', "[" * 100000 + "{" + "}",
            '{"phase_summary": Infinity, "steps": {"1": "kept",}}', '{"steps": {"%s": "long"}}' % ("9" * 5000)]
    rows = [("p", f"s{i}.py", "processing", raw) for i, raw in enumerate(raws)] + [("p", "null.py", "processing", None)]
    one = s.collect()
    steps = spark.createDataFrame([tuple({**r.asDict(), "path": f"s{i}.py"}.values()) for i in range(len(raws)) for r in one], s.schema)
    got = {}
    for r in I.parse_responses(spark.createDataFrame(rows, "project_id string, path string, phase string, raw string"), steps).collect():
        got.setdefault(r.path, []).append((r.kind, r.line, r.text))
    lines = {r.line_number for r in one}
    for i, raw in enumerate(raws):
        want = [(k, n, t.encode("utf-8", "backslashreplace").decode()) for k, n, t in _python_reading(raw, lines)]
        assert sorted(got.get(f"s{i}.py", []), key=str) == want, raw[:80]


def test_script_fields_and_progress(spark):
    scripts = spark.createDataFrame([("p", f"{x}.py") for x in "abc"] + [("q", "d.py")], "project_id string, path string")
    merged = spark.createDataFrame([("p", "a.py", "summary", "setup", "s"), ("p", "a.py", "step", "3", "t"), ("p", "b.py", "risk", "setup", "r")],
                                   "project_id string, path string, kind string, key string, text string")
    texts = I.reply_texts(spark.createDataFrame([("p", "a.py", "script", " one \n"), ("p", "b.py", "script", "  "), ("p", "c.py", "data_flow", "flow"), ("p", "", "project", "whole"),
                                                 ("p", "c.py", "script", None)], "project_id string, path string, kind string, raw string"))
    fields = I.script_fields(scripts, merged, texts)
    got = {r.path: (r.summary, r.data_flow, r.phase_summaries, r.contextual_steps, r.phase_risks) for r in fields.collect()}
    assert got == {"a.py": ("one", None, {"setup": "s"}, {3: "t"}, {}), "b.py": (None, None, {}, {}, {"setup": "r"}), "c.py": (None, "flow", None, None, None),
                   "d.py": (None, None, None, None, None)}
    assert sorted(tuple(r) for r in I.reply_progress(fields, texts).collect()) == [("p", 2, 1), ("q", 0, 0)]


def test_project_prompt_parts_join_to_the_whole(spark):
    paths = [f"d/s{i:03}.py" for i in range(60)]
    scripts = spark.createDataFrame([("p", x, i % 3 == 0) for i, x in enumerate(paths)] + [("q", "only.py", False)], "project_id string, path string, is_entry_point boolean")
    services = spark.createDataFrame([("p", 0, "HTTP", "requests", None), ("p", 1, "Slack", "slack", None)], "project_id string, pos int, name string, library string, icon string")
    conns = spark.createDataFrame([("p", paths[i], paths[i + 1], "import", f"detail {i}", i) for i in range(40)],
                                  "project_id string, source string, target string, type string, detail string, pos int")
    summaries = spark.createDataFrame([("p", paths[3], "Third\nline"), ("p", paths[4], "")], "project_id string, path string, summary string")
    lines = [f"- {x}: " + ("Third\nline" if i == 3 else I.NO_SUMMARY) for i, x in enumerate(paths)]
    edges = [f"- {paths[i]} -> {paths[i + 1]}: detail {i}" for i in range(40)]

    def text(project, n, svc, entries, script_lines, conn_lines):
        return (I.PROJECT_OBJECTIVE + f"Project: {project}\nScripts: {n}\nServices: {svc}\nEntry points: {entries}\n\nScript summaries:\n" + "\n".join(script_lines)
                + "\n\nConnections between scripts:\n" + conn_lines + "\n\n" + I.PROJECT_INSTRUCTIONS)

    want = {"p": text("p", 60, "HTTP, Slack", ", ".join(paths[::3]), lines, "\n".join(edges)), "q": text("q", 1, "None", "None", [f"- only.py: {I.NO_SUMMARY}"], "No connections.")}
    assert {r.project_id: r.user for r in I.project_prompts(scripts, services, conns, summaries).collect()} == want
    parts = sorted((r.part_no, r.text) for r in I.project_prompt_parts(scripts, services, conns, summaries, part_bytes=300).collect() if r.project_id == "p")
    assert "".join(t for _, t in parts) == want["p"] and len(parts) > 10
    assert max(len(t) for _, t in parts) <= 300 + len(I.PROJECT_INSTRUCTIONS) + 2


def test_replies_are_parsed_once(spark):
    from codeatlas.operators import prompts as I
    steps = spark.createDataFrame([("p", "a.py", 0, 3, "output", "print()")], "project_id string, path string, pos int, line_number int, type string, description string")
    raw = ['```json\n{"phase_summary": "s", "steps": {"3": "x", "4": "y"}, "risk": "r"}\n```', None, "{ no end", "} {"]
    replies = spark.createDataFrame([("p", "a.py", "reporting", r) for r in raw], "project_id string, path string, phase string, raw string")
    parsed = I.parse_responses(replies, steps)
    assert "MapInArrow" not in parsed._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.kind, r.line, r.text) for r in parsed.collect()) == [("risk", None, "r"), ("step", 3, "x"), ("summary", None, "s")]
