"""Extraction rules on inline snippets."""

from conftest import analyze, steps_of


def test_method_call_rules(spark):
    src = (
        "import requests\n"
        "r = requests.get(url)\n"          # api_call
        "json.dump(x, fh)\n"               # file_io (module guarded)
        "p.write_text('x')\n"              # pathlib -> file_io always
        "cursor.execute(q)\n"              # db_op
        "session.add(x)\n"                 # db_op (add not an HTTP verb)
        "session.get(k)\n"                 # api_call (get + session)
        "logger.info('x')\n"               # output
        "s.split(',')\n"                   # transform
        "data.execute()\n"                 # nothing: object not a DB name
        "items.add(1)\n"                   # nothing: object not a DB name
    )
    st = steps_of(analyze(spark, {"a.py": src}), "a.py")
    assert st == [
        (2, "api_call", "requests.get()"), (3, "file_io", "json.dump()"), (4, "file_io", ".write_text()"),
        (5, "db_op", "cursor.execute()"), (6, "db_op", "session.add()"), (7, "api_call", "session.get()"),
        (8, "output", "logger.info()"), (9, "transform", ".split()"),
    ]


def test_bare_calls_and_flow(spark):
    src = (
        "print('x')\n"
        "f = open('in.csv')\n"
        "g = open(name)\n"
        "n = len(sorted(x))\n"
        "if __name__ == '__main__':\n    pass\n"
        "if a:\n    pass\nelif b:\n    pass\n"
        "for (k, v) in d.items():\n    pass\n"
        "while n:\n    pass\n"
        "try:\n    pass\nexcept Exception:\n    pass\n"
        "y = [i for i in x]\n"
        "z = {k: v for k, v in d}\n"
        "w = {i for i in x}\n"
    )
    st = steps_of(analyze(spark, {"b.py": src}), "b.py")
    assert st == [
        (1, "output", "print()"), (2, "file_io", "open('in.csv')"), (3, "file_io", "open()"),
        (4, "transform", "len()"), (4, "transform", "sorted()"),
        (7, "decision", "if a"), (9, "decision", "if b"),
        (11, "decision", "for (k, v) in d.items()"), (13, "decision", "while n"),
        (15, "decision", "try/except block"),
        (19, "transform", "list comprehension: [i for ...]"),
        (20, "transform", "dict comprehension: {k: v for ...}"),
        (21, "transform", "set comprehension: {i for ...}"),
    ]


def test_service_attribution_and_sdk_calls(spark):
    src = ("import httpx\nimport requests\nimport openai\nfrom google.cloud import storage\n"
           "requests.get(u)\nhttpx.get(u)\nopenai.chat(p)\nstorage.upload(b)\nother.chat(p)\n")
    an = analyze(spark, {"c.py": src})
    rows = an.steps.orderBy("pos").collect()
    got = [(r.description, r.service.name if r.service else None) for r in rows]
    # requests and httpx share one service; its library is the first import
    # in sorted order (httpx), so requests.get() has no service.
    assert got == [("requests.get()", None), ("httpx.get()", "HTTP Client"), ("openai.chat()", "OpenAI"),
                   ("storage.upload()", "Google Cloud Storage")]
    svcs = [(r.pos, r.name, r.library) for r in an.services.orderBy("pos").collect()]
    assert svcs == [(0, "Google Cloud Storage", "google.cloud.storage"), (1, "HTTP Client", "httpx"),
                    (2, "OpenAI", "openai")]


def test_longest_prefix_service(spark):
    src = "import google.cloud.bigquery.client\nimport boto3.session\nimport botocore\n"
    an = analyze(spark, {"d.py": src})
    got = sorted((r.name, r.library) for r in an.services.collect())
    assert got == [("AWS", "boto3"), ("BigQuery", "google.cloud.bigquery")]


def test_imports_and_locality(spark):
    files = {"a.py": "import b\nfrom c.d import e\nfrom c.d import *\nfrom . import x\nimport os.path\n",
             "b.py": "x = 1\n", "c/__init__.py": "y = 2\n"}
    an = analyze(spark, files)
    rows = sorted((r.path, r["import"], r.is_internal) for r in an.imports.collect())
    assert ("a.py", "b", True) in rows
    assert ("a.py", "c.d", True) in rows and ("a.py", "c.d.e", True) in rows
    assert ("a.py", "os.path", False) in rows
    assert not any(r[1] == "c.d.*" for r in rows)


def test_secrets_decouple_guard(spark):
    files = {"a.py": "import os\nos.getenv('A')\nos.environ.get('B')\nos.environ['C']\nconfig('D')\n",
             "b.py": "from decouple import config\nconfig('E')\ndecouple.config('F')\nconfig(name)\n"}
    an = analyze(spark, files)
    got = sorted((r.path, r.secret) for r in an.secrets.collect())
    assert got == [("a.py", "A"), ("a.py", "B"), ("a.py", "C"), ("b.py", "E"), ("b.py", "F")]


def test_triggers_and_entry_point(spark):
    src = ("import argparse\n"
           "@app.post('/hook')\ndef h():\n    pass\n"
           "@app.get(path)\ndef g():\n    pass\n"
           "@click.command()\ndef cmd():\n    pass\n"
           "@modal.web_endpoint()\ndef ep():\n    pass\n"
           "schedule.every(5).minutes.do(job)\n"
           "p = argparse.ArgumentParser()\nq = ArgumentParser()\n"
           "if __name__ == '__main__':\n    main()\n")
    an = analyze(spark, {"t.py": src})
    got = [(r.type, r.detail) for r in an.triggers.orderBy("pos").collect()]
    # ast.walk is breadth first: the module-level guard precedes the calls
    # nested one level down inside statements.
    assert got == [("webhook", "POST /hook"), ("webhook", "GET <dynamic>"), ("cli", "click/typer: cmd"),
                   ("webhook", "modal endpoint: ep"), ("cli", "__main__ guard"), ("cron", "schedule job"),
                   ("cli", "argparse")]
    assert an.scripts.collect()[0].is_entry_point is True


def test_main_signature(spark):
    src = ("def main(self, a: int, b='x', c=[1, 2], d=None):\n    pass\n"
           "async def main(z):\n    pass\n")
    an = analyze(spark, {"m.py": src})
    got = [(r.param, r.annotation, r.default_json) for r in an.signature.orderBy("ord").collect()]
    assert got == [("a", "int", None), ("b", None, '"x"'), ("c", None, "[1, 2]"), ("d", None, "null")]


def test_io_enrichment(spark):
    src = ("data = json.load(fh)\n"
           "with open('out.csv', 'w') as f: pass\n"
           "rows = open('in.csv').read()\n"
           "fh = open('log.txt', 'a')\n"
           "m = open('x.txt', mode)\n"
           "if a and b.c: pass\n"
           "for x in items: pass\n"
           "a, b = int(x), str(y)\n")
    an = analyze(spark, {"io.py": src})
    got = [(r.line_number, r.description, list(r.inputs), list(r.outputs)) for r in an.steps.orderBy("pos").collect()]
    assert got == [
        (1, "json.load()", [], ["data"]),
        (2, "open('out.csv')", [], ["out.csv"]),
        (3, "open('in.csv')", ["in.csv"], ["rows"]),
        (4, "open('log.txt')", [], ["fh", "log.txt"]),
        (5, "open('x.txt')", ["x.txt"], ["m", "x.txt"]),
        (6, "if a and b.c", ["a", "b"], []),
        (7, "for x in items", ["items"], []),
        (8, "int()", [], ["a", "b"]),
        (8, "str()", [], ["a", "b"]),
    ]


def test_syntax_error_quarantine(spark):
    an = analyze(spark, {"bad.py": "def (:\n", "ok.py": "print(1)\n"})
    kinds = {(r.path, r.kind) for r in an.facts.select("path", "kind").collect()}
    assert ("bad.py", "error") in kinds
    assert an.steps.where("path = 'bad.py'").count() == 0


def test_one_walk_numbers_nodes_in_both_orders():
    import ast
    from codeatlas.operators.facts import _WANTED, _visited
    tree = ast.parse("def f(a, *, b=g(1)):\n    x = {**a, 'k': h(b)}\n    class C:\n        def m(self): return [q(i) for i in x if i]\ntry: f(1)(2)\nexcept E: pass\n")
    pre, stack = [], [(tree, 0, None)]
    while stack:
        node, depth, func = stack.pop()
        pre.append((node, depth, func))
        inner = node.name if isinstance(node, ast.FunctionDef) else func
        stack += [(c, depth + 1, inner) for c in reversed(list(ast.iter_child_nodes(node)))]
    breadth = {id(n): i for i, n in enumerate(ast.walk(tree))}
    assert _visited(tree) == [(i, breadth[id(n)], d, f, n) for i, (n, d, f) in enumerate(pre) if type(n) in _WANTED]
