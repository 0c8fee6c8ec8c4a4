"""DuckDB oracle SQL, one statement per registered query.

The oracle never parses source: it derives the *expected* analysis of the
corpus from the code templates (``sources.corpus``) joined to ``events`` by
the same arithmetic, and re-implements every rule in plain SQL. Rule tables
are rendered from the same fixed values in ``codeatlas.rules``.
"""

from __future__ import annotations

import ast
import json
import re

from codeatlas import rules as R
from codeatlas.operators import prompts as PR
from codeatlas.sources import corpus as C

W = r"[\p{L}\p{N}_]"       # Python's Unicode \w
NW = r"[^\p{L}\p{N}_]"


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"


def any_of(col: str, needles) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(n)})" for n in needles) + ")"


def subst(expr: str) -> str:
    sec = "([" + ", ".join(lit(s) for s in C.SECRET_NAMES) + "])[user_id % 5 + 1]"
    vals = (("{sec}", sec), ("{pd}", "CAST((user_id + 7) % 3 AS VARCHAR)"),
            ("{p2}", "CAST(user_id + 14 AS VARCHAR)"), ("{p}", "CAST(user_id + 7 AS VARCHAR)"),
            ("{q}", "CAST(user_id - 7 AS VARCHAR)"), ("{u}", "CAST(user_id AS VARCHAR)"),
            ("{m}", "CAST(user_id % 5 AS VARCHAR)"), ("{s}", "CAST(sif AS VARCHAR)"))
    out = expr
    for tok, v in vals:
        out = f"replace({out}, {lit(tok)}, {v})"
    return out


def lst(expr: str) -> str:
    return f"list_filter(string_split({subst(expr)}, '|'), lambda x: x <> '')"


# ----------------------------------------------------------------------------
# fixture tables rendered from the templates
# ----------------------------------------------------------------------------

def _template_rows():
    steps, trig, sec, params, flow = [], [], [], [], []
    for i, (_code, _tail, st, tr, se, pa) in enumerate(C.TEMPLATES):
        for k, (typ, desc, obj, cond, ins, outs) in enumerate(st):
            steps.append((i, k, typ, desc, obj, cond, ins, outs, "code"))
            kind = ("if" if desc.startswith("if ") else "for" if desc.startswith("for ")
                    else "while" if desc.startswith("while ") else "try" if desc.startswith("try/except")
                    else "listcomp" if desc.startswith("list comprehension") else None)
            if kind:
                flow.append((i, kind, 1 if kind == "listcomp" else 0))
        for typ, det, d in tr:
            trig.append((i, typ, det, d))
            if det == "__main__ guard":
                flow.append((i, "if", 0))
        for name, cond in se:
            sec.append((i, name, cond))
        for j, (p, a, d) in enumerate(pa):
            params.append((i, j, p, a, d))
    steps.append((C.LAUNCH_TEMPLATE, 0, "api_call", C.LAUNCH_DESCRIPTION, None, None, "", "", "launch"))
    return steps, trig, sec, params, flow


# Every token as digits, so that a template can be read as Python, and back.
_DIGITS = {token: str(7_300_001 + i) for i, token in enumerate(("{sec}", "{pd}", "{p2}", "{p}", "{q}", "{u}", "{m}", "{s}"))}
FACT_COLUMNS = ["template", "kind", "ladd", "eadd", "vadd", "vabs", "dadd", "fname", "obj", "method", "name", "chain", "arg0_str", "open_mode", "text", "text2", "names", "flag"]


def _expected_facts(template: int, source: str) -> list[tuple]:
    """Facts of one template (or header line), line and depth relative to it."""
    for token, digits in _DIGITS.items():
        source = source.replace(token, digits)
    rows: list[tuple] = []

    def dotted(x) -> str | None:
        text = ast.unparse(x)
        return text if re.fullmatch(r"\w+(\.\w+)*", text) and not text[0].isdigit() else None

    def constant(call, i, keyword=None):
        """A constant argument by place or name, as a list of at most one."""
        found = call.args[i:i + 1] or [k.value for k in call.keywords if k.arg == keyword]
        return [x.value for x in found if isinstance(x, ast.Constant)], bool(found)

    def add(node, kind, func, depth, **more):
        row = dict(template=template, kind=kind, ladd=getattr(node, "lineno", 1) - 1, dadd=depth - 1, fname=func, **more)
        for k, v in row.items():
            for token, digits in _DIGITS.items():
                if isinstance(v, str):
                    v = v.replace(digits, token)
            row[k] = v
        rows.append(tuple(row.get(c) for c in FACT_COLUMNS))

    def names(x) -> str:
        return "|".join(sorted({n.id for n in ast.walk(x) if isinstance(n, ast.Name)}))

    def first_text(call):
        return next((v for v in constant(call, 0)[0] if isinstance(v, str)), None) if isinstance(call, ast.Call) and call.args else None

    def visit(node, func, depth):
        u = ast.unparse
        if isinstance(node, ast.Call):
            f, more = node.func, {"arg0_str": first_text(node)}
            if isinstance(f, ast.Attribute):
                more |= {"obj": getattr(f.value, "id", getattr(f.value, "attr", "")), "method": f.attr, "chain": dotted(f.value)}
            elif isinstance(f, ast.Name):
                more["name"] = f.id
                if f.id == "open":
                    mode, given = constant(node, 1, "mode")
                    more |= {"open_mode": str(mode[0]) if mode else None if given else "r", "text": repr(more["arg0_str"]) if more["arg0_str"] else None}
                    more["flag"] = more["open_mode"] is None
            add(node, "call", func, depth, **more)
        elif isinstance(node, ast.Import):
            add(node, "import", func, depth, names="|".join(a.name for a in node.names))
        elif isinstance(node, ast.ImportFrom) and node.module:
            parts = [node.module] + [f"{node.module}.{a.name}" for a in node.names if "." in node.module]
            add(node, "import", func, depth, names="|".join(parts), chain=node.module)
        elif isinstance(node, ast.Assign):
            add(node, "assign", func, depth, eadd=node.end_lineno - 1, vadd=node.value.lineno - 1, names="|".join(t.id for t in node.targets if isinstance(t, ast.Name)))
        elif isinstance(node, (ast.If, ast.While)):
            guard = u(node.test) == "__name__ == '__main__'"
            add(node, type(node).__name__.lower(), func, depth, text=u(node.test), names=names(node.test), **({"flag": guard} if isinstance(node, ast.If) else {}))
        elif isinstance(node, ast.For):
            add(node, "for", func, depth, text=u(node.target), text2=u(node.iter), names=names(node.iter))
        elif isinstance(node, ast.Try):
            add(node, "try", func, depth)
        elif isinstance(node, (ast.ListComp, ast.SetComp)):
            add(node, type(node).__name__.lower(), func, depth, text=u(node.elt))
        elif isinstance(node, ast.DictComp):
            add(node, "dictcomp", func, depth, text=u(node.key), text2=u(node.value))
        elif isinstance(node, ast.Subscript) and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            add(node, "subscript", func, depth, chain=dotted(node.value), arg0_str=node.slice.value)
        elif isinstance(node, ast.FunctionDef):
            add(node, "funcdef", func, depth, name=node.name, flag=False)
            for j, d in enumerate(node.decorator_list):
                add(node, "decorator", func, depth, name=node.name, text=u(d), arg0_str=first_text(d), vabs=j)
            if node.name == "main":
                given = [None] * (len(node.args.args) - len(node.args.defaults)) + node.args.defaults
                for j, (a, d) in enumerate(zip(node.args.args, given)):
                    add(node, "param", func, depth, name=a.arg, vabs=j, text=a.annotation and u(a.annotation), text2=d and json.dumps(ast.literal_eval(d)))
            func = node.name
        for child in ast.iter_child_nodes(node):
            visit(child, func, depth + 1)

    visit(ast.parse(source), None, 0)
    return rows


def _expected(sources) -> str:
    """The facts of numbered sources as a table, untyped nulls as text."""
    body = values([r for i, source in sources for r in _expected_facts(i, source)], FACT_COLUMNS)
    text = ("fname", "obj", "method", "name", "chain", "arg0_str", "open_mode", "text", "text2", "names")
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in text)}, CAST(vabs AS BIGINT) AS vabs, CAST(eadd AS BIGINT) AS eadd, CAST(vadd AS BIGINT) AS vadd, CAST(flag AS BOOLEAN) AS flag) FROM {body}"


def fact_select() -> str:
    """Facts of the corpus: of every slot's template, of header lines and of the
    functions that slots begin."""
    text = ", ".join(f"{subst(c)} AS {c}" for c in ("obj", "method", "name", "chain", "arg0_str", "open_mode", "text", "text2", "names"))
    where = "project_id, path, kind"
    slots = _expected((i, t[0] + "\n" + (t[1] or "")) for i, t in enumerate(C.TEMPLATES))
    numbered_heads = " UNION ALL ".join(f"SELECT {h} AS h, {n} AS nth, * FROM ({_expected([(h, line)])})" for h, lines in enumerate(C.HEADERS) for n, line in enumerate(lines) if _expected_facts(h, line))
    return (f"SELECT {where}, CAST(line + ladd AS BIGINT) AS line, CAST(line + eadd AS BIGINT) AS end_line, CAST(coalesce(vabs, line + vadd) AS BIGINT) AS value_line, "
            f"CAST(sdepth + dadd AS BIGINT) AS depth, coalesce({subst('fname')}, function_name) AS func_name, {text}, flag FROM ce JOIN ({slots}) t USING (template) "
            f"UNION ALL SELECT {where}, nth + 1, NULL, NULL, 1, NULL, {text}, flag FROM (SELECT *, 0 AS sif FROM files) f JOIN ({numbered_heads}) t ON t.h = f.hdr "
            f"UNION ALL SELECT project_id, path, 'funcdef', line - 1, NULL, NULL, 1, NULL, NULL, NULL, 'f' || CAST(block AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, FALSE "
            f"FROM ce WHERE in_func AND sif % {C.SLOTS_PER_BLOCK} = 0")


def base_ctes() -> list[tuple[str, str]]:
    steps, trig, sec, params, flow = _template_rows()
    mods = " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(C.FLAVOUR_MODULI))
    ctes = [
        ("hdrs", values([(h, len(lines)) for h, lines in enumerate(C.HEADERS)], ["hdr", "header_lines"])),
        ("timports", values([(h, imp) for h, imps in enumerate(C.HEADER_IMPORTS) for imp in imps], ["hdr", "imp"])),
        ("tsteps", values(steps, ["template", "k", "type", "description", "obj", "cond", "inputs", "outputs", "src"])),
        ("ttrig", values(trig, ["template", "type", "detail", "depth_add"])),
        ("tsec", values(sec, ["template", "name", "cond"])),
        ("tparam", values(params, ["template", "ord", "param", "annotation", "default_json"])),
        ("tflow", values(flow, ["template", "kind", "depth_add"])),
        ("svcmap", values(list(R.SERVICE_MAP), ["prefix", "name", "icon"])),
        ("phasedim", values([(p, lab, i) for i, (p, lab) in enumerate(R.PHASES)], ["phase", "phase_label", "phase_ord"])),
        ("typedim", values([t[:4] for t in R.TYPE_LABELS], ["type", "business", "technical", "short"])),
        ("ev", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS slot "
               "FROM events"),
        ("ce0", f"""SELECT event_id, user_id, slot, slot // {C.SLOTS_PER_FILE} AS chunk,
                CAST(slot % {C.SLOTS_PER_FILE} AS INTEGER) AS sif,
                CAST((slot % {C.SLOTS_PER_FILE}) // {C.SLOTS_PER_BLOCK} AS INTEGER) AS block,
                ((slot % {C.SLOTS_PER_FILE}) // {C.SLOTS_PER_BLOCK}) % 3 <> 2 AS in_func,
                CAST(user_id % 6 AS INTEGER) AS hdr,
                CAST((event_id * 31 + user_id) % (CASE user_id % 4 {mods} END) AS INTEGER) AS template,
                'p' || CAST(user_id % 7 AS VARCHAR) AS project_id,
                'd' || CAST(user_id % 3 AS VARCHAR) || '/m' || CAST(user_id AS VARCHAR) || 'c'
                    || CAST(slot // {C.SLOTS_PER_FILE} AS VARCHAR) || '.py' AS path
            FROM ev"""),
        ("ce", """SELECT ce0.*, h.header_lines + 3 * sif + 2 AS line,
                CASE WHEN in_func THEN 'f' || CAST(block AS VARCHAR) END AS function_name,
                CASE WHEN in_func THEN 2 ELSE 1 END AS sdepth
            FROM ce0 JOIN hdrs h USING (hdr)"""),
        ("files", "SELECT DISTINCT project_id, path, user_id, hdr FROM ce"),
        ("mods", r"SELECT DISTINCT project_id, regexp_replace(regexp_extract(path, '[^/]*$'), '\.py$', '') AS module "
                 "FROM files"),
        ("imps0", f"SELECT f.project_id, f.path, {subst('t.imp').replace('sif', '0')} AS import "
                  "FROM (SELECT *, 0 AS sif FROM files) f JOIN timports t USING (hdr)"),
        ("imps", """SELECT i.project_id, i.path, i.import, m.module IS NOT NULL AS is_internal
            FROM imps0 i LEFT JOIN mods m ON m.project_id = i.project_id AND m.module = split_part(i.import, '.', 1)"""),
        ("svc_best", """SELECT * FROM (
                SELECT i.project_id, i.path, i.import, m.prefix, m.name, m.icon,
                       row_number() OVER (PARTITION BY i.project_id, i.path, i.import ORDER BY length(m.prefix) DESC) rn
                FROM imps i JOIN svcmap m ON (i.import = m.prefix OR starts_with(i.import, m.prefix || '.'))
                WHERE NOT i.is_internal) WHERE rn = 1"""),
        ("svc", """SELECT project_id, path, row_number() OVER (PARTITION BY project_id, path ORDER BY first_import) - 1 AS pos,
                name, library, icon FROM (
                SELECT project_id, path, name, min(import) AS first_import, arg_min(prefix, import) AS library,
                       arg_min(icon, import) AS icon
                FROM svc_best GROUP BY project_id, path, name)"""),
        ("skeys", """SELECT project_id, path, key, arg_min(name, pos) AS svc_name, arg_min(library, pos) AS svc_library,
                arg_min(icon, pos) AS svc_icon FROM (
                SELECT project_id, path, pos, name, library, icon, library AS key FROM svc
                UNION ALL
                SELECT project_id, path, pos, name, library, icon, regexp_extract(library, '[^.]*$') AS key
                FROM svc WHERE contains(library, '.'))
            GROUP BY project_id, path, key"""),
        ("st0", f"""SELECT c.project_id, c.path, c.user_id, c.sif, c.line, c.function_name, t.k, t.type, t.src,
                {subst('t.description')} AS description, {lst('t.inputs')} AS inputs, {lst('t.outputs')} AS outputs,
                CASE WHEN t.type = 'api_call' THEN sk.svc_name END AS svc_name,
                CASE WHEN t.type = 'api_call' THEN sk.svc_library END AS svc_library,
                CASE WHEN t.type = 'api_call' THEN sk.svc_icon END AS svc_icon
            FROM ce c JOIN tsteps t ON t.template = c.template
            LEFT JOIN skeys sk ON sk.project_id = c.project_id AND sk.path = c.path AND sk.key = t.obj
            WHERE t.cond IS NULL OR sk.key IS NOT NULL"""),
        ("stc", """SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY line, k) - 1 AS pos
            FROM st0 WHERE src = 'code'"""),
        ("st", """SELECT project_id, path, row_number() OVER (PARTITION BY project_id, path ORDER BY line, k) - 1 AS pos,
                line AS line_number, type, description, function_name, svc_name, svc_library, svc_icon, inputs, outputs
            FROM st0"""),
        ("trig", f"""SELECT project_id, path, row_number() OVER (PARTITION BY project_id, path ORDER BY d, l) - 1 AS pos,
                type, detail FROM (
                SELECT project_id, path, type, detail, min(d * 100000000 + l) AS dl, min(d) AS d0,
                       arg_min(d, d * 100000000 + l) AS d, arg_min(l, d * 100000000 + l) AS l FROM (
                    SELECT c.project_id, c.path, t.type, {subst('t.detail')} AS detail, c.sdepth + t.depth_add AS d,
                           c.line AS l
                    FROM ce c JOIN ttrig t ON t.template = c.template)
                GROUP BY project_id, path, type, detail)"""),
        ("sec", f"""SELECT DISTINCT c.project_id, c.path, {subst('t.name')} AS secret
            FROM ce c JOIN tsec t ON t.template = c.template WHERE t.cond IS NULL OR c.hdr = 1"""),
        ("scripts", """SELECT f.project_id, f.path, coalesce(e.flag, FALSE) AS is_entry_point
            FROM files f LEFT JOIN (SELECT DISTINCT project_id, path, TRUE AS flag FROM trig
                                    WHERE detail = '__main__ guard') e USING (project_id, path)"""),
        ("sig", """SELECT c.project_id, c.path, p.ord, p.param, p.annotation, p.default_json
            FROM (SELECT project_id, path, arg_min(line, sdepth * 100000000 + line) AS line
                  FROM ce WHERE template IN (SELECT DISTINCT template FROM tparam) GROUP BY project_id, path) m
            JOIN ce c ON c.project_id = m.project_id AND c.path = m.path AND c.line = m.line
            JOIN tparam p ON p.template = c.template WHERE p.param <> 'self'"""),
    ]
    ctes += label_ctes() + link_ctes() + response_ctes()
    return ctes


# ----------------------------------------------------------------------------
# E: labels in SQL
# ----------------------------------------------------------------------------

def clean_var(x: str) -> str:
    v = f"regexp_replace(regexp_replace({x}, '^self\\.', ''), '^_+', '')"
    return f"(CASE WHEN {v} = '' THEN 'value' ELSE {v} END)"


def humanize_tokens(c: str) -> str:
    r = (f"regexp_replace({c}, '({W}+)\\[''({W}+)''\\]|({W}+)\\[\"({W}+)\"\\]', '\\1\\3 \\2\\4', 'g')")
    r = (f"regexp_replace({r}, '({W}+)\\.get\\(''({W}+)''\\)|({W}+)\\.get\\(\"({W}+)\"\\)', '\\1\\3 \\2\\4', 'g')")
    r = f"replace({r}, ' and (not ', ' and not ')"
    r = f"regexp_replace({r}, '[()]', '', 'g')"
    return (f"array_to_string(list_transform(regexp_extract_all({r}, '({W}+|{NW}+)', 1), "
            f"lambda t: CASE WHEN regexp_full_match(t, '{W}+_{W}+') THEN replace(t, '_', ' ') ELSE t END), '')")


def humanize_finish(h: str) -> str:
    return (f"(CASE WHEN regexp_matches({h}, '[.\\[\\]{{}}]') OR trim({h}) = '' THEN 'data meets conditions' "
            f"ELSE trim({h}) END)")


def simplify(cond: str, human: str) -> str:
    subject = f"trim(substring({cond}, 5))"
    before = f"trim(split_part({cond}, ' is None', 1))"
    return (f"(CASE WHEN starts_with({cond}, 'not ') AND (contains({subject}, 'os.path.exists') "
            f"OR contains({subject}, 'Path(')) THEN 'file doesn''t exist' "
            f"WHEN starts_with({cond}, 'not ') THEN {clean_var(subject)} || ' is missing' "
            f"WHEN contains({cond}, ' is None') THEN {clean_var(before)} || ' is empty' "
            f"WHEN length({human}) > {R.CONDITION_MAX} THEN substring({human}, 1, {R.CONDITION_MAX - 3}) || '...' "
            f"ELSE {human} END)")


def translate_step(t: str, d: str, svc: str, checks: str) -> str:
    dl = f"lower({d})"
    target = f"coalesce({svc}, 'external service')"
    api = "CASE " + " ".join(f"WHEN contains({d}, {lit(n)}) THEN {lit(v + ' ')} || {target}" for n, v in R.API_VERBS) \
        + f" ELSE 'Fetches data from ' || {target} END"
    fil = (f"CASE WHEN {any_of(dl, R.FILE_WRITE_SIGNALS)} THEN 'Saves data to file' "
           f"WHEN {any_of(dl, R.FILE_READ_SIGNALS)} THEN 'Reads data from file' "
           f"WHEN contains({dl}, 'open(') THEN 'Opens file' ELSE 'Reads/writes file' END")
    db = f"CASE WHEN {any_of(dl, R.DB_WRITE_SIGNALS)} THEN 'Saves to database' ELSE 'Queries database' END"
    var = f"regexp_extract({d}, '^for\\s+\\(?({W}+)', 1)"
    dec = (f"CASE WHEN starts_with({d}, 'try/except') THEN 'Handles potential errors' "
           f"WHEN starts_with({d}, 'for ') AND {var} <> '' THEN 'Processes each ' || {var} "
           f"WHEN starts_with({d}, 'for ') THEN 'Repeats for each item' "
           f"WHEN starts_with({d}, 'while ') THEN 'Repeats while condition is met' "
           f"WHEN starts_with({d}, 'if ') THEN 'Checks: ' || {checks} ELSE 'Checks a condition' END")
    lg = f"(contains({dl}, 'logger.') OR contains({dl}, 'logging.'))"
    out = (f"CASE WHEN {lg} AND contains({dl}, 'error') THEN 'Records an error' "
           f"WHEN {lg} AND contains({dl}, 'warning') THEN 'Records a warning' "
           f"WHEN {lg} THEN 'Records activity' WHEN contains({dl}, 'print(') THEN 'Displays message' "
           f"WHEN contains({dl}, 'send') THEN 'Sends notification' ELSE 'Produces output' END")
    tr = "CASE " + " ".join(f"WHEN {any_of(dl, ns)} THEN {lit(lab)}" for ns, lab in R.TRANSFORM_RULES) \
        + " ELSE 'Processes data' END"
    return (f"(CASE WHEN {t} = 'api_call' THEN {api} WHEN {t} = 'file_io' THEN {fil} WHEN {t} = 'db_op' THEN {db} "
            f"WHEN {t} = 'decision' THEN {dec} WHEN {t} = 'output' THEN {out} WHEN {t} = 'transform' THEN {tr} "
            f"ELSE upper(substring(replace({t}, '_', ' '), 1, 1)) || lower(substring(replace({t}, '_', ' '), 2)) END)")


def infer_phase(t: str, d: str) -> str:
    dl = f"lower(coalesce({d}, ''))"
    return (f"(CASE WHEN {t} = 'decision' AND starts_with({dl}, 'try/except') THEN 'error_handling' "
            f"WHEN {t} = 'decision' AND (starts_with({dl}, 'for ') OR starts_with({dl}, 'while ')) THEN 'processing' "
            f"WHEN {t} = 'output' THEN 'reporting' WHEN {t} = 'transform' THEN 'processing' "
            f"WHEN {any_of(dl, R.STORAGE_KEYWORDS)} THEN 'storage' "
            f"WHEN {any_of(dl, R.SETUP_KEYWORDS)} THEN 'setup' "
            f"WHEN {t} = 'decision' THEN 'processing' "
            f"WHEN {t} IN ('api_call', 'file_io', 'db_op') THEN 'setup' ELSE 'processing' END)")


def translate_trigger(t: str, d: str) -> str:
    cron = "CASE " + " ".join(f"WHEN contains({d}, {lit(p)}) THEN {lit(h)}" for p, h in R.CRON_PATTERNS) + \
        (f" WHEN regexp_extract({d}, '^\\*/(\\d+)\\s', 1) <> '' THEN 'Runs every ' || "
         f"CAST(CAST(regexp_extract({d}, '^\\*/(\\d+)\\s', 1) AS BIGINT) AS VARCHAR) || ' minutes' "
         "ELSE 'Runs on a schedule' END")
    after = f"trim(substring({d}, strpos({d}, ':') + 1))"
    dlow = f"lower({d})"
    cli = (f"CASE WHEN contains({d}, '__main__') THEN 'Can be run directly' "
           f"WHEN contains({d}, 'argparse') THEN 'Accepts command-line options' "
           f"WHEN (contains({d}, 'click') OR contains({d}, 'typer')) AND (contains({dlow}, 'click:') "
           f"OR contains({dlow}, 'typer:')) AND {after} <> '' THEN 'Command: ' || {after} "
           "ELSE 'Run from command line' END")
    path = "CASE " + " ".join(f"WHEN starts_with(upper({d}), {lit(m)}) THEN trim(substring({d}, {len(m) + 1}))"
                              for m in R.WEBHOOK_METHOD_PREFIXES) + f" ELSE {d} END"
    hook = (f"CASE WHEN contains({dlow}, 'modal') THEN 'Cloud function: ' || "
            f"(CASE WHEN contains({d}, ':') THEN {after} ELSE {d} END) "
            f"WHEN ({path}) <> '' THEN 'Triggered by web request to ' || ({path}) ELSE 'Triggered by web request' END")
    return (f"(CASE WHEN lower({t}) IN ('cron', 'schedule') THEN {cron} WHEN lower({t}) = 'cli' THEN {cli} "
            f"WHEN lower({t}) = 'webhook' THEN {hook} WHEN lower({t}) = 'import' THEN 'Used by other scripts' "
            f"WHEN lower({t}) = 'manual' THEN 'Run manually' "
            f"ELSE upper(substring({t}, 1, 1)) || lower(substring({t}, 2)) END)")


def title_case(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1), "
            "lambda t: CASE WHEN regexp_matches(t, '^\\p{L}') THEN upper(substring(t, 1, 1)) || lower(substring(t, 2)) "
            "ELSE t END), '')")


def translate_secret(s: str) -> str:
    up = f"upper({s})"
    parts = [f"WHEN starts_with({up}, {lit(p)}) THEN {lit(lab + ' credentials')}" for p, lab in R.SECRET_PREFIXES]
    for suf in R.SECRET_SUFFIXES:
        stem = f"trim(replace(substring({s}, 1, length({s}) - {len(suf)}), '_', ' '))"
        parts.append(f"WHEN ends_with({up}, {lit(suf)}) THEN CASE WHEN {stem} <> '' THEN "
                     f"{title_case(stem)} || ' credentials' ELSE 'API credentials' END")
    return "(CASE " + " ".join(parts) + f" ELSE 'Configuration: ' || {s} END)"


def translate_connection(t: str) -> str:
    return "(CASE " + " ".join(f"WHEN {t} = {lit(a)} THEN {lit(b)}" for a, b in R.CONNECTION_VERBS) + f" ELSE {t} END)"


def label_ctes() -> list[tuple[str, str]]:
    return [
        ("lab0", f"""SELECT st.*, CASE WHEN type = 'decision' AND starts_with(description, 'if ')
                THEN trim(substring(description, 4)) END AS _cond, {infer_phase('type', 'description')} AS phase
            FROM st"""),
        ("lab1", f"SELECT *, {humanize_finish(humanize_tokens('_cond'))} AS _human FROM lab0"),
        ("lab", f"""SELECT l.*, {translate_step('type', 'description', 'svc_name', simplify('_cond', '_human'))} AS label,
                p.phase_label, p.phase_ord FROM lab1 l JOIN phasedim p USING (phase)"""),
    ]


# ----------------------------------------------------------------------------
# D: links in SQL
# ----------------------------------------------------------------------------

def looks_like_file(x: str) -> str:
    return (f"(NOT starts_with({x}, 'http') AND length({x}) <= 256 AND "
            f"regexp_full_match({x}, '(?s).*\\.[\\p{{L}}\\p{{N}}]{{1,6}}'))")


def link_ctes() -> list[tuple[str, str]]:
    return [
        ("modmap", r"""SELECT project_id, regexp_replace(regexp_extract(path, '[^/]*$'), '^(.+)\.[^.]+$', '\1') AS stem,
                max(path) AS target FROM files GROUP BY 1, 2"""),
        ("e_imp", """SELECT i.project_id, i.path AS source, m.target, 'import' AS type,
                i.path || ' imports from ' || m.target AS detail, 0 AS kind, i.import AS a, 0 AS b, m.target AS c
            FROM imps i JOIN modmap m ON m.project_id = i.project_id AND m.stem = split_part(i.import, '.', 1)
            WHERE i.is_internal AND i.path <> m.target"""),
        ("fio", "SELECT * FROM st WHERE type = 'file_io'"),
        ("reads", f"""SELECT DISTINCT project_id, path, file FROM (
                SELECT project_id, path, unnest(inputs) AS file FROM fio) WHERE {looks_like_file('file')}
            UNION
            SELECT DISTINCT project_id, path, regexp_extract(description, '(?s)''(.*)''', 1) AS file FROM fio
            WHERE len(inputs) = 0 AND len(outputs) = 0 AND contains(description, 'open(')
              AND strpos(description, '''') > 0
              AND length(description) - strpos(reverse(description), '''') + 1 > strpos(description, '''')"""),
        ("writes", f"""SELECT DISTINCT project_id, path, file FROM (
                SELECT project_id, path, unnest(outputs) AS file FROM fio) WHERE {looks_like_file('file')}"""),
        ("e_file", """SELECT w.project_id, w.path AS source, r.path AS target, 'file_io' AS type,
                w.path || ' writes ' || min(w.file) AS detail, 1 AS kind, r.path AS a, 0 AS b, min(w.file) AS c
            FROM writes w JOIN reads r ON r.project_id = w.project_id AND r.file = w.file
            WHERE w.path <> r.path GROUP BY w.project_id, w.path, r.path"""),
        ("e_launch", """SELECT s.project_id, s.path AS source, f.path AS target, 'subprocess' AS type,
                s.path || ' runs ' || f.path || ' via subprocess' AS detail, 2 AS kind, '' AS a, min(s.pos) AS b,
                f.path AS c
            FROM st s JOIN files f ON f.project_id = s.project_id AND contains(s.description, f.path)
            WHERE s.type = 'api_call' GROUP BY s.project_id, s.path, f.path"""),
        ("conns", """SELECT project_id, source, target, type, detail,
                row_number() OVER (PARTITION BY project_id ORDER BY source, kind, a, b, c) - 1 AS pos
            FROM (SELECT *, row_number() OVER (PARTITION BY project_id, source, target, type ORDER BY kind, a, b, c) AS rn
                  FROM (SELECT * FROM e_imp UNION ALL SELECT * FROM e_file UNION ALL SELECT * FROM e_launch))
            WHERE rn = 1"""),
    ]


# ----------------------------------------------------------------------------
# Replies, derived from the conversations by the same arithmetic
# ----------------------------------------------------------------------------

def response_ctes() -> list[tuple[str, str]]:
    phase = "[" + ", ".join(lit(p) for p, _ in R.PHASES) + "][turn + 1]"
    strip = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
    return [
        ("talk", """SELECT conv_id, turn, role, text, 'p' || CAST(conv_id % 7 AS VARCHAR) AS project_id,
                'd' || CAST(conv_id % 3 AS VARCHAR) || '/m' || CAST(conv_id AS VARCHAR) || 'c0.py' AS path FROM conversations"""),
        ("asked", "SELECT DISTINCT project_id, path, phase FROM lab"),
        ("reply", f"""SELECT *, (conv_id + turn) % 8 AS v, string_split(text, ' ') AS w FROM (SELECT *, {phase} AS phase FROM talk WHERE turn BETWEEN 0 AND 4)
            SEMI JOIN asked USING (project_id, path, phase) WHERE (conv_id + turn) % 8 NOT IN (3, 5)"""),
        ("rkey", f"""SELECT *, 2 + (conv_id * 7 + turn * 3 + k * k) % {C.REPLY_LINES} AS n, k % 7 NOT IN (3, 5) AS is_text, w[CAST((k * 3) % len(w) AS INTEGER) + 1] AS word
            FROM (SELECT *, unnest(range({C.REPLY_KEYS})) AS k FROM reply)"""),
        # equal keys of one object: the first place, the last value
        ("rmember", """SELECT project_id, path, phase, conv_id, turn, n, form, min(k) AS place, arg_max(is_text, k) AS is_text, arg_max(word, k) AS word
            FROM (SELECT *, CASE WHEN k % 6 = 3 AND n < 10 THEN 0 ELSE k % 6 END AS form FROM rkey) WHERE form <> 5 GROUP BY ALL"""),
        ("rparsed_ok", f"""SELECT project_id, path, phase, 'summary' AS kind, -1 AS line, {strip.format('text')} AS text FROM reply WHERE {strip.format('text')} <> ''
            UNION ALL SELECT project_id, path, phase, 'risk', -1, {strip.format('role')} FROM reply WHERE v NOT IN (6, 7) AND {strip.format('role')} <> ''
            UNION ALL SELECT m.project_id, m.path, m.phase, 'step', m.n, arg_max({strip.format('word')}, place)
            FROM rmember m SEMI JOIN lab l ON l.project_id = m.project_id AND l.path = m.path AND l.phase = m.phase AND l.line_number = m.n
            WHERE is_text AND {strip.format('word')} <> '' GROUP BY m.project_id, m.path, m.phase, m.n"""),
        ("rtext", f"""SELECT * FROM (
                SELECT project_id, path, CASE turn WHEN 5 THEN 'script' ELSE 'data_flow' END AS kind, {strip.format('text')} AS text
                FROM talk SEMI JOIN files USING (project_id, path) WHERE turn IN (5, 6)
                UNION ALL
                SELECT project_id, '', 'project', {strip.format('arg_min(text, conv_id)')} FROM talk WHERE turn = 7 GROUP BY project_id HAVING project_id IN (SELECT project_id FROM files))
            WHERE text <> ''"""),
        ("rmerged", """SELECT project_id, path, kind, phase AS key, text FROM rparsed_ok WHERE kind <> 'step'
            UNION ALL
            SELECT r.project_id, r.path, 'step', CAST(r.line AS VARCHAR), arg_max(r.text, p.phase_ord)
            FROM rparsed_ok r JOIN phasedim p USING (phase) WHERE r.kind = 'step' GROUP BY r.project_id, r.path, r.line"""),
        ("rmaps", """SELECT f.project_id, f.path, m.project_id IS NOT NULL AS found, coalesce(ns, 0) AS ns, coalesce(nt, 0) AS nt, coalesce(nr, 0) AS nr, summaries, steps, risks
            FROM files f LEFT JOIN (SELECT project_id, path, count(*) FILTER (kind = 'summary') AS ns, count(*) FILTER (kind = 'step') AS nt, count(*) FILTER (kind = 'risk') AS nr,
                coalesce(string_agg(key || '=' || text, chr(10) ORDER BY key) FILTER (kind = 'summary'), '') AS summaries,
                coalesce(string_agg(key || '=' || text, chr(10) ORDER BY TRY_CAST(key AS INTEGER)) FILTER (kind = 'step'), '') AS steps,
                coalesce(string_agg(key || '=' || text, chr(10) ORDER BY key) FILTER (kind = 'risk'), '') AS risks
                FROM rmerged GROUP BY ALL) m USING (project_id, path)"""),
    ]


# ----------------------------------------------------------------------------
# per-query SELECTs
# ----------------------------------------------------------------------------

FINDING_SELECT = "project_id, path, id, severity, title, detail, phase, CAST(count AS BIGINT) AS count"
RSQUO = "’"
EM = "—"


def findings_ctes() -> list[tuple[str, str]]:
    return [
        ("cnt", """SELECT project_id, path, count(*) AS total,
                count(*) FILTER (WHERE type = 'output' AND contains(lower(description), 'print')) AS n_print,
                count(*) FILTER (WHERE type = 'output' AND (contains(lower(description), 'logger')
                                  OR contains(lower(description), 'logging'))) AS n_logger,
                count(*) FILTER (WHERE type = 'decision' AND starts_with(description, 'try/except')) AS n_try,
                count(*) FILTER (WHERE type IN ('api_call', 'file_io', 'db_op')) AS n_io
            FROM st GROUP BY project_id, path"""),
        ("pg", """SELECT project_id, path, phase, phase_label, phase_ord, count(*) AS n_steps, min(pos) AS first_pos,
                sum(count(*)) OVER (PARTITION BY project_id, path) AS total
            FROM lab GROUP BY project_id, path, phase, phase_label, phase_ord"""),
        ("f_print", f"""SELECT project_id, path, 0 AS rule, 0 AS sub, 'print_spam' AS id, 'warning' AS severity,
                'No logging framework' AS title,
                CAST(n_print AS VARCHAR) || ' print() calls found. Python{RSQUO}s logging module provides log levels, timestamps, and configurable output.' AS detail,
                CAST(NULL AS VARCHAR) AS phase, n_print AS count
            FROM cnt WHERE n_print > {R.PRINT_SPAM_MIN} AND n_logger = 0"""),
        ("f_phase", """SELECT project_id, path, 1 AS rule, phase_ord AS sub, 'phase_imbalance' AS id, 'info' AS severity,
                phase_label || ' dominates' AS title,
                phase_label || ' accounts for ' || CAST(CAST(floor(n_steps / total * 100) AS BIGINT) AS VARCHAR)
                || '% of all steps (' || CAST(n_steps AS VARCHAR) || '/' || CAST(CAST(total AS BIGINT) AS VARCHAR)
                || '). This phase may be doing too much.' AS detail, phase, n_steps AS count
            FROM pg WHERE n_steps / total > 0.5"""),
        ("f_bulk", f"""SELECT project_id, path, 2 AS rule, 0 AS sub, 'error_handling_bulk' AS id, 'warning' AS severity,
                'Repetitive error handling' AS title,
                CAST(n_try AS VARCHAR) || ' try/except blocks. Consider extracting a retry/error-handling helper function.'
                AS detail, CAST(NULL AS VARCHAR) AS phase, n_try AS count FROM cnt WHERE n_try > {R.TRY_BULK_MIN}"""),
        ("f_noerr", f"""SELECT project_id, path, 3 AS rule, 0 AS sub, 'no_error_handling' AS id, 'concern' AS severity,
                'No error handling' AS title,
                'This script has no try/except blocks. External service calls and file operations should be wrapped in error handling.'
                AS detail, CAST(NULL AS VARCHAR) AS phase, 0 AS count FROM cnt WHERE total > {R.NO_ERROR_MIN_STEPS} AND n_try = 0 AND n_io > 0"""),
        ("f_heavy", f"""SELECT project_id, path, 4 AS rule, min(pos) AS sub, 'transform_heavy' AS id, 'info' AS severity,
                'Heavy data manipulation' AS title,
                '"' || label || '" appears ' || CAST(count(*) AS VARCHAR) || ' times. Complex transform chains may benefit from a data pipeline library (pandas, etc.).'
                AS detail, CAST(NULL AS VARCHAR) AS phase, count(*) AS count FROM lab WHERE type = 'transform' GROUP BY project_id, path, label
            HAVING count(*) > {R.TRANSFORM_HEAVY_MIN}"""),
        ("fall", """SELECT * FROM f_print UNION ALL SELECT * FROM f_phase UNION ALL SELECT * FROM f_bulk
            UNION ALL SELECT * FROM f_noerr UNION ALL SELECT * FROM f_heavy"""),
    ]


def _pattern(label: str, n: str, first_type: str) -> str:
    dl = f"lower({label})"
    ns = f"CAST({n} AS VARCHAR)"
    after = lambda sep: f"substring({label}, strpos({label}, {lit(sep)}) + {len(sep)})"
    svc_upd = (f"CASE WHEN contains({dl}, 'to ') THEN (CASE WHEN contains({label}, 'to ') THEN {after('to ')} "
               f"ELSE {label} END) WHEN contains({dl}, 'on ') THEN (CASE WHEN contains({label}, 'on ') THEN "
               f"{after('on ')} ELSE {label} END) ELSE 'service' END")
    biz = "CASE " + " ".join(f"WHEN {first_type} = {lit(t[0])} THEN {lit(t[1])}" for t in R.TYPE_LABELS) + \
        f" ELSE upper(substring(replace({first_type}, '_', ' '), 1, 1)) || lower(substring(replace({first_type}, '_', ' '), 2)) END"
    return f"""(CASE
        WHEN contains({dl}, 'displays message') AND {n} > {R.PRINT_EXCESS} THEN 'Excessive output {EM} ' || {ns} || ' print() calls; consider Python{RSQUO}s logging module for structured output'
        WHEN contains({dl}, 'displays message') THEN 'Status logging {EM} tracks workflow progress across ' || {ns} || ' checkpoints'
        WHEN {any_of(dl, ('records activity', 'records a warning', 'records an error', 'produces output'))} THEN 'Status logging {EM} tracks workflow progress across ' || {ns} || ' checkpoints'
        WHEN contains({dl}, 'sends notification') THEN 'Notification system {EM} alerts stakeholders at ' || {ns} || ' different stages'
        WHEN contains({dl}, 'handles potential errors') AND {n} > {R.TRY_EXCESS} THEN 'Repetitive error handling {EM} ' || {ns} || ' identical try/except blocks suggest extracting a shared helper'
        WHEN contains({dl}, 'handles potential errors') THEN 'Defensive coding {EM} each operation is protected so one failure doesn{RSQUO}t crash the script'
        WHEN contains({dl}, 'fetches data from') THEN 'Batch data gathering {EM} collects data from ' || (CASE WHEN contains({label}, 'from ') THEN {after('from ')} ELSE 'service' END) || ' in ' || {ns} || ' requests'
        WHEN contains({dl}, 'sends data to') OR contains({dl}, 'updates data on') THEN 'Batch updates {EM} pushes data to ' || ({svc_upd}) || ' in ' || {ns} || ' operations'
        WHEN contains({dl}, 'authenticates with') THEN 'Multi-service authentication {EM} connects to ' || {ns} || ' different services'
        WHEN contains({dl}, 'saves to database') THEN 'Incremental storage {EM} saves results in ' || {ns} || ' operations as they{RSQUO}re processed'
        WHEN contains({dl}, 'queries database') THEN 'Multi-query retrieval {EM} retrieves different data sets in ' || {ns} || ' queries'
        WHEN contains({dl}, 'saves data to file') THEN 'Progressive file output {EM} writes data across ' || {ns} || ' save operations'
        WHEN contains({dl}, 'reads data from file') THEN 'Multi-source input {EM} loads data from ' || {ns} || ' different reads'
        WHEN contains({dl}, 'processes each') OR contains({dl}, 'repeats for each') THEN 'Iteration pattern {EM} ' || {ns} || ' loops process data through multiple stages'
        WHEN contains({dl}, 'checks:') THEN 'Validation logic {EM} verifies ' || {ns} || ' conditions to ensure correct behavior'
        WHEN {any_of(dl, ('processes data', 'builds a collection', 'cleans up text', 'sorts data', 'converts data', 'counts items', 'splits text', 'joins text'))} THEN 'Data pipeline {EM} transforms data through ' || {ns} || ' processing steps'
        ELSE 'Repeated ' || ({biz}) || ' {EM} this pattern appears ' || {ns} || ' times across the script' END)"""


def _prefix(t: str) -> str:
    return "(CASE " + " ".join(f"WHEN {t} = {lit(x[0])} THEN {lit(x[4])}" for x in R.TYPE_LABELS) + " ELSE '' END)"


def _or_none(x: str, none: str = "None") -> str:
    return f"(CASE WHEN coalesce({x}, '') = '' THEN {lit(none)} ELSE {x} END)"


def _nl(s: str) -> str:
    """SQL text for a Python string that may hold newlines."""
    parts = s.split("\n")
    return " || chr(10) || ".join(lit(p) for p in parts) if len(parts) > 1 else lit(s)


def _listj(x: str) -> str:
    return f"(CASE WHEN len({x}) > 0 THEN array_to_string({x}, ', ') ELSE 'none' END)"


SELECTS: dict[str, str] = {
    "scan_sources": f"""SELECT project_id, path, CAST(length AS BIGINT) AS length,
        CASE WHEN length > {R.MAX_FILE_SIZE} THEN 'too_large' ELSE 'ok' END AS status FROM tree
        WHERE ends_with(path, '.py') AND NOT regexp_matches(path, '(^|/)(' || {lit('|'.join(d.replace('.', chr(92) + '.') for d in R.SKIP_DIRS))} || '|\\.[^/]*)/')
          AND NOT (regexp_extract(path, '[^/]*$') = '__init__.py' AND length = 0)""",
    "local_modules": f"""SELECT DISTINCT project_id,
        CASE WHEN regexp_extract(path, '[^/]*$') = '__init__.py' THEN regexp_extract(path, '([^/]*)/[^/]*$', 1)
             ELSE regexp_replace(regexp_extract(path, '[^/]*$'), '\\.py$', '') END AS module FROM tree
        WHERE ends_with(path, '.py') AND NOT regexp_matches(path, '(^|/)(' || {lit('|'.join(d.replace('.', chr(92) + '.') for d in R.SKIP_DIRS))} || '|\\.[^/]*)/')""",
    "analysis_roundtrip": None,
    "syntax_facts": None,
    "imports_split": "SELECT project_id, path, import, is_internal FROM imps",
    "secrets": "SELECT project_id, path, secret FROM sec",
    "triggers": """SELECT t.project_id, t.path, CAST(t.pos AS BIGINT) AS pos, t.type, t.detail, s.is_entry_point
        FROM trig t JOIN scripts s USING (project_id, path)""",
    "main_signature": "SELECT project_id, path, CAST(ord AS BIGINT) AS ord, param, annotation, default_json FROM sig",
    "steps_classified": """SELECT project_id, path, CAST(pos AS BIGINT) AS pos, CAST(line AS BIGINT) AS line_number, type,
        description, function_name, svc_name AS service_name, svc_library AS service_library, svc_icon AS service_icon
        FROM stc""",
    "steps_io": """SELECT project_id, path, CAST(pos AS BIGINT) AS pos, array_to_string(inputs, '|') AS inputs,
        array_to_string(outputs, '|') AS outputs FROM stc""",
    "script_services": "SELECT project_id, path, CAST(pos AS BIGINT) AS pos, name, library, icon FROM svc",
    "project_services": """SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY fpath, fpos) - 1 AS BIGINT) AS pos,
        name, library, icon FROM (
            SELECT project_id, name, arg_min(path, path || chr(1) || lpad(CAST(pos AS VARCHAR), 9, '0')) AS fpath,
                   arg_min(pos, path || chr(1) || lpad(CAST(pos AS VARCHAR), 9, '0')) AS fpos,
                   arg_max(library, path || chr(1) || lpad(CAST(pos AS VARCHAR), 9, '0')) AS library,
                   arg_max(icon, path || chr(1) || lpad(CAST(pos AS VARCHAR), 9, '0')) AS icon
            FROM svc GROUP BY project_id, name)""",
    "project_inventory": """SELECT s.project_id, CAST(s.n_scripts AS BIGINT) AS n_scripts,
        CAST(coalesce(v.n, 0) AS BIGINT) AS n_services, CAST(coalesce(x.n, 0) AS BIGINT) AS n_secrets,
        CAST(s.n_entry AS BIGINT) AS n_entry_points
        FROM (SELECT project_id, count(*) AS n_scripts, count(*) FILTER (WHERE is_entry_point) AS n_entry
              FROM scripts GROUP BY project_id) s
        LEFT JOIN (SELECT project_id, count(DISTINCT name) AS n FROM svc GROUP BY project_id) v USING (project_id)
        LEFT JOIN (SELECT project_id, count(DISTINCT secret) AS n FROM sec GROUP BY project_id) x USING (project_id)""",
    "import_edges": "SELECT DISTINCT project_id, source, target, detail FROM e_imp",
    "file_sets": """SELECT project_id, path, file, 'read' AS mode FROM reads
        UNION ALL SELECT project_id, path, file, 'write' FROM writes""",
    "file_edges": "SELECT project_id, source, target, detail FROM e_file",
    "launch_edges": "SELECT project_id, source, target, detail FROM e_launch",
    "connections": "SELECT project_id, source, target, type, detail, CAST(pos AS BIGINT) AS pos FROM conns",
    "step_labels": """SELECT l.project_id, l.path, CAST(l.pos AS BIGINT) AS pos, l.type, l.label, d.business, d.technical,
        d.short FROM lab l LEFT JOIN typedim d USING (type)""",
    "condition_text": f"""SELECT project_id, path, CAST(pos AS BIGINT) AS pos, _cond AS condition,
        {simplify('_cond', '_human')} AS simplified FROM lab1 WHERE _cond IS NOT NULL""",
    "trigger_labels": f"""SELECT project_id, path, CAST(pos AS BIGINT) AS pos, type, detail,
        {translate_trigger('type', 'detail')} AS label FROM trig""",
    "secret_labels": f"""SELECT project_id, secret, label, secret = min(secret) OVER (PARTITION BY project_id, label) AS is_first
        FROM (SELECT DISTINCT project_id, secret, {translate_secret('secret')} AS label FROM sec)""",
    "edge_labels": f"SELECT project_id, source, target, type, {translate_connection('type')} AS verb FROM conns",
    "phases": "SELECT project_id, path, CAST(pos AS BIGINT) AS pos, phase, phase_label FROM lab",
    "phase_profile": f"""SELECT project_id, path, phase, phase_label, CAST(phase_ord AS BIGINT) AS phase_ord,
        CAST(n_steps AS BIGINT) AS n_steps, CAST(n_steps * 100 // total AS BIGINT) AS pct,
        n_steps * 100 // total > {R.PHASE_SHARE_SHOWN} AS pct_shown,
        split_part(split_part(phase_label, ' & ', 1), ' ', 1) AS chip FROM pg""",
    "step_groups": """SELECT project_id, path, label, CAST(count(*) AS BIGINT) AS n, CAST(min(pos) AS BIGINT) AS first_pos,
        arg_min(type, pos) AS first_type, string_agg(CAST(line_number AS VARCHAR), ',' ORDER BY pos) AS lines
        FROM lab GROUP BY project_id, path, label""",
    "pattern_insights": f"""SELECT project_id, path, phase, label, CAST(n AS BIGINT) AS n, CAST(first_pos AS BIGINT) AS first_pos,
        {_pattern('label', 'n', 'first_type')} AS insight FROM (
            SELECT project_id, path, phase, label, count(*) AS n, min(pos) AS first_pos, arg_min(type, pos) AS first_type
            FROM lab GROUP BY project_id, path, phase, label) WHERE n > 1""",
    "top_types": """SELECT project_id, path, CAST(rk AS BIGINT) AS rank, type, short FROM (
        SELECT f.project_id, f.path, f.type, d.short,
               row_number() OVER (PARTITION BY f.project_id, f.path ORDER BY f.first_pos) AS rk
        FROM (SELECT project_id, path, type, min(pos) AS first_pos FROM st GROUP BY ALL) f
        LEFT JOIN typedim d USING (type)) WHERE rk <= 4""",
    "step_display": """SELECT l.project_id, l.path, CAST(l.pos AS BIGINT) AS pos, coalesce(m.text, l.label) AS display,
        m.text IS NOT NULL AS is_contextual
        FROM lab l LEFT JOIN (SELECT project_id, path, CAST(key AS BIGINT) AS line, text FROM rmerged WHERE kind = 'step') m
          ON m.project_id = l.project_id AND m.path = l.path AND m.line = l.line_number""",
    "finding_print_spam": f"SELECT {FINDING_SELECT} FROM f_print",
    "finding_phase_imbalance": f"SELECT {FINDING_SELECT} FROM f_phase",
    "finding_error_bulk": f"SELECT {FINDING_SELECT} FROM f_bulk",
    "finding_no_errors": f"SELECT {FINDING_SELECT} FROM f_noerr",
    "finding_transform_heavy": f"SELECT {FINDING_SELECT} FROM f_heavy",
    "findings": f"""SELECT project_id, path,
        CAST(row_number() OVER (PARTITION BY project_id, path ORDER BY rule, sub) - 1 AS BIGINT) AS pos, {FINDING_SELECT.replace('project_id, path, ', '')}
        FROM fall""",
    "health": """SELECT s.project_id, s.path,
        CASE WHEN coalesce(c, 0) > 0 THEN 'needs attention' WHEN coalesce(w, 0) >= 2 THEN 'has issues'
             WHEN coalesce(w, 0) = 1 THEN 'minor issues' ELSE 'clean' END AS score,
        CASE WHEN coalesce(c, 0) > 0 THEN 'red' WHEN coalesce(w, 0) >= 2 THEN 'amber'
             WHEN coalesce(w, 0) = 1 THEN 'yellow' ELSE 'green' END AS color,
        CAST(coalesce(n, 0) AS BIGINT) AS n_findings, CAST(coalesce(w, 0) AS BIGINT) AS n_warnings,
        CAST(coalesce(c, 0) AS BIGINT) AS n_concerns
        FROM scripts s LEFT JOIN (SELECT project_id, path, count(*) AS n,
            count(*) FILTER (WHERE severity = 'warning') AS w, count(*) FILTER (WHERE severity = 'concern') AS c
            FROM fall GROUP BY ALL) f USING (project_id, path)""",
    "importance": """SELECT project_id, path, degree, n_services, n_steps, is_entry_point,
        CAST(degree + CASE WHEN is_entry_point THEN 2 ELSE 0 END + n_services + least(n_steps // 20, 5) AS BIGINT) AS score
        FROM imp_base""",
    "ranking": """SELECT project_id, path, score, CAST(rk AS BIGINT) AS rank,
        rk <= greatest(1, n // 3) AS is_key FROM (
            SELECT project_id, path, score, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, path) AS rk,
                   count(*) OVER (PARTITION BY project_id) AS n FROM imp_scored)""",
    "graph_nodes": r"""SELECT project_id, path, regexp_extract(path, '[^/]*$') AS name,
        CASE WHEN dir <> '' AND n_dirs > 1 THEN dir END AS "group", is_entry_point FROM (
            SELECT *, count(DISTINCT dir) OVER (PARTITION BY project_id) AS n_dirs FROM (
                SELECT project_id, path, is_entry_point,
                       CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir
                FROM scripts))""",
    "graph_edges": f"""SELECT project_id, source, target, type, {translate_connection('type')} AS verb,
        CAST(pos AS BIGINT) AS pos FROM conns""",
    "flow_nodes": f"""SELECT project_id, path, CAST(pos AS BIGINT) AS pos, CAST(line_number AS BIGINT) AS line_number, type,
        coalesce(function_name, '_module_') AS function, {_prefix('type')} || description AS label_tech,
        label AS label_biz FROM lab""",
    "flow_edges": """SELECT project_id, path, function, CAST(pos AS BIGINT) AS src_pos, CAST(nxt AS BIGINT) AS dst_pos FROM (
        SELECT project_id, path, coalesce(function_name, '_module_') AS function, pos,
               lead(pos) OVER (PARTITION BY project_id, path, coalesce(function_name, '_module_') ORDER BY pos) AS nxt
        FROM st) WHERE nxt IS NOT NULL""",
    "flow_compact": None,  # filled below
    "phase_pipeline": """SELECT project_id, path, phase, phase_label, CAST(phase_ord AS BIGINT) AS phase_ord,
        CAST(n_steps AS BIGINT) AS n_steps,
        CAST(n_steps AS VARCHAR) || CASE WHEN n_steps = 1 THEN ' step' ELSE ' steps' END AS caption,
        lead(phase) OVER (PARTITION BY project_id, path ORDER BY phase_ord) AS next_phase FROM pg""",
    "prompt_script": None,
    "prompt_project": None,
    "prompt_dataflow": None,
    "prompt_phase": None,
    "responses_parsed": "SELECT project_id, path, phase, kind, CAST(line AS BIGINT) AS line, text FROM rparsed_ok",
    "responses_merged": """SELECT project_id, path, kind, key, text FROM rmerged
        UNION ALL SELECT project_id, path, kind || '_text', '', text FROM rtext
        UNION ALL SELECT project_id, path, 'maps', '', CASE WHEN found THEN ns || '/' || nt || '/' || nr ELSE 'null' END FROM rmaps
        UNION ALL SELECT m.project_id, '', 'progress', '', (count(t.text) + (SELECT count(*) FROM rtext o WHERE o.kind = 'project' AND o.project_id = m.project_id)) || '/' || count(*) FILTER (ns > 0)
        FROM rmaps m LEFT JOIN (SELECT * FROM rtext WHERE kind = 'script') t ON t.project_id = m.project_id AND t.path = m.path GROUP BY m.project_id""",
}

_compact_t = "CASE " + " ".join(f"WHEN type = {lit(t[0])} THEN {lit(t[5])}" for t in R.TYPE_LABELS) + " ELSE type END"
_compact_b = "CASE " + " ".join(f"WHEN type = {lit(t[0])} THEN {lit(t[1])}" for t in R.TYPE_LABELS) + " ELSE type END"
SELECTS["flow_compact"] = f"""SELECT project_id, path, function_name AS function, CAST(total AS BIGINT) AS n_steps,
    function_name || '() {EM} ' || CAST(total AS VARCHAR) || ' steps (' || pt || more || ')' AS label_tech,
    function_name || ' {EM} ' || CAST(total AS VARCHAR) || ' steps (' || pb || more || ')' AS label_biz
    FROM (
        SELECT project_id, path, function_name, total,
               string_agg(CAST(n AS VARCHAR) || ' ' || ({_compact_t}), ', ' ORDER BY rk) FILTER (WHERE rk <= 4) AS pt,
               string_agg(CAST(n AS VARCHAR) || ' ' || ({_compact_b}), ', ' ORDER BY rk) FILTER (WHERE rk <= 4) AS pb,
               CASE WHEN max(n_types) > 4 THEN ', +' || CAST(max(n_types) - 4 AS VARCHAR) || ' more' ELSE '' END AS more
        FROM (
            SELECT *, sum(n) OVER w AS total, count(*) OVER w AS n_types,
                   row_number() OVER (PARTITION BY project_id, path, function_name ORDER BY n DESC, first_pos) AS rk
            FROM (SELECT project_id, path, function_name, type, count(*) AS n, min(pos) AS first_pos
                  FROM st WHERE function_name IS NOT NULL GROUP BY ALL)
            WINDOW w AS (PARTITION BY project_id, path, function_name))
        WHERE total > {R.COMPACT_THRESHOLD}
        GROUP BY project_id, path, function_name, total)"""

_open_functions = f"""(SELECT * FROM (
    SELECT *, coalesce(function_name, '_module_') AS function,
           count(*) OVER (PARTITION BY project_id, path, function_name) AS in_function FROM {{0}})
    WHERE function_name IS NULL OR in_function <= {R.COMPACT_THRESHOLD})"""
SELECTS["compact_nodes"] = f"""SELECT project_id, path, function, CAST(NULL AS BIGINT) AS pos, n_steps, label_tech, label_biz
    FROM ({SELECTS["flow_compact"]})
    UNION ALL
    SELECT project_id, path, function, CAST(pos AS BIGINT), CAST(1 AS BIGINT), {_prefix('type')} || description, label
    FROM {_open_functions.format('lab')}"""
SELECTS["compact_edges"] = f"""SELECT project_id, path, function, CAST(pos AS BIGINT) AS src_pos, CAST(nxt AS BIGINT) AS dst_pos FROM (
        SELECT project_id, path, function, pos, lead(pos) OVER (PARTITION BY project_id, path, function ORDER BY pos) AS nxt
        FROM {_open_functions.format('st')}) WHERE nxt IS NOT NULL"""

SELECTS["prompt_script"] = f"""SELECT s.project_id, s.path, {lit(PR.SYSTEM_PROMPT)} AS system,
    {_nl(PR.SCRIPT_OBJECTIVE)} || 'Script: ' || s.path || chr(10)
    || 'Entry point: ' || CASE WHEN s.is_entry_point THEN 'Yes' ELSE 'No' END || chr(10)
    || 'Triggers: ' || {_or_none('tr.txt')} || chr(10)
    || 'Services used: ' || {_or_none('sv.txt')} || chr(10)
    || 'Secrets/API keys needed: ' || {_or_none('se.txt')} || chr(10) || chr(10)
    || 'Steps (in execution order):' || chr(10) || {_or_none('b.txt', 'No steps detected.')} || chr(10)
    || {_nl(PR.SCRIPT_INSTRUCTIONS)} AS "user"
    FROM scripts s
    LEFT JOIN (SELECT project_id, path, string_agg(type || ': ' || detail, ', ' ORDER BY pos) AS txt FROM trig GROUP BY ALL) tr
      USING (project_id, path)
    LEFT JOIN (SELECT project_id, path, string_agg(name, ', ' ORDER BY pos) AS txt FROM svc GROUP BY ALL) sv
      USING (project_id, path)
    LEFT JOIN (SELECT project_id, path, string_agg(secret, ', ' ORDER BY secret) AS txt FROM sec GROUP BY ALL) se
      USING (project_id, path)
    LEFT JOIN (SELECT project_id, path, string_agg(chr(10) || 'In ' || func || ':' || chr(10) || body || chr(10), ''
                      ORDER BY first_pos) AS txt FROM (
                 SELECT project_id, path, coalesce(function_name, '(top-level)') AS func, min(pos) AS first_pos,
                        string_agg('- [' || type || '] ' || description, chr(10) ORDER BY pos) AS body
                 FROM st GROUP BY ALL) GROUP BY project_id, path) b USING (project_id, path)"""

SELECTS["prompt_project"] = f"""SELECT p.project_id, {lit(PR.SYSTEM_PROMPT)} AS system,
    {_nl(PR.PROJECT_OBJECTIVE)} || 'Project: ' || p.project_id || chr(10)
    || 'Scripts: ' || CAST(p.n AS VARCHAR) || chr(10)
    || 'Services: ' || {_or_none('v.txt')} || chr(10)
    || 'Entry points: ' || {_or_none('p.entry')} || chr(10) || chr(10)
    || 'Script summaries:' || chr(10) || {_or_none('p.lines', 'No scripts.')} || chr(10) || chr(10)
    || 'Connections between scripts:' || chr(10) || {_or_none('c.txt', 'No connections.')} || chr(10) || chr(10)
    || {_nl(PR.PROJECT_INSTRUCTIONS)} AS "user"
    FROM (SELECT project_id, count(*) AS n,
                 string_agg('- ' || path || ': ' || coalesce(t.text, {lit(PR.NO_SUMMARY)}), chr(10) ORDER BY path) AS lines,
                 string_agg(path, ', ' ORDER BY path) FILTER (WHERE is_entry_point) AS entry
          FROM scripts LEFT JOIN (SELECT project_id, path, text FROM rtext WHERE kind = 'script') t USING (project_id, path) GROUP BY project_id) p
    LEFT JOIN (SELECT project_id, string_agg(name, ', ' ORDER BY fpath, fpos) AS txt FROM (
                 SELECT project_id, name, min(path) AS fpath, arg_min(pos, path) AS fpos FROM svc GROUP BY ALL)
               GROUP BY project_id) v USING (project_id)
    LEFT JOIN (SELECT project_id, string_agg('- ' || source || ' -> ' || target || ': ' || detail, chr(10) ORDER BY pos) AS txt
               FROM conns GROUP BY project_id) c USING (project_id)"""

SELECTS["prompt_dataflow"] = f"""SELECT ph.project_id, ph.path, {lit(PR.SYSTEM_PROMPT)} AS system,
    {_nl(PR.FLOW_OBJECTIVE)} || 'Script: ' || ph.path || chr(10)
    || 'Services used: ' || {_or_none('sv.txt')} || chr(10)
    || CASE WHEN len(io.ins) > 0 THEN 'Key inputs: ' || array_to_string(io.ins, ', ') || chr(10) ELSE '' END
    || CASE WHEN len(io.outs) > 0 THEN 'Key outputs: ' || array_to_string(io.outs, ', ') || chr(10) ELSE '' END
    || chr(10) || 'Phases:' || chr(10) || {_or_none('ph.txt', 'No phases.')} || chr(10) || chr(10)
    || {_nl(PR.FLOW_INSTRUCTIONS)} AS "user"
    FROM (SELECT project_id, path, string_agg('- ' || phase_label || ': ' || types, chr(10) ORDER BY phase_ord) AS txt
          FROM (SELECT project_id, path, phase_label, phase_ord,
                       string_agg(type || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY first_pos) AS types
                FROM (SELECT project_id, path, phase_label, phase_ord, type, count(*) AS n, min(pos) AS first_pos
                      FROM lab GROUP BY ALL) GROUP BY ALL) GROUP BY project_id, path) ph
    JOIN (SELECT project_id, path,
                 list_slice(list_sort(list_distinct(flatten(list(inputs)))), 1, {R.PROMPT_IO_MAX}) AS ins,
                 list_slice(list_sort(list_distinct(flatten(list(outputs)))), 1, {R.PROMPT_IO_MAX}) AS outs
          FROM st GROUP BY project_id, path) io USING (project_id, path)
    LEFT JOIN (SELECT project_id, path, string_agg(name, ', ' ORDER BY pos) AS txt FROM svc GROUP BY ALL) sv
      USING (project_id, path)"""

SELECTS["prompt_phase"] = f"""SELECT g.project_id, g.path, g.phase, {lit(PR.SYSTEM_PROMPT)} AS system,
    'Objective: Explain the "' || g.phase_label || '" phase of this automation script.' || chr(10) || chr(10)
    || 'Script: ' || g.path || chr(10)
    || 'Services used: ' || {_or_none('sv.txt')} || chr(10)
    || 'This phase contains ' || CAST(g.n AS VARCHAR) || ' steps:' || chr(10) || chr(10)
    || {_or_none('g.txt', 'No steps.')} || chr(10) || chr(10)
    || {_nl(PR.PHASE_INSTRUCTIONS)} AS "user"
    FROM (SELECT project_id, path, phase, phase_label, count(*) AS n,
                 string_agg('- Line ' || CAST(line_number AS VARCHAR) || ' [' || type || ']: ' || description || chr(10)
                            || '  Service: ' || coalesce(svc_name, 'none') || ' | Inputs: ' || {_listj('inputs')}
                            || ' | Outputs: ' || {_listj('outputs')}, chr(10) ORDER BY pos) AS txt
          FROM lab GROUP BY project_id, path, phase, phase_label) g
    LEFT JOIN (SELECT project_id, path, string_agg(name, ', ' ORDER BY pos) AS txt FROM svc GROUP BY ALL) sv
      USING (project_id, path)"""


def source_ctes() -> list[tuple[str, str]]:
    from codeatlas.sources import files as FS
    codes = [(i, code, tail or "# end") for i, (code, tail, *_r) in enumerate(C.TEMPLATES)]
    heads = [(h, "\n".join(lines) + "\n") for h, lines in enumerate(C.HEADERS)]
    extras = [(p, len(c)) for p, c in FS.TREE_EXTRAS]
    slot_len = (f"length(CASE WHEN in_func AND sif % {C.SLOTS_PER_BLOCK} = 0 THEN 'def f' || CAST(block AS VARCHAR) || '():' "
                f"ELSE '# ' || CAST(sif AS VARCHAR) END) + 1 + 2 * (CASE WHEN in_func THEN 4 ELSE 0 END) "
                f"+ length({subst('t.code')}) + 1 + length({subst('t.tail')}) + 1")
    return [
        ("tcode", values(codes, ["template", "code", "tail"])),
        ("theads", values(heads, ["hdr", "header"])),
        ("textras", values(extras, ["xpath", "xlen"])),
        ("flen", f"""SELECT c.project_id, c.path, sum({slot_len}) AS body_len, any_value(c.user_id) AS user_id,
                any_value(c.hdr) AS hdr FROM ce c JOIN tcode t USING (template) GROUP BY c.project_id, c.path"""),
        ("tree", f"""SELECT project_id, path, body_len + length({subst('h.header').replace('sif', '0')}) AS length
            FROM (SELECT *, 0 AS sif FROM flen) f JOIN theads h USING (hdr)
            UNION ALL
            SELECT p.project_id, x.xpath, x.xlen FROM (SELECT DISTINCT project_id FROM files) p, textras x"""),
    ]


def importance_ctes() -> list[tuple[str, str]]:
    return [
        ("imp_base", """SELECT s.project_id, s.path, CAST(coalesce(d.degree, 0) AS BIGINT) AS degree,
                CAST(coalesce(v.n, 0) AS BIGINT) AS n_services, CAST(coalesce(t.n, 0) AS BIGINT) AS n_steps, s.is_entry_point
            FROM scripts s
            LEFT JOIN (SELECT project_id, path, count(*) AS degree FROM (
                SELECT project_id, source AS path FROM conns UNION ALL SELECT project_id, target FROM conns)
                GROUP BY ALL) d USING (project_id, path)
            LEFT JOIN (SELECT project_id, path, count(*) AS n FROM svc GROUP BY ALL) v USING (project_id, path)
            LEFT JOIN (SELECT project_id, path, count(*) AS n FROM st GROUP BY ALL) t USING (project_id, path)"""),
        ("imp_scored", """SELECT project_id, path,
                CAST(degree + CASE WHEN is_entry_point THEN 2 ELSE 0 END + n_services + least(n_steps // 20, 5) AS BIGINT)
                AS score FROM imp_base"""),
    ]


SELECTS["syntax_facts"] = fact_select()
SELECTS["project_secrets"] = "SELECT DISTINCT project_id, secret FROM sec"
SELECTS["project_entry_points"] = "SELECT project_id, path FROM scripts WHERE is_entry_point"
SELECTS["scorecard"] = f"""SELECT r.project_id, r.path, r.rank, r.is_key, r.score, h.score AS health, h.color, h.n_findings
    FROM ({SELECTS["ranking"]}) r JOIN ({SELECTS["health"]}) h USING (project_id, path)"""


def _field(name: str, value: str, source: str, path: str = "path") -> str:
    return f"SELECT project_id, {path} AS path, {lit(name)} AS field, {value} AS value FROM {source}"


def _listed(name: str, item: str, source: str, order: str, sep: str = "chr(10)", where: str = "TRUE") -> str:
    """One row a script, empty where it has no items."""
    return (f"SELECT f.project_id, f.path, {lit(name)} AS field, coalesce(x.value, '') AS value FROM files f LEFT JOIN (SELECT project_id, path, "
            f"string_agg({item}, {sep} ORDER BY {order}) AS value FROM {source} WHERE {where} GROUP BY ALL) x USING (project_id, path)")


_SERVICE = "name || '|' || library || '|' || coalesce(icon, '')"
_STEP = ("line_number || '|' || type || '|' || description || '|' || coalesce(function_name, '') || '|' || coalesce(svc_name, '') || '|' || coalesce(svc_library, '') || '|' || "
         "coalesce(svc_icon, '') || '|' || array_to_string(inputs, ',') || '|' || array_to_string(outputs, ',')")
_OF_PROJECT = ("SELECT f.project_id, '' AS path, {} AS field, coalesce(x.value, '') AS value FROM (SELECT DISTINCT project_id FROM files) f "
               "LEFT JOIN (SELECT project_id, string_agg({}, {} ORDER BY {}) AS value FROM ({}) GROUP BY project_id) x USING (project_id)")
SELECTS["analysis_roundtrip"] = " UNION ALL ".join([
    _field("is_entry_point", "CAST(is_entry_point AS VARCHAR)", "scripts"),
    _listed("steps", _STEP, "st", "pos"),
    _listed("imports_internal", "import", "imps", "import", "'|'", "is_internal"),
    _listed("imports_external", "import", "imps", "import", "'|'", "NOT is_internal"),
    _listed("services", _SERVICE, "svc", "pos"),
    _listed("secrets", "secret", "sec", "secret", "'|'"),
    _listed("triggers", "type || '|' || detail", "trig", "pos"),
    "SELECT project_id, path, 'signature', string_agg(param || '|' || coalesce(annotation, '') || '|' || coalesce(CAST(json(default_json) AS VARCHAR), ''), chr(10) ORDER BY ord) "
    "FROM sig GROUP BY project_id, path",
    _field("summary", "text", "rtext WHERE kind = 'script'"),
    _field("data_flow", "text", "rtext WHERE kind = 'data_flow'"),
    _field("phase_summaries", "summaries", "rmaps WHERE found"),
    _field("contextual_steps", "steps", "rmaps WHERE nt > 0"),
    _field("phase_risks", "risks", "rmaps WHERE found"),
    _OF_PROJECT.format("'services'", _SERVICE, "chr(10)", "pos", SELECTS["project_services"]),
    _OF_PROJECT.format("'secrets'", "secret", "'|'", "secret", SELECTS["project_secrets"]),
    _OF_PROJECT.format("'entry_points'", "path", "'|'", "path", SELECTS["project_entry_points"]),
    _field("summary", "text", "rtext WHERE kind = 'project'", "''"),
    _field("connection", "target || '|' || type || '|' || detail || '|' || pos", f"({SELECTS['connections']})", "source"),
])


def oracle_sql() -> dict[str, str]:
    ctes = base_ctes() + findings_ctes() + importance_ctes() + source_ctes()
    prefix = "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes) + "\n"
    return {name: prefix + sel for name, sel in SELECTS.items() if sel is not None}
