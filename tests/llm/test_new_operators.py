"""Embedding near-duplicates, source divergence and conversation repair against
brute-force versions, SQL and edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ embeddings

def brute_links(rows, cosine=0.93):
    """(number of links, component) of each row, by all pairs."""
    def sound(i, v, label):
        return i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    near = [set() for _ in rows]
    for a, b in itertools.combinations(range(n), 2):
        (i, v, x), (j, w, y) = rows[a], rows[b]
        if sound(*rows[a]) and sound(*rows[b]) and x == y and len(v) == len(w):
            p, q = np.array(v, float), np.array(w, float)
            p, q = p / np.abs(p).max(), q / np.abs(q).max()
            if p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= cosine:
                near[a].add(b)
                near[b].add(a)
    out = []
    for a in range(n):
        reach, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()] - reach:
                reach.add(b)
                todo.append(b)
        known = [rows[b][0] for b in reach if rows[b][0] is not None]
        out.append((rows[a][0], len(near[a]), min(known) if known else None))
    return out


def vector_rows(seed=1, n=400, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        centre = rng.normal(size=dim)
        for k in range(rng.integers(1, 4)):
            rows.append((len(rows), (centre + rng.normal(size=dim) * rng.uniform(0, 0.35)).tolist(), int(rng.integers(0, 3)) if i % 3 else 1))
    return rows


@pytest.mark.parametrize("cell_rows,block", [(1024, 4096), (20, 16)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, cell_rows, block):
    from codeatlas.llm import embedding_dedup as E
    monkeypatch.setattr(E, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "SLICE", 64 if block == 16 else E.SLICE)
    rows = vector_rows()
    rows += [(9000 + i, [x * (i + 1) for x in rows[0][1]], rows[0][2]) for i in range(12)]     # one direction, many lengths
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_vectors(df).collect())
    assert got == sorted((i, n, c, i == c) for i, n, c in brute_links(rows))


def test_near_vectors_edges(spark):
    from codeatlas.llm.embedding_dedup import near_vectors
    v = [1.0, 2.0, 0.0]
    rows = [(5, v, 1), (3, v, 1), (7, [1.0, 2.0, -0.0], 1), (8, [10.0, 20.0, 0.1], 1), (1, v, 2), (2, v, None), (4, None, 1), (6, [], 1), (9, [0.0, 0.0, 0.0], 1),
            (10, [1.0, None, 2.0], 1), (11, [1.0, float("nan"), 2.0], 1), (12, [float("inf"), 0.0, 0.0], 1), (None, v, 1), (13, [1.0, 2.0], 1), (14, [1.0, 2.0], 1),
            (15, [1e300, 2e300, 0.0], 1), (16, [1e-300, 2e-300, 0.0], 1), (20, [0.0, 0.0, 1.0], 1), (20, [0.0, 1e-9, 1.0], 1), (21, [-1.0, -2.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, cell string, gid int")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df).collect()), key=str)
    assert got == sorted(brute_links(rows), key=str)
    assert near_vectors(df.limit(0)).count() == 0


def test_probes_and_lookups_never_lose_a_near_pair():
    """The bounds hold for any centres, fitted or not."""
    from codeatlas.llm.embedding_dedup import Index, centres
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[150:] = x[:150] + rng.normal(size=(150, 16)) * 0.08
    x /= np.linalg.norm(x, axis=1)[:, None]
    radius = np.sqrt(2 - 2 * 0.93)
    for coarse in (centres(x, 12), rng.normal(size=(12, 16))):
        index = Index(coarse, [rng.normal(size=(9, 4)) * 0.3 for _ in range(4)], 16)
        own, probes = index.cells(x, radius)
        codes, left = index.codes(x, own)
        for a, b in itertools.combinations(range(300), 2):
            if x[a] @ x[b] >= 0.93:
                asks, entry = (a, b) if own[a] <= own[b] else (b, a)
                assert own[entry] in probes[asks]
                d = index.distances(x[asks:asks + 1], own[entry], codes[entry:entry + 1], index.constants(codes[entry:entry + 1], own[entry]))
                assert d[0, 0] - left[entry] <= radius + 1e-9


# ------------------------------------------------------------------ divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_divergence(rows, least, top):
    rows = [(a or "", b or "", TERM.findall((t or "").translate(LOW))) for a, b, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        held = collections.Counter(t for la, _, w in rows if la == lang for t in set(w))
        kept = sorted((t for t in held if held[t] >= least), key=str.encode)
        count = {s: collections.Counter() for la, s, _ in rows if la == lang}
        for la, s, w in rows:
            if la == lang:
                count[s].update(t for t in w if held[t] >= least)
        total = {s: sum(c.values()) for s, c in count.items()}
        every, n = sum(count.values(), collections.Counter()), sum(total.values())

        def p(c, n, t):
            return 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept))

        for s in count:
            pairs = [(o, sum(abs(p(count[s], total[s], t) - p(count[o], total[o], t)) for t in kept)) for o in count if o != s]
            terms = [(t, p(count[s], total[s], t) - p(every, n, t)) for t in kept if count[s][t]]
            for part, items, most in (("pair", pairs, None), ("term", [x for x in terms if x[1] > 0], top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def divergence_rows():
    rng = random.Random(2)
    words = ["the", "The", "an", "ant", "ants", "want", "wants", "épée", "épées", "日本", "日本語", "z" * 300, "aé", "a"]
    rows = [("en" if k % 4 else "fr", f"s{rng.randrange(5)}", " ".join(rng.choice(words) + rng.choice(["", ",", "1", "\n", "\x7f"]) for _ in range(rng.randrange(12)))) for k in range(150)]
    return rows + [(None, None, "the ant"), (None, "b", None), ("de", "x", "only one"), ("de", "y", ""), ("en", "none", "123 ..."), ("en", None, "the the"), rows[0], rows[0]]


@pytest.mark.parametrize("piece_terms,group_bytes,block,tile", [(1 << 17, 64 << 20, 4096, 128), (3, 200, 4, 2)])
def test_divergence_equals_brute_force(spark, monkeypatch, piece_terms, group_bytes, block, tile):
    from codeatlas.llm import divergence as D
    monkeypatch.setattr(D, "PIECE_TERMS", piece_terms)
    monkeypatch.setattr(D, "GROUP_BYTES", group_bytes)
    rows = divergence_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, n long")
    got = sorted(tuple(r) for r in D.divergence(df, least_docs=3, top=4, block=block, tile=tile).collect())
    assert got == brute_divergence(rows, 3, 4)
    assert D.divergence(df.limit(0)).count() == 0


def test_transducer_is_minimal_and_numbers_terms():
    from codeatlas.llm.divergence import automaton, ordinals
    rng = random.Random(5)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))).encode() for _ in range(300)} | {"é".encode(), b"walking", b"talking", b"walked", b"talked"})
    machine = automaton(terms)
    probes = terms + [b"walk", b"x", b"abcabcabc", b"talkings"]
    data = np.frombuffer(b" ".join(probes), np.uint8)
    ends = np.cumsum([len(p) + 1 for p in probes]) - 1
    starts = ends - [len(p) for p in probes]
    assert ordinals(machine, data, starts, ends).tolist() == [*range(len(terms)), -1, -1, -1, -1]
    # as many states as there are distinct sets of continuations
    prefixes = {t[:k] for t in terms for k in range(len(t) + 1)}
    rights = {frozenset(t[len(p):] for t in terms if t.startswith(p)) for p in prefixes}
    assert len(machine["final"]) == len(rights)


# ------------------------------------------------------------------ conversations

def brute_repair(rows):
    """(cost, audit, repaired rows), by trying all edits in order of cost."""
    def fault(i):
        role, text = rows[i]
        body = text.rstrip(" \t\n\x0b\x0c\r")
        return "blank" if not body else "duplicate" if rows[i] in rows[:i] else "truncated" if body[-1] not in ".!?" else ""

    faults = [fault(i) for i in range(len(rows))]
    best = None

    def go(i, cost, audit, out):
        nonlocal best
        if best and cost > best[0] or audit.endswith("III"):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, out)
        for role in ("user", "assistant"):
            go(i, cost + 2, audit + "I", [*out, (role, "")])
        if i < len(rows):
            go(i + 1, cost + 3, audit + "D", out)
            if faults[i] in ("", "truncated"):
                extra = faults[i] == "truncated"
                go(i + 1, cost + extra, audit + "K", [*out, rows[i]])
                for role in ("user", "assistant"):
                    go(i + 1, cost + 2 + extra, audit + "R", [*out, (role, rows[i][1])])

    best = (3 * len(rows), "D" * len(rows), [])
    go(0, 0, "", [])
    return best, faults


def conversation_rows(n=60, seed=4):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 5)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "user"]), rng.choice(["Yes.", "No!", "cut", " ", "Yes.", f"t{turn}?"])))
    return rows


@pytest.mark.parametrize("chunk", [1, 2, 128])
def test_repair_equals_brute_force(spark, chunk):
    from codeatlas.llm.conversations import repair, repaired
    rows = conversation_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, longer = repair(df, chunk)
    got = collections.defaultdict(list)
    for r in whole.unionByName(longer).collect():
        got[r.key].append(r)
    out = collections.defaultdict(list)
    for r in repaired(df, chunk).orderBy("key", "nth", "at").collect():
        out[r.key].append((r.role, r.text))
    for conv, of in itertools.groupby(rows, lambda r: r[0]):
        of = [(r, t) for _, _, r, t in of]
        (cost, audit, fixed), faults = brute_repair(of)
        parts = sorted(got[f"v{conv}"], key=lambda r: r.nth)
        assert (sum(p.cost for p in parts), "".join(p.audit for p in parts)) == (cost, audit), of
        assert out[f"v{conv}"] == fixed
        assert [sum(p[f] for p in parts) for f in ("blank", "duplicate", "truncated")] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]


def serial(rows):
    """Audit and cost of one conversation in one run (conv_id, turn, role, text)."""
    from codeatlas.llm import conversations as C
    marks = [f"{len(r)}:{r}:{t}" for _, _, r, t in rows]
    codes = bytes(C.code(r, t) for _, _, r, t in rows)
    codes, *_ = C.marked(codes, [i for i, m in enumerate(marks) if m in marks[:i]])
    costs = C.costs_back(codes, C.END)
    return sum(costs[4::5]) + costs[0], C.traced(codes, costs, C.END, 0, True)[0]


@pytest.mark.parametrize("chunk", [3, 64])
def test_long_conversations_over_chunks_and_runs_of_chunks(spark, monkeypatch, chunk):
    """A third of the rows in one conversation; chunk maps composed on several levels."""
    from codeatlas.llm import conversations as C
    monkeypatch.setattr(C, "FAN", 4)
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "odd"]), rng.choice(["a.", f"b{t}.", f"c{t}", f"d{t}!", ""])) for t in range(700)]
    rows += [(k, t, ("user", "assistant")[t % 2], f"{t}.") for k in range(2, 200) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, longer = C.repair(df.repartition(5), chunk)
    got = sorted((r.nth, r.cost, r.audit) for r in whole.unionByName(longer).collect() if r.key == "v1")
    assert (sum(c for _, c, _ in got), "".join(a for *_, a in got)) == serial(rows[:700])
    assert len(got) >= 700 // chunk


def test_fix_up_stops_where_vectors_differ_by_constants():
    from codeatlas.llm import conversations as C
    rng = random.Random(1)
    for _ in range(200):
        codes = bytes(4 * rng.randrange(4) + rng.randrange(4) for _ in range(rng.randrange(1, 12)))
        end, other = (C.raised(C.END, 4 * rng.randrange(4) + rng.randrange(4))[0] for _ in range(2))
        assert C.costs_back(codes, end, C.costs_back(codes, other)) == C.costs_back(codes, end)


def test_repair_digests_edges(spark):
    from codeatlas.llm.conversations import repair_digests
    dropped = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(1, 0, "user", "Hi."), (1, 1, None, "What?"), (1, None, "user", None), (1, 3, "", "Empty role."), (1, 3, "assistant", "x " * 40000 + "."), (1, 3, "assistant", "Tie."),
            (None, 0, "user", "Null id."), (None, 0, "user", "Null id."), (None, None, "system", "s."), (dropped, 0, "user", "gone."), (7, None, "user", "a."), (7, None, "assistant", "b.")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, nth int")
    got = {r.conv_id: r.asDict() for r in repair_digests(df).collect()}
    assert set(got) == {1, None, dropped, 7}
    assert got[dropped] == {"conv_id": dropped, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert got[7]["gaps"] == 0
    assert repair_digests(df.limit(0)).count() == 0
    for chunk in (1, 2):
        assert {r.conv_id: r.asDict() for r in repair_digests(df, chunk).collect()} == got


# ------------------------------------------------------------------ SQL

@pytest.mark.parametrize("name", ["op11_embedding_dedup", "op12_source_divergence", "op13_conversation_repair"])
def test_sql(spark, name):
    import duckdb
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = E.queries()[name](spark, SF)
    want = con.execute(E.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
