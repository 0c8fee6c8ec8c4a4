"""The training-data operators against brute-force versions, SQL and edge cases."""

import collections
import hashlib
import json
import re
import uuid
import zlib

import numpy as np
import pytest

from codeatlas.session import checkpoint_dir

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, copy string, row string, n int"


def words(n, start=0):
    return " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(start, start + n))


def edge_rows():
    base = words(120)
    near = base + " extra"
    return [(1, base, "en", "a"), (2, near, "en", "a"), (3, base, "en", "b"), (4, None, None, None), (5, "", "de", "a"), (6, " \n\t", "de", "b"),
            (7, "one", None, "b"), (8, "one", "en", "b"), (None, base, "en", "a"), (9, words(60, 200), "en", None), (9, words(60, 200), "en", None),
            (10, "x" * 9000 + " " + words(3000, 7), "en", "a"), (11, "don't  stop <|endoftext|>,\n\nüñí 12 %%%  x", "fr", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, la, s, len(t or ""), True, "c", "r", 7) for i, t, la, s in edge_rows()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i in (2, 5))) for i in range(1, 12)] + [(None, 1, 1), (3, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(name))


# ------------------------------------------------------------------ quality

def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n_sym = sum(text.count(c) for c in "#*$%&|<>")
    chars, dup = sum(map(len, w)), len(lines) - len(set(lines))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    lettered = sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7F]", x)) for x in w)
    bad = (10 * n_sym > len(w) or 10 * dup > 3 * len(lines) or not 2 * len(w) <= chars <= 14 * len(w) or 2 * upper > letters
           or 10 * text.count("!") > 3 * len(w) or 100 * lettered < 80 * len(w))
    return len(w), chars, n_sym, dup, len(covered), failed, not failed and not bad


def test_quality_rules(spark, docs, empty):
    from codeatlas.llm import quality_rules as Q
    got = sorted((tuple(r) for r in Q.quality(docs).collect()), key=str)
    assert got == sorted(((i, *brute_quality(t)) for i, t, *_ in edge_rows()), key=str)
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted((i or 0) for i, t, *_ in edge_rows() if brute_quality(t)[-1])
    assert Q.quality(empty).count() == 0 and Q.keep_good(empty).count() == 0


def test_cascade_order_changes_cost_only():
    from codeatlas.llm import quality_rules as Q
    assert [r.name for r in Q.ordered([("a", 1.0, 0.1), ("b", 0.1, 0.1), ("c", 0.1, 0.9)], tuple(Q.Rule(n, None) for n in "abc"))] == ["c", "b", "a"]
    texts = [t for _, t, *_ in edge_rows() if t] + ["LOUD WORDS " * 40, "a!! b " * 60, "ab# " * 70]
    from codeatlas.llm.common import text_chunks
    import pyarrow as pa
    (_, data, offsets), = text_chunks(pa.array(texts))
    t = Q.Texts(data, offsets)
    rows = np.flatnonzero(~t.base_failed())
    assert Q.cascade(t, rows, Q.RULES).tolist() == Q.cascade(t, rows, Q.RULES[::-1]).tolist()


# ------------------------------------------------------------------ tokens

def test_piece_values_are_joined_where_they_are_looked_up():
    from codeatlas.llm.vocab import encoder, tokenizer_path
    texts = ["", None, "one two, two", "  odd\tspace\n\nrun ", "Head tail <|endoftext|> end", "x" * 100 + " y"] * 3
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        pieces = encoder(tokenizer_path(name), spaced)
        assert list(pieces.all(texts, b"".join)) == [b"".join(v) for v in pieces.all(texts)]


def test_pieces_equal_the_library():
    from codeatlas.llm.token_counts import counter
    from codeatlas.llm.vocab import encoder, tokenizer_path
    rng = np.random.default_rng(1)
    parts = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", " ", "　", "é", "é", "́", "Σ", "ß", "中", "1", "23", "'s", "don't",
             ",", ".", "!!", "%%%", "<|endoftext|>", "<|startoftext|>", "<|", "👍🏽", "‍", "\r\n", "aaaa", "İ", "x" * 70, "Word", ". "]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(4000)]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        want = [e.ids for e in tokenizer(name).encode_batch(texts, add_special_tokens=False)]
        got = [np.frombuffer(b"".join(v), "<u4").tolist() for v in encoder(tokenizer_path(name), spaced).all(texts)]
        assert got == want
        if spaced:
            assert [sum(v) for v in counter(tokenizer_path(name)).all(texts)] == [len(w) for w in want]


def test_columns_of_texts_give_the_library_ids_and_see_each_piece_once(monkeypatch):
    import pyarrow as pa
    from codeatlas.llm import vocab as V
    monkeypatch.setattr(V, "_encoders", {})
    monkeypatch.setattr(V, "COLUMN_KEPT", 300)  # tables are cut while they are used
    monkeypatch.setattr(V, "COLUMN_BYTES", 4000)
    monkeypatch.setattr(V, "FOLLOWING", 7)
    rng = np.random.default_rng(2)
    parts = ["a", "the", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\x85", "\u00a0", "é", "Σ", "中", "23", "'s", ",", ".", "!!", "<|endoftext|>", "<|", "👍🏽", "\r\n", "x" * 70, "Word", ". "]
    texts = ["", None, " ", "\n", " a", "\na", *("".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(3000))]
    texts += [f"w{i} w{i}, w{i // 2}.\nw{i}<|endoftext|> b{i}" for i in range(400)]
    want = [e.ids for e in tokenizer("byte_bpe_50k.json").encode_batch([t or "" for t in texts], add_special_tokens=False)]
    pieces = V.encoder(V.tokenizer_path("byte_bpe_50k.json"), spaced=True)
    column = pa.array(texts)
    got = [x for lo in range(0, len(texts), 500) for x in pieces.column(column.slice(lo, 500))]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert pieces.column(column[:0]) == [] and pieces.column(column[:2]) == [b"", b""]
    asked = []

    class Counted(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    monkeypatch.setattr(V, "COLUMN_BYTES", 1 << 20)
    pieces.inner = Counted()
    pieces.column(pa.array(["head red blue red blue"] * 200))
    assert len(asked) <= 3  # head, red, blue: not once for each of 800 words


def test_token_counts(docs, empty):
    from codeatlas.llm.token_counts import token_counts
    tok = tokenizer("byte_bpe_50k.json")
    want = []
    for i, t, *_ in edge_rows():
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert sorted((tuple(r) for r in token_counts(docs).collect()), key=str) == sorted(want, key=str)
    assert token_counts(empty).count() == 0


def test_token_files_round_trip(spark, docs, empty):
    from codeatlas.llm import tokenfiles as T
    tok = tokenizer("word_bpe_49k.json")
    folder = f"{checkpoint_dir(spark)}/tf-{uuid.uuid4().hex}"
    files = T.write_documents(docs, folder)
    assert files.agg({"n_docs": "sum"}).first()[0] == len(edge_rows())
    rows = sorted(T.read_documents(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([i for i, *_ in edge_rows()], key=lambda i: -1 if i is None else i)
    at = 0
    encoded = collections.Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, *_ in edge_rows())
    for r in rows:
        ids = tuple(np.frombuffer(r.ids, "<u4").tolist())
        assert r.start == at and r.n_tokens == len(ids)
        at += len(ids)
        encoded[r.doc_id, ids] -= 1
    assert not +encoded and not -encoded
    some = T.read_documents(spark, folder, [10, 4]).collect()
    assert sorted(r.doc_id for r in some) == [4, 10]
    blank = f"{checkpoint_dir(spark)}/tf-{uuid.uuid4().hex}"
    T.write_documents(empty, blank)
    assert T.read_documents(spark, blank).count() == 0


def test_token_file_reads_only_needed_frames_and_checks_sums(tmp_path):
    import pyarrow.fs as pafs
    from codeatlas.llm import tokenfiles as T
    store = pafs.LocalFileSystem()
    name = str(tmp_path / "a.zst")
    w = T.Writer(store.open_output_stream(name, compression=None))
    lists = [np.arange(n, dtype="<u4").tobytes() for n in (5, 20_000, 0, 70_000, 9)]
    for i, x in enumerate(lists):
        w.add(i, x)
    w.close()
    with store.open_input_file(name) as f:
        r = T.Reader(f)
        assert len(r.frames) >= 3 and [x for _, _, x in r.documents()] == lists
        seen = []
        real = r.frame
        r.frame = lambda k: (seen.append(k), real(k))[1]
        assert [x for _, _, x in r.documents({4})] == [lists[4]] and set(seen) == {len(r.frames) - 1}
    raw = bytearray(open(name, "rb").read())
    raw[20] ^= 0xFF
    open(name, "wb").write(raw)
    with store.open_input_file(name) as f, pytest.raises(Exception):
        list(T.Reader(f).documents({0}))


# ------------------------------------------------------------------ packing

def test_packing(docs, empty):
    from codeatlas.llm.packing import pack
    tok = tokenizer("byte_bpe_50k.json")
    whole = collections.Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, *_ in edge_rows())
    rows = pack(docs).collect()
    parts, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.length > 0
        parts[r.doc_id, r.doc_tokens].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    got = collections.Counter()
    for (i, n), own in parts.items():
        own = sorted(own, key=lambda r: r.start)
        copies = sum(r.length for r in own) // n
        for k in range(copies):  # repeated rows have equal pieces
            ids = b"".join(r.ids for r in own[k::copies])
            got[i, tuple(np.frombuffer(ids, "<u4").tolist())] += 1
    assert got == whole
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(empty).count() == 0


def test_best_fit_and_padding():
    from codeatlas.llm.packing import Room, pack_lengths
    room = Room(16)
    for capacity, window in ((9, 0), (4, 1), (12, 2)):
        room.put(capacity, window)
    assert room.tightest(5) == (9, 0) and room.tightest(5) == (12, 2) and room.tightest(5) is None and room.tightest(4) == (4, 1)
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 6000, 800).tolist()
    windows = pack_lengths(lengths)
    covered = collections.defaultdict(list)
    for pieces in windows:
        assert sum(p[2] for p in pieces) <= 2048
        for doc, start, length in pieces:
            covered[doc].append((start, length))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(covered[doc]):
            assert start == at
            at += length
        assert at == n
    assert len(windows) * 2048 <= 1.02 * sum(lengths) + 2048


# ------------------------------------------------------------------ near duplicates

def brute_components(rows, n_words, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        k = min(n_words, len(w))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[top(i)] = min([x for x in (low.get(top(i)), doc) if x is not None], default=None)
    return [(doc, len(sets[i]), low[top(i)]) for i, (doc, _) in enumerate(rows)]


def near_rows():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(12):
        base = rng.choice(vocabulary, int(rng.integers(3, 160))).tolist()
        for _ in range(int(rng.integers(1, 9))):
            text = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 14))):
                text[int(rng.integers(0, len(text)))] = str(rng.choice(vocabulary))
            rows.append(" ".join(text))
    shared = " ".join(rng.choice(vocabulary, 60).tolist())
    rows += [shared + " " + " ".join(rng.choice(vocabulary, 60).tolist()) for _ in range(40)]
    return list(enumerate(rows))


@pytest.mark.parametrize("n_words", [2, 5])
def test_near_duplicates(spark, n_words):
    from codeatlas.llm.near_dedup import near_duplicates
    rows = near_rows() + [(900, None), (901, ""), (902, "only"), (903, "Only"), (None, "only"), (904, " \n")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component int")
    got = near_duplicates(df, n_words, 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(brute_components(rows, n_words, 80), key=str)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_near_duplicates_in_large_buckets_of_one_template(spark):
    from codeatlas.llm.near_dedup import near_duplicates
    rng = np.random.default_rng(8)
    # every slot has four fillings, so buckets are shared by many and the few similar pairs meet in large ones
    rows = [(i, " ".join([f"t{k}" for k in range(60)] + [f"slot{k}x{v}" for k, v in enumerate(rng.integers(0, 4, 24))])) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df, 1, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, 1, 80))


def test_near_duplicates_edges(spark, docs, empty):
    from codeatlas.llm.near_dedup import drop_near, near_duplicates
    left = drop_near(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 4, 5, 6, 7, 9, 10, 11]
    assert near_duplicates(empty).count() == 0 and drop_near(empty).count() == 0


def test_drop_near_keeps_unlike_texts_of_one_id(spark):
    from codeatlas.llm.near_dedup import drop_near
    texts = [words(40, 100 * k) for k in range(5)]
    rows = list(zip((1, 1, 2, 2, 3), texts)) + [(4, texts[1]), (3, texts[4]), (None, texts[0]), (5, texts[2] + " more"), (0, texts[3])]
    df = spark.createDataFrame([(i, t, n, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, nth int, id int")
    left = drop_near(df)
    assert left.columns == df.columns
    # of each group the smallest id stays; the null id stays; unlike texts of one id all stay
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, texts[0]), (1, texts[1]), (2, texts[2]), (0, texts[3]), (3, texts[4]), (None, texts[0])], key=str)


def test_densified_signature_keeps_similarity():
    from codeatlas.llm.common import mixed
    from codeatlas.llm.near_dedup import BINS, band_keys, signature
    x = np.unique(mixed(np.arange(1, 400, dtype=np.uint64)))
    rng = np.random.default_rng(0)
    same = np.mean([np.mean(signature(np.sort(rng.permutation(x)[:30])) == signature(np.sort(rng.permutation(x)[:30]))) for _ in range(5)])
    assert same < 0.3
    keep = np.sort(rng.permutation(x)[:360])
    assert np.mean(signature(x) == signature(keep)) > 0.8 and len(np.intersect1d(band_keys(signature(x)), band_keys(signature(keep)))) > 5
    assert len(signature(x[:1])) == BINS and (signature(x[:1]) == x[0]).all()


# ------------------------------------------------------------------ top-k

def brute_top_k(rows, k=20):
    """Of every row whose id is divisible by 20, its best other rows."""
    out = []
    for n, (q, x) in enumerate(rows):
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), v) for m, (v, y) in enumerate(rows) if m != n)[:k]
            out += [(q, rank, v, -s) for rank, (s, v) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k_keeps_rows_that_repeat_an_id(spark, monkeypatch):
    from codeatlas.llm import topk
    rows = [(20, [1.0, 0.0]), (7, [0.1, 0.0]), (7, [5.0, 0.0]), (8, [1.0, 1.0]), (40, [2.0, 1.0]), (40, [-2.0, 1.0])] + [(100 + i, [i / 9 - 1, 1 - i / 7]) for i in range(30)]
    whole = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == brute_top_k(whole)
    monkeypatch.setattr(topk, "QUERY_ROWS", 1)
    assert sorted(tuple(r) for r in topk.top_k(df, k=3).collect()) == brute_top_k(whole, 3)


def test_top_k_resolves_few_entries():
    """Full sums are made for gathered and collected entries, not for all."""
    from codeatlas.llm import topk
    rng = np.random.default_rng(2)
    x = rng.integers(-64, 64, (4000, 16))
    x[:40] *= 6
    own, nth = np.arange(20), np.arange(4000)
    full = x[:20] @ x.T
    full[own, own] = topk.NEVER
    gathered = dict(topk.gather(own, x[:20], nth, nth, x, None, 5))
    cutoff = np.array([np.sort(s)[-5] for _, s in gathered.values()])
    collected = dict(topk.collect_and_resolve(own, x[:20], nth, nth, x, cutoff, 5))
    assert sum(len(v) for v, _ in gathered.values()) <= 2 * 5 * 20
    for i in range(20):
        assert sorted(collected[i][1])[-5:] == sorted(full[i])[-5:]
    assert sum(len(v) for v, _ in collected.values()) < 20 * 4000 / 10
    assert len(topk.reachable(x[:20], x[40:], np.full(20, 10**6))) == 0


def test_top_k(spark):
    from codeatlas.llm.topk import top_k
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 16)], 0) for i in range(130)]
    rows += [(200 + i, [0.5] * 16, 1) for i in range(30)] + [(300, None, 1), (301, [None] * 16, 1), (302, [float("nan")] * 16, 1), (303, [float("inf")] * 16, 1)]
    rows += [(None, [0.1] * 16, 1), (40, rows[40][1], 0), (304, [0.25] * 5, 0)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")).collect()
    ok = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert sorted(tuple(r) for r in got) == brute_top_k(ok)
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ------------------------------------------------------------------ mixing

def test_mixing(spark, docs, empty):
    from codeatlas.llm.mixing import mix
    got = mix(docs)
    assert got.columns == [c for c in docs.columns if c != "copy"] + ["copy", "shuffle_key"]
    assert sorted(map(str, got.collect())) == sorted(map(str, mix(docs).collect()))
    assert mix(empty).count() == 0
    many = spark.range(4000).selectExpr("id as doc_id", "'abcd' as text", "case when id < 3000 then 'big' else 'small' end as source")
    w = spark.createDataFrame([("big", 1.0), ("small", 9.0), ("none", 5.0)], "source string, weight double")
    n = {r["source"]: r["count"] for r in mix(many, w).groupBy("source").count().collect()}
    # rate 4000 * w / 15 / size: the weight of sources that are missing still counts
    total = sum(n.values())
    assert abs(n["small"] / total - 0.9) < 0.02 and abs(total - 4000) < 300


def test_mixing_draws_each_row_on_its_own(spark, monkeypatch):
    """Null and repeated ids, equal rows among them: the rows of the registered
    SQL, counts that differ, one shuffle key a copy."""
    import duckdb
    from codeatlas.llm import mixing
    from codeatlas.llm.queries import ORACLE
    rows = [(None, "equal", "en", "a", 5)] * 700 + [(None, f"text {i}", None, "a", i) for i in range(300)]
    rows += [(7, f"seven {i % 40}", "en", "b", 7) for i in range(200)] + [(i, "é" * i, "en", None if i % 2 else "b", None) for i in range(100, 200)]
    rows += [(8, None, "1", "a", 1), (8, "", "1", "a", 1), (8, "", "1", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    res = con.execute(ORACLE["op2_mixing"])
    cols = [d[0] for d in res.description]
    want = collections.Counter(res.fetchall())
    monkeypatch.setattr(mixing, "NUMBERED", 64)
    got = collections.Counter(map(tuple, mixing.mix(df).select(*cols).collect()))
    assert got == want
    keys = collections.Counter(r[cols.index("shuffle_key")] for r in got.elements())
    assert max(keys.values()) == 1
    copies = collections.Counter(r[:5] for r in got.elements())
    assert 500 < copies[(None, "equal", "en", "a", 5)] < 3000 and len({r[cols.index("copy")] for r in got}) > 2
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", -1)
    assert collections.Counter(map(tuple, mixing.mix(df).select(*cols).collect())) == want


# ------------------------------------------------------------------ learned operators

def test_toxicity(spark, docs, labels, empty):
    from codeatlas.llm.toxicity import drop_toxic, toxicity
    rng = np.random.default_rng(5)
    plain = ["table", "river", "green", "walk", "stone", "light", "paper", "under", "again", "window"]
    rows, marks = [], []
    for i in range(600):
        text = rng.choice(plain, 40).tolist()
        bad = i % 4 == 0
        if bad:
            text[int(rng.integers(0, 40))] = "gruzz" + str(rng.choice(plain))[:2]
        rows.append((i, " ".join(text)))
        marks.append((i, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity(df, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    for i, y in marks:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
    held = [(y, got[i].predicted) for i, y in marks if got[i].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    edge = toxicity(docs, labels).collect()
    assert len(edge) == len(edge_rows()) and all(0 <= r.score <= 1 for r in edge)
    assert toxicity(empty, labels).count() == 0 and drop_toxic(docs, labels.where("false")).count() == len(edge_rows())


def test_toxicity_keeps_all_windows_of_the_sample(spark):
    from codeatlas.llm import toxicity as T
    rng = np.random.default_rng(12)
    found = ["".join(map(chr, w)) for w in rng.integers(97, 123, (90_000, 12))]
    rows = [(i, " ".join(found[1000 * i:1000 * i + 1000])) for i in range(90)]
    made = T.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, toxic int"))
    taught = [w for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2 for w in t.split()]
    codes = np.unique(T._symbols(taught, made.model.letters)[0])
    assert len(codes) > 1 << 19 and np.array_equal(made.model.grams[-1], codes)


def test_toxicity_learns_from_every_label(spark):
    from codeatlas.llm import toxicity as T
    n = 28_000  # more than 20,000 ordinary ones outside the held-out fold
    letters = "abcdefghijklmnop"
    rows = [(i, " ".join("".join(letters[i >> s & 15] for s in (12, 8, 4, 0)) * k for k in (1, 2))) for i in range(n)]
    made = T.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 28 == 0)) for i in range(n)], "doc_id long, toxic int"))
    taught = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    assert made.share == pytest.approx(sum(i % 28 == 0 for i, _ in taught) / len(taught), abs=1e-12)
    assert np.array_equal(made.model.grams[-1], np.unique(T._symbols([w for _, t in taught for w in t.split()], made.model.letters)[0]))


def test_backoff_is_shared_and_probabilities_sum_to_one():
    from codeatlas.llm import toxicity as X
    letters = {c: k for k, c in enumerate("abc", 1)}
    words = ["abc", "ab", "cab", "bca", "a"]
    code, sizes = X._symbols(words, letters)
    assert sizes.tolist() == [4, 3, 4, 4, 2]
    u, where = np.unique(code, return_inverse=True)
    one = np.bincount(where)
    m = X.fit(letters, u, np.array([one, one]))
    assert all(np.allclose(r, 0) for r in m.ratios) and np.allclose(m.word_ratios(["abc", "zzz"]), 0)
    m = X.fit(letters, u, np.array([one, 0 * one]))
    assert np.allclose(m.ratios[0], 0) and np.allclose(m.ratios[X.SHARED - 1], 0)  # pooled orders


def test_language(spark, docs, empty):
    from codeatlas.llm.langid import automaton, languages
    rng = np.random.default_rng(6)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["ste", "ung", "sch"], "cc": ["eau", "oux", "ère"]}
    rows = []
    for i in range(300):
        lang = "abc"[i % 3] * 2
        rows.append((i, " ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(20)), lang if i % 7 else None))
    df = spark.createDataFrame(rows + [(999, None, "aa"), (998, "12 %% !", "bb"), (None, "kaka lolo", "cc")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in languages(df).collect()}
    assert all(got[i].lang_pred == "abc"[i % 3] * 2 and 0 <= got[i].score <= 1 for i in range(300))
    assert got[999].lang_pred == "und" and got[998].lang_pred == "und" and got[None].lang_pred == "aa" and not got[None].held_out
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300))
    assert len(languages(docs).collect()) == len(edge_rows()) and languages(empty).count() == 0
    text = rng.integers(1, 4, 60)
    nexts = automaton(text)

    def accepts(s):
        state = 0
        for c in s:
            if c not in nexts[state]:
                return False
            state = nexts[state][c]
        return True
    subs = {tuple(text[i:j].tolist()) for i in range(60) for j in range(i, 61)}
    assert all(accepts(s) for s in subs) and not any(accepts(s) for s in [tuple(rng.integers(1, 4, 7).tolist()) for _ in range(300)] if s not in subs)


def test_a_rare_language_does_not_shorten_the_others(spark):
    from codeatlas.llm.langid import languages
    rng = np.random.default_rng(7)
    late = {"aa": ["ka", "lo", "mi", "ra"], "bb": ["ste", "ung", "sch", "zwo"]}

    def text(syllables):
        return " ".join("".join(rng.choice(syllables, 3)) for _ in range(40))
    # up to id 199 both languages are alike; what tells them apart comes later
    rows = [(i, text(["pe", "to", "nu"] if i < 200 else late["ab"[i % 2] * 2]), "ab"[i % 2] * 2) for i in range(500)]
    df = spark.createDataFrame(rows + [(1001, "öxö üxü", "zz")], "doc_id long, text string, lang string")
    assert zlib.crc32(b"1001") % 5
    got = {r.doc_id: r.lang_pred for r in languages(df).collect()}
    assert all(got[i] == "ab"[i % 2] * 2 for i in range(200, 500))
    assert got[1001] == "zz"


def test_a_language_learns_the_same_among_many(spark):
    from codeatlas.llm import langid as L
    rng = np.random.default_rng(11)
    rows = [(i, "".join(rng.choice(list("abcdefgh "), 900)), f"l{i % 40:02d}") for i in range(1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many, one = L.train(df), L.train(df.where("lang = 'l07'"))
    samples = {lang: sample for group, _ in many for lang, sample in group.items()}
    assert len(samples) == 40 and len(one) == 1 and one[0][0] == {"l07": samples["l07"]} and len(samples["l07"]) > 8000
    assert all(sum(map(len, group.values())) <= 1.25 * L.TABLE_SYMBOLS for group, _ in many) and len(many) > 1


def test_every_language_is_learned(spark, monkeypatch):
    from codeatlas.llm import langid as L
    rng = np.random.default_rng(9)
    rows = []
    for k in range(70):
        syllables = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(3)]
        rows += [(10 * k + i, " ".join("".join(rng.choice(syllables, 2)) for _ in range(12)), f"l{k:02d}") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in L.languages(df).collect())
    assert [x[:2] for x in got] == [(i, lang) for i, _, lang in rows]
    monkeypatch.setattr(L, "GROUP_LANGS", 16)  # five tables
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in L.languages(df).collect()) == got


def test_cross_parsing_counts_longest_matches():
    from codeatlas.llm import langid as L
    p = L.build({"x": "abcabd", "y": "zzzz"})
    table = L.letter_table(p.letters)
    text = "abdabcq"
    sym, offsets = L.symbols([text, ""], table)
    got = p.phrases(sym, offsets)
    assert got[0].tolist() == [3, 0]  # abd | abc | q
    assert got[1, 1] == 0 and got[1, 0] >= 6


# ------------------------------------------------------------------ pages

PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li><a href=/a>menu</a><li>two</ul></nav>"
        "<div class=\"ad top\">buy</div><header>site</header><article><header><h1>Head {n}</h1></header><p><b>A {n}  &amp; b<br><p>x&lt;y {n}</p>"
        "<div class=comments><p>first!</p></div><form>mail<input></form></article><aside>side</aside><footer>&copy; foot</footer></body></html>")


def test_main_text(spark):
    from codeatlas.llm.wrappers import main_text
    rows = [(i, "http://h.example/%d" % i, PAGE.replace("{n}", str(i))) for i in range(30)]
    plain = "<body><div class=menu>m</div><div id=c><h4>same</h4><p>body {n} text</div><div><a href=x>only links</a></div>"
    rows += [(100 + i, "https://plain.example:80/x", plain.replace("{n}", str(i))) for i in range(5)]
    rows += [(200, None, "<p>alone"), (201, "nonsense", None), (None, "http://h.example/z", ""), (202, "http://h.example/z", PAGE.replace("{n}", "9")[:-60]),
             (203, "http://h.example/cut", "<article><p>one <foo bar='"), (0, "http://h.example/0", PAGE.replace("{n}", "0"))]
    got = collections.defaultdict(list)
    for r in main_text(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")).collect():
        got[r.page_id].append(r)
        assert r.n_chars == len(r.text)
    assert got[3][0].text == "Head 3 A 3 & b x<y 3" and got[202][0].text == "Head 9 A 9 & b x<y 9" and len(got[0]) == 2
    assert got[101][0].text == "body 1 text" and got[200][0].text == "alone" and got[201][0].text == "" and got[None][0].text == "" and got[203][0].text == "one"
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_alignment_is_a_longest_common_subsequence():
    from codeatlas.llm.wrappers import align
    rng = np.random.default_rng(8)
    for _ in range(300):
        a, b = (rng.choice(list("abcd"), rng.integers(0, 14)).tolist() for _ in "xy")
        pairs = align(a, b)
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in np.ndindex(len(a), len(b)):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        assert len(pairs) == best[-1, -1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    long = [f"p{i}" for i in range(3000)]
    assert len(align(long, long[::-1])) == 1


def test_raw_elements_and_named_boilerplate():
    from codeatlas.llm.wrappers import extract
    page = ("<article class=with-sidebar>İİİİ<SCRIPT>x</ScRiPt><p>body</p><div class='post-comments'>c</div><div class='site-nav'>n</div>"
            "<div class='no-ads'>kept</div></article>")
    assert extract(page, None) == "İİİİ body kept"


def test_wrapper_expression():
    from codeatlas.llm import wrappers as W
    pages = ["<body><h1>a</h1><ul><li>x<li>y</ul><p>same", "<body><h1>b</h1><div class=ad>z</div><ul><li>x</ul><p>same", "<body><h1>c</h1><ul><li>q<li>y</ul><p>same"]
    spec = json.loads(W.compiled(pages))
    assert spec["expression"] == "<h1># <div.ad>=? <ul/li>#+ <p>="
    assert dict(zip(spec["paths"], spec["plain"])) == {"h1": True, "div.ad": False, "ul/li": True, "p": True} and not any(spec["main"])
    nested = W.fold_repeats(W.tokens(W.parse("<body>" + "<h2>t</h2><p>u</p><p>v</p>" * 3)))
    assert W.expression(nested) == "(<h2>= <p>#+)+"


def test_slots_decide_and_templates_are_counted_over_all_pages(spark):
    """Against brute force: a constant notice at the path of the body's
    paragraphs goes, whatever its slot is called; equal pages count once."""
    from codeatlas.llm import wrappers as W
    page = "<body><div><p>Subscribe to our weekly letter</p><p>{n} first</p><p>{n} second</p></div><ul><li>{n} <a href=x>one</a></ul>"
    rows = [(i, "http://one.example/", page.replace("{n}", f"body {i}")) for i in range(20)]
    # a second page type, rarer than the pages that a wrapper is learned from
    other = "<body><h2>Our terms apply</h2><section><p>{n} only</p></section>"
    rows += [(100 + i, "http://one.example/", other.replace("{n}", f"text {i}")) for i in range(3)]
    rows += [(200 + i, "http://copies.example/", "<body><p>the same page") for i in range(9)] + [(300, "http://copies.example/", "<body><p>another")]
    rows += [(400 + i, "http://mixed.example/", f"<body><p>menu</p><div role=main><p>main {i}</p></div>") for i in range(4)]
    rows += [(500 + i, "http://mixed.example/", f"<body><p>menu</p><p>plain {i}</p>") for i in range(4)]
    got = {r.page_id: r.text for r in W.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i in range(20):
        assert got[i] == f"body {i} first body {i} second body {i} one"
    assert [got[100 + i] for i in range(3)] == [f"text {i} only" for i in range(3)]
    assert got[200] == "the same page" and got[300] == "another"
    assert all(got[400 + i] == f"main {i}" and got[500 + i] == f"plain {i}" for i in range(4))

    # brute force: slots from the same wrappers, templates by counting sets of pages
    by_host = collections.defaultdict(set)
    for _, url, html in rows:
        by_host[url].add(html)
    for url, pages in by_host.items():
        few = sorted(pages, key=lambda h: hashlib.md5(h.encode()).hexdigest())[:W.SAMPLE]
        wrapper = json.loads(W.compiled(few))
        texts, slots = collections.defaultdict(set), collections.defaultdict(set)
        for html in pages:
            article, found = W.judged(html, wrapper)
            for slot, text in [] if article else found:
                texts[slot, text].add(html)
                slots[slot].add(html)
        template = frozenset(k for k, v in texts.items() if len(v) >= W.MIN_CONSTANT and 2 * len(v) >= len(slots[k[0]]))
        for n, u, html in rows:
            if u == url:
                assert got[n] == W.extract(html, wrapper, template)


def test_slots_come_from_the_alignment():
    """The verdict follows the slot that a block aligned with: two slots of one
    path differ, a lone token of a repeated group finds its slot, and without
    the wrapper's shapes the result changes."""
    from codeatlas.llm import wrappers as W
    link = "<div><a href=x>read {n}</a></div>"
    pages = [("<body>" + link + "<h1>t {n}</h1><div>lead {n}</div>" + "<h3>q {n}</h3><p>a {n}</p>" * 2).replace("{n}", str(i)) for i in range(4)]
    wrapper = json.loads(W.compiled(pages))
    assert wrapper["paths"] == ["div", "h1", "div", "h3", "p"] and wrapper["plain"] == [False, True, True, True, True]
    new = "<body><div>read me</div><h1>t</h1><div><a href=x>lead</a></div><h3>q</h3><p>a</p>"
    assert W.placed(W.parse(new), wrapper) == [0, 1, 2, 3, 4]
    assert W.extract(new, wrapper) == "t lead q a"
    assert W.extract(new, {**wrapper, "shapes": [], "slots": []}) == "read me t q a"
    deep = "<div>" * 9 + "x"
    assert W.parse("<section>" + deep)[0].key != W.parse("<p class=a></p><ul><li>" + deep)[0].key
    assert W.parse("<div>" * 20000 + "x")[0].text == "x"


# ------------------------------------------------------------------ registration, SQL, pipeline

def test_sql(spark):
    import duckdb
    from codeatlas.llm.queries import ORACLE, QUERIES
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in ORACLE.items():
        res = con.execute(sql)
        cols = [d[0] for d in res.description]
        df = QUERIES[name](spark, SF)
        assert sorted(df.columns) == sorted(cols)
        assert collections.Counter(map(tuple, df.select(*cols).collect())) == collections.Counter(res.fetchall()), name


def test_pipeline(spark):
    import corpus_pipeline as P
    from codeatlas.llm.common import table
    from codeatlas.llm.toxicity import toxicity
    from codeatlas.session import cut_table
    docs = table(spark, SF, "documents")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "toxicity", "near_dedup", "mixing", "packing"]
    steps = [docs]
    for _, stage in P.STAGES:
        steps.append(cut_table(stage(spark, steps[-1], SF), "t"))
    ids = [sorted(r.doc_id for r in s.select("doc_id").collect()) for s in steps[:5]]
    assert ids[1] == sorted(r.doc_id for r in docs.collect() if brute_quality(r.text)[-1])
    bad = {r.doc_id for r in toxicity(steps[1], table(spark, SF, "labels")).collect() if r.predicted}
    assert ids[2] == [i for i in ids[1] if i not in bad]
    assert ids[3] == sorted({c for _, _, c in brute_components([(r.doc_id, r.text) for r in steps[2].collect()], 5, 80)})
    assert set(ids[4]) <= set(ids[3]) and all(s.columns == docs.columns for s in steps[:5])
    tokens = collections.Counter()
    for r in steps[5].collect():
        tokens[r.doc_id] += r.length
    tok = tokenizer("byte_bpe_50k.json")
    copies = collections.Counter(ids[4])
    assert tokens == {r.doc_id: copies[r.doc_id] * (len(tok.encode(r.text).ids) + 1) for r in steps[3].collect() if copies[r.doc_id]}
    run = collections.Counter(P.run(spark, SF).select("doc_id", "start", "length").collect())
    assert sum(n * r.length for r, n in run.items()) == sum(tokens.values())
