"""Conversation structure repair by rank-convergence parallel Viterbi (operator 13).

The cheapest edits that turn a conversation's roles into ``(s?(ua)+)?`` (an
optional system turn, then user and assistant in turn) are a shortest path over
four states: nothing yet, after system, after user, after assistant. Costs to
the end are a vector of four numbers, taken row by row from the end.

1. Rows are sorted over ranges of (conversation, turn), so a conversation of any
   size spreads over tasks, and written as chunks of at most CHUNK rows and
   CHUNK_BYTES of text. A conversation inside one chunk is settled there.
2. The chunks of a longer one all start at once, from a speculative vector in
   place of their successor's. In fix-up passes a chunk whose successor's vector
   differs (after subtracting its minimum) runs again from its end, and stops at
   the first row whose vector differs from the former one by a constant alone.
   Passes end when no chunk hands on another vector.
3. Stitched costs (the constants add up over chunks) then drive the tracing of
   the least audit: at each row the edit with the smallest initial whose cost
   plus cost to the end is the least. A chunk is traced from each of the four
   states at once, and these small maps are composed over the chunks.

A row that repeats role and text of an earlier one is found inside a chunk by
its fingerprint, and over the chunks of a longer conversation by the smallest
place of each fingerprint. The digest of a repaired conversation is sequential
by definition; its pieces are streamed in order, never held together.

Defined cases: null role or text is one space (so the text is blank and the role
has no initial that the pattern allows); an empty role has none either; rows with
a null id are one conversation; null turns come first; rows with equal turns are
in order of an md5 over role and text; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.common import bounded_batches
from codeatlas.operators.numbering import numbered
from codeatlas.session import cut_table

CHUNK, CHUNK_BYTES = 128, 1 << 20
FAN = 1024  # chunk maps that are composed together
SPACE = " \t\n\x0b\x0c\r"
GOOD, BLANK, TRUNCATED, DUPLICATE = range(4)
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 3, 2, 2, 1
KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}  # state after a kept row
TURNED = {0: 2, 1: 2, 3: 2, 2: 3}                              # state after a rerole or an insert
FILLED = {2: "user", 3: "assistant"}                           # the role that led there
END = (0, 2 * INSERT_COST, INSERT_COST, 0)                     # cost to the end after the last row
_INITIALS = "sua"

PIECES = ("key string, part int, no int, closed boolean, codes binary, marks array<string>, roles array<string>, texts array<string>, "
          "blank long, duplicate long, truncated long, illegal long, cost long, audit string")


# --------------------------------------------------------------------------
# one row, one chunk
# --------------------------------------------------------------------------

def code(role: str, text: str) -> int:
    """Initial and fault of a row, as one small number."""
    body = text.rstrip(SPACE)
    fault = BLANK if not body else GOOD if body[-1] in ".!?" else TRUNCATED
    return 4 * (_INITIALS.find(role[0]) if role and role[0] in _INITIALS else 3) + fault


def _consumed(after: tuple, row: int, state: int) -> list[tuple[int, str, int]]:
    """(cost to the end, edit, next state) of the ways to use a row."""
    fault = row % 4
    ways = [(DELETE_COST + after[state], "D", state)]
    if fault in (GOOD, TRUNCATED):
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        kept = KEEPS.get(_INITIALS[row // 4:row // 4 + 1], {}).get(state)
        if kept is not None:
            ways.append((extra + after[kept], "K", kept))
        ways.append((REROLE_COST + extra + after[TURNED[state]], "R", TURNED[state]))
    return ways


@cache
def raised(after: tuple, row: int) -> tuple[tuple, int]:
    """The costs before a row from those after it, less their minimum, and that
    minimum. Inserts may come before the row."""
    use = [min(_consumed(after, row, s))[0] for s in range(4)]
    user, assistant = min(use[2], INSERT_COST + use[3]), min(use[3], INSERT_COST + use[2])
    costs = (min(use[0], INSERT_COST + user), min(use[1], INSERT_COST + user), user, assistant)
    low = min(costs)
    return tuple(c - low for c in costs), low


@cache
def edits(after: tuple, row: int, state: int) -> tuple[str, int]:
    """The least initials of cheapest edits up to and with this row, and the state behind it."""
    costs, low = raised(after, row)
    done = ""
    while True:
        ways = [(edit, to) for cost, edit, to in _consumed(after, row, state) if cost == costs[state] + low]
        if costs[state] == INSERT_COST + costs[TURNED[state]]:
            ways.append(("I", TURNED[state]))
        edit, state = min(ways)
        done += edit
        if edit != "I":
            return done, state


def costs_back(codes: bytes, end: tuple, known: bytes = b"") -> bytes:
    """The vector before each row and the constant taken off there (5 bytes a
    row), from ``end`` backwards. ``known`` is a former run: as soon as a vector
    equals its own, the rows before differ by constants alone and are kept."""
    out, after = bytearray(known or 5 * len(codes)), end
    for i in range(len(codes) - 1, -1, -1):
        after, low = raised(after, codes[i])
        now = bytes((*after, low))
        if known and out[5 * i:5 * i + 4] == now[:4]:
            out[5 * i + 4] = low
            break
        out[5 * i:5 * i + 5] = now
    return bytes(out)


def traced(codes: bytes, costs: bytes, end: tuple, state: int, last: bool) -> tuple[str, int]:
    """Audit of a chunk entered in ``state``, and the state behind it."""
    done = []
    for i, row in enumerate(codes):
        after = end if i + 1 == len(codes) else tuple(costs[5 * i + 5:5 * i + 9])
        piece, state = edits(after, row, state)
        done.append(piece)
    while last and END[state]:
        done.append("I")
        state = TURNED[state]
    return "".join(done), state


def repaired_rows(audit: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows that the audit leaves, from ``state``."""
    row = 0
    for edit in audit:
        if edit == "I":
            state = TURNED[state]
            yield edit, FILLED[state], ""
            continue
        role, text = roles[row], texts[row]
        row += 1
        if edit == "D":
            continue
        if edit == "K":
            state = KEEPS[role[0]][state]
        else:
            state = TURNED[state]
            role = FILLED[state]
        yield edit, role, text


def illegal_pairs(codes: bytes) -> int:
    """Adjacent rows whose initials are not su, ua or au."""
    return sum((a // 4, b // 4) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(codes, codes[1:]))


# --------------------------------------------------------------------------
# rows -> chunks
# --------------------------------------------------------------------------

def conversation_key() -> Column:
    return F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))


def damage_kind() -> Column:
    """What damages a row: 0 drops it, 1 empties its text, 2 removes its end
    marks, 3 repeats it, 4 makes it the user's; others leave it."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    return F.crc32(name.cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the deterministic damage."""
    kind, text = damage_kind(), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", kind.alias("kind"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text")).where("kind <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")).drop("again")


def _chunker(chunk: int):
    schema = {"key": pa.string(), "part": pa.int32(), "no": pa.int32(), "closed": pa.bool_(), "codes": pa.binary(), "marks": pa.list_(pa.string()),
              "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(),
              "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string()}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, out, held, size = TaskContext.get().partitionId(), [], 0, 0
        key, no, rows, first = None, 0, [], True

        def cut(closed: bool) -> dict:
            roles, texts, marks = ([r[i] for r in rows] for i in (0, 1, 2))
            codes = bytes(code(a, b) for a, b in zip(roles, texts))
            row = {"key": key, "part": part, "no": no, "closed": closed, "codes": codes, "marks": None if closed else marks, "roles": roles, "texts": texts}
            if closed:
                seen: set[str] = set()
                again = []
                for i, m in enumerate(marks):
                    if m in seen:
                        again.append(i)
                    seen.add(m)
                row.update(zip(("codes", "blank", "duplicate", "truncated"), marked(codes, again)))
                costs = costs_back(row["codes"], END)
                audit, _ = traced(row["codes"], costs, END, 0, True)
                row.update(illegal=illegal_pairs(codes), cost=sum(costs[4::5]) + costs[0], audit=audit)
            return row

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], t) for n, t in schema.items()], names=list(schema))

        for b in it:
            for k, role, text, mark in zip(*(c.to_pylist() for c in b.columns)):
                ended = k != key
                if rows and (ended or len(rows) == chunk or size >= CHUNK_BYTES):
                    # a partition's first and last conversation may go on in its neighbours
                    out.append(cut(ended and no == 0 and not first))
                    held += size
                    no, rows, size = no + 1, [], 0
                if ended:
                    first, key, no = key is None, k, 0
                rows.append((role, text, mark))
                size += len(text)
                if held >= CHUNK_BYTES:
                    yield batch()
                    out, held = [], 0
        if rows:
            out.append(cut(False))
        if out:
            yield batch()
    return run


def marked(codes: bytes, again: list[int]) -> tuple[bytes, int, int, int]:
    """Codes with the repeated rows (positions) as duplicates, and the numbers
    of blank, duplicate and truncated rows."""
    out = bytearray(codes)
    for i in again:
        if out[i] % 4 != BLANK:
            out[i] = 4 * (out[i] // 4) + DUPLICATE
    faults = [c % 4 for c in out]
    return bytes(out), faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED)


# --------------------------------------------------------------------------
# chunks of longer conversations
# --------------------------------------------------------------------------

def _arrow(df: DataFrame, made, schema: str) -> DataFrame:
    """``made(row dict) -> row dict`` over rows, batch by batch."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_pylist([made(r) for r in batch.to_pylist()], schema=target)
    return df.mapInArrow(run, schema)


def open_codes(pieces: DataFrame) -> DataFrame:
    """(key, part, no, nth, of, codes, blank, duplicate, truncated) of the chunks
    of longer conversations, repeats of all earlier rows found."""
    chunks = cut_table(numbered(pieces.where("not closed").select("key", "part", "no", "codes", "marks"), "key", [F.col("part"), F.col("no")], "repair_chunks"), "repair_numbered")
    rows = chunks.select("key", "nth", F.posexplode("marks").alias("at", "mark"))
    first = rows.groupBy("key", "mark").agg(F.min(F.struct("nth", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "mark", "first")
    again = (rows.join(first, ["key", "mark"]).where(F.struct("nth", "at") != F.col("first"))
             .groupBy("key", "nth").agg(F.collect_list("at").alias("again")))

    def made(r: dict) -> dict:
        codes, blank, duplicate, truncated = marked(r["codes"], r["again"] or [])
        return dict(r, codes=codes, blank=blank, duplicate=duplicate, truncated=truncated)

    return _arrow(chunks.join(again, ["key", "nth"], "left").select("key", "part", "no", "nth", "of", "codes", "again"), made,
                  "key string, part int, no int, nth long, of long, codes binary, blank long, duplicate long, truncated long")


def stitched(chunks: DataFrame) -> DataFrame:
    """``chunks`` (key, nth, of, codes, ...) with ``after`` (the successor's
    vector, 4 bytes) and ``costs`` (see ``costs_back``): speculative runs and
    fix-up passes until the vectors handed on no longer change."""
    names = [f for f in chunks.schema.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names) + ", after binary, costs binary, changed boolean"

    def speculate(r: dict) -> dict:
        return dict(r, after=bytes(END), costs=costs_back(r["codes"], END), changed=r["nth"] > 1)

    def fix(r: dict) -> dict:
        new = r.pop("new")
        if new is None or new == r["after"]:
            return dict(r, changed=False)
        costs = costs_back(r["codes"], tuple(new), r["costs"])
        return dict(r, after=new, changed=costs[:4] != r["costs"][:4], costs=costs)

    now = cut_table(_arrow(chunks, speculate, schema), "repair_costs")
    while not now.where("changed").isEmpty():
        handed = now.where("changed and nth > 1").select("key", (F.col("nth") - 1).alias("nth"), F.substring("costs", 1, 4).alias("new"))
        now = cut_table(_arrow(now.join(handed, ["key", "nth"], "left").select(*[f.name for f in names], "after", "costs", "changed", "new"), fix, schema), "repair_costs")
    return now.drop("changed")


def entry_states(maps: DataFrame) -> DataFrame:
    """(key, nth, entry): the state in which each chunk is entered. ``maps``
    (key, nth, exits): the state behind a chunk by the state before it. Maps are
    composed in runs of FAN, runs again in runs, and states handed down."""
    runs = cut_table(maps.groupBy("key", F.ceil(F.col("nth") / FAN).alias("run")).agg(F.array_sort(F.collect_list(F.struct("nth", "exits"))).alias("chunks")), "repair_runs")
    if runs.agg(F.coalesce(F.max("run"), F.lit(1))).first()[0] > 1:
        whole = F.aggregate("chunks", F.array(*[F.lit(s) for s in range(4)]), lambda acc, x: F.transform(acc, lambda s: F.element_at(x["exits"], s + 1)))
        above = entry_states(runs.select("key", F.col("run").alias("nth"), whole.alias("exits")))
        runs = runs.join(above.select("key", F.col("nth").alias("run"), "entry"), ["key", "run"])
    else:
        runs = runs.withColumn("entry", F.lit(0))
    start = F.struct(F.col("entry").alias("state"), F.array().cast("array<int>").alias("entries"))
    walk = F.aggregate("chunks", start, lambda acc, x: F.struct(F.element_at(x["exits"], acc["state"] + 1).alias("state"),
                                                               F.concat(acc["entries"], F.array(acc["state"])).alias("entries")), lambda acc: acc["entries"])
    return (runs.select("key", F.explode(F.arrays_zip(F.col("chunks.nth").alias("nth"), walk.alias("entry"))).alias("x"))
            .select("key", F.col("x.nth").alias("nth"), F.col("x.entry").alias("entry")))


def audited(chunks: DataFrame) -> DataFrame:
    """Stitched chunks with ``entry``, ``audit`` and their share of the cost."""
    def made(r: dict) -> dict:
        walks = [traced(r["codes"], r["costs"], tuple(r["after"]), s, r["nth"] == r["of"]) for s in range(4)]
        cost = sum(r["costs"][4::5]) + (r["costs"][0] if r["nth"] == 1 else 0)
        return dict(r, cost=cost, audits=[a for a, _ in walks], exits=[s for _, s in walks])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields) + ", cost long, audits array<string>, exits array<int>"
    walked = cut_table(_arrow(chunks, made, schema), "repair_walks")
    return (walked.join(entry_states(walked.select("key", "nth", "exits")), ["key", "nth"])
            .withColumn("audit", F.element_at("audits", F.col("entry") + 1)).drop("audits", "exits"))


# --------------------------------------------------------------------------
# the operator
# --------------------------------------------------------------------------

def repair(rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """``rows`` (conv_id, turn, role, text) -> chunks of whole conversations
    (settled) and of longer ones, both with key, nth, of, roles, texts, entry,
    audit and the numbers of faults; ``cost`` is the chunk's share."""
    bounded_batches(rows)
    mark = F.md5(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text").cast("binary"))
    sorted_rows = (rows.select(conversation_key().alias("key"), "turn", "role", "text", mark.alias("mark"))
                   .repartitionByRange("key", F.asc_nulls_first("turn"), "mark").sortWithinPartitions("key", F.asc_nulls_first("turn"), "mark"))
    pieces = cut_table(sorted_rows.select("key", "role", "text", "mark").mapInArrow(_chunker(chunk), PIECES), "repair_pieces")
    shared = ["key", "nth", "of", "codes", "roles", "texts", "entry", "audit", "blank", "duplicate", "truncated", "cost"]
    whole = pieces.where("closed").withColumn("nth", F.lit(1).cast("long")).withColumn("of", F.lit(1).cast("long")).withColumn("entry", F.lit(0))
    chunks = audited(stitched(cut_table(open_codes(pieces), "repair_codes")))
    longer = chunks.join(pieces.where("not closed").select("key", "part", "no", "roles", "texts"), ["key", "part", "no"])
    return whole.select(*shared), longer.select(*shared)


def repaired(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The repaired conversations: (key, nth, at, edit, role, text), in order of
    (nth, at) within a key; ``key`` is v and the id, or n for the null id."""
    whole, longer = repair(rows, chunk)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                out = [(r["key"], r["nth"], i, *row) for i, row in enumerate(repaired_rows(r["audit"], r["entry"], r["roles"], r["texts"]))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()))],
                                                     names=["key", "nth", "at", "edit", "role", "text"])

    cols = ["key", "nth", "roles", "texts", "entry", "audit"]
    return whole.select(cols).union(longer.select(cols)).mapInArrow(run, "key string, nth long, at int, edit string, role string, text string")


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its chunks, which come in order."""
    names = ["key", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()]
    key, sums, audit, digest, last, begun, out = None, [0] * 5, [], None, None, False, []

    def ended() -> tuple:
        return (key, *sums, "".join(audit), digest.hexdigest())

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    for b in it:
        for r in b.to_pylist():
            if r["nth"] == 1:
                if digest is not None:
                    out.append(ended())
                key, sums, audit, digest, last, begun = r["key"], [0] * 5, [], hashlib.sha256(), b"", False
            codes = r["codes"]
            for i, x in enumerate((r["blank"], r["duplicate"], r["truncated"], illegal_pairs(last + codes), r["cost"])):
                sums[i] += x
            last = codes[-1:]
            audit.append(r["audit"])
            for _, role, text in repaired_rows(r["audit"], r["entry"], r["roles"], r["texts"]):
                digest.update(f"\n{role}:{text}".encode() if begun else f"{role}:{text}".encode())
                begun = True
            if len(out) >= 1024:
                yield batch()
                out = []
    if digest is not None:
        out.append(ended())
    if out:
        yield batch()


def repair_digests(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 for every conversation, damaged and then repaired."""
    whole, longer = repair(damaged(conversations), chunk)
    schema = "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    found = (whole.mapInArrow(_digests, schema)
             .unionByName(longer.repartition("key").sortWithinPartitions("key", "nth").mapInArrow(_digests, schema)))
    left = F.when(damage_kind() != 0, F.col("turn").cast("long"))
    every = (conversations.groupBy("conv_id").agg(F.min(left).alias("lo"), F.max(left).alias("hi"), F.count_distinct(left).alias("n"))
             .select("conv_id", conversation_key().alias("key"), F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps")))
    none = hashlib.sha256(b"").hexdigest()
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, "key", "left").select("conv_id", "gaps", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
                                                   F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
