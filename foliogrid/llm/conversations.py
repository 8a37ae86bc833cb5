"""Conversation structure repair by cheapest edits.

A conversation is legal if its roles read: at most one system turn, then user and assistant in turn, ending with the
assistant; or if it is empty. Edits walk a lattice of (rows read, last role written): keep a row, give it another role,
delete it, or insert an empty turn. A forward search from the start and a reverse search from the legal ends, each a
Dijkstra with a heap of its own, meet in between. They go on until no path as cheap as the best one can be left that
has not crossed, then the least audit (the initials of the edits) of all crossings of that cost is taken.

Rows are sorted over sampled ranges of conversation and turn, so a conversation of any length is spread. One that lies
within a range is repaired there. Those that reach over the border of a range, or are long, are cut into segments of
bounded size: their repeated turns are found by grouping digests, each segment gets the cheapest edits between any two
roles at its ends, and the same search over the segments of a conversation chooses among them. The repaired text is
then written segment by segment and its digest taken while it streams by.

Defined results: null roles and texts are one space; an empty role has no legal place, like any role but the three,
and what counts of a role is its first letter; rows are sorted by turn, null turns first, then by role and text; rows
of a null conversation are one conversation; repeated rows are repeated turns; a conversation without rows that are
present has zeros, an empty audit and the digest of nothing; an empty table gives an empty result; other columns are
ignored; long texts are read whole. The audit of a conversation is one value and has to fit into a row.
"""

from __future__ import annotations

import hashlib
from functools import cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliogrid.llm.common import materialize, table

#: Rows and characters after which a conversation is cut.
SEGMENT_ROWS, SEGMENT_CHARS = 256, 4 << 20

# White space, ends of sentences, costs of the edits.
BLANKS, STOPS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: States of the lattice: nothing written yet, or the initial of the last role. What the next written turn may be.
STATES = ("", "s", "u", "a")
KEEPS = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
TURN = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}
LEGAL_ENDS = ("", "a")


@cache
def _edits(alive: bool, truncated: bool, initial: str) -> tuple[tuple[int, int, int, str], ...]:
    """``from, to, cost, letter`` of every edit that reads a row."""
    out = [(i, i, DELETE, "D") for i in range(4)]
    if alive:
        more = TRUNCATED * truncated
        out += [(i, STATES.index(TURN[s]), REROLE + more, "R") for i, s in enumerate(STATES)]
        out += [(i, STATES.index(initial), more, "K") for i, s in enumerate(STATES) if (s, initial) in KEEPS]
    return tuple(out)


INSERTS = tuple((i, STATES.index(TURN[s]), INSERT, "I") for i, s in enumerate(STATES))


def cheapest(steps: list, start: int, ends: tuple[int, ...], inserts: tuple = INSERTS) -> tuple[int, str] | None:
    """The least cost from ``start`` before all steps to one of ``ends`` after them, and the least audit of that cost.

    A step is a list of ``from, to, cost, letters``; steps that cost nothing go on by one. Heaps are ordered by cost,
    then by place, so that what may still improve an audit at equal cost is settled before.
    """
    n = len(steps)

    def leaving(place: int, state: int):
        if place < n:
            for a, b, cost, letters in steps[place]:
                if a == state:
                    yield place + 1, b, cost, letters
        for a, b, cost, letters in inserts:
            if a == state:
                yield place, b, cost, letters

    def entering(place: int, state: int):
        if place:
            for a, b, cost, letters in steps[place - 1]:
                if b == state:
                    yield place - 1, a, cost, letters
        for a, b, cost, letters in inserts:
            if b == state:
                yield place, a, cost, letters

    ahead: dict = {}
    behind: dict = {(n, e): (0, "") for e in ends}
    to_go, to_come, best = [(0, 0, "", start)], [], float("inf")
    for place, state in behind:
        for p, s, cost, letters in entering(place, state):
            heappush(to_come, (cost, -p, letters, s))
    while to_go or to_come:
        top, bottom = to_go[0][0] if to_go else float("inf"), to_come[0][0] if to_come else float("inf")
        if top + bottom > best or (not to_go and best == float("inf")):
            break
        if (top, len(ahead)) <= (bottom, len(behind)):
            cost, place, audit, state = heappop(to_go)
            if (place, state) in ahead:
                continue
            ahead[place, state] = (cost, audit)
            if (place, state) in behind:
                best = min(best, cost + behind[place, state][0])
            for p, s, more, letters in leaving(place, state):
                if (p, s) in behind:
                    best = min(best, cost + more + behind[p, s][0])
                if (p, s) not in ahead:
                    heappush(to_go, (cost + more, p, audit + letters, s))
        else:
            cost, place, audit, state = heappop(to_come)
            place = -place
            if (place, state) in behind:
                continue
            behind[place, state] = (cost, audit)
            if (place, state) in ahead:
                best = min(best, cost + ahead[place, state][0])
            for p, s, more, letters in entering(place, state):
                if (p, s) in ahead:
                    best = min(best, cost + more + ahead[p, s][0])
                if (p, s) not in behind:
                    heappush(to_come, (cost + more, -p, letters + audit, s))
    # all crossings of the least cost: a node that both have settled, or an edge from one to the other
    least = None
    for (place, state), (cost, audit) in ahead.items():
        for p, s, more, letters in ((place, state, 0, ""), *leaving(place, state)):
            if (p, s) in behind and cost + more + behind[p, s][0] == best:
                whole = audit + letters + behind[p, s][1]
                least = whole if least is None or whole < least else least
    return None if least is None else (best, least)


def _faults(texts: list[str], first: list[bool]) -> list[str]:
    """The first fault of each row: blank, duplicate, truncated or none; ``first`` says whether role and text are new."""
    out = []
    for text, new in zip(texts, first, strict=True):
        bare = text.rstrip(BLANKS)
        out.append("blank" if not bare else "duplicate" if not new else "" if bare[-1] in STOPS else "truncated")
    return out


def _counts(roles: list[str], faults: list[str]) -> dict[str, int]:
    initials = [r[:1] for r in roles]
    return {"blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"), "illegal": sum((a, b) not in KEEPS or not a for a, b in zip(initials, initials[1:], strict=False))}


def _steps(roles: list[str], faults: list[str]) -> list:
    return [_edits(f not in ("blank", "duplicate"), f == "truncated", r[:1]) for r, f in zip(roles, faults, strict=True)]


def _gaps(turns: list[int]) -> int:
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0


def repaired(roles: list[str], texts: list[str], audit: str, state: str = "") -> list[str]:
    """``role:text`` of what ``audit`` leaves of the rows."""
    out, at = [], 0
    for letter in audit:
        if letter == "K":
            out.append(f"{roles[at]}:{texts[at]}")
            state = roles[at][:1]
        elif letter in "RI":
            state = TURN[state]
            out.append(f"{ROLE[state]}:{texts[at] if letter == 'R' else ''}")
        at += letter != "I"
    return out


def _digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


_FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_SHOWN = [c.split()[0] for c in _FOUND.split(", ")]


def _folded(kind: str):
    """Sorted rows of a range to conversations that are repaired, and segments of those that may go on elsewhere."""
    schema = f"conv {kind}, whole boolean, part int, k int, {_FOUND}, turns array<long>, roles array<string>, texts array<string>"

    def run(batches):
        part, k, first, conv, rows, chars, cut = TaskContext.get().partitionId(), 0, True, None, [], 0, False
        began, held = False, []

        def segment():
            nonlocal k
            held.append({"conv": conv, "whole": False, "part": part, "k": k, "turns": [r[0] for r in rows], "roles": [r[1] for r in rows], "texts": [r[2] for r in rows]})
            k += 1

        def conversation():
            roles, texts, seen, new = [r[1] for r in rows], [r[2] for r in rows], set(), []
            for r in rows:
                new.append(r[1:] not in seen)
                seen.add(r[1:])
            faults = _faults(texts, new)
            cost, audit = cheapest(_steps(roles, faults), 0, tuple(map(STATES.index, LEGAL_ENDS)))
            held.append({"conv": conv, "whole": True, "gaps": _gaps([r[0] for r in rows if r[0] is not None]), **_counts(roles, faults), "cost": cost, "audit": audit, "repaired_sha256": _digest(repaired(roles, texts, audit))})

        for batch in batches:
            convs, turns, roles, texts, there = (c.to_pylist() for c in batch.columns)
            for c, *row, present in zip(convs, turns, roles, texts, there, strict=True):
                if not began or c != conv:
                    if began:
                        segment() if first or cut else conversation()
                        first = False
                    began, conv, rows, chars, cut = True, c, [], 0, False
                if present:
                    if len(rows) >= SEGMENT_ROWS or chars >= SEGMENT_CHARS:
                        segment()
                        rows, chars, cut = [], 0, True
                    rows.append(tuple(row))
                    chars += len(row[2])
            if held:
                yield _batch(held, kind_of(batch))
                held.clear()
        if began:
            segment()
            yield _batch(held, kind_of(batch))

    def kind_of(batch):
        return pa.schema([("conv", batch.schema.field(0).type), ("whole", pa.bool_()), ("part", pa.int32()), ("k", pa.int32()), *((c, pa.int64()) for c in _SHOWN[:6]), *((c, pa.string()) for c in _SHOWN[6:]), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    return run, schema


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_TRANSFER = "struct<part: int, k: int, counts: array<long>, initials: array<string>, turns: array<long>, edges: array<struct<a: int, b: int, cost: long, audit: string>>>"


def _transfers(segments: DataFrame, kind: str) -> DataFrame:
    """``conv, part, k, counts, initials, turns, edges``: the cheapest edits of each segment between any two states.

    ``turns`` are the least, largest, first and last turn that is not null and the number of different ones.
    """

    def run(batches):
        for batch in batches:
            out = []
            for conv, part, k, turns, roles, texts, new in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fresh = set(new or ())
                faults = _faults(texts, [i in fresh for i in range(len(texts))])
                steps, known = _steps(roles, faults), [t for t in turns if t is not None]
                found = ((a, b, cheapest(steps, a, (b,))) for a in range(4) for b in range(4))
                out.append({"conv": conv, "part": part, "k": k, "counts": list(_counts(roles, faults).values()), "initials": [r[:1] for r in roles], "turns": [known[0], known[-1], len(set(known))] if known else [], "edges": [{"a": a, "b": b, "cost": x[0], "audit": x[1]} for a, b, x in found if x]})
            edge = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
            yield _batch(out, pa.schema([batch.schema.field(0), ("part", pa.int32()), ("k", pa.int32()), ("counts", pa.list_(pa.int64())), ("initials", pa.list_(pa.string())), ("turns", pa.list_(pa.int64())), ("edges", pa.list_(edge))]))

    each = segments.select("part", "k", F.posexplode(F.arrays_zip("roles", F.transform("texts", lambda t: F.sha2(t, 256)).alias("digests"))).alias("i", "row"), "conv")
    firsts = each.groupBy("conv", F.col("row.roles").alias("role"), F.col("row.digests").alias("digest")).agg(F.min(F.struct("part", "k", "i")).alias("at"))
    new = firsts.groupBy(F.col("at.part").alias("part"), F.col("at.k").alias("k")).agg(F.collect_list("at.i").alias("new"))
    return segments.join(new, ["part", "k"], "left").select("conv", "part", "k", "turns", "roles", "texts", "new").mapInArrow(run, f"conv {kind}, part int, k int, counts array<long>, initials array<string>, turns array<long>, edges array<struct<a: int, b: int, cost: long, audit: string>>")


def _combined(conv, parts: list[dict]) -> dict:
    """One conversation of its segments in order: what is reported, and the edits of each segment with the state before it."""
    ends = tuple(map(STATES.index, LEGAL_ENDS))
    cost, audit = cheapest([[(e["a"], e["b"], e["cost"], e["audit"]) for e in p["edges"]] for p in parts], 0, ends, ())
    totals = [sum(x) for x in zip(*(p["counts"] for p in parts), strict=True)]
    joints = [p["initials"] for p in parts if p["initials"]]
    totals[3] += sum((a[-1], b[0]) not in KEEPS or not a[-1] for a, b in zip(joints, joints[1:], strict=False))
    turns = [p["turns"] for p in parts if p["turns"]]
    distinct = sum(t[2] for t in turns) - sum(a[1] == b[0] for a, b in zip(turns, turns[1:], strict=False))
    pieces, at, state = [], 0, ""
    for i, p in enumerate(parts):
        began, before, read = at, state, 0
        while at < len(audit) and (read < len(p["initials"]) or i == len(parts) - 1):
            letter = audit[at]
            state = p["initials"][read] if letter == "K" else state if letter == "D" else TURN[state]
            read += letter != "I"
            at += 1
        pieces.append({"part": p["part"], "k": p["k"], "state": before, "edits": audit[began:at]})
    return {"conv": conv, "gaps": turns[-1][1] - turns[0][0] + 1 - distinct if turns else 0, **dict(zip(("blank", "duplicate", "truncated", "illegal"), totals, strict=True)), "cost": cost, "audit": audit, "pieces": pieces}


def _settled(segments: DataFrame, kind: str) -> DataFrame:
    """The conversations that lie in segments, repaired."""

    def choose(batches):
        for batch in batches:
            out = [_combined(conv, parts) for conv, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            piece = pa.struct([("part", pa.int32()), ("k", pa.int32()), ("state", pa.string()), ("edits", pa.string())])
            yield _batch(out, pa.schema([batch.schema.field(0), *((c, pa.int64()) for c in _SHOWN[:6]), ("audit", pa.string()), ("pieces", pa.list_(piece))]))

    def write(batches):
        for batch in batches:
            out = []
            for conv, part, k, roles, texts, state, edits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = repaired(roles, texts, edits, state)
                out.append({"conv": conv, "part": part, "k": k, "lines": len(lines), "body": "\n".join(lines)})
            yield _batch(out, pa.schema([batch.schema.field(0), ("part", pa.int32()), ("k", pa.int32()), ("lines", pa.int32()), ("body", pa.string())]))

    def digest(batches):
        conv, sha, any_, began = None, None, False, False
        for batch in batches:
            out = []
            for c, n, body in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not began or c != conv:
                    if began:
                        out.append({"conv": conv, "sha": sha.hexdigest()})
                    began, conv, sha, any_ = True, c, hashlib.sha256(), False
                if n:
                    sha.update((("\n" if any_ else "") + body).encode())
                    any_ = True
            kind_of = pa.schema([batch.schema.field(0), ("sha", pa.string())])
            yield _batch(out, kind_of)
        if began:
            yield _batch([{"conv": conv, "sha": sha.hexdigest()}], kind_of)

    parts = _transfers(segments, kind).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "k", "counts", "initials", "turns", "edges"))).alias("parts"))
    chosen = materialize(parts.mapInArrow(choose, f"conv {kind}, {_FOUND.removesuffix(', repaired_sha256 string')}, pieces array<struct<part: int, k: int, state: string, edits: string>>"), "turns-chosen")
    edits = chosen.select(F.explode("pieces").alias("p")).select("p.*")
    bodies = segments.join(edits, ["part", "k"]).select("conv", "part", "k", "roles", "texts", "state", "edits").mapInArrow(write, f"conv {kind}, part int, k int, lines int, body string")
    sums = bodies.repartition("conv").sortWithinPartitions("conv", "part", "k").select("conv", "lines", "body").mapInArrow(digest, f"conv {kind}, sha string")
    both = chosen.join(sums.withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of")))
    return both.select("conv", *_SHOWN[:7], F.col("sha").alias("repaired_sha256"))


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None) -> DataFrame:
    """``conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation.

    Rows that are not ``present`` only name their conversation.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))), there.alias("there"))
    order = ["conv", "turn", "role", "text", "row"]
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    run, schema = _folded(kind)
    folded = materialize(ranged.mapInArrow(run, schema), "turns-folded")
    whole = folded.filter("whole").select("conv", *_SHOWN)
    segments = folded.filter("NOT whole").select("conv", "part", "k", "turns", "roles", "texts")
    return whole.union(_settled(segments, kind)).withColumnRenamed("conv", conv_col)


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with a fault in a fourth of the rows, chosen by the checksum of conversation and turn; ``there`` is false for dropped rows."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") != 0).alias("there"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), present=F.col("there"))


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLES: dict[str, str] = {}
