"""Conversation repair against plain dynamic programming, and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliogrid.llm import conversations as C

KIND = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def legal(initials: str) -> bool:
    return re.fullmatch(r"(s?(ua)+)?", initials) is not None


def brute_audit(roles, faults):
    """Least cost and audit by relaxing labels (cost, edits) of suffixes until nothing changes."""
    n = len(roles)
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    label = {(n, ""): (0, ""), (n, "a"): (0, "")}
    changed = True
    while changed:
        changed = False
        for i in range(n, -1, -1):
            for s in after:
                tries = [(2, "I", (i, after[s]))]
                if i < n:
                    tries.append((3, "D", (i + 1, s)))
                    if faults[i] not in ("blank", "duplicate"):
                        more, r = faults[i] == "truncated", roles[i][:1]
                        tries.append((2 + more, "R", (i + 1, after[s])))
                        if r and (r == after[s] or (r == "s" and s == "")):
                            tries.append((int(more), "K", (i + 1, r)))
                for cost, letter, to in tries:
                    if to in label:
                        new = (label[to][0] + cost, letter + label[to][1])
                        if new < label.get((i, s), (10**9, "")):
                            label[i, s] = new
                            changed = True
    return label[0, ""]


def brute(rows):
    """Everything that is reported of one conversation; rows are (turn, role, text), any of them null."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, r, x in rows:
        bare = x.strip(BLANK)
        faults.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((r, x))
    turns = [t for t, *_ in rows if t is not None]
    cost, audit = brute_audit([r for _, r, _ in rows], faults)
    out, at, state = [], 0, ""
    for letter in audit:
        if letter == "K":
            out.append((rows[at][1], rows[at][2]))
            state = rows[at][1][:1]
        elif letter in "RI":
            state = "a" if state == "u" else "u"
            out.append(("user" if state == "u" else "assistant", rows[at][2] if letter == "R" else ""))
        at += letter != "I"
    assert legal("".join(r[:1] for r, _ in out)) and at == len(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha)


def brute_table(rows):
    by = defaultdict(list)
    for conv, *row in rows:
        by[conv].append(row)
    return {conv: brute(r) for conv, r in by.items()}


def shown(df, conv="conv_id"):
    return {r[conv]: tuple(r)[1:] for r in df.collect()}


def random_rows(rng, convs, most):
    texts = ["Yes.", "No!", "cut off", "Why?", "", " \n", "Yes. \t", "so", None, "é?"]
    return [(c, rng.choice([None, *range(most)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "sys", "Ă"]), rng.choice(texts)) for c in range(convs) for _ in range(rng.randrange(1, most))]


def test_search_against_brute_force():
    rng = random.Random(7)
    for _ in range(400):
        n = rng.randrange(9)
        roles, faults = [rng.choice(["s", "u", "a", "u", "a", "x", ""]) for _ in range(n)], [rng.choice(["", "", "", "truncated", "blank", "duplicate"]) for _ in range(n)]
        assert C.cheapest(C._steps(roles, faults), 0, (0, 3)) == brute_audit(roles, faults)


@pytest.mark.parametrize(("segment", "parts"), [(256, 1), (3, 5), (1, 7)])
def test_conversations_and_segments(spark, monkeypatch, segment, parts):
    monkeypatch.setattr(C, "SEGMENT_ROWS", segment)
    rows = random_rows(random.Random(segment), 40, 12)
    df = spark.createDataFrame(rows, KIND).repartition(parts)
    assert shown(C.repair_conversations(df)) == brute_table(rows)


def test_one_long_conversation_is_spread(spark, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT_ROWS", 16)
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", "c!", "long " * 5000 + "."]) + str(rng.randrange(150)) + ".") for t in range(300)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Hello.")]
    assert shown(C.repair_conversations(spark.createDataFrame(rows, KIND))) == brute_table(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a."), (None, None, None, None), (5, 2**40, "system", "x" * 300_000 + "."), (6, 1, "user", "q?"), (6, 1, "user", "q?"), (7, None, "assistant", "z.")]
    df = spark.createDataFrame(rows, KIND)
    clashing = df.withColumns({c: F.lit(1) for c in ("conv", "whole", "part", "k", "there", "row", "audit", "cost", "pieces")})
    want = brute_table(rows)
    assert shown(C.repair_conversations(clashing)) == want
    named = shown(C.repair_conversations(df.selectExpr("concat('c', conv_id) AS conv_id", "turn", "role", "text")))
    assert named == {None if k is None else f"c{k}": v for k, v in want.items()}
    empty = C.repair_conversations(df.limit(0))
    assert empty.count() == 0 and empty.columns[0] == "conv_id"
    gone = shown(C.repair_conversations(df, present=F.lit(None).cast("boolean")))
    assert set(gone.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and set(gone) == {None, 5, 6, 7}


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def test_query_against_brute_force(spark):
    from tests.conftest import DATA

    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    nothing = brute([])
    want = {c: nothing for c, *_ in rows} | brute_table(brute_damage(rows))
    assert shown(C.op12_conversation_repair(spark, DATA)) == want
