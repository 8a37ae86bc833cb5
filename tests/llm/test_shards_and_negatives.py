"""Sharding and hard negatives against plain code, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliogrid.llm import hard_negatives as H
from foliogrid.llm import sharding as S
from tests.conftest import DATA

DOCS = "doc_id long, text string, lang string"


def wait(key, shard, weight):
    draw = int(hashlib.md5(f"{key}/{shard}".encode()).hexdigest()[:13], 16)
    return -math.log((draw + 0.5) / 16**13) / weight


def winner(key, weights):
    return min((i for i, w in enumerate(weights) if w > 0), key=lambda i: (wait(key, i, weights[i]), i))


@pytest.mark.parametrize("weights", [[1.0] * 6, [3.0, 1.0, 0.0, 0.5]])
def test_shards_and_slots(spark, weights):
    rows = [(i, f"t{i % 7}é" * (i % 50), "en") for i in range(400)] + [(7, "again", "de"), (7, None, None), (None, "x", "en"), (None, "y", "en"), (None, None, None)]
    got = S.assign_shards(spark.createDataFrame(rows, DOCS).repartition(5), weights).collect()
    want = Counter()
    for i, text, _ in rows:
        raw = (text or "").encode()
        key = str(i) if i is not None else f"text:{hashlib.md5(raw).hexdigest()}"
        shard = winner(key, weights)
        want[i, len(raw) + 16, zlib.crc32(raw), "key", shard, winner(key, [*weights, 1.0])] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, len(weights))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 2 not in slots or weights[2] > 0


def test_weights_are_shares(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'' AS text")
    got = Counter(r.shard for r in S.assign_shards(docs, [1.0, 2.0, 5.0]).collect())
    assert all(abs(got[i] / 20_000 - w / 8) < 0.015 for i, w in enumerate([1, 2, 5]))


def test_sharding_of_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "en"), (None, None, None), (1, "long " * 200_000, "de")], DOCS)
    clashing = docs.withColumns({c: F.lit(c) for c in ("id", "key", "shard", "slot", "at", "range", "row", "won", "size")})
    assert S.assign_shards(clashing, [1.0, 1.0]).count() == 3
    assert S.assign_shards(docs.limit(0), [1.0]).count() == 0
    named = S.assign_shards(docs.selectExpr("concat('d', doc_id) AS doc_id", "text"), [1.0] * 9).collect()
    assert {r.shard for r in named if r.doc_id == "d1"} == {winner("d1", [1.0] * 9)}
    with pytest.raises(ValueError):
        S.assign_shards(docs, [0.0])
    S.write_shards(clashing, str(tmp_path / "out"), [1.0] * 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(clashing.columns) < set(back.columns) and back.count() == 3


@pytest.mark.parametrize(("width", "most"), [(64, 300), (3000, 40), (5, 2**28), (1, 2**29), (2500, 2**24)])
def test_products_are_exact(width, most):
    rng = np.random.default_rng(width)
    a, b = rng.integers(-most, most + 1, (9, width)), rng.integers(-most, most + 1, (11, width))
    a[0], b[0], b[1] = most, most, -most
    primes = H.moduli(width * most * most)
    got = H.exact_scores(H.residues(a, primes), H.residues(b, primes), primes)
    want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    assert got.tolist() == want and math.prod(primes) > 2 * width * most * most


def brute_negatives(rows, k=5):
    """Rows are (vec_id, vector, label), as the query sees them before labels move."""
    known = []
    for place, (i, vector, label) in enumerate(rows):
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            known.append((i, [math.floor(256 * float(x)) for x in vector], (label + 1) % 10 if i is not None and i % 7 == 0 else label, place))
    out = []
    for a, qa, la, pa_ in known:
        if a is None or a % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(qa, q, strict=False)), i is None, i or 0, p, label) for i, q, label, p in known if p != pa_))
        for s, no_p, p, *_ in [x for x in scored if x[4] == la][:k]:
            fits = [x for x in scored if x[4] != la and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a, None if no_p else p, rank, None if x[1] else x[2], -s, -x[0]) for rank, x in enumerate(fits, 1)]
    return Counter(out)


def shown(df):
    return Counter(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


VECTORS = "vec_id long, embedding array<float>, label int"


def mined(spark, rows):
    df = spark.createDataFrame(rows, VECTORS)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return H.mine_hard_negatives(df.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@pytest.mark.parametrize("blocks", [(32 << 20, 8 << 20), (400, 100)])
def test_negatives_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(H, "ROW_BYTES", blocks[0])
    monkeypatch.setattr(H, "ANCHOR_BYTES", blocks[1])
    monkeypatch.setattr(H, "ROW_STEP", 7)
    rng = random.Random(5)
    make = lambda: [round(rng.gauss(0.3, 0.4), 2) for _ in range(4)]
    rows = [(i * 20, make(), rng.randrange(3)) for i in range(120)]
    rows += [(i * 20 + 1, [0.5, 0.5, 0.5, 0.5], 1 + i % 2) for i in range(30)]  # ties
    rows += [(200, None, 1), (300, [1.0, None], 1), (400, [float("nan")], 2), (500, [float("inf")], 2), (600, [0.1], None), (700, [], 1), (800, [0.9, 0.9], 2), (900, [9.0] * 9, 1), (None, [0.4] * 4, 1), (1, [-0.5] * 4, 7)]
    rows += [(1000, [0.7] * 4, 2), (1000, [0.7] * 4, 2)]  # repeated rows
    assert shown(mined(spark, rows)) == brute_negatives(rows)


def test_negatives_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert H.mine_hard_negatives(empty, F.col("vec_id") % 100 == 0).count() == 0
    rows = [(i, [0.5, i / 50], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    clashing = df.withColumns({c: F.lit(1) for c in ("id", "row", "q", "anchor", "g", "h", "k", "score", "rank")})
    named = H.mine_hard_negatives(clashing.selectExpr("*", "concat('v', vec_id) AS name", "concat('l', label) AS kind"), F.col("vec_id") == 0, id_col="name", label_col="kind")
    plain = H.mine_hard_negatives(df, F.col("vec_id") == 0)
    assert plain.count() == named.count() > 0
    assert {r.positive_score for r in plain.collect()} == {r.positive_score for r in named.collect()}
    with pytest.raises(ValueError):
        H.mine_hard_negatives(spark.createDataFrame([(0, [1e30], 1)], VECTORS), F.lit(True))


def test_query_of_negatives(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert shown(H.op13_hard_negatives(spark, DATA)) == brute_negatives(rows)


def test_matrix_of_ragged_lists():
    lists = pa.chunked_array([pa.array([[1, 2], [], [3]], pa.list_(pa.int16())), pa.array([[4, 5, 6]], pa.list_(pa.int16()))])
    assert H._matrix(lists, 3).tolist() == [[1, 2, 0], [0, 0, 0], [3, 0, 0], [4, 5, 6]]
