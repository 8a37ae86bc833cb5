"""Exact dedup and packing on small tables and against plain code."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliogrid.llm import exact_dedup as ED
from foliogrid.llm.exact_dedup import drop_exact_copies, exact_dedup
from foliogrid.llm.packing import best_fit_plan, cut_pieces, encoder, default_vocabulary, pack_documents

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "a b", "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "a b", "de", "t", 3), (None, "a b", "en", "s", 3), (None, "lone", "en", "s", 4), (5, "long " * 40_000, "en", "s", 9), (6, "x" * 60 + "1", "en", "s", 9), (7, "x" * 60 + "2", "en", "s", 9), (4, "a b", "de", "t", 3)]


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("hot_rows", [ED.HOT_ROWS, 1])
def test_groups_of_equal_texts(spark, monkeypatch, keep, hot_rows):
    monkeypatch.setattr(ED, "HOT_ROWS", hot_rows)
    got = exact_dedup(spark.createDataFrame(ODD, DOCS), keep=keep).collect()
    groups = defaultdict(list)
    for i, text, *_ in ODD:
        groups[text or ""].append(i)
    best = {t: (max if keep == "max" else min)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    want = Counter((i, best[t], len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame(ODD, DOCS).withColumns({"sha": F.lit(1), "salt": F.lit("x"), "rn": F.lit(2), "kept": F.lit(None).cast("int"), "row": F.lit(0), "length": F.lit("q"), "__key": F.lit(5), "__n": F.lit(6), "whole": F.lit("w")})
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == 6
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}
    assert exact_dedup(docs.limit(0)).count() == 0 and drop_exact_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sampled", [1, ED.SAMPLED])
def test_ranges_of_common_beginnings_and_hot_texts(spark, monkeypatch, sampled):
    monkeypatch.setattr(ED, "HOT_ROWS", 20)
    monkeypatch.setattr(ED, "SAMPLED", sampled)
    rng = random.Random(sampled)
    texts = ["é" * 40 + str(rng.randrange(400)) for _ in range(800)] + ["the same text"] * 900 + [chr(rng.randrange(32, 0x2FFF)) * rng.randrange(4) for _ in range(700)]
    rng.shuffle(texts)
    got = exact_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    last, size = {t: i for i, t in enumerate(texts)}, Counter(texts)
    want = {(i, last[t], size[t], last[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)}
    assert {tuple(r) for r in got} == want and len(got) == len(texts)


def test_splitters_cut_common_beginnings_by_digests_only(spark):
    keys = [("AA/%02d" % i, 5) for i in range(20)] + [("BB/07", 3), ("CC/05", 9), ("DD/01", 1)]
    splitters = ED._splitters(spark.createDataFrame(keys, "key string, n long"), 20)
    assert splitters == sorted(splitters) and sum(k.startswith("AA/") for k in splitters) > 2 and set(splitters) - {k for k, _ in keys} <= {"BB/", "CC/", "DD/"}
    probes = ["", "A", "AA/", "AA/00", "AA/03", "AA/19", "AA/99", "B/", "BB/07", "CC/", "CC/99", "ZZ/"]
    got = spark.createDataFrame([(p,) for p in probes], "p string").select("p", ED._range_of(F.col("p"), splitters).alias("r")).collect()
    assert {r.p: r.r for r in got} == {p: sum(s <= p for s in splitters) for p in probes}


def brute_best_fit(lengths: list[int], window: int) -> int:
    """Windows that best-fit decreasing opens."""
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, room in enumerate(bins) if room >= n]
        if fit:
            i = min(fit, key=lambda k: bins[k])
            bins[i] -= n
        else:
            bins.append(window - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 64), rng.randint(1, 20), 64]) for _ in range(rng.randint(1, 400))]
    plan = best_fit_plan(dict(Counter(lengths)), 64)
    fill, taken = defaultdict(list), Counter()
    for length, first, n, sequence, base in plan:
        assert first == taken[length]
        taken[length] += n
        for k in range(n):
            fill[sequence + k].append((base, length))
    assert taken == Counter(lengths)
    for parts in fill.values():
        at = 0
        for base, length in sorted(parts):
            assert base == at
            at += length
        assert at <= 64
    assert sorted(64 - sum(n for _, n in p) for p in fill.values()) == brute_best_fit(lengths, 64)


def test_pieces_hold_every_token_once(spark):
    docs = spark.createDataFrame([r for r in ODD if r[0] != 4], DOCS).dropDuplicates(["doc_id"])
    rows = pack_documents(docs, window=64).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    encode = encoder(default_vocabulary()).encode_ordinary
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = np.array([*encode(text or ""), 0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert cut_pieces(docs.limit(0)).count() == 0 and pack_documents(docs.limit(0)).count() == 0


def test_ids_are_those_of_the_json_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["", " ", "\n\n\t x", "漢字 🙂", "<|endoftext|>", "don't  1234\u00a0x"]
    assert [encoder(default_vocabulary()).encode_ordinary(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_have_the_ids_of_the_json_tokenizer_as_given(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\n y", "<|endoftext", "a<|endoftext|>'s 12", "plain text", "<|ENDOFTEXT|>"]
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(texts)], DOCS)
    want = {i: np.array([*e.ids, 0], "<u4") for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False))}
    assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in cut_pieces(docs).collect()} == {i: (len(ids), zlib.crc32(ids.tobytes())) for i, ids in want.items()}


def test_packing_of_long_stretches_repeats_nulls_and_clashing_names(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["x" + " " * 1_000_000 + "y", "a" * 100_000, "!" * 100_000, "\n\t " * 100_000 + "<|endoftext|>", "same", "same", None, "漢" * 30_000]
    ids = [0, 1, 2, 3, 4, 4, None, 5]
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in zip(ids, texts, strict=True)], DOCS).withColumns({"start": F.lit("q"), "length": F.lit(1), "sequence_id": F.lit(2), "shard": F.lit(3), "steps": F.lit(4)})
    want = Counter()
    for i, x in zip(ids, texts, strict=True):
        e = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((i, at, len(e[at : at + 1024]), zlib.crc32(e[at : at + 1024].tobytes()), len(e)) for at in range(0, len(e), 1024))
    rows = pack_documents(docs).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in parts) <= 1024 and [o for o, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))])[:-1]) for parts in held.values())
