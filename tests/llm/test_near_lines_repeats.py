"""Near-dedup, line dedup, repeat removal and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from foliogrid.llm import line_dedup as LD
from foliogrid.llm import near_dedup as ND
from foliogrid.llm import repeats as RP

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))], DOCS)


def shingles(text: str | None, k: int) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute_components(texts: dict, k: int, percent: int) -> dict:
    sets, root = {i: shingles(t, k) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_texts(rng, n=120):
    vocabulary = [f"v{i}" for i in range(3000)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 90))] for _ in range(12)]
    out = []
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            words = words[: rng.randint(1, len(words))]
        out.append("\t ".join(w.upper() if rng.random() < 0.1 else w for w in words))
    return out


@pytest.mark.parametrize(("k", "seed"), [(2, 1), (5, 2)])
def test_components_equal_brute_force(spark, k, seed):
    texts = near_texts(random.Random(seed)) + ["", " \n", None, "one", "ONE", "one two", "Ä one", "ä one", "long words " * 30_000]
    ids = list(range(100, 100 + len(texts)))
    random.Random(seed).shuffle(ids)
    docs = frame(spark, texts, ids).withColumns({"n": F.lit("x"), "sig": F.lit(1), "id": F.lit(2), "key": F.lit(3), "kept": F.lit("k")})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ND.near_components(docs, k).collect()}
    want = brute_components(dict(zip(ids, texts, strict=True)), k, 80)
    assert got == want
    kept = ND.drop_near_copies(docs, shingle=k)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, (_, c) in want.items() if c == i}


def test_repeated_and_null_identifiers(spark):
    docs = frame(spark, ["a b c d", "a b c d", "a b c d", "x y z", None], [7, 7, None, None, 3])
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in ND.near_components(docs, 2).collect())
    assert got == [(-1, 2, -1, True), (-1, 3, -1, True), (3, 0, 3, True), (7, 3, 7, True), (7, 3, 7, True)]
    assert ND.near_components(docs.limit(0), 2).count() == 0


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(70)]
    texts = []
    for _ in range(400):
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(70)] = f"r{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ND.near_components(frame(spark, texts), 2).collect()}
    assert got == brute_components(dict(enumerate(texts)), 2, 80)


def brute_lines(rows: list[tuple[int, str | None]], percent=80):
    """Removed line numbers by place of the row, rows in order of identifier and input."""
    seen, out = [], {}
    for at, (_, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0], x[0])):
        gone = []
        for number, line in enumerate((text or "").encode().lower().split(b"\n")):
            s = frozenset(line.split())
            if s and any(100 * len(s & o) >= percent * len(s | o) for o in seen):
                gone.append(number)
            if s:
                seen.append(s)
        out[at] = gone
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 25))] for _ in range(40)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append(" ".join(words).upper() if rng.random() < 0.1 else " ".join(words))
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "a b c d e f " * 9000, "a b c d e f"]
    rows = list(enumerate(texts))
    docs = frame(spark, texts).coalesce(1).withColumns({"h": F.lit(1), "row": F.lit("r"), "line": F.lit(2), "token": F.lit("t")})
    want = brute_lines(rows)
    report = LD.line_report(docs)
    got = {r.doc_id: r.removed_lines for r in report.collect()}
    assert got == {i: ",".join(map(str, g)) for i, g in want.items()}
    cleaned = {r.doc_id: r.text for r in LD.without_lines(docs, report).select("doc_id", "text").collect()}
    assert all((cleaned[i] or "") == "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in want[i]) for i, t in rows)


@pytest.mark.parametrize(("scan", "tries", "most_rows", "hot"), [(4096, 16, 1 << 20, 81), (2, 1, 1 << 20, 81), (4096, 16, 8, 81), (4096, 2, 1 << 20, 1)])
def test_lines_whose_words_are_in_parts(spark, monkeypatch, scan, tries, most_rows, hot):
    rng = random.Random(scan + hot)
    base = [f"w{i}" for i in range(20)]
    texts = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(20)] = f"x{rng.randrange(40)}"
        texts.append(" ".join(words) + ("\n" + " ".join(rng.sample(base, 4)) if i % 3 else ""))
    monkeypatch.setattr(LD, "ROWS", 50)
    monkeypatch.setattr(LD, "VERIFIED", min(tries, 3))
    monkeypatch.setattr(LD, "HOT_CLASS", hot)
    monkeypatch.setattr(LD.earlier_candidates, "__defaults__", (scan, tries, most_rows))
    ids = [None if i == 7 else 500 - i for i in range(len(texts))]
    got = {r.doc_id: r.removed_lines for r in LD.line_report(frame(spark, texts, ids)).collect()}
    assert got == {ids[k]: ",".join(map(str, g)) for k, g in brute_lines(list(zip(ids, texts, strict=True))).items()}
    # identifiers of another type sort as Spark sorts them
    named = frame(spark, texts, ids).withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 5, "0"))
    assert {r.doc_id and int(r.doc_id): r.removed_lines for r in LD.line_report(named).collect()} == got


def test_a_repeated_row_is_later_and_nothing_gives_nothing(spark):
    docs = frame(spark, ["a b\nc", "a b\nc", "c"], [1, 1, None]).coalesce(1)
    assert sorted((r.doc_id or 0, r.n_lines, r.n_removed, r.removed_lines) for r in LD.line_report(docs).collect()) == [(0, 1, 0, ""), (1, 2, 1, "1"), (1, 2, 2, "0,1")]
    assert LD.line_report(docs.limit(0)).count() == 0


def brute_repeats(rows: list[tuple[int | None, str | None]], length: int):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 2, int)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s + 1 : s + length + 1] = 1
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone[1:], strict=False) if not g)
        out.append((i, len(raw), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "batches", "chunk"), [(1, 4, 1 << 21), (2, 1, 700), (3, 6, 1 << 21)])
def test_repeats_equal_brute_force(spark, seed, batches, chunk):
    rng = random.Random(seed)
    letters = "abcdé漢 "
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(20, 300))) for _ in range(8)]
    rows = []
    for i in range(70):
        text = "".join(rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(rng.randint(0, 6)))
        rows.append((i if rng.random() < 0.95 else None, text))
    rows += [(200, None), (201, ""), (202, "x" * 99), (203, "ab" * 900), (204, "Der " * 400), (205, "x" * 100)]
    nulls = [r for r in rows if r[0] is None]
    rows = [r for r in rows if r[0] is not None] + nulls[:1]
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows]).withColumns({"id": F.lit(1), "row": F.lit(2), "g": F.lit("g"), "body": F.lit("b")})
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in RP.remove_repeats(docs, batches=batches, chunk=chunk).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == brute_repeats(rows, 100)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("foliogrid_level")]


@pytest.mark.parametrize("module", [LD, RP])
def test_rows_keep_their_numbers_when_files_are_split_anew(spark, monkeypatch, tmp_path, module):
    rng, write, splits = random.Random(4), module.materialize, "spark.sql.files.minPartitionNum"
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(30)]
    texts = ["\n".join(line + f" x{i}" for line in rng.sample(lines, 3)) for i in range(40)]
    frame(spark, texts).repartition(10, "doc_id").write.parquet(str(tmp_path / "docs"))

    def other_splits_after(*args):
        out = write(*args)
        spark.conf.set(splits, "1")
        return out

    monkeypatch.setattr(module, "materialize", other_splits_after)
    spark.conf.set(splits, "16")
    try:
        docs = spark.read.parquet(str(tmp_path / "docs"))
        if module is LD:
            assert {r.doc_id: r.removed_lines for r in LD.line_report(docs).collect()} == {i: ",".join(map(str, g)) for i, g in brute_lines(list(enumerate(texts))).items()}
        else:
            assert sorted(tuple(r) for r in RP.remove_repeats(docs).collect()) == brute_repeats(list(enumerate(texts)), 100)
    finally:
        spark.conf.unset(splits)


def test_repeats_of_repeated_rows_and_of_nothing(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdef") for _ in range(150))
    docs = frame(spark, [text, text], [4, 4]).coalesce(1)
    assert sorted(r.n_removed for r in RP.remove_repeats(docs).collect()) == [0, 150]
    assert RP.remove_repeats(docs.limit(0)).count() == 0


def test_levels_merge_geometrically(spark):
    rngs = [random.Random(k) for k in range(6)]
    text = lambda k: "".join(rngs[k].choice("abcdefgh") for _ in range(400))
    family, sizes = RP.LevelFamily(spark), []
    for k in range(6):
        docs = frame(spark, [""], [k]).select(F.col("doc_id").alias("id"), F.lit(k).cast("long").alias("row"), F.lit(zstandard.compress(text(k).encode())).alias("body"))
        family.settle()
        family.insert(RP.suffix_entries(docs, 100, 24))
        sizes.append([s for s, _ in family.levels])
    family.settle()
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1], [4, 1, 1]] and [s for s, _ in family.levels] == [4, 2]
    family.drop()


def test_pipeline_stages_hold_their_own_contracts(spark):
    import corpus_pipeline as CP

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for _, stage in CP.STAGES[:-1]:
        out = stage(spark, seen[-1], sf).cache()
        assert out.columns == docs.columns
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in seen[-1].select("doc_id").collect()}
        seen.append(out)
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen]
    groups = defaultdict(list)
    for i, t in texts[1].items():
        groups[t].append(i)
    assert set(texts[2]) == {max(g) for g in groups.values()}
    near = brute_components(texts[2], 5, 80)
    assert set(texts[3]) == {i for i, (_, c) in near.items() if i == c}
    from tests.llm.test_scans import brute_overlaps, words_of

    items = [words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {i for i, t in texts[3].items() if any(brute_overlaps(words_of(t), it) is not None for it in items)}
    assert set(texts[4]) == set(texts[3]) - dirty
    pieces = CP.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in pieces} == set(texts[4]) and all(r.n == r.m for r in pieces)


def test_wide_marks_are_parities_of_long_sets():
    from foliogrid.llm import line_dedup as L

    words = np.random.default_rng(7).integers(0, 1 << 62, 300, np.uint64)
    sizes = np.array([60, 3, 0, 237])
    columns = [c.to_pylist() for c in L.LineSets(np.zeros(0, np.uint8), 80).wide_marks(sizes, words)]
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i, n in enumerate(sizes.tolist()):
        marks = 0
        for w in words[at[i] : at[i + 1]].tolist():
            marks ^= 1 << (w % (64 * L.WIDE))
        told = [c[i] for c in columns]
        assert told == [None] * L.WIDE if n < L.WIDE_FROM else sum((t % (1 << 64)) << (64 * k) for k, t in enumerate(told)) == marks


def test_identifiers_that_repeat_with_other_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, b), (5, a), (5, b), (5, a), (9, a.replace("a7 ", "zz ")), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "digest", "sig", "component", "id")})
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in ND.near_components(docs, 2).collect())
    assert got == {(3, 39, 3, True): 1, (5, 39, 5, True): 2, (5, 39, 3, False): 1, (9, 39, 5, False): 1, (None, 39, None, True): 1}
    kept = ND.drop_near_copies(docs, shingle=2)
    assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == {(3, b): 1, (5, a): 2, (None, a): 1}
    named = ND.near_components(docs.selectExpr("concat('d', doc_id) AS doc_id", "text"), 2).collect()
    assert {(r.doc_id, r.component_id) for r in named} == {("d3", "d3"), ("d5", "d5"), ("d5", "d3"), ("d9", "d5"), (None, None)}


def test_word_counts_travel_in_parts_of_the_sketch(spark):
    """A task gives one row for each part of the sketch, not one for each word; the classes are those of plain counts."""
    from foliogrid.llm import setjoin as SJ
    from foliogrid.llm.words import word_hashes

    rng = random.Random(12)
    texts = [" ".join(f"w{min(rng.randrange(6000), rng.randrange(6000))}" for _ in range(3000)) for _ in range(8)] + [None, ""]
    counts = LD.word_counts(frame(spark, texts).coalesce(2), "text")
    assert 0 < counts.count() <= 2 * 256
    tokens = [(int(h) & ((1 << SJ.SKETCH_BITS) - 1), 1) for h in word_hashes([t.encode() for t in texts if t])[0]]
    want = SJ.rarity_sketch(spark.createDataFrame(tokens, "token long, n long")).value
    assert want.any() and (SJ.packed_sketch(counts).value == want).all()
    assert not SJ.packed_sketch(counts.limit(0)).value.any()


def test_report_reads_documents_and_lines_that_go_only(spark):
    """The lines are not shuffled again to be counted; lines and report tell the same."""
    texts = ["a b c d e f\nx\nA b c d e f", "a b c d e f g\n\na b c d e f", None, "x\nx"]
    docs = frame(spark, texts)
    report = LD.line_report(docs)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.removed_lines) for r in report.collect()} == {0: (3, 1, "2"), 1: (3, 2, "0,2"), 2: (1, 0, ""), 3: (2, 2, "0,1")}
    removed = {(r.id, r.line) for r in LD.similar_lines(docs).filter("removed").collect()}
    assert removed == {(r.doc_id, int(k)) for r in report.collect() for k in r.removed_lines.split(",") if k}
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(n_lines" in plan


def test_likeliest_pairs_of_a_set(spark):
    pairs = [(1, 5, 40, False), (1, 5, 40, False), (1, 6, 60, True), (2, 7, 80, False), (2, 7, 80, False), (2, 8, 70, False), (3, 3, 101, True)] + [(4, k, 51 + k, False) for k in range(10, 30)]
    got = {(r.l, r.r, r.more) for r in LD.picked(spark.createDataFrame(pairs, "l long, r long, apart int, more boolean")).collect()}
    assert got == {(1, 5, True), (2, 7, False), (2, 8, False), (3, 3, True)} | {(4, k, True) for k in range(10, 10 + LD.VERIFIED)}


def test_order_of_word_rows():
    rng = np.random.default_rng(5)
    for low, high in ((0, 9), (-(2**63), 2**63 - 1)):
        g, ranks, number = np.sort(rng.integers(-4, 4, 200)), rng.integers(low, high, 200), rng.permutation(200)
        assert LD._word_order(g, ranks, number).tolist() == np.lexsort((number, ranks, g)).tolist()
        assert LD._word_order(g, ranks, np.arange(200)).tolist() == np.lexsort((np.arange(200), ranks, g)).tolist()


def test_lines_by_shuffled_lookups_only(spark, monkeypatch):
    """What is left to all earlier sets goes by the likeliest first where it is not small."""
    from foliogrid.llm import common

    for module in (LD, common):
        monkeypatch.setattr(module, "is_small", lambda *_: False)
    monkeypatch.setattr(LD.earlier_candidates, "__defaults__", (1, 1, 8))
    monkeypatch.setattr(LD, "VERIFIED", 1)
    rng = random.Random(31)
    base = [[f"w{rng.randrange(60)}" for _ in range(14)] for _ in range(4)]
    texts = ["\n".join(" ".join(w if rng.random() < 0.92 else f"w{rng.randrange(60)}" for w in rng.choice(base)) for _ in range(4)) for _ in range(25)]
    got = {r.doc_id: r.removed_lines for r in LD.line_report(frame(spark, texts)).collect()}
    assert got == {i: ",".join(map(str, g)) for i, g in brute_lines(list(enumerate(texts))).items()}
