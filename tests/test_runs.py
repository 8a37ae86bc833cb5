"""Masks as runs against plain pixels: sweeps, morphology, labels over strips, running sums; records of regions."""

from __future__ import annotations

import random

import numpy as np
import pytest

from foliogrid.operators import masks as MK
from foliogrid.operators.changes import region_metadata
from foliogrid.operators.selection import case_entries

RUNS = "image_id string, y long, x0 long, x1 long"
H, WIDTH = 23, 17


def masks(seed: int, share: float = 0.5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {f"m/{i}": rng.random((H, WIDTH)) < share for i in range(3)}
    return {**out, "m/full": np.ones((H, WIDTH), bool), "m/dot": np.arange(H * WIDTH).reshape(H, WIDTH) == 40}


def pixels(spark, images):
    rows = [(i, int(y), int(x)) for i, m in images.items() for y, x in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(rows, "image_id string, y long, x long")


def painted(df, images) -> dict[str, np.ndarray]:
    out = {i: np.zeros((H, WIDTH), bool) for i in images}
    for r in df.collect():
        assert not out[r.image_id][r.y, r.x]
        out[r.image_id][r.y, r.x] = True
    return out


def near(m: np.ndarray, offsets, combine, outside: bool) -> np.ndarray:
    """Combines the kernel's neighbours of each pixel; those outside the canvas count as ``outside``."""
    out = np.zeros_like(m)
    for y in range(H):
        for x in range(WIDTH):
            out[y, x] = combine(m[y + dy, x + dx] if 0 <= y + dy < H and 0 <= x + dx < WIDTH else outside for dy, dx in offsets)
    return out


@pytest.mark.parametrize(("shape", "size"), [("rect", 5), ("cross", 3), ("ellipse", 5)])
def test_morphology_of_runs(spark, shape, size):
    images, offsets = masks(size, 0.7), MK.kernel(shape, size)
    df = pixels(spark, images)
    grown, shrunk = painted(MK.dilate(df, shape, size, 2, WIDTH, H), images), painted(MK.erode(df, shape, size, 1, WIDTH, H), images)
    for i, m in images.items():
        assert (grown[i] == near(near(m, offsets, any, False), offsets, any, False)).all()
        assert (shrunk[i] == near(m, offsets, all, True)).all()


def test_overlapping_runs_are_merged_and_compared(spark):
    rng = random.Random(1)
    make = lambda: [(f"m/{rng.randrange(2)}", rng.randrange(3), a := rng.randrange(30), a + rng.randrange(6)) for _ in range(60)]
    left, right = make(), make()
    ink = lambda runs: {(i, y, x) for i, y, a, b in runs for x in range(a, b)}
    merged = [tuple(r) for r in MK.merge_runs(spark.createDataFrame(left, RUNS)).collect()]
    assert sum(b - a for *_, a, b in merged) == len(ink(left)) and ink(merged) == ink(left)
    assert not any(m[:2] == n[:2] and m != n and m[2] <= n[3] and n[2] <= m[3] for m in merged for n in merged)
    both = {r.image_id: r.tp for r in MK.overlap_runs(spark.createDataFrame(left, RUNS), spark.createDataFrame(right, RUNS)).collect()}
    common = ink(left) & ink(right)
    assert both == {i: sum(p[0] == i for p in common) for i in {p[0] for p in common}}
    assert MK.overlap_runs(spark.createDataFrame(left, RUNS), spark.createDataFrame([], RUNS)).count() == 0


@pytest.mark.parametrize("strip", [1, 4, 64])
def test_labels_over_strips(spark, strip):
    images = masks(strip, 0.35)
    spiral = np.zeros((H, WIDTH), bool)
    spiral[::2] = True
    spiral[1::4, -1] = spiral[3::4, 0] = True
    images["m/snake"] = spiral
    got = MK.label_runs(MK.to_runs(pixels(spark, images)), strip).collect()
    for i, m in images.items():
        label, todo = np.zeros((H, WIDTH), int), list(zip(*np.nonzero(m), strict=True))
        for start in todo:
            if label[start]:
                continue
            label[start], stack = start[0] * (1 << 31) + start[1] + 1, [start]
            while stack:
                y, x = stack.pop()
                for v in range(max(0, y - 1), min(H, y + 2)):
                    for u in range(max(0, x - 1), min(WIDTH, x + 2)):
                        if m[v, u] and not label[v, u]:
                            label[v, u] = label[start]
                            stack.append((v, u))
        for r in (r for r in got if r.image_id == i):
            assert (label[r.y, r.x0 : r.x1] == r.label + 1).all()
        assert sum(r.x1 - r.x0 for r in got if r.image_id == i) == m.sum()


@pytest.mark.parametrize("block", [3, 7, 41])
def test_box_means_of_any_block(spark, block):
    m = np.random.default_rng(block).integers(0, 256, (H, WIDTH))
    df = spark.createDataFrame([("a", y, x, int(m[y, x])) for y in range(H) for x in range(WIDTH)], "image_id string, y long, x long, v int")
    r = block // 2
    padded = np.pad(m, r, mode="edge").astype(float)
    want = np.array([[padded[y : y + block, x : x + block].mean() for x in range(WIDTH)] for y in range(H)])
    got = MK.local_mean(df, block).collect()
    assert len(got) == m.size and all(q.mean == pytest.approx(want[q.y, q.x]) for q in got)


def test_landing_counts_ink_near_ink(spark):
    new, old = masks(11, 0.2), masks(12, 0.02)
    del old["m/0"]
    got = {r.image_id: r.landed for r in MK.landing(pixels(spark, new), pixels(spark, old), 1, WIDTH, H).collect()}
    square = MK.kernel("rect", 3)
    want = {i: (near(old[i], square, any, False) & m).sum() / m.sum() if i in old else 0.0 for i, m in new.items()}
    assert got == pytest.approx(want)


def test_records_keep_nulls_of_a_stage_and_default_without_it(spark):
    regions = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "region long, kind string")
    ocr = spark.createDataFrame([(1, "text", "ok", None), (2, None, "failed", "broken")], "region long, text string, status string, error string")
    said = spark.createDataFrame([(1, "said", "ok")], "region long, translated_text string, status string")
    drawn = spark.createDataFrame([], "region long, render_status string, line_count int")
    got = {r.region: r for r in region_metadata(regions, ["region"], ocr=ocr, translation=said, render=drawn).collect()}
    assert (got[1].ocr_text, got[1].ocr_status, got[1].ocr_error, got[1].manually_edited, got[1].translation) == ("text", "ok", None, None, "said")
    assert (got[2].ocr_text, got[2].ocr_status, got[2].ocr_error, got[2].translation_status, got[2].translation) == (None, "failed", "broken", "skipped", "")
    assert (got[3].ocr_text, got[3].ocr_status, got[3].manually_edited, got[3].render_status, got[3].line_count) == ("", "failed", False, "skipped", 0)


def test_cases_of_many_equal_scores(spark):
    rng = random.Random(6)
    pages = [(m, f"p{i:03}", rng.choice([0.1, 0.5, 0.5, 0.9])) for m in ("a", "b") for i in range(41)] + [("c", "one", 0.3)]
    failures = spark.createDataFrame([("a", "p003")], "method string, image_id string")
    got = {(r.method, r.image_id, r.case_kind, r["rank"]) for r in case_entries(spark.createDataFrame(pages, "method string, image_id string, f1 double").repartition(5), failures, 3).collect()}
    want = {("a", "p003", "failure", None)}
    for m in "abc":
        order = sorted((-f, i) for n, i, f in pages if n == m and (n, i) != ("a", "p003"))
        middle = max((len(order) - 3) // 2, 0)
        want |= {(m, i, "good" if k <= 3 else "average", k) for k, (_, i) in enumerate(order, 1) if k <= 3 or middle < k <= middle + 3}
    assert got == want
