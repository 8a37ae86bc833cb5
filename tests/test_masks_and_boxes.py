"""Masks, boxes, graphs and morphology against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliogrid.operators import masks as MK
from foliogrid.operators import spatial as SP
from foliogrid.operators.graph import connected_components
from foliogrid.operators.metrics import confusion_of_runs

BOXES = "page long, label long, x long, y long, w long, h long, area long"


def pixels(spark, images: dict[str, np.ndarray]):
    rows = [(k, int(y), int(x), int(m[y, x])) for k, m in images.items() for y in range(m.shape[0]) for x in range(m.shape[1])]
    return spark.createDataFrame(rows, "image_id string, y int, x int, v int")


def as_array(df, shape, value="v"):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r["y"], r["x"]] = r[value] if value else 1
    return out


def test_components_of_a_long_chain_cycle_and_loop(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (502, 500), (900, 900), (500, 501), (None, 3)]
    random.Random(3).shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "l long, r long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500, 502: 500, 900: 900}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "l long, r long")).count() == 0


def test_runs_there_and_back_and_confusion(spark):
    rng = np.random.default_rng(5)
    g, p = ({f"m/{i}": rng.integers(0, 2, (9, 13)) * 255 for i in range(3)} for _ in range(2))
    g["m/9"] = p["m/9"] = np.zeros((2, 2), int)
    gi, pi = (pixels(spark, m).filter("v = 255").select("image_id", "y", "x") for m in (g, p))
    runs = MK.to_runs(gi)
    assert sorted(map(tuple, MK.from_runs(runs).select("image_id", "y", "x").collect())) == sorted(map(tuple, gi.collect()))
    got = {r.image_id: (r.tp, r.fp, r.fn) for r in confusion_of_runs(pixels(spark, g), runs, MK.to_runs(pi)).collect()}
    assert got == {k: (int(((g[k] > 0) & (p[k] > 0)).sum()), int(((g[k] == 0) & (p[k] > 0)).sum()), int(((g[k] > 0) & (p[k] == 0)).sum())) for k in g}


def flood(mask):
    seen, areas = set(), []
    for y0, x0 in zip(*np.nonzero(mask), strict=True):
        if (y0, x0) in seen:
            continue
        todo, n = [(y0, x0)], 0
        seen.add((y0, x0))
        while todo:
            y, x = todo.pop()
            n += 1
            for v, u in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and mask[v, u] and (v, u) not in seen:
                    seen.add((v, u))
                    todo.append((v, u))
        areas.append(n)
    return sorted(areas)


def test_labels_are_eight_connected(spark):
    m = (np.random.default_rng(2).random((14, 17)) < 0.35).astype(int) * 255
    stats = MK.component_stats(MK.label_runs(MK.to_runs(pixels(spark, {"a/b": m}).filter("v = 255"))))
    assert sorted(r.area for r in stats.collect()) == flood(m)


def test_otsu_and_kmeans(spark):
    m = np.array([[10] * 6 + [200] * 2, [12] * 6 + [210] * 2])
    p = pixels(spark, {"a/b": m, "a/flat": np.full((2, 2), 7)})
    t = {r.image_id: r.threshold for r in MK.otsu(p).collect()}
    assert t["a/b"] == 12 and t["a/flat"] == 7
    k = {r.image_id: r for r in MK.kmeans2(p).collect()}
    assert (k["a/b"].c0, k["a/b"].c1, k["a/b"].n0, k["a/b"].n1, k["a/b"].foreground) == (11.0, 205.0, 12, 4, 1)
    assert k["a/flat"].foreground is None
    assert (as_array(MK.normalise_mask(p).filter("image_id = 'a/b'"), m.shape) == np.where(m > 100, 255, 0)).all()


def test_local_threshold_repeats_edges(spark):
    m = np.random.default_rng(1).integers(0, 255, (7, 9))
    wide = np.pad(m, 2, mode="edge")
    for gaussian in (False, True):
        w = np.array(MK._weights(5, gaussian))
        mean = np.array([[(wide[y : y + 5, x : x + 5] * np.outer(w, w)).sum() for x in range(9)] for y in range(7)])
        got = as_array(MK.local_mean(pixels(spark, {"a/b": m}), 5, gaussian), m.shape, None) * 0
        rows = MK.local_mean(pixels(spark, {"a/b": m}), 5, gaussian).collect()
        assert max(abs(r["mean"] - mean[r["y"], r["x"]]) for r in rows) < 1e-9 and got.shape == m.shape
    with pytest.raises(ValueError):
        MK.adaptive_threshold(pixels(spark, {"a/b": m}), 4, 1)


def test_denoise_median(spark):
    m = np.random.default_rng(4).integers(0, 255, (6, 5))
    wide = np.pad(m, 1, mode="edge")
    want = np.array([[int(np.median(wide[y : y + 3, x : x + 3])) for x in range(5)] for y in range(6)])
    assert (as_array(MK.denoise(pixels(spark, {"a/b": m}), "median"), m.shape) == want).all()


@pytest.mark.parametrize("shape", ["rect", "cross", "ellipse"])
def test_dilate_and_erode(spark, shape):
    m = (np.random.default_rng(6).random((8, 9)) < 0.4).astype(int)
    ink = pixels(spark, {"a/b": m}).filter("v = 1").select("image_id", "y", "x")
    offsets = MK.kernel(shape, 3)
    inside = lambda y, x: 0 <= y < 8 and 0 <= x < 9
    grown = np.array([[any(inside(y + a, x + b) and m[y + a, x + b] for a, b in offsets) for x in range(9)] for y in range(8)]).astype(int)
    shrunk = np.array([[all(not inside(y + a, x + b) or m[y + a, x + b] for a, b in offsets) for x in range(9)] for y in range(8)]).astype(int)
    assert (as_array(MK.dilate(ink, shape, 3, 1, 9, 8), m.shape, None) == grown).all()
    assert (as_array(MK.erode(ink, shape, 3, 1, 9, 8), m.shape, None) == shrunk).all()
    assert MK.dilate(ink, shape, 3, 0, 9, 8).count() == ink.count()
    with pytest.raises(ValueError):
        MK.dilate(ink, shape, None, 1, 9, 8)


def block(label, x, y, w, h, page=1):
    return (page, label, x, y, w, h, w * h)


def test_two_blocks_merge_only_within_the_distance(spark):
    boxes = spark.createDataFrame([block(1, 300, 300, 30, 30), block(2, 335, 300, 30, 30)], BOXES)
    for distance, want in ((0, [(300, 300, 30, 30, 1), (335, 300, 30, 30, 1)]), (5, [(300, 300, 30, 30, 1), (335, 300, 30, 30, 1)]), (6, [(300, 300, 65, 30, 2)])):
        regions, outcomes = SP.extract_regions(boxes, boxes, 1, 400000, distance)
        assert sorted((r.x, r.y, r.w, r.h, r.merged_from) for r in regions.collect()) == want
        assert outcomes.first().outcome == "ok"


def test_area_bounds_are_inclusive_and_outcomes_told(spark):
    boxes = spark.createDataFrame([block(1, 300, 200, 600, 200), block(2, 1200, 800, 300, 100), block(1, 0, 0, 2, 2, 2)], BOXES)
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page long")
    reasons = lambda lo, hi: [r.reason for r in SP.filter_components(boxes, lo, hi).orderBy("page", "label").collect()]
    assert reasons(30000, 120000)[:2] == [None, None]
    assert reasons(30001, 400000)[:2] == [None, "below_min_area"]
    assert reasons(1, 50000)[:2] == ["above_max_area", None]
    _, outcomes = SP.extract_regions(boxes, pages, 5, 400000, 0)
    assert {r.page: r.outcome for r in outcomes.collect()} == {1: "ok", 2: "no_text_region_detected", 3: "empty_mask"}


@pytest.mark.parametrize("distance", [1, 9, 40])
def test_grid_join_finds_all_near_pairs(spark, distance):
    rng = random.Random(distance)
    rows = [(p, i, rng.randrange(-50, 300), rng.randrange(-50, 300), rng.randrange(1, 90), rng.randrange(1, 40), 1) for p in (1, 2) for i in range(25)]
    got = {tuple(r) for r in SP.near_pairs(spark.createDataFrame(rows, BOXES), distance, cell=32).collect()}
    gap = lambda a, aw, b, bw: max(a - (b + bw), b - (a + aw), 0)
    want = {(l[0], l[1], r[1]) for l in rows for r in rows if l[0] == r[0] and l[1] < r[1] and gap(l[2], l[4], r[2], r[4]) < distance and gap(l[3], l[5], r[3], r[5]) < distance}
    assert got == want


def test_partitioning_does_not_change_groups(spark):
    rng = random.Random(1)
    boxes = spark.createDataFrame([(1, i, rng.randrange(400), rng.randrange(400), 20, 10, 200) for i in range(60)], BOXES)
    one = lambda df: sorted((r.label, r.grp) for r in SP.page_groups(df, SP.near_pairs(df, 15)).collect())
    assert one(boxes.repartition(1)) == one(boxes.repartition(13)) == one(boxes.orderBy(F.desc("label")))


def test_large_pages_get_the_groups_of_small_ones(spark):
    rng = random.Random(2)
    boxes = spark.createDataFrame([(p, i, rng.randrange(400), rng.randrange(400), 20, 10, 200) for p in (1, 2) for i in range(60)], BOXES)
    pairs = SP.near_pairs(boxes, 25)
    one = lambda most: sorted((r.page, r.label, r.grp) for r in SP.page_groups(boxes, pairs, most).collect())
    assert one(0) == one(10_000)
    assert len({g for p, _, g in one(0) if p == 1}) < 60


def test_sweep_counts_false_regions(spark):
    rows = [(1, 0, 0, 0, 10, 10, 100, 0), (1, 1, 15, 0, 10, 10, 100, 50), (2, 0, 0, 0, 10, 10, 30, 0)]
    boxes = spark.createDataFrame(rows, BOXES + ", true_area long")
    grid = spark.createDataFrame([("a", 0, 0), ("b", 50, 8), ("none", 1000, 8)], "config string, min_area int, distance int")
    got = {r.config: (r.regions, r.false_regions, r.true_regions, r.median_box) for r in SP.region_sweep(boxes, grid).collect()}
    assert got == {"a": (3, 2, 1, 100.0), "b": (1, 0, 1, 250.0)}
