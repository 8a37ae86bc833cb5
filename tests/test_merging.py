"""Gated merging, spanning forests, ranks and quantiles against plain code."""

from __future__ import annotations

import random
from collections import defaultdict
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliogrid.functions.storage import intermediates, materialize
from foliogrid.operators import merging as MG
from foliogrid.operators import spatial as SP
from foliogrid.operators.graph import connected_components, spanning_forest
from foliogrid.operators.ranks import exact_quantiles, running_sums, wide_quantiles

BOXES = "page long, label long, x long, y long, w long, h long, area long"


def random_boxes(rng, pages, most, spread=90):
    out = []
    for page in range(pages):
        for label in range(1, rng.randrange(1, most) + 1):
            w, h = rng.choice([(3, 40), (40, 2), (rng.randrange(1, 15), rng.randrange(1, 15))])
            out.append((page, label, rng.randrange(spread), rng.randrange(spread), w, h, rng.randrange(1, w * h + 1)))
    return out


def gaps(a, b):
    return max(a[0] - b[0] - b[2], b[0] - a[0] - a[2], 0), max(a[1] - b[1] - b[3], b[1] - a[1] - a[3], 0)


def brute_groups(rows, distance, pair, group):
    """Groups by plain union in order of the links, and the links that joined two."""
    pages = defaultdict(dict)
    for page, label, x, y, w, h, area in rows:
        pages[page][label] = (x, y, w, h, area)
    found, took = {}, set()
    for page, boxes in pages.items():
        grp = {i: i for i in boxes}
        for a in sorted(boxes):
            for b in sorted(i for i in boxes if i > a):
                h, v = gaps(boxes[a], boxes[b])
                if grp[a] == grp[b] or h >= distance or v >= distance or not pair(boxes[a], boxes[b], h, v):
                    continue
                both = [boxes[i] for i in boxes if grp[i] in (grp[a], grp[b])]
                box = (max(m[0] + m[2] for m in both) - min(m[0] for m in both)) * (max(m[1] + m[3] for m in both) - min(m[1] for m in both))
                if group(max(1, box), sum(m[4] for m in both), sum(m[2] * m[3] for m in both)):
                    lo, hi = sorted((grp[a], grp[b]))
                    grp = {i: lo if g == hi else g for i, g in grp.items()}
                    took.add((page, a, b))
        found |= {(page, i): g for i, g in grp.items()}
    return found, took


def rule(b):
    return min(b[2], b[3]) <= 3 and max(b[2], b[3]) >= 20


CASES = {
    "all": ((None, MG.GroupGate()), lambda a, b, h, v: True, lambda box, ink, own: True),
    "axis": ((SP.axis_overlap_gate, MG.GroupGate(min_fill=0.3)), lambda a, b, h, v: h == 0 or v == 0, lambda box, ink, own: ink / box >= 0.3),
    "rule": ((lambda: SP.not_rule_gate(3, 20), MG.GroupGate(min_box_fill=0.5)), lambda a, b, h, v: not rule(a) and not rule(b), lambda box, ink, own: own / box >= 0.5),
    "hub": ((lambda: SP.not_hub_gate(5), MG.GroupGate()), lambda a, b, h, v: all(max(q[2:4]) / max(1, min(q[2:4])) <= 5 for q in (a, b)), lambda box, ink, own: True),
    "grow": ((None, MG.GroupGate(max_growth=1.5)), lambda a, b, h, v: True, lambda box, ink, own: box <= 1.5 * own),
}


@pytest.mark.parametrize("most", [9, 60])
def test_gated_groups_against_plain_union(spark, most):
    rows = random_boxes(random.Random(most), 12, most)
    df = spark.createDataFrame(rows, BOXES)
    got = MG.gated_groups(df, 8, {n: (gate and gate(), group) for n, ((gate, group), _, _) in CASES.items()}).collect()
    for name, (_, pair, group) in CASES.items():
        want, _ = brute_groups(rows, 8, pair, group)
        assert {(r.page, r.label): r.grp for r in got if r.variant == name} == want, name
    assert len(got) == len(CASES) * len(rows)


def test_thin_and_long_is_a_rule_but_small_is_not(spark):
    rows = [(1, 1, 0, 0, 2, 2, 4), (1, 2, 4, 0, 9, 9, 60), (1, 3, 0, 12, 30, 2, 50)]
    df = spark.createDataFrame(rows, BOXES)
    assert [tuple(r) for r in SP.near_pairs(df, 8, gate=SP.not_rule_gate(3, 20)).collect()] == [(1, 1, 2)]


def test_spanning_links_are_those_that_join(spark):
    rows = random_boxes(random.Random(2), 8, 25)
    pairs = SP.near_pairs(spark.createDataFrame(rows, BOXES), 8)
    _, took = brute_groups(rows, 8, lambda *x: True, lambda *x: True)
    assert {tuple(r) for r in SP.spanning_links(pairs).collect()} == took


def test_forest_of_a_hub_a_chain_and_loops(spark):
    edges = [(0, i, 5) for i in range(1, 60)] + [(i, i + 1, 1) for i in range(1, 40)] + [(100 + i, 101 + i, i % 3) for i in range(50)] + [(7, 7, 0), (None, 3, 0), (3, 7, 9), (7, 3, 9)]
    df = spark.createDataFrame(edges, "l long, r long, cost int")
    parent, want = {}, 0

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b, c in sorted((e for e in edges if e[0] is not None), key=lambda e: (e[2], min(e[:2]), max(e[:2]))):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            want += c
    got = spanning_forest(df, order=["cost"]).collect()
    assert sum(r.cost for r in got) == want and len(got) == len({x for e in edges[:-4] for x in e[:2]}) - 2
    assert spanning_forest(df.limit(0)).count() == 0
    assert connected_components(spark.createDataFrame(got, df.schema)).select("component").distinct().count() == 2


def test_chain_edges_of_one_page(spark):
    rows = [(1, 1, 0, 0, 10, 10, 90), (1, 2, 12, 0, 10, 10, 80), (1, 3, 24, 0, 10, 10, 70), (1, 4, 12, 14, 40, 2, 60), (1, 5, 80, 80, 5, 5, 9), (2, 1, 0, 0, 4, 4, 2)]
    df = spark.createDataFrame(rows, BOXES)
    got = {r.page: r for r in SP.chain_edges(df, SP.near_pairs(df, 8), 10_000).collect()}
    assert (got[1].grp, got[1].members, got[1].edges, got[1].hub, got[1].hub_degree) == (1, 4, 3, 1, 2)
    assert got[1].box_share == pytest.approx(52 * 16 / 10_000) and got[1].v_max == 4 and got[1].diagonal == 1
    assert (got[2].members, got[2].edges, got[2].hub, got[2].hub_degree, got[2].h_median) == (1, 0, None, 0, None)


@pytest.mark.parametrize("parts", [1, 6])
def test_quantiles_and_running_sums(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.choice([None, 3.0, 3.0, round(rng.gauss(0, 5), 1)]), rng.randrange(5)) for _ in range(3000)] + [("one", 4.0, 1), ("none", None, None)]
    df = spark.createDataFrame(rows, "k string, v double, w int").repartition(parts)
    got = {(r.k, r.feature): r for r in exact_quantiles(df, ["k"], {"v": F.col("v"), "w": F.col("w")}, (0.0, 0.1, 0.5, 0.95, 1.0)).collect()}
    for key in {r[0] for r in rows}:
        for feature, i in (("v", 1), ("w", 2)):
            values = [r[i] for r in rows if r[0] == key and r[i] is not None]
            if not values:
                assert (key, feature) not in got
                continue
            one = got[key, feature]
            assert [one.p0, one.p10, one.p50, one.p95, one.p100] == pytest.approx([float(x) for x in np.quantile(values, [0, 0.1, 0.5, 0.95, 1])])
    wide = {r.k: r.median_v for r in wide_quantiles(df, ["k"], {"v": F.col("v")}, {"median": 0.5}, "{point}_{feature}").collect()}
    assert wide["one"] == 4.0 and "none" not in wide
    counts = df.filter("v IS NOT NULL").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("s"))
    for r in running_sums(counts, ["k"], ["v"], ["n", "s"]).collect():
        before = [x for x in rows if x[0] == r.k and x[1] is not None and x[1] < r.v]
        assert (r.before_n, r.before_s) == (len(before), sum(x[2] for x in before))


def test_tables_of_a_scope_are_deleted(spark, tmp_path):
    df = spark.createDataFrame([("a", float(i)) for i in range(9)], "k string, v double")
    outer = materialize(df, "outer")
    with intermediates(spark):
        inner = materialize(df, "inner")
        exact_quantiles(df, ["k"], {"v": F.col("v")}, (0.5,)).write.parquet(str(tmp_path / "q"))
        with intermediates(spark):
            lost = materialize(df, "lost")
        files = inner.inputFiles()
        assert inner.count() == 9 and not [f for f in lost.inputFiles() if Path(urlparse(f).path).exists()]
    assert spark.read.parquet(str(tmp_path / "q")).first().p50 == 4.0 and outer.count() == 9
    assert files and not [f for f in files if Path(urlparse(f).path).exists()]
