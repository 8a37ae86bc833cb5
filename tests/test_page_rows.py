"""Pages that are one row against pages spread over the cluster; failing rows of batches; closed runs."""

from __future__ import annotations

import random
from functools import partial

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from foliogrid.functions.storage import intermediates
from foliogrid.operators import ledger as L
from foliogrid.operators import merging as MG
from foliogrid.operators import pages as PG
from foliogrid.operators import plugins as P
from foliogrid.operators import spatial as SP
from tests.conftest import DATA
from tests.test_merging import BOXES, brute_groups, random_boxes, rule


def rows_of(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.fixture(scope="module")
def boxes(spark):
    rows = random_boxes(random.Random(3), 14, 12) + [(100 + p, *r) for p, *r in random_boxes(random.Random(4), 2, 50)]
    return spark.createDataFrame(rows, BOXES)


NEAR = {
    "links": lambda b, most: SP.near_links(b, 8, most), "groups": lambda b, most: SP.near_groups(b, 8, most), "regions": lambda b, most: SP.near_regions(b, 8, most),
    "spanning": lambda b, most: SP.near_spanning_links(b, 8, most), "report": lambda b, most: SP.near_chain_report(b, 8, most),
    "edges": lambda b, most: SP.near_chain_edges(b, 8, 10_000, most), "inside": lambda b, most: SP.components_in_regions(b, 5, 120, 8, most=most),
}


@pytest.mark.parametrize("name", NEAR)
def test_pages_in_a_row_and_spread_pages_agree(spark, boxes, name):
    in_rows, spread = NEAR[name](boxes, 64), NEAR[name](boxes, 1)
    want = rows_of(spread)
    assert want and rows_of(in_rows) == want and rows_of(NEAR[name](boxes, 12)) == want
    assert in_rows.columns == spread.columns


def test_pages_keep_every_box(spark):
    rows = [(p, i, i, 0, 1, 1, 1) for p, n in ((1, 3), (2, 4), (3, 5), (None, 2), (None, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, BOXES)
    pages = PG.by_page(df, most=4)
    assert {(r.page, len(r.boxes)) for r in pages.few.collect()} == {(1, 3), (2, 4)} and pages.many.count() == 10
    assert SP.near_groups(df.limit(0), 3).count() == 0
    # boxes without a page are never near
    assert rows_of(SP.near_groups(df.filter("page IS NULL AND label < 2").distinct(), 3).select("label", "grp")) == [(0, 0), (1, 1)]


GATES = {
    "all": ((None, MG.GroupGate()), lambda a, b, h, v: True, lambda box, ink, own: True),
    "axis": ((SP.axis_overlap_gate, MG.GroupGate(min_fill=0.3)), lambda a, b, h, v: h == 0 or v == 0, lambda box, ink, own: ink / box >= 0.3),
    "rule": ((partial(SP.not_rule_gate, 3, 20), MG.GroupGate(min_box_fill=0.5)), lambda a, b, h, v: not rule(a) and not rule(b), lambda box, ink, own: own / box >= 0.5),
    "grow": ((None, MG.GroupGate(max_growth=1.5)), lambda a, b, h, v: True, lambda box, ink, own: box <= 1.5 * own),
}


@pytest.mark.parametrize("most", [1, 10, 64])
def test_folds_of_page_rows_against_plain_union(spark, most):
    rows = random_boxes(random.Random(most), 14, 24, 60)
    got = MG.gated_groups(spark.createDataFrame(rows, BOXES), 8, {n: v for n, (v, _, _) in GATES.items()}, most).collect()
    for name, (_, pair, group) in GATES.items():
        assert {(r.page, r.label): r.grp for r in got if r.variant == name} == brute_groups(rows, 8, pair, group)[0], name
    assert len(got) == len(GATES) * len(rows)
    reports = [rows_of(MG.merge_report(spark.createDataFrame(rows, BOXES), 8, 3600, most=m)) for m in (1, most)]
    assert reports[0] == reports[1]


@pytest.mark.parametrize("name", ["grf1_components", "agg12_merge_regions", "grf4_extract_regions", "grf5_gated_groups", "grf6_spanning_links", "grf6_chain_edges", "grf6_chain_report", "jn11_components_in_box"])
def test_small_pages_are_shuffled_once(spark, name):
    """All that follows the one table of pages is told without another shuffle."""
    plan = __spark_entry__.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "pages-" in plan


@pytest.mark.parametrize("name", ["agg20_region_sweep", "grf6_spanning_links", "grf6_chain_report", "jn11_components_in_box", "agg12_merge_regions"])
def test_boxes_are_dealt_by_page_once(spark, monkeypatch, name):
    """The table of pages comes from one shuffle: boxes numbered by page are not dealt by page again."""
    laid, write = [], PG.materialize
    monkeypatch.setattr(PG, "materialize", lambda df, label: laid.append(df) or write(df, label))
    __spark_entry__.queries()[name](spark, DATA)
    assert [df._jdf.queryExecution().executedPlan().toString().count("Exchange ") for df in laid] == [1]


def test_sweep_reads_one_table_of_small_rows(spark):
    with intermediates(spark):
        grid = spark.createDataFrame([("a", 1, 0), ("b", 4, 8)], "config string, min_area int, distance int")
        rows = random_boxes(random.Random(8), 9, 20)
        df = spark.createDataFrame(rows, BOXES).withColumn("true_area", F.col("area") % 2)
        got = {r.config: r.regions for r in SP.region_sweep(df, grid).collect()}
        groups = {k: v for k, v in brute_groups([r for r in rows if r[6] >= 4], 8, lambda *x: True, lambda *x: True)[0].items()}
    assert got == {"a": len(rows), "b": len({(page, g) for (page, _), g in groups.items()})}


def test_isolated_makes_few_frames(spark, monkeypatch):
    """Pieces of a batch are put together once: whole numbers stay exact, and rows keep their order and errors."""
    asked = []

    def odd(rows: pd.DataFrame) -> pd.DataFrame:
        if (rows["v"] % 7 == 0).any():
            raise ValueError("seven")
        return rows.assign(q=rows["v"], b=rows["v"] % 2 == 0, s="x")

    base = 2**53 + 1
    df = spark.createDataFrame([(i, base + i) for i in range(500)], "id long, v long").coalesce(1)
    got = P.isolated(df, odd, "q long, b boolean, s string", "id", batched=True).collect()
    want = [(i, None, None, None, "failed", "ValueError: seven") if (base + i) % 7 == 0 else (i, base + i, (base + i) % 2 == 0, "x", "ok", None) for i in range(500)]
    assert [tuple(r) for r in got] == want and not asked
    made = P._laid([pd.DataFrame({"q": [base]}), pd.DataFrame({"q": [base + 2]})], [[0], [2]], ["q"], 3)
    assert made["q"].tolist()[::2] == [base, base + 2] and pd.isna(made["q"][1])


def test_closed_runs_on_odd_rows(spark, tmp_path):
    table = "l_orderkey long, l_partkey long, l_returnflag string, l_quantity double, l_linestatus string"
    rows = [(1, 1, "A", 5.0, "F"), (1, 2, "N", 1.0, "F"), (1, 2, "N", 1.0, "O"), (2, 1, "A", 11.0, "F"), (3, 1, None, None, "F"), (4, None, "N", 1.0, "O"), (None, 4, "N", 1.0, "F"), (5, 5, "N", 2.0, None), (5, 5, "R", 2.0, "F")]
    spark.createDataFrame(rows, table).write.parquet(str(tmp_path / "lineitem.parquet"))
    sql = __spark_entry__.oracle_sql()["run12_close"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    key = lambda r: tuple((x is None, x) for x in r)
    df = __spark_entry__.queries()["run12_close"](spark, str(tmp_path))
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(duckdb.sql(sql).fetchall(), key=key)
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_partitions_follow_the_rows(spark):
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert L.parts(spark.range(1000), 100) == max(10, at_least) and L.parts(spark.range(0)) == at_least
