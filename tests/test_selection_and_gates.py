"""Selection, gates, ledgers, edits and enrichment against literal expectations."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliogrid.operators import catalog as C
from foliogrid.operators import changes as CH
from foliogrid.operators import gates as G
from foliogrid.operators import ledger as L
from foliogrid.operators import metrics as M
from foliogrid.operators import plugins as P
from foliogrid.operators import selection as SEL

COLS = "method string, image_id string, iou double, f1 double, fp long, fn long"


def metrics(spark, scores, method="a"):
    return spark.createDataFrame([(method, f"m/{i:03d}", s, s, i, -i) for i, s in enumerate(scores)], COLS)


def picked(df):
    return [r.image_id for r in df.orderBy("method", "rank").collect()]


def test_three_tie_rules(spark):
    m = metrics(spark, [0.5] * 4)
    assert picked(SEL.select_samples(m, "highest_iou_f1", 2)) == ["m/000", "m/001"]
    assert picked(SEL.select_pages(m, "best", 2)) == ["m/003", "m/002"]
    assert picked(SEL.select_pages(m, "worst", 2)) == ["m/000", "m/001"]


def test_shortfall_manual_flags_and_refusals(spark):
    m = metrics(spark, [0.1, 0.9, 0.4])
    flags = spark.createDataFrame([(0, "m/002"), (1, "x/y"), (2, "m/002"), (3, "m/000")], "pos int, image_id string")
    got = SEL.select_samples(m, "manual", 5, flags)
    assert picked(got) == ["m/002", "x/y", "m/000"]
    assert SEL.shortfall(m, got, 5).first().shortfall == 2
    assert SEL.shortfall(m, SEL.select_samples(m, "lowest_iou_f1", 0), 0).first().asDict() == {"method": "a", "selected": 0, "shortfall": 0}
    for rule, n in (("odd", 1), ("manual", -1)):
        with pytest.raises(ValueError):
            SEL.select_samples(m, rule, n, flags)


def test_cases_do_not_repeat_a_page(spark):
    m = metrics(spark, [0.9, 0.8, 0.7, 0.6])
    failures = spark.createDataFrame([("a", "m/001")], "method string, image_id string")
    rows = {(r.image_id, r.case_kind) for r in SEL.case_entries(m, failures, 2).collect()}
    assert rows == {("m/000", "good"), ("m/002", "good"), ("m/001", "failure")}
    rows = {(r.image_id, r.case_kind) for r in SEL.case_entries(m, failures.limit(0), 1).collect()}
    assert rows == {("m/000", "good"), ("m/001", "average")}


def test_comparison_keeps_awaited_methods_null(spark):
    m = spark.createDataFrame([("a", "m/0", 0.48, 0.5, 0.5, 0.5, 1.0), ("a", "m/1", 0.52, 0.5, 0.5, 0.5, 3.0)], "method string, image_id string, iou double, precision double, recall double, f1 double, inference_time_seconds double")
    failures = spark.createDataFrame([("a", "m/1"), ("a", "z/9")], "method string, image_id string")
    got = {r.method: r for r in M.compare(m, failures, spark.createDataFrame([("b", "late")], "method string, reason string")).collect()}
    assert (round(got["a"].iou_mean, 9), round(got["a"].iou_std, 9), got["a"].success, got["a"].failed) == (0.5, 0.02, 1, 1)
    assert got["b"].status == "not_run" and got["b"].iou_mean is None and got["b"].reason == "late"
    assert M.summarize(m.limit(1)).first().std_iou == 0.0


def test_first_failing_check_decides(spark):
    df = spark.createDataFrame([("h1", "p1", 1, 0), ("h1", "p2", 0, 1), ("h2", "p3", 0, 0)], "handoff string, page string, a int, b int")
    rules = [G.Rule("first", F.col("b") > 0, "b is set"), G.Rule("second", F.col("a") > 0, "a is set")]
    got = {r.handoff: (r.verdict, r.check_no, r.page) for r in G.receipt(df, rules, "handoff", "page").collect()}
    assert got == {"h1": ("refused", 1, "p2"), "h2": ("admitted", None, None)}
    assert [r.category for r in G.intake(df, rules).orderBy("page").collect()] == ["second", "first", None]


def test_threshold_is_verified_or_recovered(spark):
    rows = [("ok", 0.3, True), ("ok", 0.1, False), ("moved", 0.5, True), ("moved", 0.4, False), ("full", 0.1, True), ("mixed", 0.1, True), ("mixed", 0.9, False)]
    got = {r.image_id: (r.outcome, r.cut) for r in G.verify_threshold(spark.createDataFrame(rows, "image_id string, p double, inside boolean"), 0.235).collect()}
    assert got == {"ok": ("reproduced", 0.235), "moved": ("recovered", pytest.approx(0.45)), "full": ("unrecoverable", None), "mixed": ("inconsistent", None)}


def test_fold_entitlement(spark):
    folds = spark.createDataFrame([("ARMS", 2)], "manga string, fold int")
    rows = [("ARMS", "fold_2"), ("ARMS", "fold_1"), ("ARMS", None), ("Other", "fold_2")]
    got = [r.verdict for r in C.check_folds(spark.createDataFrame(rows, "manga string, fold_attribution string"), folds).orderBy("manga", F.desc_nulls_last("fold_attribution")).collect()]
    assert got == ["ok", "wrong_fold", "unreadable_fold", "unknown_book"]


def test_requirements(spark):
    lines = spark.createDataFrame([("Torch==1.4.0",), ("numpy == 2.3.5 # pin",), ("free>=1",), ("gone==1",)], "line string")
    installed = spark.createDataFrame([("torch", "2.0"), ("numpy", "2.3.5")], "name string, version string")
    assert {(r.name, r.conflict) for r in G.requirement_conflicts(lines, installed).collect()} == {("torch", "different"), ("gone", "missing")}


def test_edits_invalidation_and_status(spark):
    edits = spark.createDataFrame([(1, 1, "old", False), (1, 2, "new", False), (1, 3, "void", True), (2, 1, "  ", False)], "region int, seq int, edited string, invalidated boolean")
    ocr = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "region int, text string")
    stale = spark.createDataFrame([(4,)], "region int")
    got = {r.region: (r.text, r.status, r.manually_edited) for r in CH.apply_edits(ocr, edits, stale).collect()}
    assert got == {1: ("new", "ok", True), 2: ("  ", "empty", True), 3: ("c", "ok", False)}


def test_reextraction_flags_edits_of_changed_regions_only(spark):
    sig = "region int, signature string, state string"
    old, new = (spark.createDataFrame(r, sig) for r in ([(1, "a", "done"), (2, "b", "done"), (3, "c", "done")], [(1, "x", ""), (2, "b", ""), (4, "d", "")]))
    edits = spark.createDataFrame([(1, False), (2, False)], "region int, invalidated boolean")
    got = {r.region: (r.state, r.stale_edits) for r in CH.reextract(old, new, edits).collect()}
    assert got == {1: ("pending", 1), 2: ("done", 0), 3: ("removed", 0), 4: ("pending", 0)}


@pytest.mark.parametrize(("policy", "failed"), [("keep_ocr_text", ("c", "failed")), ("exclude", ("", "skipped"))])
def test_enrichment_asks_each_miss_once(spark, policy, failed):
    rows = [(1, "a", "ok", "ka", False), (2, "b", "ok", "kb", False), (3, "b", "ok", "kb", False), (4, "c", "ok", "kc", False), (5, " ", "empty", "ke", False), (6, "a", "ok", "ka", True)]
    requests = spark.createDataFrame(rows, "region int, text string, status string, cache_key string, bypass boolean")
    cache = spark.createDataFrame([("ka", "A")], "cache_key string, translated string")
    asked = []

    def provider(df):
        asked.append(sorted(r.cache_key for r in df.collect()))
        return df.select("cache_key", F.when(F.col("text") != "c", F.upper("text")).alias("answer"))

    got = {r.region: (r.result, r.result_status, r.cache_status) for r in CH.enrich(requests, cache, provider, policy).collect()}
    assert asked == [["ka", "kb", "kc"]]
    assert got == {1: ("A", "ok", "hit"), 2: ("B", "ok", "miss"), 3: ("B", "ok", "miss"), 4: (*failed, "miss"), 5: ("", "skipped", "none"), 6: ("A", "ok", "miss")}


def test_failures_never_enter_the_cache(spark):
    results = spark.createDataFrame([("k1", 2, "late", "ok"), ("k1", 1, "first", "ok"), ("k2", 1, "x", "failed"), ("k3", 1, "has s3cret", "ok"), ("k0", 1, "again", "ok")], "cache_key string, seq int, result string, result_status string")
    cache = spark.createDataFrame([("k0", "kept")], "cache_key string, translated string")
    assert sorted(map(tuple, CH.cache_append(results, cache, "s3cret").collect())) == [("k0", "kept"), ("k1", "first")]


def test_ledger_report_is_dense_and_verdicts_keep_order(spark):
    errors = spark.createDataFrame([("c1", "m/0"), ("c1", "m/0")], "category string, image_id string")
    dim = spark.createDataFrame([("c0",), ("c1",)], "category string")
    assert sorted(map(tuple, L.error_report(errors, dim).collect())) == [("c0", 0, 0), ("c1", 2, 1)]
    checks = spark.createDataFrame([("x", 2, "b", False), ("x", 1, "a", False), ("x", 3, "c", True), ("y", 1, "d", True)], "subject string, ord int, reason string, ok boolean")
    assert {r.subject: (r.verdict, r.reason) for r in L.verdict_rollup(checks).collect()} == {"x": ("unavailable", "a; b"), "y": ("available", "")}


def test_table_identity_moves_with_any_row(spark):
    df = spark.createDataFrame([("r", i, str(i)) for i in range(9)], "run string, pos int, v string")
    one = lambda d: L.table_identity(d, ["pos"], ["pos", "v"], ["run"]).first().identity
    assert one(df) == one(df.repartition(5))
    assert len({one(df), one(df.filter("pos <> 4")), one(df.withColumn("v", F.when(F.col("pos") == 4, "x").otherwise(F.col("v"))))}) == 3


def test_registry_and_isolation(spark):
    P.register_method("t-double", lambda d: d.withColumn("v", F.col("v") * 2))
    assert "t-double" in P.available()
    for bad in (lambda: P.create("none"), lambda: P.register_method("t-double", None)):
        with pytest.raises(ValueError):
            bad()
    df = spark.createDataFrame([(1, 4), (2, 0)], "id int, v int")
    assert [r.v for r in P.compose(["t-double", lambda d: d.filter("v > 0")])(df).collect()] == [8]
    got = {r.id: (r.q, r.status, (r.error or "")[:17]) for r in P.isolated(df, lambda p: p.assign(q=8 // int(p["v"].iloc[0])), "q long", "id").collect()}
    assert got == {1: (2, "ok", ""), 2: (None, "failed", "ZeroDivisionError")}


def test_batches_are_halved_down_to_the_rows_at_fault(spark):
    def tenth(rows):
        if (rows["v"] == 0).any():
            raise ValueError("zero")
        return rows.assign(q=rows["v"] * 10)

    df = spark.createDataFrame([(i, i % 7) for i in range(40)], "id int, v int").coalesce(1)
    got = {r.id: (r.q, r.status) for r in P.isolated(df, tenth, "q long", "id", batched=True).collect()}
    assert got == {i: (None, "failed") if i % 7 == 0 else (i % 7 * 10, "ok") for i in range(40)}


def test_a_crop_whose_recogniser_raises_is_a_failed_row(spark):
    crops = spark.createDataFrame([("a", "x"), ("b", ""), ("c", "　")], "region string, payload string")

    def read(p):
        if not p:
            raise ValueError("no crop")
        return p, float("inf")

    got = {r.region: (r.text, r.confidence, r.status, r.error) for r in P.recognise(crops, read).collect()}
    assert got == {"a": ("x", None, "ok", None), "b": (None, None, "failed", "ValueError: no crop"), "c": ("　", None, "empty", None)}
