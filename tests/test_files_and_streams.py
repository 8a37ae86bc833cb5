"""Sources, sinks and streams on temporary folders."""

from __future__ import annotations

import json
import struct
import zlib
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliogrid.operators.changes import cache_append
from foliogrid.operators.gates import Rule
from foliogrid.sources import admission as ADM
from foliogrid.sources import files, sinks
from foliogrid.streaming import incremental as ST


def png(rows: list[list[int]]) -> bytes:
    """An 8-bit grey PNG."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + chunk(b"IEND", b"")


def test_discovery_is_two_levels_deep_and_ordered(spark, tmp_path):
    for name in ("B/002.PNG", "A/001.png", "A/notes.txt", "A/deep/003.png", "top.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [(r.manga, r.stem, r.ext) for r in files.discover(spark, str(tmp_path)).collect()] == [("A", "001", ".png"), ("B", "002", ".PNG")]
    assert files.discover(spark, str(tmp_path / "none")).count() == 0


def test_images_become_pixels_and_corrupt_files_stay(spark, tmp_path):
    (tmp_path / "A").mkdir()
    (tmp_path / "A/1.png").write_bytes(png([[0, 255, 7], [1, 2, 3]]))
    (tmp_path / "A/2.png").write_bytes(b"broken")
    images = files.read_images(spark, str(tmp_path / "A"))
    assert {(r.stem, r.corrupt) for r in images.collect()} == {("1", False), ("2", True)}
    got = sorted((r.y, r.x, r.v) for r in files.to_pixels(images).collect())
    assert got == [(0, 0, 0), (0, 1, 255), (0, 2, 7), (1, 0, 1), (1, 1, 2), (1, 2, 3)]


def test_metrics_keep_zero_padded_stems(spark, tmp_path):
    df = spark.createDataFrame([("A", "007", "otsu", 0.5, 0.5, 0.5, 0.5, 1, 2, 3, 0.1)], files.METRICS)
    sinks.write_table(df, str(tmp_path / "m"), df.columns, ["manga", "stem"])
    assert files.read_metrics(spark, str(tmp_path / "m")).first() == df.first()


def test_sidecars_failures_and_identity(spark, tmp_path):
    (tmp_path / "s/A").mkdir(parents=True)
    (tmp_path / "s/A/1.json").write_text(json.dumps({"method": "x", "device": {"type": "cpu"}}))
    (tmp_path / "s/A/2.json").write_text("{not json")
    schema = T.StructType([T.StructField("method", T.StringType()), T.StructField("device", T.StructType([T.StructField("type", T.StringType())]))])
    got = {r.image_id: (r.method, r._corrupt_record is None) for r in files.read_sidecars(spark, str(tmp_path / "s/*"), schema).collect()}
    assert got == {"A/1": ("x", True), "A/2": (None, False)}
    for method, doc in (("a", [{"image_id": "A/1", "error": "e"}]), ("b", {"errors": [{"image_id": "A/2", "stage": "s"}]}), ("c", {"errors": None})):
        (tmp_path / f"f/{method}").mkdir(parents=True)
        (tmp_path / f"f/{method}/errors.json").write_text(json.dumps(doc))
    assert sorted((r.method, r.image_id, r.error, r.stage) for r in files.read_failures(spark, str(tmp_path / "f/*")).collect()) == [("a", "A/1", "e", None), ("b", "A/2", None, "s")]
    (tmp_path / "i.json").write_text(json.dumps({"A/1": {"sha256": "00", "size_bytes": 3}}))
    assert tuple(files.read_identity(spark, str(tmp_path / "i.json")).first()) == ("A/1", "00", 3)


def test_runs_are_not_overwritten_and_bundles_verified(spark, tmp_path):
    df = spark.range(3).select(F.col("id").cast("string").alias("image_id"))
    sinks.write_run(df, str(tmp_path), "r1")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_run(df, str(tmp_path), "r1")
    sinks.write_run(df.limit(1), str(tmp_path), "r1", overwrite=True)
    with pytest.raises(ValueError):
        sinks.write_run(df, str(tmp_path), "../x")
    schema = "image_id string, sha256 string"
    found = sinks.verify_bundle(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], schema), spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], schema))
    assert {(r.image_id, r.finding) for r in found.collect()} == {("b", "altered"), ("c", "missing"), ("d", "unlisted")}
    with pytest.raises(ValueError):
        sinks.export_page({"x": df}, "1", str(tmp_path / "run/out"), str(tmp_path / "run"))
    sinks.export_page({"x": df}, "1", str(tmp_path / "out"), str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "out/x")).count() == 1


def test_admission_is_one_act(spark, tmp_path):
    base, pages = str(tmp_path), spark.range(3).selectExpr("CAST(id AS STRING) AS image_id")
    good = pages.selectExpr("image_id", "IF(image_id = '1', 255, 0) AS value")
    rules = [Rule("non_binary_mask", ~F.col("value").isin(0, 255), "between")]
    score = lambda s: s.select("image_id", (F.col("value") == 255).alias("ink"))
    take = lambda df, method, of=pages, how=score: ADM.admit(df, of, rules, how, base, "run", method)

    def refused(df, method, category, image=None, of=pages):
        before = {p: p.read_bytes() for p in tmp_path.rglob("*.*")}
        with pytest.raises(ADM.Refused) as no:
            take(df, method, of)
        assert (no.value.category, no.value.image_id) == (category, image)
        assert {p: p.read_bytes() for p in tmp_path.rglob("*.*")} == before

    refused(good.filter("image_id <> '2'"), "a", "missing_page", "2")
    refused(good.union(good.limit(1)), "a", "repeated_page", "0")
    refused(good.union(spark.createDataFrame([("9", 0)], good.schema)), "a", "unlisted_page", "9")
    refused(good.withColumn("value", F.lit(7)), "a", "non_binary_mask", "0")
    refused(pages.limit(0).withColumn("value", F.lit(0)), "a", "missing_page", "0")
    assert ADM.read_fact(spark, base, "run", "scores") is None
    first = take(good, "a")
    before = {p: p.read_bytes() for p in tmp_path.rglob("*.*")}
    assert take(good.repartition(2), "a") == first and {p: p.read_bytes() for p in tmp_path.rglob("*.*")} == before
    refused(good.withColumn("value", F.lit(0)), "a", "admitted_already")
    refused(good.limit(2), "b", "page_list_identity", of=pages.limit(2))

    def broken(_):
        raise RuntimeError("no scores")

    with pytest.raises(RuntimeError):
        take(good, "b", how=broken)
    assert ADM.run_record(spark, base, "run", ["a", "b"])["methods_awaited"] == ["b"]
    take(good.withColumn("value", F.lit(0)), "b")
    assert all(p.read_bytes() == b for p, b in before.items())
    record = ADM.run_record(spark, base, "run", ["a", "b"])
    assert record["methods_admitted"] == ["a", "b"] and record["ended"] and record["page_list"] == ADM.page_list_identity(pages)
    assert sorted((r.method, r.image_id, r.ink) for r in ADM.read_fact(spark, base, "run", "scores").collect()) == [(m, str(i), m == "a" and i == 1) for m in "ab" for i in range(3)]


def test_json_report_writes_nulls_in_order(spark, tmp_path):
    sinks.write_json(spark.createDataFrame([(2, None), (1, "x")], "k int, v string"), str(tmp_path / "j"), ["k"])
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"k":1,"v":"x"}', '{"k":2,"v":null}']


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"c{i % 3}", i % 4, i % 5 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, category string, region int, invalidated boolean")
    df.repartition(6).write.parquet(str(tmp_path / "t.parquet"))
    stream = lambda: ST.table_stream(spark, str(tmp_path), "t")
    dim = spark.createDataFrame([(f"c{i}",) for i in range(4)], "category string")
    assert sorted(map(tuple, ST.running_error_counts(stream(), dim).collect())) == [("c0", 20), ("c1", 20), ("c2", 20), ("c3", 0)]
    first = ST.first_writes(stream().withColumn("seq", -F.col("id")), "region", "seq", "category")
    assert {r.region: r.category for r in first.collect()} == {k: f"c{(56 + k) % 3}" for k in range(4)}
    gate = ST.incremental_intake(stream(), [Rule("odd", F.col("id") % 2 == 1, "odd")], "id")
    assert {r.id for r in gate.filter("category IS NOT NULL").collect()} == set(range(1, 60, 2)) and gate.count() == 60
    edits = stream().select("region", F.col("id").alias("seq"), F.col("id").cast("string").alias("edited"), "invalidated")
    want = {k: str(max(i for i, _, r, bad in rows if r == k and not bad)) for k in range(4)}
    assert {r.region: r.edited for r in ST.latest_edits_stream(edits).collect()} == want


def test_windows_close_with_the_watermark(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 01:00", "a"), ("2024-01-01 23:00", "a"), ("2024-01-03 05:00", "b")], "t string, category string").select(F.col("t").cast("timestamp_ntz").alias("ts"), "category")
    for i, day in enumerate(("2024-01-01", "2024-01-03")):
        df.filter(F.to_date("ts") == day).coalesce(1).write.mode("append").parquet(str(tmp_path / "e.parquet"))
    got = [(str(r.start), r.category, r.n) for r in ST.windowed_errors(ST.table_stream(spark, str(tmp_path), "e")).collect()]
    assert got == [("2024-01-01 00:00:00", "a", 2)]


def test_cache_fill_does_not_depend_on_batches(spark, tmp_path):
    rows = [(f"k{i % 5}", i * 37 % 60, f"r{i}" if i % 7 else "secret", "ok" if i % 3 else "failed") for i in range(60)]
    df = spark.createDataFrame(rows, "cache_key string, seq int, result string, result_status string")
    cache = spark.createDataFrame([("k2", "old")], "cache_key string, translated string")
    want = {tuple(r) for r in cache_append(df, cache, "secret").collect()}
    for parts in (1, 9):
        df.repartition(parts).write.parquet(str(tmp_path / f"r{parts}.parquet"))
        stream = ST.table_stream(spark, str(tmp_path), f"r{parts}")
        assert {tuple(r) for r in ST.cache_fill(stream, cache, "secret").collect()} == want


def test_states_of_old_keys_are_deleted(spark, tmp_path):
    days = [("a", 1, 5, "x"), ("b", 1, 1, "y"), ("a", 2, 3, "z"), ("c", 20, 9, "p"), ("d", 40, 9, "q"), ("a", 41, 4, "late"), ("b", 41, 0, "first"), ("c", 42, 10, "no")]
    for i, (key, day, seq, value) in enumerate(days):
        df = spark.createDataFrame([(key, f"2024-01-01 00:00:0{i}", day, seq, value)], "k string, t string, day int, seq int, v string")
        df.selectExpr("k", "CAST(t AS TIMESTAMP_NTZ) + make_dt_interval(day) AS ts", "seq", "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "s.parquet"))
    stream = ST.table_stream(spark, str(tmp_path), "s")
    got = ST.first_writes(stream, "k", "seq", "v", "ts", timedelta(days=3))
    assert {tuple(r) for r in got.collect()} == {("a", "z"), ("b", "first"), ("c", "p"), ("d", "q")}
