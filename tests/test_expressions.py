"""Scalar expressions against literal expectations."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from foliogrid.functions import scalars as S


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first().asDict()


@pytest.mark.parametrize(("counts", "want"), [((0, 0, 0), (1, 1, 1, 1)), ((0, 3, 0), (0, 0, 0, 0)), ((0, 0, 2), (0, 0, 0, 0)), ((2, 1, 1), (0.5, 2 / 3, 2 / 3, 2 / 3))])
def test_scores_of_empty_and_full_masks(spark, counts, want):
    got = one(spark, **S.prf_iou(*(F.lit(c) for c in counts)))
    assert [got[k] for k in ("iou", "precision", "recall", "f1")] == pytest.approx(want)


def test_crop_is_clipped_before_it_is_cut(spark):
    got = one(spark, **S.crop_geometry(*(F.lit(v) for v in (0, 0, 9, 8)), 5, 1654, 1170))
    assert got == {"crop_x": 0, "crop_y": 0, "crop_w": 14, "crop_h": 13, "clipped": True}


def test_backoff_doubles_up_to_the_bound(spark):
    assert one(spark, w=S.backoff_schedule(F.lit(4), 0.25, 1.0))["w"] == [0.25, 0.5, 1.0, 1.0]


@pytest.mark.parametrize("text", ["plain", 'q"uote', "back\\slash", "sla/sh", "漢字\n<&'>", "\x01\x0b\x1f tab\t"])
def test_cache_key_is_the_digest_of_canonical_json(spark, text):
    want = hashlib.sha256(json.dumps([text, "en", "p", "m"], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    row = spark.createDataFrame([(text,)], "t string").select(S.cache_key("t", F.lit("en"), F.lit("p"), F.lit("m")).alias("k")).first()
    assert row["k"] == want


def test_wrapping_breaks_long_words(spark):
    assert one(spark, lines=S.wrap_text(F.lit("a bb ccccccc d"), 4))["lines"] == ["a bb", "cccc", "ccc", "d"]


@pytest.mark.parametrize(("ref", "want"), [("/a", "absolute"), ("C:\\x", "absolute"), ("out/../x", "traversal"), ("no/x", "unknown_root"), ("out", "empty"), ("out/", "empty"), ("out/raw/x", "forbidden"), ("out/rawer", "ok"), (None, "unknown_root")])
def test_reference_gate(spark, ref, want):
    row = spark.createDataFrame([(ref,)], "r string").select(S.classify_reference(F.col("r"), ["out"], ["out/raw"]).alias("v")).first()
    assert row["v"] == want


def test_identifiers_end_at_the_end(spark):
    df = spark.createDataFrame([("a/b",), ("a/b/c",), ("a",), (None,)], "i string")
    assert [r[0] for r in df.select(S.is_image_id(F.col("i"))).collect()] == [True, False, False, None]
    df = spark.createDataFrame([("0" * 40,), ("0" * 40 + "\n",), ("0" * 39,)], "i string")
    assert [r[0] for r in df.select(S.is_revision(F.col("i"))).collect()] == [True, False, False]


def test_letterbox_rounds_half_to_even(spark):
    got = one(spark, **S.letterbox_geometry(F.lit(5), F.lit(2048), 1024))
    assert got == {"new_h": 2, "new_w": 1024}


def test_page_status_names_the_most_fundamental_state(spark):
    kind = "array<struct<ocr_status:string,translation_status:string,render_status:string>>"
    ok, bad = ("ok", "ok", "ok"), ("ok", "failed", "failed")
    df = spark.createDataFrame([(1, [], "m", "i", "r"), (2, [ok], None, "i", "r"), (3, [ok], "m", None, "r"), (4, [ok], "m", "i", None), (5, [ok, bad], "m", "i", "r"), (6, [ok, (None, None, None)], "m", "i", "r"), (7, None, "m", "i", "r")], f"id int, regions {kind}, m string, i string, r string")
    got = {r[0]: r[1] for r in df.select("id", S.page_status(F.col("regions"), F.col("m"), F.col("i"), F.col("r"))).collect()}
    assert got == {1: "no_text_regions", 2: "missing_prediction_mask", 3: "missing_inpainting_output", 4: "missing_ocr_translation_output", 5: "region_translation_failure", 6: "valid", 7: "no_text_regions"}


@pytest.mark.parametrize(("text", "want"), [(None, "empty"), ("", "empty"), ("\n\t 　 \x1c ", "empty"), ("​", "ok"), (" a\n", "ok")])
def test_white_space_of_any_kind_is_empty(spark, text, want):
    assert (not (text or "").strip()) == (want == "empty")
    assert one(spark, s=S.text_status(F.lit(text).cast("string")))["s"] == want


def test_wrapping_splits_at_any_white_space_and_keeps_blank_texts(spark):
    assert one(spark, lines=S.wrap_text(F.lit("a　bb c"), 4))["lines"] == ["a bb", "c"]
    assert one(spark, lines=S.wrap_text(F.lit(" \n"), 4))["lines"] == [" \n"]
