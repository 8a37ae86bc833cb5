"""Edits, staleness, scoped re-runs and cache-aware enrichment over facts keyed by page and region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliogrid.functions.scalars import is_blank, text_status


def latest_edits(edits: DataFrame) -> DataFrame:
    """The last edit of each region by append order that was not invalidated."""
    live = edits.filter("NOT invalidated")
    last = live.groupBy("region").agg(F.max_by(F.struct("edited"), F.struct("seq", "edited")).alias("e"))
    return last.select("region", F.col("e.edited").alias("edited"))


def apply_edits(ocr: DataFrame, edits: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """OCR texts with the latest edits; stale regions are dropped."""
    out = ocr if stale is None else ocr.join(stale, "region", "left_anti")
    out = out.join(latest_edits(edits), "region", "left")
    text = F.coalesce("edited", "text")
    return out.select("region", text.alias("text"), text_status(text).alias("status"), F.col("edited").isNotNull().alias("manually_edited"))


def detect_edits(ocr: DataFrame, baseline: DataFrame, edits: DataFrame) -> DataFrame:
    """Regions whose text differs from the recognised one and is not the latest edit already."""
    base = baseline.select("region", F.col("text").alias("original"))
    out = ocr.join(base, "region").join(latest_edits(edits), "region", "left").filter("text <> original AND NOT (text <=> edited)")
    return out.select("region", "original", F.col("text").alias("edited"))


def apply_edit(edits: DataFrame, ocr: DataFrame, new: DataFrame) -> DataFrame:
    """The edit log with new edits appended; the original is what OCR holds, the status follows the text."""
    current = ocr.select("region", F.col("text").alias("original"))
    rows = new.join(current, "region").select("region", "seq", "original", "edited", F.lit(False).alias("invalidated"), text_status(F.col("edited")).alias("status"))
    old = edits.select("region", "seq", F.lit(None).cast("string").alias("original"), "edited", "invalidated", text_status(F.col("edited")).alias("status"))
    return old.union(rows)


def stale_regions(ocr: DataFrame, regions: DataFrame, translations: DataFrame) -> DataFrame:
    """``region, ocr_stale, translation_stale``: geometry or source text moved on since."""
    r = regions.select("region", F.col("signature").alias("now"))
    o = ocr.select("region", F.col("signature").alias("was"), F.col("text").alias("source"))
    t = translations.select("region", F.col("source_text").alias("used"))
    out = o.join(r, "region", "full_outer").join(t, "region", "full_outer")
    return out.select("region", (~F.col("was").eqNullSafe(F.col("now"))).alias("ocr_stale"), (~F.col("used").eqNullSafe(F.col("source"))).alias("translation_stale"))


def invalidate(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a change clears: changed OCR clears translation and rendering, changed translation clears rendering."""
    o = old.select("region", F.col("ocr_text").alias("o0"), F.col("translation").alias("t0"))
    out = new.join(o, "region", "left")
    ocr = ~F.col("o0").eqNullSafe(F.col("ocr_text"))
    moved = ocr | ~F.col("t0").eqNullSafe(F.col("translation"))
    return out.select("region", ocr.alias("clear_translation"), moved.alias("clear_rendering"))


def rerun(fact: DataFrame, scope: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The fact with the rows of the scope replaced; siblings stay as they are."""
    return fact.join(scope.select(*keys).distinct(), keys, "left_anti").unionByName(new.join(scope.select(*keys).distinct(), keys, "left_semi"))


def reextract(old: DataFrame, new: DataFrame, edits: DataFrame) -> DataFrame:
    """Regions after extraction anew: unchanged geometry keeps its state, other regions start over.

    Adds how many live edits became stale.
    """
    o = old.select("region", F.col("signature").alias("was"), "state")
    live = edits.filter("NOT invalidated").groupBy("region").agg(F.count(F.lit(1)).alias("edits"))
    out = new.select("region", "signature").join(o, "region", "full_outer").join(live, "region", "left")
    same = F.col("was").eqNullSafe(F.col("signature"))
    return out.select("region", F.when(F.col("signature").isNull(), "removed").when(same, F.col("state")).otherwise("pending").alias("state"), F.when(same, 0).otherwise(F.coalesce("edits", F.lit(0))).alias("stale_edits"))


def cache_lookup(requests: DataFrame, cache: DataFrame, enabled: bool = True) -> DataFrame:
    """Requests with ``cache_status`` and the cached text; ``bypass`` rows and a disabled cache always miss."""
    known = cache.select("cache_key", "translated") if enabled else cache.select("cache_key", "translated").limit(0)
    out = requests.join(known, "cache_key", "left")
    hit = F.col("translated").isNotNull() & ~F.coalesce("bypass", F.lit(False))
    return out.withColumn("cache_status", F.when(hit, "hit").otherwise("miss")).withColumn("translated", F.when(hit, F.col("translated")))


def enrich(requests: DataFrame, cache: DataFrame, provider, policy: str = "keep_ocr_text") -> DataFrame:
    """Translated requests ``(region, text, status, cache_key, bypass)``.

    Rows without text are skipped. Misses are asked once for each key; ``provider`` maps distinct
    ``(cache_key, text)`` to ``(cache_key, answer)`` with null for a failure, and may be any DataFrame function.
    """
    if policy not in ("keep_ocr_text", "exclude"):
        raise ValueError(f"unknown failure policy {policy!r}")
    able = (F.col("status") == "ok") & ~is_blank(F.col("text"))
    looked = cache_lookup(requests.filter(able), cache)
    asked = provider(looked.filter("cache_status = 'miss'").groupBy("cache_key").agg(F.min("text").alias("text"))).select("cache_key", "answer")
    both = looked.join(asked, "cache_key", "left")
    got = F.coalesce("translated", "answer")
    failed = got.isNull()
    text = F.when(~failed, got).otherwise(F.col("text") if policy == "keep_ocr_text" else F.lit(""))
    state = F.when(~failed, "ok").otherwise("failed" if policy == "keep_ocr_text" else "skipped")
    done = both.select("region", "cache_key", text.alias("result"), state.alias("result_status"), "cache_status")
    skipped = requests.filter(~F.coalesce(able, F.lit(False))).select("region", "cache_key", F.lit("").alias("result"), F.lit("skipped").alias("result_status"), F.lit("none").alias("cache_status"))
    return done.union(skipped)


def cache_append(results: DataFrame, cache: DataFrame, secret: str | None = None) -> DataFrame:
    """The cache with the first good answer of each new key; failures and answers with the secret stay out."""
    good = results.filter("result_status = 'ok'")
    if secret:
        good = good.filter(~F.contains("result", F.lit(secret)))
    new = good.groupBy("cache_key").agg(F.min(F.struct("seq", "result")).alias("r")).select("cache_key", F.col("r.result").alias("translated"))
    return cache.select("cache_key", "translated").union(new.join(cache, "cache_key", "left_anti"))


# What the record of a region says of each stage: name, column of the stage, value without the stage.
REGION_FIELDS = {
    "ocr": (("crop_path", "crop_path", None), ("ocr_text", "text", ""), ("ocr_confidence", "confidence", None), ("ocr_status", "status", "failed"), ("ocr_error", "error", None), ("manually_edited", "manually_edited", False), ("ocr_time_seconds", "seconds", None)),
    "translation": (("translation", "translated_text", ""), ("translation_status", "status", "skipped"), ("translation_error", "error", None), ("cache_status", "cache_status", None), ("failure_policy", "failure_policy", None), ("translation_time_seconds", "seconds", None)),
    "render": (("render_status", "render_status", "skipped"), ("render_warning", "warning", None), ("font_size_used", "font_size_used", None), ("line_count", "line_count", 0), ("display_box", "display_box", None), ("direction_used", "direction_used", None), ("render_time_seconds", "seconds", None)),
}


def region_metadata(regions: DataFrame, keys: list[str], **stages: DataFrame) -> DataFrame:
    """The record of every region: its own columns, then what each stage says of it.

    ``stages`` are ``ocr``, ``translation`` and ``render``, with one row a region at most. Where a stage has no row for
    a region the defaults stand; where it has one its values do, nulls included. Columns that a stage lacks are null.
    """
    out = regions
    for stage, fields in REGION_FIELDS.items():
        rows = stages[stage]
        has = [f for f in fields if f[1] in rows.columns]
        known = rows.select(*keys, *(F.col(c).alias(f"__{n}") for n, c, _ in has), F.lit(True).alias("__there"))
        out = out.join(known, keys, "left")
        value = {n: F.col(f"__{n}") for n, _, _ in has}
        out = out.withColumns({n: F.when(F.col("__there"), value.get(n, F.lit(None))).otherwise(F.lit(default)) for n, _, default in fields}).drop(*(f"__{n}" for n in value), "__there")
    return out


def assemble_regions(regions: DataFrame, ocr: DataFrame, translations: DataFrame, rendered: DataFrame) -> DataFrame:
    """One row per region with the states of its stages; OCR is failed and later stages skipped where absent."""
    out = regions.join(ocr.select("region", F.col("status").alias("ocr_status"), F.col("text").alias("ocr_text")), "region", "left")
    out = out.join(translations.select("region", F.col("status").alias("translation_status"), "translation"), "region", "left")
    out = out.join(rendered.select("region", F.col("status").alias("render_status"), "line_count"), "region", "left")
    defaults = {"ocr_status": "failed", "translation_status": "skipped", "render_status": "skipped", "ocr_text": "", "translation": "", "line_count": 0}
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
