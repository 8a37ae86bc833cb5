"""Catalogue joins: pairing, orphans, mismatches, exactly-one matches, identities, folds and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pair(masks: DataFrame, raws: DataFrame) -> DataFrame:
    """One row per mask whose (manga, stem) has a raw page; of several raws the last path counts."""
    last = raws.groupBy("manga", "stem").agg(F.max("path").alias("raw_path"))
    return masks.join(last, ["manga", "stem"])


def orphans(masks: DataFrame, raws: DataFrame) -> DataFrame:
    """Rows of the first without a partner in the second."""
    return masks.join(raws, ["manga", "stem"], "left_anti")


def stem_mismatches(orphan_masks: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of another manga with the stem of an orphan mask; the page id takes the mask's stem."""
    o = orphan_masks.select(F.col("manga").alias("mask_manga"), F.col("stem").alias("mask_stem"), F.lower("stem").alias("k"))
    p = pages.select(F.col("manga").alias("page_manga"), F.lower("stem").alias("k"))
    hit = o.join(p, "k").filter("mask_manga <> page_manga")
    return hit.select(F.concat_ws("/", "mask_manga", "mask_stem").alias("mask_id"), F.concat_ws("/", "page_manga", "mask_stem").alias("page_id"))


def folder_mismatches(lone_pages: DataFrame, masks: DataFrame) -> DataFrame:
    """For each page without a mask the first mask of another manga with its stem."""
    p = lone_pages.select(F.col("manga").alias("page_manga"), F.col("stem").alias("page_stem"), F.lower("stem").alias("k"))
    m = masks.select(F.col("manga").alias("mask_manga"), F.col("stem").alias("mask_stem"), F.lower("stem").alias("k"))
    hit = p.join(m, "k").filter("mask_manga <> page_manga")
    first = hit.groupBy("page_manga", "page_stem").agg(F.min(F.struct("mask_manga", "mask_stem")).alias("m"))
    return first.select(F.concat_ws("/", "page_manga", "page_stem").alias("page_id"), F.concat_ws("/", "m.mask_manga", "m.mask_stem").alias("mask_id"))


def map_exactly_one(masks: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Each mask with ``outcome``: mapped, no_page or ambiguous."""
    n = manifest.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"))
    out = masks.join(n, keys, "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
    return out.withColumn("outcome", F.when(F.col("pages") == 0, "no_page").when(F.col("pages") > 1, "ambiguous").otherwise("mapped"))


def check_identity(sidecars: DataFrame, identity: DataFrame) -> DataFrame:
    """Sidecars with ``agrees``: the quoted hash is the committed one (both absent agree as well)."""
    known = identity.select("image_id", F.col("sha256").alias("committed"))
    return sidecars.join(known, "image_id", "left").withColumn("agrees", F.col("quoted").eqNullSafe(F.col("committed")))


def case_lists(metrics: DataFrame, failures: DataFrame, methods: DataFrame) -> DataFrame:
    """Per method its number of successes and failures; null, not zero, for methods that were not run."""
    ok = metrics.join(failures, ["method", "image_id"], "left_anti").groupBy("method").agg(F.count_distinct("image_id").alias("n_success"))
    bad = failures.groupBy("method").agg(F.count_distinct("image_id").alias("n_failed"))
    ran = metrics.select("method").distinct().withColumn("ran", F.lit(True))
    out = methods.join(ran, "method", "left").join(ok, "method", "left").join(bad, "method", "left")
    zero = lambda c: F.when(F.col("ran"), F.coalesce(c, F.lit(0))).alias(c)
    return out.select("method", zero("n_success"), zero("n_failed"))


def check_folds(sidecars: DataFrame, folds: DataFrame) -> DataFrame:
    """``verdict`` of each sidecar's claimed fold: ok, unknown_book, unreadable_fold or wrong_fold."""
    claimed = F.regexp_extract("fold_attribution", r"^fold_(\d+)$", 1)
    out = sidecars.join(F.broadcast(folds), "manga", "left")
    return out.withColumn("verdict", F.when(F.col("fold").isNull(), "unknown_book").when(F.coalesce(claimed, F.lit("")) == "", "unreadable_fold").when(claimed.cast("int") != F.col("fold"), "wrong_fold").otherwise("ok"))


def artifact_presence(pages: DataFrame, files: DataFrame, kinds: list[str]) -> DataFrame:
    """Pages with a flag for each kind of artifact that exists."""
    have = files.groupBy("image_id").agg(*(F.max((F.col("kind") == k).cast("int")).alias(f"has_{k}") for k in kinds))
    out = pages.join(have, "image_id", "left")
    return out.select(*pages.columns, *((F.coalesce(f"has_{k}", F.lit(0)) == 1).alias(f"has_{k}") for k in kinds))


def check_run_links(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Runs with ``verdict`` on the run they say they come from: ok, missing_source or method_mismatch."""
    src = sources.select(F.col("run_id").alias("source_run"), F.col("method").alias("source_method"))
    out = runs.join(src, "source_run", "left")
    return out.withColumn("verdict", F.when(F.col("source_method").isNull(), "missing_source").when(F.col("source_method") != F.col("method"), "method_mismatch").otherwise("ok"))


def sweep_grid(pages: DataFrame, *dims: DataFrame) -> DataFrame:
    """Every page with every combination of the dimensions. They must be configuration tables of a few rows."""
    out = pages
    for d in dims:
        out = out.crossJoin(F.broadcast(d))
    return out


def signature_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``keys, change``: unchanged, changed, removed or added by a null-safe comparison of the fields."""
    o = old.select(*keys, F.struct(*fields).alias("o"), F.lit(True).alias("had"))
    n = new.select(*keys, F.struct(*fields).alias("n"), F.lit(True).alias("has"))
    change = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("changed")
    return o.join(n, keys, "full_outer").select(*keys, change.alias("change"))


def dominant_run(pages: DataFrame, group: list[str]) -> DataFrame:
    """The run with the most pages of each group; ties go to the smallest id."""
    counts = pages.groupBy(*group, "run_id").agg(F.count(F.lit(1)).alias("pages"))
    return counts.withColumn("r", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("pages"), "run_id"))).filter("r = 1").drop("r")


def catalog(pages: DataFrame) -> DataFrame:
    """Pages of each manga and how its stems run from first to last."""
    return pages.groupBy("manga").agg(F.count_distinct("stem").alias("pages"), F.min("stem").alias("first"), F.max("stem").alias("last"))
