"""Profiles, rank statistics and trade-offs of filters: partial aggregates, and ranks over sorted ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliogrid.operators.ranks import running_sums, wide_quantiles


def profile(df: DataFrame, group: list[str], value: str, weight: str, cut: float, points: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Percentiles (linear interpolation), share above a cut, the same by weight, and the weighted mean."""
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    above = v > cut
    means = df.groupBy(*group).agg(F.avg(above.cast("double")).alias("share"), (F.sum(F.when(above, w).otherwise(0.0)) / F.sum(w)).alias("weighted_share"), (F.sum(w * v) / F.sum(w)).alias("weighted_mean"))
    return _with_quantiles(means, wide_quantiles(df, group, {"v": v}, {f"p{round(p * 100)}": p for p in points}, "{point}"), group)


def _with_quantiles(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the quantiles of their keys, null keys included; null for keys without values."""
    named = found.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(named, same, "left").drop(*(f"__{k}" for k in keys))


def bucket_profile(df: DataFrame, value: str, measure: str, edges: list[float]) -> DataFrame:
    """Rows, sum and median of ``measure`` for half-open bins of ``value``; values outside have no bin."""
    v, bin_ = F.col(value), F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        bin_ = F.when((v >= edges[i]) & (v < edges[i + 1]), i).otherwise(bin_)
    m = F.col(measure).cast("double")
    binned = df.withColumn("bin", bin_).filter("bin IS NOT NULL")
    sums = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum(m).alias("total"))
    return _with_quantiles(sums, wide_quantiles(binned, ["bin"], {"m": m}, {"median": 0.5}, "{point}"), ["bin"])


def auc(df: DataFrame, features: list[str], label: str, ties: str = "average", order: list[str] | None = None) -> DataFrame:
    """Probability that a positive row has the larger value, per feature, with a verdict.

    Missing values are -1. Equal values are counted first, and ranks come from running counts over sorted ranges, so
    no task holds a feature; ``ties='first'`` ranks rows, in the given order, which has to tell rows apart.
    """
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("double"), F.lit(-1.0)).alias("v")) for f in features)))
    long = df.select(F.col(label).cast("int").alias("y"), *(order or []), each.alias("e")).select("y", *(order or []), "e.feature", "e.v")
    by = ["v", *(order or [])] if ties == "first" else ["v"]
    counts = long.groupBy("feature", *by).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"))
    rank = F.col("before_n") + (F.col("n") + 1) / 2
    sums = running_sums(counts, ["feature"], by, ["n"]).groupBy("feature").agg(F.sum(rank * F.col("n1")).alias("rank_sum"), F.sum("n1").alias("n1"), F.sum("n").alias("n"))
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    value = F.when((n1 == 0) | (n0 == 0), F.lit(None)).otherwise((F.col("rank_sum") - n1 * (n1 + 1) / 2) / (n1 * n0))
    out = sums.select("feature", value.alias("auc"))
    strength = F.abs(F.col("auc") - 0.5)
    return out.withColumn("verdict", F.when(strength.isNull(), "undefined").when(strength < 0.05, "useless").when(strength < 0.12, "weak").otherwise("signal"))


def filter_tradeoff(df: DataFrame, rules: dict[str, Column], false_: Column, weight: Column) -> DataFrame:
    """Per keeping rule: kept rows, share of false weight removed, of true weight lost, and false weight left."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.coalesce(c, F.lit(False)).alias("keep")) for k, c in rules.items())))
    g = df.select(false_.alias("bad"), weight.cast("double").alias("w"), each.alias("e")).groupBy(F.col("e.rule").alias("rule")).agg(
        F.count_if("e.keep").alias("kept"), F.sum("w").alias("total"),
        *(F.sum(F.when(c, F.col("w")).otherwise(0.0)).alias(n) for n, c in {"bad_w": F.col("bad"), "good_w": ~F.col("bad"), "bad_out": F.col("bad") & ~F.col("e.keep"), "good_out": ~F.col("bad") & ~F.col("e.keep")}.items()),
    )
    return g.select("rule", "kept", (100 * F.col("bad_out") / F.col("bad_w")).alias("removed_false"), (100 * F.col("good_out") / F.col("good_w")).alias("lost_true"), (100 * (F.col("bad_w") - F.col("bad_out")) / F.col("total")).alias("residual_false"))


def evidence_score(tests: list[Column]) -> Column:
    """Number of tests that hold."""
    total = F.lit(0)
    for t in tests:
        total = total + F.coalesce(t.cast("int"), F.lit(0))
    return total


def weighted_share(df: DataFrame, value: str, weight: str, cuts: list[float]) -> DataFrame:
    """Share of the weight at or above each cut."""
    w, v = F.col(weight).cast("double"), F.col(value)
    each = F.explode(F.array(*(F.struct(F.lit(float(c)).alias("cut"), (v >= c).alias("above")) for c in cuts)))
    return df.select(w.alias("w"), each.alias("e")).groupBy(F.col("e.cut").alias("cut")).agg((F.sum(F.when(F.col("e.above"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("share"))


def mask_composition(components: DataFrame, glyph_max: int, art_min: int) -> DataFrame:
    """Per page: components, glyph-like and art-like ones, and the share of the biggest."""
    return components.groupBy("page").agg(F.count(F.lit(1)).alias("components"), F.sum("area").alias("ink"), F.count_if(F.col("area") <= glyph_max).alias("glyph_like"), F.count_if(F.col("area") >= art_min).alias("art_like"), (F.max("area") / F.sum("area")).alias("biggest_share"))


def centroid_offset(a: DataFrame, b: DataFrame, regions: DataFrame, least: int = 5) -> DataFrame:
    """Distance of the ink centroids of two masks in each region ``(left, top, width, height)``, and over the diagonal.

    Rows of ink meet boxes by image and by row, so a region only looks at the rows it covers.
    """
    rows = regions.withColumn("y", F.explode(F.sequence(F.col("top"), F.col("top") + F.col("height") - 1)))

    def centre(ink: DataFrame, p: str) -> DataFrame:
        inside = rows.join(ink, ["image_id", "y"]).filter((F.col("x") >= F.col("left")) & (F.col("x") < F.col("left") + F.col("width")))
        return inside.groupBy("image_id", "region_id").agg(F.avg("x").alias(f"{p}x"), F.avg("y").alias(f"{p}y"), F.count(F.lit(1)).alias(f"{p}n"))

    both = regions.join(centre(a, "a"), ["image_id", "region_id"]).join(centre(b, "b"), ["image_id", "region_id"]).filter((F.col("an") >= least) & (F.col("bn") >= least))
    offset = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return both.select("image_id", "region_id", offset.alias("offset"), (offset / F.hypot(F.col("width").cast("double"), F.col("height").cast("double"))).alias("relative"))


def compare_groups(df: DataFrame, flag: Column, features: list[str]) -> DataFrame:
    """Rows and feature medians of flagged and other rows."""
    flagged = df.withColumn("flagged", flag)
    medians = wide_quantiles(flagged, ["flagged"], {f: F.col(f) for f in features}, {"median": 0.5}, "{point}_{feature}")
    return _with_quantiles(flagged.groupBy("flagged").agg(F.count(F.lit(1)).alias("n")), medians, ["flagged"])
