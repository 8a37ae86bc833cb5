"""Confusion counts, scores, summaries and the method comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliogrid.functions.scalars import prf_iou
from foliogrid.operators.masks import overlap_runs

SCORES = ("iou", "precision", "recall", "f1")


def confusion_by_key(predicted: DataFrame, truth: DataFrame, key: str, groups: list[str]) -> DataFrame:
    """``n, tp, fp, fn`` per group of two boolean facts about the same keys; the fact side is shuffled by key once."""
    both = predicted.join(truth, key)
    t, p = F.col("truth"), F.col("predicted")
    return both.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count_if(t & p).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(t & ~p).alias("fn"))


def run_area(runs: DataFrame, name: str) -> DataFrame:
    return runs.groupBy("image_id").agg(F.sum(F.col("x1") - F.col("x0")).alias(name))


def confusion_of_runs(images: DataFrame, gt: DataFrame, pred: DataFrame) -> DataFrame:
    """``tp, fp, fn`` of every image in ``images``; pixels are never expanded."""
    out = images.select("image_id").distinct()
    for part in (overlap_runs(gt, pred), run_area(gt, "gt"), run_area(pred, "pred")):
        out = out.join(part, "image_id", "left")
    out = out.fillna(0, ["tp", "gt", "pred"])
    return out.select("image_id", "tp", (F.col("pred") - F.col("tp")).alias("fp"), (F.col("gt") - F.col("tp")).alias("fn"))


def with_scores(counts: DataFrame) -> DataFrame:
    return counts.withColumns(prf_iou(F.col("tp"), F.col("fp"), F.col("fn")))


def summarize(metrics: DataFrame) -> DataFrame:
    """Per method: number of images, means, population deviation of iou, mean time."""
    means = [F.avg(c).alias(f"mean_{c}") for c in SCORES]
    return metrics.groupBy("method").agg(F.count(F.lit(1)).alias("n_images"), *means, F.stddev_pop("iou").alias("std_iou"), F.avg("inference_time_seconds").alias("mean_time"))


def failed_counts(failures: DataFrame, metrics: DataFrame) -> DataFrame:
    """Distinct failed images per method, of those that were scored."""
    seen = metrics.select("method", "image_id").distinct()
    return failures.join(seen, ["method", "image_id"], "left_semi").groupBy("method").agg(F.count_distinct("image_id").alias("failed"))


def scored(metrics: DataFrame, failures: DataFrame) -> DataFrame:
    """Comparison rows of scored methods; means are over all scored rows, counts set failed pages apart."""
    stats = [f(c).alias(f"{c}_{n}") for c in SCORES for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    rows = metrics.groupBy("method").agg(*stats, F.avg("inference_time_seconds").alias("time_mean"), F.sum("inference_time_seconds").alias("time_total"), F.count_distinct("image_id").alias("pages"))
    out = rows.join(failed_counts(failures, metrics), "method", "left").withColumn("failed", F.coalesce("failed", F.lit(0)))
    return out.withColumn("success", F.col("pages") - F.col("failed")).drop("pages").withColumn("status", F.lit("scored"))


def compare(metrics: DataFrame, failures: DataFrame, awaited: DataFrame) -> DataFrame:
    """Scored methods and, with null numbers, those not run yet; sorted by method."""
    waiting = awaited.select("method", "reason").withColumn("status", F.lit("not_run"))
    return scored(metrics, failures).withColumn("reason", F.lit(None).cast("string")).unionByName(waiting, allowMissingColumns=True).orderBy("method")


def macro_scores(counts: DataFrame) -> DataFrame:
    """Means of per-page precision, recall and iou with denominators of at least 1, and weak pages."""
    one = F.lit(1)
    tp = F.col("tp").cast("double")
    per = counts.select("method", (tp / F.greatest(one, F.col("tp") + F.col("fp"))).alias("p"), (tp / F.greatest(one, F.col("tp") + F.col("fn"))).alias("r"), (tp / F.greatest(one, F.col("tp") + F.col("fp") + F.col("fn"))).alias("i"))
    return per.groupBy("method").agg(F.avg("p").alias("mean_precision"), F.avg("r").alias("mean_recall"), F.avg("i").alias("mean_iou"), F.count_if(F.col("p") < 0.5).alias("weak_pages"), F.count(F.lit(1)).alias("pages"))
