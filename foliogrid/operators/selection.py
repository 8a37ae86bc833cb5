"""Ranked selection of pages per method; ranks are windows over the method, pre-limited where only a top is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliogrid.operators.ranks import running_sums

RULES = ("highest_iou_f1", "lowest_iou_f1", "most_false_positives", "most_false_negatives", "manual")


def _order(rule: str):
    score = (F.col("iou") + F.col("f1")) / 2
    return {"highest_iou_f1": score.desc(), "lowest_iou_f1": score.asc(), "most_false_positives": F.desc("fp"), "most_false_negatives": F.desc("fn")}[rule]


def select_samples(metrics: DataFrame, rule: str, n: int, flags: DataFrame | None = None) -> DataFrame:
    """Up to ``n`` pages of each method with ``rank``; ties go by image id.

    ``manual`` takes ``flags(pos, image_id)`` in order, the first place of a repeated id, and keeps unknown ids.
    """
    if rule not in RULES:
        raise ValueError(f"unknown selection rule {rule!r}; known: {', '.join(RULES)}")
    if n < 0:
        raise ValueError("n must not be negative")
    if rule == "manual":
        order = W.partitionBy("method").orderBy("pos")
        wanted = flags.groupBy("image_id").agg(F.min("pos").alias("pos"))
        each = metrics.select("method").distinct().crossJoin(F.broadcast(wanted)).join(metrics, ["method", "image_id"], "left")
    else:
        order, each = W.partitionBy("method").orderBy(_order(rule), F.asc("image_id")), metrics
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def shortfall(metrics: DataFrame, selected: DataFrame, n: int) -> DataFrame:
    """Per method how many pages are missing to ``n``."""
    got = selected.groupBy("method").agg(F.count(F.lit(1)).alias("selected"))
    every = metrics.select("method").distinct().join(got, "method", "left").withColumn("selected", F.coalesce("selected", F.lit(0)))
    return every.withColumn("shortfall", F.greatest(F.lit(n) - F.col("selected"), F.lit(0)))


def select_pages(metrics: DataFrame, mode: str, n: int) -> DataFrame:
    """first, best or worst ``n`` of each method; best ranks both score and id downwards."""
    by = {"first": [F.asc("image_id")], "best": [F.desc("f1"), F.desc("image_id")], "worst": [F.asc("f1"), F.asc("image_id")]}[mode]
    return metrics.withColumn("rank", F.row_number().over(W.partitionBy("method").orderBy(*by))).filter(F.col("rank") <= n)


def case_entries(metrics: DataFrame, failures: DataFrame, n: int) -> DataFrame:
    """``method, image_id, case_kind, rank``: good, average and failed pages; a page picked twice is good.

    Ranks are running counts over sorted ranges, so a method's pages are spread over the cluster.
    """
    scored = metrics.join(failures, ["method", "image_id"], "left_anti").groupBy("method", (-F.col("f1")).alias("down"), "image_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sums(scored, ["method"], ["down", "image_id"], ["n"]).withColumn("rank", F.explode(F.sequence(F.col("before_n") + 1, F.col("before_n") + F.col("n"))))
    middle = F.greatest(F.floor((F.col("all_n") - n) / 2), F.lit(0))
    kind = F.when(F.col("rank") <= n, "good").when((F.col("rank") > middle) & (F.col("rank") <= middle + n), "average")
    picked = ranked.withColumn("case_kind", kind).filter("case_kind IS NOT NULL").select("method", "image_id", "case_kind", F.col("rank").cast("int").alias("rank"))
    return picked.union(failures.select("method", "image_id", F.lit("failure"), F.lit(None).cast("int")))


def select_typical(metrics: DataFrame, n: int) -> DataFrame:
    """The ``n`` pages of each method whose f1 is closest to its mean, with ``rank``."""
    mean = metrics.groupBy("method").agg(F.avg("f1").alias("mean_f1"))
    near = metrics.join(mean, "method").withColumn("distance", F.round(F.abs(F.col("f1") - F.col("mean_f1")), 12))
    return near.withColumn("rank", F.row_number().over(W.partitionBy("method").orderBy("distance", "image_id"))).filter(F.col("rank") <= n)


def worst(df: DataFrame, by: str, n: int, ties: list[str]) -> DataFrame:
    """The ``n`` smallest rows overall, without a full sort."""
    return df.orderBy(F.asc(by), *ties).limit(n)


def canonical_order(df: DataFrame, fixed: list[str] | None = None, column: str = "method", then: tuple[str, ...] = ()) -> DataFrame:
    """Total order of written tables: a fixed list first (unknown values last), then the other keys."""
    if not fixed:
        return df.orderBy(column, *then)
    place = F.array_position(F.array(*map(F.lit, fixed)), F.col(column))
    return df.orderBy(F.when(place == 0, len(fixed) + 1).otherwise(place), column, *then)
