"""Writers of reports and facts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliogrid.functions.scalars import RUN_ID


def write_table(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """A report as one CSV file with fixed columns in a total order. For aggregates, not for facts."""
    df.select(*columns).orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, order: list[str]) -> None:
    """One file with a JSON object a line, nulls written out, in a total order. For aggregates, not for facts."""
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    df.orderBy(*order).select(row.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def run_name(run_id: str) -> str:
    """The identifier of a run or method, if it is safe as a part of a path."""
    if not re.match(RUN_ID.replace(r"\z", r"\Z"), run_id):
        raise ValueError(f"not a run id: {run_id!r}")
    return run_id


def write_run(df: DataFrame, base: str, run_id: str, overwrite: bool = False) -> str:
    """A run's fact under its own path; an existing run is refused unless told, siblings are never touched."""
    path = f"{base.rstrip('/')}/run_id={run_name(run_id)}"
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return path


def verify_bundle(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Differences of a page list ``(image_id, sha256)`` and the files of a bundle, both ways; empty if it is whole."""
    p, f = pages.select("image_id", F.col("sha256").alias("listed")), files.select("image_id", F.col("sha256").alias("found"))
    both = p.join(f, "image_id", "full_outer")
    why = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("found") != F.col("listed"), "altered")
    return both.withColumn("finding", why).filter("finding IS NOT NULL").select("image_id", "finding")


def export_page(facts: dict[str, DataFrame], image_id: str, base: str, run_root: str) -> None:
    """One page's rows of every fact, written outside the run tree."""
    if (base.rstrip("/") + "/").startswith(run_root.rstrip("/") + "/"):
        raise ValueError("the export must lie outside the run tree")
    for name, fact in facts.items():
        fact.filter(F.col("image_id") == image_id).write.mode("errorifexists").parquet(f"{base.rstrip('/')}/{name}")
