"""Admission of a method's hand-off into a run as one act.

A hand-off is copied into an attempt of its own, and the gate looks at that copy. Only if every check passes are the
samples scored, and only when the scores are written does one small manifest file come into being, which names the
attempt. Readers follow manifests alone: samples, scores and the run record of a method appear together or not at
all, a refused or broken attempt leaves nothing that is seen, and methods admitted earlier are never touched.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliogrid.operators.gates import Rule, first_failure, violations
from foliogrid.sources.sinks import run_name

ENTRY = "method string, attempt string, page_list string, pages long, digest string"


class Refused(ValueError):
    """Why a hand-off is not admitted: ``category`` and, if one is at fault, ``image_id``."""

    def __init__(self, category: str, image_id: str | None = None):
        super().__init__(f"{category}: {image_id}" if image_id is not None else category)
        self.category, self.image_id = category, image_id


def _files(spark: SparkSession, path: str):
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def entries(spark: SparkSession, run: str) -> dict[str, dict]:
    """The manifest of each admitted method. There is one small file a method."""
    fs, where = _files(spark, f"{run}/manifest")
    if not fs.exists(where) or not any(f.getPath().getName().endswith(".json") for f in fs.listStatus(where)):
        return {}
    rows = spark.read.schema(ENTRY).json(f"{run}/manifest/*.json").collect()
    return {r.method: r.asDict() for r in rows}


def page_list_identity(pages: DataFrame) -> str:
    """Digest of the listed image ids in any order."""
    return _digest(pages.select("image_id").distinct())


def _digest(rows: DataFrame) -> str:
    """Count and sum of the digests of all rows, whatever their order."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(rows.columns)]
    head = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    n, total = rows.agg(F.count(F.lit(1)), F.sum(head)).first()
    return f"{n}-{total or 0}"


def coverage(samples: DataFrame, pages: DataFrame) -> DataFrame:
    """``check_no, category, image_id`` of listed pages without a sample, samples that are not listed, and pages with several."""
    n = samples.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    both = pages.select("image_id").distinct().withColumn("listed", F.lit(True)).join(n, "image_id", "full_outer")
    broken = [("missing_page", F.col("n").isNull()), ("unlisted_page", F.col("listed").isNull()), ("repeated_page", F.col("n") > 1)]
    rules = [Rule(c, bad, c) for c, bad in broken]
    return violations(both, rules, ["image_id"]).select("check_no", "category", "image_id")


def admit(samples: DataFrame, pages: DataFrame, rules: list[Rule], score: Callable[[DataFrame], DataFrame], base: str, run_id: str, method: str) -> dict:
    """Gate, store, score and publish a hand-off of ``method``; returns its manifest.

    ``samples`` has a row for each page of ``pages``; ``rules`` are checked in order behind the coverage of the list.
    Admitting the same samples again changes nothing and returns the manifest that is there; other samples of an
    admitted method are refused, and so are results for another page list than the run's.
    """
    spark, run = samples.sparkSession, f"{base.rstrip('/')}/{run_name(run_id)}"
    run_name(method)
    known, listed = entries(spark, run), page_list_identity(pages)
    if any(e["page_list"] != listed for e in known.values()):
        raise Refused("page_list_identity")
    attempt = f"attempts/{method}-{uuid.uuid4().hex}"
    samples.write.parquet(f"{run}/{attempt}/samples")
    stored = spark.read.schema(samples.schema).parquet(f"{run}/{attempt}/samples")
    try:
        digest = _digest(stored)
        if method in known:
            if known[method]["digest"] != digest:
                raise Refused("admitted_already")
            _drop(spark, f"{run}/{attempt}")
            return known[method]
        row_rules = violations(stored, rules, ["image_id"]).select((F.col("check_no") + 3).alias("check_no"), "category", "image_id")
        found = coverage(stored, pages).union(row_rules).withColumn("handoff", F.lit(method))
        first = first_failure(found, ["handoff"], ["image_id"]).head(1)
        if first:
            raise Refused(first[0]["category"], first[0]["image_id"])
        score(stored).write.parquet(f"{run}/{attempt}/scores")
        entry = {"method": method, "attempt": attempt, "page_list": listed, "pages": pages.select("image_id").distinct().count(), "digest": digest}
        _publish(spark, f"{run}/manifest/{method}.json", entry)
    except BaseException:
        _drop(spark, f"{run}/{attempt}")
        raise
    return entry


def _drop(spark: SparkSession, path: str) -> None:
    fs, where = _files(spark, path)
    fs.delete(where, True)


def _publish(spark: SparkSession, path: str, entry: dict) -> None:
    """Write a manifest aside and rename it into place, which is one step; a manifest that is there is not replaced."""
    aside, (fs, where) = f"{path}.{uuid.uuid4().hex}", _files(spark, path)
    fs.mkdirs(where.getParent())
    out = fs.create(_files(spark, aside)[1], False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    if fs.exists(where) or not fs.rename(_files(spark, aside)[1], where):
        fs.delete(_files(spark, aside)[1], False)
        raise Refused("admitted_already")


def read_fact(spark: SparkSession, base: str, run_id: str, fact: str) -> DataFrame | None:
    """``samples`` or ``scores`` of all admitted methods with ``method``; none if nothing is admitted."""
    run, out = f"{base.rstrip('/')}/{run_name(run_id)}", None
    for method, entry in sorted(entries(spark, run).items()):
        part = spark.read.parquet(f"{run}/{entry['attempt']}/{fact}").withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part)
    return out


def run_record(spark: SparkSession, base: str, run_id: str, registry: list[str]) -> dict:
    """Admitted and awaited methods, the page list they answer, and whether the run has ended."""
    known = entries(spark, f"{base.rstrip('/')}/{run_name(run_id)}")
    awaited = sorted(set(registry) - set(known))
    return {"run_id": run_id, "page_list": next((e["page_list"] for e in known.values()), None), "methods_admitted": sorted(known), "methods_awaited": awaited, "ended": bool(known) and not awaited}
