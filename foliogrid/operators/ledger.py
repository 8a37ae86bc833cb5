"""Run ledgers: error reports, counters, timings, admissions, scaffolds, ablations and run comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def error_report(errors: DataFrame, categories: DataFrame) -> DataFrame:
    """Count of every known category, zero included; one dense row each."""
    n = errors.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image_id").alias("images"))
    return categories.join(n, "category", "left").fillna(0, ["n", "images"])


def run_counts(samples: DataFrame, keys: list[str]) -> DataFrame:
    """attempted, succeeded and failed per key, and whether they add up."""
    g = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("status").isin("ok", "success", "no_regions")).alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"))
    return g.withColumn("adds_up", F.col("attempted") == F.col("succeeded") + F.col("failed"))


def performance(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Mean seconds over successes (null if none), number of successes and of failures."""
    ok = F.col("status") != "failed"
    return samples.groupBy(*keys).agg(F.avg(F.when(ok, F.col("seconds"))).alias("mean_seconds"), F.count_if(ok).alias("samples"), F.count_if(~ok).alias("failures"))


def varied_settings(configs: DataFrame) -> DataFrame:
    """Settings ``(config, name, value)`` with more than one value over the sweep, values in order of the configs."""
    g = configs.groupBy("name").agg(F.count_distinct("value").alias("distinct_values"), F.sort_array(F.collect_list(F.struct("config", "value"))).alias("vs"))
    return g.filter("distinct_values > 1").select("name", "distinct_values", F.array_join(F.transform("vs", lambda v: v["value"]), ",").alias("value_list"))


def verdict_rollup(checks: DataFrame) -> DataFrame:
    """Availability of each subject: reasons of its failed checks, in order of the checks."""
    bad = F.sort_array(F.collect_list(F.when(~F.col("ok"), F.struct("ord", "reason"))))
    g = checks.groupBy("subject").agg(F.array_join(F.transform(bad, lambda b: b["reason"]), "; ").alias("reason"), F.count_if(~F.col("ok")).alias("failed"))
    return g.withColumn("verdict", F.when(F.col("failed") == 0, "available").otherwise("unavailable"))


def run_status(admissions: DataFrame, methods: DataFrame) -> DataFrame:
    """Per run: admitted and awaited methods, and whether it has ended."""
    known = F.array_sort(F.collect_set("method"))
    got = admissions.groupBy("run_id").agg(known.alias("admitted"))
    every = methods.agg(known.alias("every"))
    out = got.crossJoin(F.broadcast(every)).withColumn("awaited", F.array_sort(F.array_except("every", "admitted")))
    return out.select("run_id", F.array_join("admitted", ",").alias("admitted"), F.array_join("awaited", ",").alias("awaited"), (F.size("awaited") == 0).alias("ended"))


def run_report(admissions: DataFrame, verdicts: DataFrame, methods: DataFrame) -> DataFrame:
    """Every run and method: admitted, or not run with the recorded verdict."""
    grid = admissions.select("run_id").distinct().crossJoin(F.broadcast(methods))
    done = admissions.select("run_id", "method").distinct().withColumn("done", F.lit(True))
    out = grid.join(done, ["run_id", "method"], "left").join(F.broadcast(verdicts.select("method", "verdict")), "method", "left")
    return out.select("run_id", "method", F.when(F.col("done"), "admitted").otherwise(F.coalesce("verdict", F.lit("no verdict"))).alias("state"))


#: Rows that a task gets where a table is dealt by ``parts``.
ROWS_A_TASK = 400_000


def parts(df: DataFrame, rows: int = ROWS_A_TASK) -> int:
    """Partitions for a shuffle of ``df``, so that memory of a task does not grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def close_run(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per run: pages listed, finished and failed, and ``outcome``: closed, unfinished or empty."""
    return closed(manifest.join(pages, ["run_id", "image_id"], "left"))


def closed(listed: DataFrame) -> DataFrame:
    """``close_run`` of listed pages with their ``status``, null for those that have not finished."""
    n = listed.groupBy("run_id").agg(F.count(F.lit(1)).alias("pages"), F.count("status").alias("finished"), F.count_if(F.col("status") == "failed").alias("failed"))
    return n.withColumn("outcome", F.when(F.col("finished") == 0, "empty").when(F.col("finished") < F.col("pages"), "unfinished").otherwise("closed"))


def ablation(configs: DataFrame) -> DataFrame:
    """Configurations numbered config-001 on, with parent and changed settings against the first."""
    order = W.partitionBy("parent_run").orderBy("config")
    numbered = configs.select("parent_run", "config", "settings").withColumn("no", F.row_number().over(order))
    base = numbered.filter("no = 1").select("parent_run", F.col("settings").alias("base"))
    out = numbered.join(base, "parent_run")
    changed = F.filter(F.array_sort(F.map_keys("settings")), lambda k: ~F.element_at(F.col("settings"), k).eqNullSafe(F.element_at(F.col("base"), k)))
    return out.select("parent_run", F.concat(F.lit("config-"), F.lpad(F.col("no").cast("string"), 3, "0")).alias("ablation_id"), (F.col("no") == 1).alias("baseline"), F.array_join(changed, ",").alias("changed"))


def ablation_grid(base: DataFrame, field: str, values: str, kind: str) -> DataFrame:
    """One row per value of a comma-separated list with ``typed`` and ``valid``."""
    v = F.trim("raw")
    return base.withColumn("raw", F.explode(F.split(F.lit(values), ","))).withColumn("field", F.lit(field)).withColumn("typed", F.expr(f"try_cast(trim(raw) AS {kind})").cast("string")).withColumn("valid", F.col("typed").isNotNull() & (v != ""))


def review_scaffold(samples: DataFrame, criteria: DataFrame) -> DataFrame:
    """Successful samples by criterion with an empty rating."""
    return samples.filter("status <> 'failed'").crossJoin(F.broadcast(criteria)).withColumn("rating", F.lit(None).cast("int"))


def run_diff(a: DataFrame, b: DataFrame, keys: list[str], ignore: list[str]) -> DataFrame:
    """Artifacts of either run with ``change``: same, differs, only_a or only_b; volatile fields are ignored."""
    fields = sorted(c for c in a.columns if c not in (*keys, *ignore))
    digest = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    both = a.select(*keys, digest.alias("da")).join(b.select(*keys, digest.alias("db")), keys, "full_outer")
    return both.select(*keys, F.when(F.col("da").isNull(), "only_b").when(F.col("db").isNull(), "only_a").when(F.col("da") == F.col("db"), "same").otherwise("differs").alias("change"))


def verdict_store(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest verdict of each method; rows without environment or reason are refused."""
    sound = new.filter("environment IS NOT NULL AND (verdict = 'available' OR trim(coalesce(reason, '')) <> '')")
    return old.join(sound, "method", "left_anti").unionByName(sound)


def table_identity(df: DataFrame, order: list[str], cols: list[str], groups: list[str]) -> DataFrame:
    """Digest of each group's rows in order; any changed, lost or added row changes it.

    Row digests are ordered by key, so a group is as large as its digests: 64 bytes a row.
    """
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols)), 256)
    listed = df.select(*groups, F.struct(*order, row.alias("d")).alias("s")).groupBy(*groups).agg(F.sort_array(F.collect_list("s")).alias("all"))
    return listed.select(*groups, F.size("all").alias("n_rows"), F.sha2(F.array_join(F.transform("all", lambda s: s["d"]), ","), 256).alias("identity"))
