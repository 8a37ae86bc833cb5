"""Queries of streaming variants and plug-in surfaces, with the DuckDB statements of what they amount to."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from foliogrid.functions.scalars import text_status
from foliogrid.operators import changes as CH
from foliogrid.operators import plugins as P
from foliogrid.operators.masks import threshold
from foliogrid.plans.q_ledger import CACHE_APPENDED as ORACLE_RUN5
from foliogrid.plans.q_ledger import CATEGORIES, CATEGORY_DIM, FIRST, NAMES, line_rules, requests
from foliogrid.plans.views import Views, oracle
from foliogrid.streaming import incremental as ST

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return add


@query("str1_incremental_intake", f"SELECT no AS check_no, {NAMES} AS category, count(*) AS n FROM (SELECT {FIRST} AS no FROM lineitem) GROUP BY ALL")
def str1(spark, d):
    out = ST.incremental_intake(ST.table_stream(spark, d, "lineitem"), line_rules(), "l_orderkey")
    return out.groupBy("check_no", "category").agg(F.count(F.lit(1)).alias("n"))


@query("str2_error_counts", f"SELECT category, count(e.event_id) AS n FROM ({CATEGORY_DIM}) LEFT JOIN v_errors e USING (category) GROUP BY 1")
def str2(spark, d):
    s = ST.table_stream(spark, d, "events").select(F.concat(F.lit("c"), F.lpad((F.col("event_id") % 11).cast("string"), 2, "0")).alias("category"))
    return ST.running_error_counts(s, spark.createDataFrame([(c,) for c in CATEGORIES], "category string"))


@query("str3_first_writes", "SELECT user_id, arg_min(event_type || ':' || value, event_id) AS answer FROM (SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS value, event_id FROM events) GROUP BY 1")
def str3(spark, d):
    """The first event of each user; the state of a user goes a month after the last one."""
    s = ST.table_stream(spark, d, "events").select("user_id", "event_id", "ts", F.concat_ws(":", "event_type", F.floor("value").cast("long")).alias("answer"))
    return ST.first_writes(s, "user_id", "event_id", "answer", "ts", timedelta(days=30))


@query("str3_cache_fill", ORACLE_RUN5)
def str3f(spark, d):
    """The batch result of cache appending, from a stream."""
    v, s = Views(spark, d), ST.table_stream(spark, d, "conversations")
    text = F.when(F.col("role") == "system", " ").otherwise(F.col("text"))
    region = F.concat(F.lit("conv-"), "conv_id", F.lit("/"), "turn")
    good = (text_status(text) == "ok") & (F.char_length(text) < 900)
    results = s.select(F.sha2("text", 256).alias("cache_key"), region.alias("seq"), F.concat(F.lit("R:"), region).alias("result"), F.when(good, "ok").otherwise("failed").alias("result_status"))
    return ST.cache_fill(results, v.cache(), "/7")


@query("str4_latest_edits", "SELECT conv_id AS region, arg_max(md5(text), turn) AS edited FROM conversations WHERE role <> 'system' GROUP BY 1")
def str4(spark, d):
    s = ST.table_stream(spark, d, "conversations").select(F.col("conv_id").alias("region"), F.col("turn").alias("seq"), F.md5("text").alias("edited"), (F.col("role") == "system").alias("invalidated"))
    return ST.latest_edits_stream(s)


@query("udf2_pipeline", "SELECT event_type AS image_id, CASE WHEN v > 60 THEN 255 ELSE 0 END AS v, count(*) AS n FROM (SELECT event_type, least(255, floor(value)) AS v FROM events) WHERE v > 10 GROUP BY ALL")
def udf2(spark, d):
    stages = P.compose([lambda df: df.filter("v > 10"), lambda df: threshold(df, 60)])
    return stages(Views(spark, d).pixels()).groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))


@query("udf3_isolated", "SELECT event_id, CASE WHEN value < 1 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN value >= 1 THEN CAST(floor(value) AS BIGINT) END AS whole FROM events")
def udf3(spark, d):
    def whole(rows):
        if (rows["value"] < 1).any():
            raise ValueError("too small")
        return rows.assign(whole=rows["value"].astype("int64"))[["whole"]]

    return P.isolated(Views(spark, d).table("events").select("event_id", "value"), whole, "whole long", "event_id", batched=True).select("event_id", "status", "whole")


@query("udf4_fixture_provider", "SELECT region, CASE WHEN role = 'system' THEN 'skipped' WHEN (c.translated IS NOT NULL AND turn <> 5) OR role = 'user' THEN 'ok' ELSE 'failed' END AS result_status FROM v_requests r LEFT JOIN v_cache c ON c.cache_key = sha256(r.text)")
def udf4(spark, d):
    v = Views(spark, d)
    answers = v.table("conversations").filter("role = 'user'").select(F.sha2("text", 256).alias("cache_key"), F.lit("a").alias("answer")).distinct()
    return CH.enrich(requests(v), v.cache(), P.fixture_provider(answers)).select("region", "result_status")


@query("udf5_recogniser", "SELECT conv_id || '/' || turn AS region, upper(role) AS text, CASE WHEN role <> 'system' THEN 0.5::DOUBLE END AS confidence, 'ok' AS status FROM conversations")
def udf5(spark, d):
    c = Views(spark, d).table("conversations").select(F.concat_ws("/", "conv_id", "turn").alias("region"), F.col("role").alias("payload"))
    return P.recognise(c, lambda s: (s.upper(), float("nan") if s == "system" else 0.5)).drop("error")
