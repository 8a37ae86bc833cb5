"""Views over the driver tables that stand for page catalogues, masks, metrics, boxes and ledgers.

Each view has a DataFrame and a DuckDB definition; ``oracle`` puts the definitions a statement names before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliogrid.functions import scalars as S

#: method -> DuckDB condition on documents; the DataFrame side takes the same text, as Spark reads it alike.
METHODS = {"adaptive": "n_chars < 500", "components": "n_chars >= 3000", "edges": "lang <> 'en'", "otsu": "doc_id % 2 = 1"}

VIEW_SQL = {
    "v_pages": "SELECT doc_id, source AS manga, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS stem, source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS image_id, n_chars, lang FROM documents",
    "v_masks": "SELECT l.doc_id, CASE WHEN l.toxic = 1 THEN 'alt-' || p.manga ELSE p.manga END AS manga, p.stem, l.quality, l.toxic FROM labels l JOIN v_pages p USING (doc_id)",
    "v_truth": "SELECT d.doc_id, d.source AS manga, d.lang AS stem, d.n_chars, coalesce(l.toxic, 0) = 1 AS truth FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)",
    "v_pred": " UNION ALL ".join(f"SELECT '{m}' AS method, doc_id, source AS manga, lang AS stem, ({c}) AS predicted FROM documents" for m, c in METHODS.items()),
    "v_conf": "SELECT p.method, p.manga, p.stem, count(*) AS n, count(*) FILTER (t.truth AND p.predicted) AS tp, count(*) FILTER (p.predicted AND NOT t.truth) AS fp, count(*) FILTER (t.truth AND NOT p.predicted) AS fn FROM v_pred p JOIN v_truth t USING (doc_id) GROUP BY ALL",
    "v_m0": "SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p0, CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS r0, CASE WHEN tp + fp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp + fn) END AS i0 FROM v_conf",
    "v_metrics": "SELECT method, manga, stem, manga || '/' || stem AS image_id, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE i0 END AS iou, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE p0 END AS \"precision\", CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE r0 END AS recall, CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN p0 + r0 = 0 THEN 0.0 ELSE 2 * p0 * r0 / (p0 + r0) END AS f1, tp, fp, fn, n / 1000.0 AS inference_time_seconds FROM v_m0",
    "v_failures": "SELECT DISTINCT m.method, m.image_id, 'stage-' || m.stem AS stage, 'no overlap' AS reason FROM v_metrics m WHERE m.tp = 0 AND m.fn > 0",
    "v_boxes": "SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS label, l_partkey % 100 AS x, l_suppkey % 10 * 10 AS y, CAST(l_quantity AS BIGINT) AS w, CAST(l_linenumber AS BIGINT) * 3 AS h, CAST(l_quantity AS BIGINT) * l_linenumber * 3 // 2 AS area, l_returnflag AS flag FROM lineitem",
    "v_pixels": "SELECT event_type AS image_id, event_id AS pixel, CAST(least(255, floor(value)) AS INTEGER) AS v FROM events",
    "v_ink": "SELECT DISTINCT event_type AS kind, 'u' || user_id AS image_id, dayofyear(ts) AS y, hour(ts) AS x FROM events",
    "v_requests": "SELECT conv_id, turn, role, text, 'conv-' || conv_id || '/' || turn AS region, role AS lang FROM conversations",
    "v_cache": "SELECT DISTINCT sha256(text) AS cache_key, 'T:' || md5(text) AS translated FROM conversations WHERE role = 'assistant'",
    "v_errors": "SELECT event_id, 'u' || user_id AS image_id, event_type AS method, 'c' || lpad(CAST(event_id % 11 AS VARCHAR), 2, '0') AS category, 'value ' || floor(value) AS reason, value, ts FROM events",
}


def oracle(sql: str) -> str:
    """The statement with the views it needs as common table expressions."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in VIEW_SQL:
            if re.search(rf"\b{name}\b", text) and name not in need:
                add(VIEW_SQL[name])
                need.append(name)

    add(sql)
    if not need:
        return sql
    ctes = ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in need)
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH {m[1] or ''}{ctes}, {sql[m.end():]}" if m else f"WITH {ctes} {sql}"


class Views:
    """The views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def pages(self) -> DataFrame:
        d = self.table("documents").select("doc_id", F.col("source").alias("manga"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("stem"), "n_chars", "lang")
        return d.withColumn("image_id", S.image_id("manga", "stem"))

    def masks(self) -> DataFrame:
        page = self.pages().select("doc_id", F.col("manga").alias("m"), "stem")
        manga = F.when(F.col("toxic") == 1, F.concat(F.lit("alt-"), F.col("m"))).otherwise(F.col("m"))
        return self.table("labels").join(page, "doc_id").select("doc_id", manga.alias("manga"), "stem", "quality", "toxic")

    def truth(self) -> DataFrame:
        toxic = self.table("labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        d = self.table("documents").select("doc_id", F.col("source").alias("manga"), F.col("lang").alias("stem"), "n_chars")
        return d.join(toxic, "doc_id", "left").select("doc_id", "manga", "stem", "n_chars", (F.coalesce("toxic", F.lit(0)) == 1).alias("truth"))

    def predictions(self) -> DataFrame:
        """One row per document and method, from one scan."""
        d = self.table("documents").select("doc_id", "source", "lang", "n_chars")
        each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.expr(c).alias("predicted")) for m, c in METHODS.items())))
        return d.select("doc_id", F.col("source").alias("manga"), F.col("lang").alias("stem"), each.alias("e")).select("e.method", "doc_id", "manga", "stem", "e.predicted")

    def metrics(self) -> DataFrame:
        from foliogrid.operators import metrics as M

        scored = M.confusion_by_key(self.predictions(), self.truth().select("doc_id", "truth"), "doc_id", ["method", "manga", "stem"])
        return M.with_scores(scored).select("method", "manga", "stem", S.image_id("manga", "stem").alias("image_id"), "iou", "precision", "recall", "f1", "tp", "fp", "fn", (F.col("n") / 1000.0).alias("inference_time_seconds"))

    def failures(self) -> DataFrame:
        m = self.metrics().filter("tp = 0 AND fn > 0")
        return m.select("method", "image_id", F.concat(F.lit("stage-"), "stem").alias("stage"), F.lit("no overlap").alias("reason")).distinct()

    def boxes(self) -> DataFrame:
        from pyspark.sql import Window as W

        order = W.partitionBy("page").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
        q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
        # numbered under its name first: the rows are then known to be dealt by page, and what is made of their columns is not shuffled
        lines = self.table("lineitem").withColumnRenamed("l_orderkey", "page").withColumn("label", F.row_number().over(order).cast("long"))
        return lines.select(
            "page", "label", (F.col("l_partkey") % 100).alias("x"), (F.col("l_suppkey") % 10 * 10).alias("y"),
            q.alias("w"), (n * 3).alias("h"), F.floor(q * n * 3 / 2).cast("long").alias("area"), F.col("l_returnflag").alias("flag"),
        )

    def pixels(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("image_id"), F.col("event_id").alias("pixel"), F.least(F.lit(255), F.floor("value")).cast("int").alias("v"))

    def ink(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("kind"), F.concat(F.lit("u"), "user_id").alias("image_id"), F.dayofyear("ts").alias("y"), F.hour("ts").alias("x")).distinct()

    def requests(self) -> DataFrame:
        return self.table("conversations").select("conv_id", "turn", "role", "text", F.concat(F.lit("conv-"), "conv_id", F.lit("/"), "turn").alias("region"), F.col("role").alias("lang"))

    def cache(self) -> DataFrame:
        c = self.table("conversations").filter("role = 'assistant'")
        return c.select(F.sha2("text", 256).alias("cache_key"), F.concat(F.lit("T:"), F.md5("text")).alias("translated")).distinct()

    def errors(self) -> DataFrame:
        return self.table("events").select(
            "event_id", F.concat(F.lit("u"), "user_id").alias("image_id"), F.col("event_type").alias("method"), F.concat(F.lit("c"), F.lpad((F.col("event_id") % 11).cast("string"), 2, "0")).alias("category"),
            F.concat(F.lit("value "), F.floor("value").cast("double").cast("string")).alias("reason"), "value", "ts",
        )
