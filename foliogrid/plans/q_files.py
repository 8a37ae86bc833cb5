"""Queries of readers and writers: the given tables go out as page trees and reports, and come back.

Every tree lies in a new folder of the cluster's shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliogrid.functions.storage import materialize, shared_dir
from foliogrid.operators import plugins as P
from foliogrid.operators.gates import Rule
from foliogrid.operators.masks import threshold
from foliogrid.operators.metrics import confusion_by_key
from foliogrid.plans.q_core import rounded
from foliogrid.plans.views import Views, oracle
from foliogrid.sources import admission, files, sinks

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name] = fn
        ORACLES[name] = oracle(sql)
        return fn

    return add


def folder(spark, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, value: Column, *keys: str, label: str = "tree") -> str:
    """One text file for each key, in a folder named ``key=value``, that holds the key's one row."""
    path = folder(df.sparkSession, label)
    df.select(*keys, value.alias("value")).repartition(*keys).write.partitionBy(*keys).text(path)
    return path


def by_source(v: Views) -> DataFrame:
    """``manga, body``: a line of facts about the documents of each source."""
    return v.pages().groupBy("manga").agg(F.concat_ws(":", F.count(F.lit(1)), F.sum("n_chars")).alias("body"))


BODIES = "SELECT manga, count(*) || ':' || sum(n_chars) AS body FROM v_pages GROUP BY 1"


@query("src1_discover", f"SELECT manga, '.txt' AS ext, CAST(length(body) + 1 AS BIGINT) AS length FROM ({BODIES})")
def src1(spark, d):
    found = files.discover(spark, written(by_source(Views(spark, d)), F.col("body"), "manga"), (".txt",))
    return found.select(F.substring_index("manga", "=", -1).alias("manga"), "ext", "length")


@query("fn1_content_sha256", f"SELECT manga, sha256(body || chr(10)) AS sha256, CAST(length(body) + 1 AS BIGINT) AS size_bytes FROM ({BODIES})")
def fn1(spark, d):
    root = written(by_source(Views(spark, d)), F.col("body"), "manga")
    found = files.content_sha256(spark, f"{root}/*/*.txt")
    return found.select(F.regexp_extract("path", r"manga=([^/]+)/", 1).alias("manga"), "sha256", "size_bytes")


INK_IMAGES = "SELECT DISTINCT kind, hour // 7 * 8 + 1 + hour % 7 AS x, day - 1 AS y FROM (SELECT event_type AS kind, dayofyear(ts) AS day, hour(ts) AS hour FROM events WHERE value > 20)"


def bitmaps(v: Views) -> DataFrame:
    """``manga, body``: bitmap files of 32 x 30 pixels, an hour of a day each, seven to a byte; one file is no image."""
    e = v.table("events").filter("value > 20")
    bits = e.select(F.col("event_type").alias("manga"), F.dayofyear("ts").alias("day"), F.hour("ts").alias("hour")).distinct()
    bits = bits.groupBy("manga", "day", F.floor(F.col("hour") / 7).alias("byte")).agg(F.sum(F.lit(1) * F.pow(F.lit(2), 6 - F.col("hour") % 7)).cast("int").alias("b"))
    held = bits.groupBy("manga").agg(F.map_from_entries(F.collect_list(F.struct((F.col("day") * 4 + F.col("byte")).cast("int"), "b"))).alias("m"))
    # as all bytes are below 128, the file is text too: type, header, width and height come first
    cells = F.transform(F.sequence(F.lit(4), F.lit(123)), lambda i: F.char(F.coalesce(F.element_at("m", i), F.lit(0)).cast("long")))
    head = F.concat(*(F.decode(F.unhex(F.lit(h)), "UTF-8") for h in ("00", "00", "20", "1E")))
    zero = F.decode(F.unhex(F.lit("00")), "UTF-8")
    body = F.concat(head, F.array_join(F.transform(cells, lambda c: F.when(c == "", zero).otherwise(c)), ""))
    return held.select("manga", body.alias("body")).union(v.table("events").agg(F.lit("zz-broken"), F.count(F.lit(1)).cast("string")))


@query("src2_read_images", "SELECT kind AS manga, 30 AS height, 32 AS width, false AS corrupt FROM (SELECT DISTINCT event_type AS kind FROM events WHERE value > 20) UNION ALL SELECT 'zz-broken', -1, -1, true")
def src2(spark, d):
    images = files.read_images(spark, written(bitmaps(Views(spark, d)), F.col("body"), "manga") + "/*")
    return images.select(F.substring_index("manga", "=", -1).alias("manga"), "height", "width", "corrupt")


@query("src3_to_pixels", f"SELECT kind AS manga, y, x FROM ({INK_IMAGES})")
def src3(spark, d):
    images = files.read_images(spark, written(bitmaps(Views(spark, d)), F.col("body"), "manga") + "/*")
    light = files.to_pixels(images).filter("v > 127")
    return light.select(F.regexp_extract("image_id", "manga=([^/]+)/", 1).alias("manga"), "y", "x")


METRIC_COLUMNS = ["manga", "stem", "method", "iou", "precision", "recall", "f1", "tp", "fp", "fn", "inference_time_seconds"]


@query("src5_read_metrics", "SELECT manga, stem, method, round(iou, 9) AS iou, CASE WHEN tp = 0 THEN NULL ELSE round(f1, 9) END AS f1, tp, fp, fn FROM (SELECT manga, '007' || ascii(stem) || length(stem) || ascii(substr(stem, 2)) AS stem, method, iou, f1, tp, fp, fn FROM v_metrics)")
def src5(spark, d):
    """Stems stay text with their zeros; NaN comes back as null."""
    m = Views(spark, d).metrics()
    stem = F.concat(F.lit("007"), F.ascii("stem"), F.length("stem"), F.ascii(F.substring("stem", 2, 9)))
    path = folder(spark, "metrics")
    sinks.write_table(m.withColumns({"stem": stem, "f1": F.when(F.col("tp") == 0, F.lit(float("nan"))).otherwise(F.col("f1"))}), path, METRIC_COLUMNS, ["manga", "stem", "method"])
    return rounded(files.read_metrics(spark, path), "iou", "f1").select("manga", "stem", "method", "iou", "f1", "tp", "fp", "fn")


SIDECAR = T.StructType([T.StructField("tp", T.LongType()), T.StructField("device", T.StructType([T.StructField("type", T.StringType())]))])


@query("src6_read_sidecars", "SELECT method, manga, stem, CASE WHEN fn % 5 > 0 THEN tp END AS tp, CASE WHEN fn % 5 > 0 THEN 'cpu' END AS device, fn % 5 = 0 AS malformed FROM v_metrics")
def src6(spark, d):
    """A record for each scored page; every one whose number of misses five divides is cut short."""
    m = Views(spark, d).metrics()
    body = F.to_json(F.struct("tp", F.struct(F.lit("cpu").alias("type")).alias("device")))
    root = written(m, F.when(F.col("fn") % 5 == 0, F.substring(body, 1, 9)).otherwise(body), "method", "manga", "stem")
    got = files.read_sidecars(spark, root, SIDECAR)
    return got.select("method", "manga", "stem", "tp", F.col("device.type").alias("device"), F.col("_corrupt_record").isNotNull().alias("malformed"))


@query("src7_read_failures", "SELECT method, image_id, stage, reason FROM v_failures")
def src7(spark, d):
    """Failures of each method as a list, or as an object; one object has none."""
    f = Views(spark, d).failures()
    each = f.groupBy("method").agg(F.to_json(F.collect_list(F.struct("image_id", "stage", "reason"))).alias("list"))
    body = F.when(F.length("method") % 2 == 0, F.col("list")).otherwise(F.concat(F.lit('{"errors":'), "list", F.lit("}")))
    none = f.agg(F.lit("none").alias("method"), F.concat(F.lit('{"n":'), F.count(F.lit(1)), F.lit(',"errors":null}')).alias("body"))
    got = files.read_failures(spark, written(each.select("method", body.alias("body")).union(none), F.col("body"), "method") + "/*")
    return got.select(F.substring_index("method", "=", -1).alias("method"), "image_id", "stage", "reason")


def identity(v: Views) -> DataFrame:
    """``manga, part, body``: what is known of each source's pages, as objects of a thousand pages keyed by image."""
    pages = v.table("documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text")).join(v.pages().select("doc_id", "image_id"), "doc_id")
    entry = F.struct("image_id", F.struct(F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size_bytes")))
    return pages.groupBy(F.col("source").alias("manga"), F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("body"))


@query("src8_read_identity", "SELECT p.image_id, sha256(coalesce(text, '')) AS sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes FROM documents JOIN v_pages p USING (doc_id)")
def src8(spark, d):
    return files.read_identity(spark, written(identity(Views(spark, d)), F.col("body"), "manga", "part") + "/*/*")


@query("snk1_write_table", "SELECT 'manga,stem,method,tp,fp,fn' AS line UNION ALL SELECT manga || ',' || stem || ',' || method || ',' || tp || ',' || fp || ',' || fn FROM v_metrics")
def snk1(spark, d):
    """The lines of a written report."""
    path = folder(spark, "table")
    sinks.write_table(Views(spark, d).metrics(), path, ["manga", "stem", "method", "tp", "fp", "fn"], ["manga", "stem", "method"])
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("snk2_write_json", "SELECT '{\"method\":\"' || method || '\",\"pages\":' || count(*) || ',\"tp\":' || sum(tp) || ',\"note\":null}' AS line FROM v_metrics GROUP BY method")
def snk2(spark, d):
    path = folder(spark, "json")
    by = Views(spark, d).metrics().groupBy("method").agg(F.count(F.lit(1)).alias("pages"), F.sum("tp").alias("tp")).withColumn("note", F.lit(None).cast("string"))
    sinks.write_json(by, path, ["method"])
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("snk3_write_run", "SELECT method AS run_id, image_id, tp FROM v_metrics WHERE method <> 'otsu' UNION ALL SELECT method, image_id, tp + 1 FROM v_metrics WHERE method = 'otsu'")
def snk3(spark, d):
    """Each method is a run; writing one again changes it alone."""
    base, m = folder(spark, "runs"), materialize(Views(spark, d).metrics(), "run-metrics")
    for name in ("adaptive", "components", "edges", "otsu"):
        sinks.write_run(m.filter(F.col("method") == name).select("image_id", "tp"), base, name)
    sinks.write_run(m.filter("method = 'otsu'").select("image_id", F.col("tp") + 1).toDF("image_id", "tp"), base, "otsu", overwrite=True)
    return spark.read.parquet(base).select("run_id", "image_id", "tp")


@query("snk5_verify_bundle", f"SELECT manga AS image_id, CASE WHEN length(manga) % 3 = 0 THEN 'altered' WHEN length(manga) % 3 = 1 THEN 'unlisted' END AS finding FROM ({BODIES}) WHERE length(manga) % 3 < 2 UNION ALL SELECT 'gone-' || manga, 'missing' FROM ({BODIES})")
def snk5(spark, d):
    """A list that lacks some files, has other contents for some, and names files that are not there."""
    known = by_source(Views(spark, d))
    found = files.content_sha256(spark, written(known, F.col("body"), "manga") + "/*/*.txt")
    listed = known.filter(F.length("manga") % 3 != 1).select(F.col("manga").alias("image_id"), F.sha2(F.concat("body", F.when(F.length("manga") % 3 == 0, "?").otherwise("\n")), 256).alias("sha256"))
    gone = known.select(F.concat(F.lit("gone-"), "manga"), F.sha2("body", 256))
    return sinks.verify_bundle(listed.union(gone), found.select(F.regexp_extract("path", r"manga=([^/]+)/", 1).alias("image_id"), "sha256"))


@query("snk6_export_page", "SELECT 'metrics' AS fact, image_id, count(*) AS n FROM v_metrics WHERE image_id = (SELECT min(image_id) FROM v_metrics) GROUP BY 2 UNION ALL SELECT 'failures', image_id, count(*) FROM v_failures WHERE image_id = (SELECT min(image_id) FROM v_metrics) GROUP BY 2")
def snk6(spark, d):
    v, base = Views(spark, d), folder(spark, "export")
    facts = {"metrics": v.metrics(), "failures": v.failures()}
    sinks.export_page(facts, facts["metrics"].agg(F.min("image_id")).first()[0], base, f"{base}-runs")
    back = [spark.read.parquet(f"{base}/{name}").groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fact"), "image_id", "n") for name in facts]
    return back[0].union(back[1])


HANDOFFS = {"adaptive": ("true", "false"), "components": ("doc_id % 97 <> 5", "false"), "edges": ("true", "false"), "otsu": ("true", "n_chars % 7 = 0")}
HANDOFF = " UNION ALL ".join(f"SELECT method, p.doc_id, CASE WHEN {odd} THEN 128 WHEN predicted THEN 255 ELSE 0 END AS value FROM v_pred p JOIN documents d USING (doc_id) WHERE method = '{m}' AND {kept}" for m, (kept, odd) in HANDOFFS.items())


@query("run1_admit", f"WITH h AS ({HANDOFF}), c AS (SELECT m.method, CASE WHEN (SELECT count(DISTINCT doc_id) FROM documents) > count(DISTINCT h.doc_id) THEN 'missing_page' WHEN count(*) > count(DISTINCT h.doc_id) THEN 'repeated_page' WHEN count(*) FILTER (value NOT IN (0, 255)) > 0 THEN 'non_binary_mask' END AS refused FROM (SELECT DISTINCT method FROM v_pred) m LEFT JOIN h ON h.method = m.method GROUP BY 1), g AS (SELECT doc_id, max(toxic) = 1 AS truth FROM labels GROUP BY 1) SELECT c.method, refused, count(h.doc_id) AS pages, count(*) FILTER (value = 255 AND coalesce(truth, false)) AS tp, count(*) FILTER (value = 255 AND NOT coalesce(truth, false)) AS fp, count(*) FILTER (value = 0 AND coalesce(truth, false)) AS fn, (SELECT string_agg(method, ',' ORDER BY method) FROM c a WHERE a.refused IS NOT NULL) AS awaited FROM c LEFT JOIN h ON h.method = c.method AND refused IS NULL LEFT JOIN g ON g.doc_id = h.doc_id GROUP BY 1, 2")
def run1(spark, d):
    """Hand-offs of four methods: those whose gate finds nothing are scored and seen, the others name their first fault.

    One is admitted again, which changes nothing, and one again with other masks, which is refused.
    """
    v, base = Views(spark, d), folder(spark, "admit")
    pages = v.table("documents").select(F.col("doc_id").cast("string").alias("image_id"))
    truth = v.truth().select(F.col("doc_id").cast("string").alias("image_id"), "truth")
    facts = v.predictions().join(v.table("documents").select("doc_id", "n_chars"), "doc_id")
    score = lambda s: confusion_by_key(s.select("image_id", (F.col("value") == 255).alias("predicted")), truth, "image_id", [])
    rules, refused = [Rule("non_binary_mask", ~F.col("value").isin(0, 255), "values between")], {}

    def handoff(name: str) -> DataFrame:
        kept, odd = HANDOFFS[name]
        value = F.when(F.expr(odd), 128).when(F.col("predicted"), 255).otherwise(0)
        return facts.filter(F.col("method") == name).filter(kept).select(F.col("doc_id").cast("string").alias("image_id"), value.alias("value"))

    tries = [(n, handoff(n)) for n in HANDOFFS] + [("adaptive", handoff("adaptive")), ("edges", handoff("edges").withColumn("value", F.lit(0)))]
    for name, samples in tries:
        try:
            admission.admit(samples, pages, rules, score, base, "run-1", name)
        except admission.Refused as no:
            refused.setdefault(name, no.category)
    if refused.pop("edges", None) != "admitted_already":
        raise AssertionError("other masks of an admitted method were taken")
    record = admission.run_record(spark, base, "run-1", list(HANDOFFS))
    seen = admission.read_fact(spark, base, "run-1", "scores").select("method", F.lit(None).cast("string").alias("refused"), F.col("n").alias("pages"), "tp", "fp", "fn")
    none = spark.createDataFrame([(m, why, 0, 0, 0, 0) for m, why in refused.items()], "method string, refused string, pages long, tp long, fp long, fn long")
    return seen.union(none).withColumn("awaited", F.lit(",".join(record["methods_awaited"])))


@query("udf1_registry", "SELECT method, image_id, v, count(*) AS n FROM (SELECT 'bright' AS method, event_type AS image_id, CASE WHEN least(255, floor(value)) > 90 THEN 255 ELSE 0 END AS v FROM events UNION ALL SELECT 'dark', event_type, CASE WHEN least(255, floor(value)) > 30 THEN 255 ELSE 0 END FROM events) GROUP BY ALL")
def udf1(spark, d):
    """Every registered method of this query on the pixels, by name."""
    pixels, out = Views(spark, d).pixels(), []
    for name, at in (("dark", 30), ("bright", 90)):
        if name not in P.available():
            P.register_method(name, lambda df, at=at: threshold(df, at))
    for name in ("bright", "dark"):
        out.append(P.create(name)(pixels).groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("method"), "image_id", "v", "n"))
    return out[0].union(out[1])
