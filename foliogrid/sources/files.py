"""Readers of page trees, images, metric tables and record files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

METRICS = "manga string, stem string, method string, iou double, precision double, recall double, f1 double, tp bigint, fp bigint, fn bigint, inference_time_seconds double"


def discover(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".png", ".jpg", ".jpeg")) -> DataFrame:
    """``manga, stem, ext, path, length`` of files two levels below ``root``, in order; empty if there are none.

    Only the listing is read: file contents are not a column of the plan.
    """
    schema = "manga string, stem string, ext string, path string, length bigint"
    try:
        files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*").select("path", "length")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    plain = re.sub(r"^[A-Za-z0-9+.-]+:(//[^/]*)?", "", root).rstrip("/")
    part = lambda i: F.regexp_extract("path", rf"\Q{plain}\E/([^/]+)/([^/]+?)(\.[^./]*)?$", i)
    out = files.select(part(1).alias("manga"), part(2).alias("stem"), part(3).alias("ext"), "path", "length")
    return out.filter((F.col("manga") != "") & F.lower("ext").isin(*suffixes)).orderBy("manga", "stem")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images with ``manga, stem, corrupt``; undecodable files stay as rows."""
    images = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    part = lambda i: F.regexp_extract("origin", r"([^/]+)/([^/]+?)(\.[^./]*)?$", i)
    return images.select(part(1).alias("manga"), part(2).alias("stem"), "height", "width", "nChannels", "data", (F.col("height") == -1).alias("corrupt"))


def to_pixels(images: DataFrame) -> DataFrame:
    """``image_id, y, x, v`` of sound images; colour is turned to grey by the usual luma weights."""
    import numpy as np
    import pyarrow as pa

    sound = images.filter("NOT corrupt").select(F.concat_ws("/", "manga", "stem").alias("image_id"), "height", "width", "nChannels", "data")

    def run(batches):
        for batch in batches:
            for name, h, w, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(data, np.uint8).reshape(h, w, n)
                grey = raw[:, :, 0] if n == 1 else np.rint(raw[:, :, :3] @ np.array([0.114, 0.587, 0.299]))
                rows = max(1, 1_000_000 // w)
                for top in range(0, h, rows):
                    part = grey[top : top + rows]
                    y, x = np.indices(part.shape, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * part.size), pa.array((y + top).ravel()), pa.array(x.ravel()), pa.array(part.astype(np.int32).ravel())], ["image_id", "y", "x", "v"])

    return sound.mapInArrow(run, "image_id string, y int, x int, v int")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric table with ``stem`` as text; NaN becomes null, so that means skip it."""
    m = spark.read.schema(METRICS).option("header", True).csv(path)
    return m.withColumns({c: F.nanvl(c, F.lit(None)) for c, t in m.dtypes if t == "double"})


def read_sidecars(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON records with ``image_id`` from their path; a malformed file is a row with null fields and its text."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.withColumn("image_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)\.json$", 1))


FAILURE = "struct<image_id:string,error:string,stage:string,reason:string>"


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Failure entries of documents that are a list, or an object with ``errors``; null is empty."""
    docs = spark.read.option("wholetext", True).text(path).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("method"))
    body = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.col("value")).otherwise(F.get_json_object("value", "$.errors"))
    return docs.select("method", F.explode(F.from_json(body, f"array<{FAILURE}>")).alias("e")).select("method", "e.*")


def read_identity(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, sha256, size_bytes`` of a JSON object keyed by image id."""
    docs = spark.read.option("wholetext", True).text(path)
    known = F.from_json("value", "map<string,struct<sha256:string,size_bytes:bigint>>")
    return docs.select(F.explode(known).alias("image_id", "v")).select("image_id", "v.sha256", "v.size_bytes")


def content_sha256(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256, size_bytes`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))
