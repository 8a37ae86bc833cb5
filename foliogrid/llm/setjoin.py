"""Filters of exact set-similarity joins: prefixes of rare words, sizes and places.

Words of a set are ordered from rare to frequent. Two sets of Jaccard similarity t share a word within the first
few of either (prefix), at places after which enough words are left (positional), and their sizes are alike
(length). Frequencies are sums over all words of a hash bucket, one byte each on a logarithmic scale, so that
what the tasks are told has a fixed size. Any order is exact, a better one is faster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of word frequencies: 16 million, a byte each.
SKETCH_BITS = 24


def rarity_sketch(counts: DataFrame) -> Broadcast:
    """Class of frequency by bucket of ``token, n``: 0 for buckets with a single occurrence, up to 255."""
    bucket = F.col("token").bitwiseAND((1 << SKETCH_BITS) - 1).cast("int")
    sums = counts.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).filter("n > 1")
    told = sums.select("bucket", F.least(F.lit(255), F.floor(1 + 4 * F.log2("n"))).cast("short").alias("c")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    out[told["bucket"].to_numpy()] = told["c"].to_numpy()
    return counts.sparkSession.sparkContext.broadcast(out)


#: Counts of a task: the buckets of a part of the sketch that occur, by their low 16 bits, and how often.
PACKED, PART_BITS = "part int, low binary, n binary", 16


def packed_counts(buckets: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each part of the sketch with the counts of its buckets."""
    found, n = np.unique(np.concatenate(buckets), return_counts=True)
    cuts = np.searchsorted(found, np.arange((1 << SKETCH_BITS - PART_BITS) + 1) << PART_BITS)
    binary = lambda x: pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
    columns = [pa.array(np.arange(len(cuts) - 1, dtype=np.int32)), binary(found.astype("<u2")), binary(n.astype("<u4"))]
    return pa.RecordBatch.from_arrays(columns, ["part", "low", "n"])


def packed_sketch(counts: DataFrame) -> Broadcast:
    """``rarity_sketch`` of ``PACKED`` counts: the rows of a part are added up in one array as they come."""

    def run(batches):
        sums = {}
        for batch in batches:
            for part, low, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(low):
                    sums.setdefault(part, np.zeros(1 << PART_BITS, np.int64))[np.frombuffer(low, "<u2")] += np.frombuffer(n, "<u4")
        for part, n in sums.items():
            classes = np.where(n > 1, np.minimum(255, np.floor(1 + 4 * np.log2(np.maximum(n, 1)))), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([classes.tobytes()], pa.binary())], ["part", "classes"])

    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in counts.repartition("part").mapInArrow(run, "part int, classes binary").collect():
        out[row.part << PART_BITS : row.part + 1 << PART_BITS] = np.frombuffer(row.classes, np.uint8)
    return counts.sparkSession.sparkContext.broadcast(out)


def rare_first(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Keys of words that sort from rare to frequent: the class in the high byte, the hash below."""
    return (sketch[tokens & np.uint64((1 << SKETCH_BITS) - 1)].astype(np.uint64) << np.uint64(56)) | (tokens >> np.uint64(8))


def prefix_length(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many words of a set of each size there are of which a similar set has one."""
    return sizes - (sizes * percent + 99) // 100 + 1


def may_match(n: str, i: str, m: str, j: str, percent: int) -> Column:
    """Length and positional filter for sets of n and m words that share a word at places i and j."""
    left = F.least(F.col(n) - F.col(i), F.col(m) - F.col(j))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (left * (100 + percent) >= (F.col(n) + F.col(m)) * percent)


def viable(rows: DataFrame, percent: int) -> DataFrame:
    """Rows ``(token, h, n, i, ...)`` that some other set with the word may match, once each, with ``size`` of all.

    A set of n words that has the word at place i can match sets of at most ``most`` words. Of two sets in order
    of size the smaller must allow the larger: by the best of those before, or by its own bound for the next.
    """
    token = W.partitionBy("token")
    by_size = token.orderBy("n", "h")
    once = rows.withColumn("before", F.lag("h").over(by_size)).filter("before IS NULL OR before <> h").drop("before")
    once = once.withColumn("most", (F.col("n") - F.col("i")) * (100 + percent) - F.col("n") * percent)
    allowed = F.coalesce(F.max("most").over(by_size.rowsBetween(W.unboundedPreceding, -1)) >= F.col("n") * percent, F.lit(False))
    allows = F.coalesce(F.lead("n").over(by_size) * percent <= F.col("most"), F.lit(False))
    return once.withColumns({"near": allowed | allows, "size": F.count(F.lit(1)).over(token)}).filter("near").drop("near", "most")
