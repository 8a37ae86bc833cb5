"""Ranks, running counts and exact quantiles of groups of any size.

Values are counted, so that equal ones are one row, and sorted over sampled ranges of group and value. A table with a
row for each group and range carries the counts across ranges; within a range they are summed as the rows pass. A group may
span any number of ranges, so no task and no buffer holds a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliogrid.functions.storage import materialize


#: Rows of the table that carries sums across ranges, up to which it is broadcast: one for each key and range.
FEW = 100_000


def _within_range(keys: int, sums: list[str]):
    """Adds to sorted rows the sums of the rows of their key before them, as far as those are in the same partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, [0] * len(sums)
        for batch in batches:
            if not batch.num_rows:
                continue
            named = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True)) if keys else [()] * batch.num_rows
            new = np.fromiter((k != p for k, p in zip(named, [last, *named], strict=False)), bool, len(named))
            # where the key of each row began: behind the rows of this batch, or before it
            start = np.maximum.accumulate(np.where(new, np.arange(len(named)), -1))
            out = []
            for i, c in enumerate(sums):
                v = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                upto = np.concatenate([[0], np.cumsum(v)])
                before = upto[:-1] - np.where(start < 0, -carry[i], upto[np.maximum(start, 0)])
                carry[i] = before[-1] + v[-1]
                out.append(pa.array(before, batch.schema.field(c).type))
            last = named[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, *(f"local_{c}" for c in sums)])

    return run


def running_sums(counts: DataFrame, keys: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """Adds for each of ``sums`` ``before_<c>``, its sum over the rows of the key that come earlier in ``order``, and ``all_<c>``, over all of them.

    ``order`` has to tell the rows of a key apart.
    """
    ranged = counts.select(*keys, *(c for c in counts.columns if c not in keys)).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__range", F.spark_partition_id())
    local = T.StructType([*ranged.schema.fields, *(T.StructField(f"local_{c}", ranged.schema[c].dataType) for c in sums)])
    laid = materialize(ranged.mapInArrow(_within_range(len(keys), sums), local), "ranks")
    totals = laid.groupBy(*keys, "__range").agg(*(F.sum(c).alias(f"total_{c}") for c in sums))
    line = W.partitionBy(*keys)
    earlier = line.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    carried = [x for c in sums for x in (F.coalesce(F.sum(f"total_{c}").over(earlier), F.lit(0)).alias(f"offset_{c}"), F.sum(f"total_{c}").over(line).alias(f"all_{c}"))]
    offsets = materialize(totals.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__range").alias("__r"), *carried), "rank-offsets")
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = laid.join(F.broadcast(offsets) if offsets.count() <= FEW else offsets, same)
    return out.select(*counts.columns, *((F.col(f"local_{c}") + F.col(f"offset_{c}")).alias(f"before_{c}") for c in sums), *(f"all_{c}" for c in sums))


def _features(df: DataFrame, keys: list[str], features: dict[str, Column]) -> DataFrame:
    """``keys, feature, v``: a row for each value that is not null."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), c.cast("double").alias("v")) for n, c in features.items())))
    return df.select(*keys, each.alias("__e")).select(*keys, "__e.feature", "__e.v").filter("v IS NOT NULL")


def exact_quantiles(df: DataFrame, keys: list[str], features: dict[str, Column], points: tuple[float, ...]) -> DataFrame:
    """``keys, feature, p<percent>...`` with linear interpolation between neighbours; nulls do not count.

    A group without values has no row.
    """
    by = [*keys, "feature"]
    counts = _features(df, keys, features).groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sums(counts, by, ["v"], ["n"])
    name = lambda p: f"p{p * 100:g}".replace(".", "_")
    holds = lambda k: (F.col("before_n") <= k) & (k < F.col("before_n") + F.col("n"))
    parts = []
    for p in points:
        at = F.lit(float(p)) * (F.col("all_n") - 1)
        parts += [F.max(F.when(holds(f(at)), F.col("v"))).alias(f"{name(p)}_{e}") for e, f in (("lo", F.floor), ("hi", F.ceil))]
    ends = ranked.groupBy(*by).agg(F.first("all_n").alias("total"), *parts)

    def value(p: float) -> Column:
        at = F.lit(float(p)) * (F.col("total") - 1)
        lo, hi = F.col(f"{name(p)}_lo"), F.col(f"{name(p)}_hi")
        return (lo + (hi - lo) * (at - F.floor(at))).alias(name(p))

    return ends.select(*by, *(value(p) for p in points))


def wide_quantiles(df: DataFrame, keys: list[str], features: dict[str, Column], points: dict[str, float], name: str) -> DataFrame:
    """One row a key: for each feature and point a column, named by ``name`` with ``{feature}`` and ``{point}``."""
    found = exact_quantiles(df, keys, features, tuple(points.values()))
    column = lambda p: f"p{p * 100:g}".replace(".", "_")
    picks = [F.max(F.when(F.col("feature") == f, F.col(column(p)))).alias(name.format(feature=f, point=n)) for f in features for n, p in points.items()]
    return found.groupBy(*keys).agg(*picks)
