"""Sharding by weighted rendezvous hashing.

Every record has a stable key, its identifier, and every shard draws a number from the digest of key and shard. The
number becomes an exponential waiting time over the shard's weight, and the shard with the shortest wait takes the
record. A shard's draws do not depend on the other shards: one more shard takes only what it wins, and a shard
whose weight changes loses or wins records of its own alone. Nothing is told to the tasks but the weights.

Slots number the rows of a shard without gaps. Rows are sorted by shard and key over sampled ranges, numbered as
they lie, and a table of one row for each shard and range brings the numbers down to zero. No task holds a shard.

Defined results: a null text has no bytes, a size of ``ROW_BYTES`` and the checksum of nothing; repeated identifiers
go to one shard, as the identifier decides, and have slots of their own; rows without an identifier are spread by the
digest of their text; equal texts of different identifiers may part; shards of weight zero or less take nothing; an
empty table gives an empty result; other columns are ignored, or kept by ``write_shards``; long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliogrid.llm.common import free_name, lookup, materialize, table, whole_text

#: Bytes that a row takes beside its text.
ROW_BYTES = 16
#: Hexadecimal digits of a digest that make a draw: 52 bits, exact in a double.
DIGITS = 13


def stable_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The identifier as text; of rows without one, a digest of their text."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(whole_text(text_col))))


def _wait(key: Column, shard: Column, weight: Column) -> Column:
    """How long ``shard`` waits for the record: -ln(u) / weight for a draw u in (0, 1)."""
    drawn = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), shard.cast("string"))), 1, DIGITS), 16, 10).cast("double")
    return -F.ln((drawn + 0.5) / float(16**DIGITS)) / weight


def _winner(key: Column, weights: list[float]) -> Column:
    """``wait, shard`` of the shard that takes the record; of equal waits the smaller shard."""
    live = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a weight")
    shards = F.array(*(F.struct(F.lit(i).alias("shard"), F.lit(w).alias("weight")) for i, w in live))
    return F.array_min(F.transform(shards, lambda s: F.struct(_wait(key, s["shard"], s["weight"]).alias("wait"), s["shard"].alias("shard"))))


def assign_shards(docs: DataFrame, weights: list[float], added: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``id_col, size, text_crc32, law, shard, slot, grown_shard``.

    ``grown_shard`` is the shard with one more of weight ``added`` behind the others.
    """
    text, n = whole_text(text_col), len(weights)
    read = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), stable_key(id_col, text_col).alias("key"))
    won = read.withColumn("won", _winner(F.col("key"), weights))
    grown = F.when(_wait(F.col("key"), F.lit(n), F.lit(float(added))) < F.col("won.wait"), F.lit(n)) if added > 0 else F.lit(None)
    placed = won.select("id", "size", "crc", "key", F.col("won.shard").alias("shard"), F.coalesce(grown, F.col("won.shard")).cast("int").alias("grown"), F.monotonically_increasing_id().alias("row"))
    # rows of one key are told apart by their number, so that ranges split them as well
    ranged = placed.repartitionByRange("shard", "id", "key", "row").sortWithinPartitions("shard", "id", "key", "row").drop("key", "row")
    laid = materialize(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.spark_partition_id()), "shard-rows")
    firsts = laid.groupBy("shard", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    offsets = materialize(_offsets(firsts), "shard-offsets")
    out = laid.join(lookup(offsets, 40), ["shard", "range"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", (F.col("at") - F.col("first") + F.col("before")).alias("slot"), F.col("grown").alias("grown_shard"))


def _offsets(firsts: DataFrame) -> DataFrame:
    """``shard, range, first, before``: the rows of the shard in earlier ranges. There is a row per range and one more per shard at most."""
    earlier = F.expr("aggregate(filter(parts, p -> p.range < one.range), 0L, (s, p) -> s + p.n)")
    parts = firsts.groupBy("shard").agg(F.collect_list(F.struct("range", "first", "n")).alias("parts"))
    return parts.select("shard", "parts", F.explode("parts").alias("one")).select("shard", "one.range", "one.first", earlier.alias("before"))


def write_shards(docs: DataFrame, path: str, weights: list[float], id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all columns of ``docs`` as Parquet into ``path``, a folder for each shard.

    Rows are dealt by ranges of shard and key, so a large shard is written by several tasks and a task writes few shards.
    """
    shard, key = "shard" if "shard" not in {c.lower() for c in docs.columns} else free_name(docs, "shard"), free_name(docs, "key")
    placed = docs.withColumn(key, stable_key(id_col, text_col)).withColumn(shard, _winner(F.col(key), weights)["shard"])
    placed.repartitionByRange(shard, key).drop(key).write.partitionBy(shard).parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), [1.0] * 40)


QUERIES = {"op11_sharding": op11_sharding}
ORACLES = {
    "op11_sharding": """
        WITH bytes AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS body, octet_length(encode(coalesce(text, ''))) + 16 AS size FROM documents),
        draws AS (
            SELECT doc_id, s.shard, ('0x' || substr(md5(doc_id::VARCHAR || '/' || s.shard::VARCHAR), 1, 13))::BIGINT AS draw
            FROM documents, range(41) AS s(shard)),
        best AS (
            SELECT doc_id, arg_max(shard, draw) FILTER (shard < 40) AS shard, arg_max(shard, draw) AS grown_shard FROM draws GROUP BY doc_id),
        steps AS (
            SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS t
            FROM range(256) AS r(b)),
        sums AS (
            SELECT doc_id, size, CASE WHEN body = '' THEN 0 ELSE xor(list_reduce(
                [('0x' || substr(body, 2 * i - 1, 2))::BIGINT FOR i IN range(1, size - 15)],
                lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) END AS text_crc32
            FROM bytes, steps)
        SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard::INTEGER AS grown_shard
        FROM sums JOIN best USING (doc_id)
    """
}
