"""Packing of token sequences into fixed windows by best-fit decreasing.

Documents are tokenised once, where they lie. An overlong document is cut into full windows and one rest, so
its pieces need no other document. Best fit then depends on the piece lengths alone: the plan is made from
their histogram (as many entries as the window has tokens, whatever the input), in descending length, with a
segment tree over remaining capacities that finds the tightest open window. The plan gives ranges of windows
to ranges of ranks; each piece finds its own by rank within its length. Ranks come from counts per
(length, shard), so a length that holds a third of all pieces is still numbered by many tasks.

Defined results: a null or empty text is the end-of-document id alone; equal lengths are ordered by shard and
identifier; a repeated row is packed as often as it occurs; an empty table gives no piece; other columns are
ignored.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliogrid.llm.common import materialize, salt_of, table

WINDOW = 1024
END_ID = 0
#: White-space characters in a row from which a text goes to the slower encoder.
LONG_SPACE = 20_000


def default_vocabulary() -> str:
    """The rank file of the 50k byte-level vocabulary; its ids are those of the .json file beside it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level tokenizer of a rank file. It yields the ids of the .json file three times as fast.

    The added tokens of the .json file are whole tokens wherever a text has them: ``encode`` with ``"all"`` allowed.
    """
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(f"{os.path.splitext(path)[0]}.json", encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=2)
def plain_encoder(path: str):
    """The tokenizer of the .json file beside a rank file: slower, but without limits."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(f"{os.path.splitext(path)[0]}.json")


def token_ids(text: str, path: str) -> list[int]:
    """Ids of one text. The fast encoder overflows its stack on very long stretches of white space, the other does not."""
    if len(text) > LONG_SPACE and re.search(rf"\s{{{LONG_SPACE}}}", text):
        return plain_encoder(path).encode(text, add_special_tokens=False).ids
    return encoder(path).encode(text, allowed_special="all")


def cut_pieces(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces ``id_col, start, length, ids_crc32, doc_tokens``: full windows and the rest of each document."""
    vocabulary = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [[] for _ in range(5)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = array("I", token_ids(text or "", vocabulary))
                ids.append(END_ID)
                n, view = len(ids), memoryview(ids)
                for start in range(0, n, window):
                    part = view[start : start + window]
                    for column, value in zip(rows, (key, start, len(part), zlib.crc32(part), n), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.schema.types[0]), *(pa.array(r, pa.int64()) for r in rows[1:])], [id_col, "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long")


class CapacityTree:
    """Segment tree over remaining capacities 0..size; finds the least capacity >= a length that has open windows."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.open = [False] * (2 * self.width)

    def mark(self, capacity: int, has: bool) -> None:
        i = capacity + self.width
        self.open[i] = has
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        i = length + self.width
        if self.open[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.width
            i //= 2
        return None


def best_fit_plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, first_rank, n, first_sequence, offset)`` of best-fit decreasing over a length histogram.

    Windows of one history are kept as ranges, so the work grows with the number of distinct lengths and not
    with the number of pieces.
    """
    tree, ranges, plan, fresh = CapacityTree(window), {}, [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                each = window // length
                # new windows take as many of this length as fit: that is what best fit does with equal pieces
                whole = left // each or 1
                first, fresh = fresh, fresh + whole
                for slot in range(each if left >= each else left):
                    plan.append((length, rank, whole, first, slot * length))
                    rank, left = rank + whole, left - whole
                rest = window - (slot + 1) * length
                span = (first, whole)
            else:
                first, n = ranges[capacity].pop()
                take = min(n, left)
                if take < n:
                    ranges[capacity].append((first + take, n - take))
                if not ranges[capacity]:
                    tree.mark(capacity, False)
                plan.append((length, rank, take, first, window - capacity))
                rank, left, rest, span = rank + take, left - take, capacity - length, (first, take)
            if rest:
                ranges.setdefault(rest, []).append(span)
                tree.mark(rest, True)
    return plan


def pack(pieces: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id, offset, fill, padding`` to materialised pieces.

    ``fill`` counts the tokens of the sequence; a sequence is padded to the window unless its fill is a power
    of two.
    """
    spark = pieces.sparkSession
    shards = max(8, min(4096, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = pieces.withColumn("shard", salt_of(F.col(id_col), F.col("start"), salts=shards))
    counts = dealt.groupBy("length", "shard").count()
    # at most `window` lengths, whatever the input
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}
    plan = best_fit_plan(histogram, window)
    steps = spark.createDataFrame(plan, "length long, first_rank long, n long, first_sequence long, base long") if plan else spark.createDataFrame([], "length long, first_rank long, n long, first_sequence long, base long")
    before = counts.select("length", "shard", (F.sum("count").over(W.partitionBy("length").orderBy("shard")) - F.col("count")).alias("before"))
    rank = F.col("before") + F.row_number().over(W.partitionBy("length", "shard").orderBy(id_col, "start")) - 1
    ranked = dealt.join(before, ["length", "shard"]).withColumn("rank", rank).drop("before", "shard")
    # the steps of one length as a sorted array: at most a few thousand over all lengths, so they are broadcast
    by_length = steps.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "n", "first_sequence", "base"))).alias("steps"))
    found = F.filter("steps", lambda s: (s["first_rank"] <= F.col("rank")) & (F.col("rank") < s["first_rank"] + s["n"]))[0]
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("s", found)
    return placed.select(*pieces.columns, (F.col("s.first_sequence") + F.col("rank") - F.col("s.first_rank")).alias("sequence_id"), F.col("s.base").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return pack(materialize(cut_pieces(docs, vocabulary, window, id_col, text_col), "pieces"), window, id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": op7_packing}
ORACLES: dict[str, str] = {}
