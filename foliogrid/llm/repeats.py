"""Removal of repeated byte strings with a logarithmic family of suffix-array levels.

Every window of ``length`` bytes is anchored at its smallest ``GRAM``-byte string (by hash, leftmost), so equal
windows have equal anchors at equal places. Neighbouring windows of one anchor form a run. The suffixes that begin
at anchors, about one in 39, make a sparse suffix array with an entry for each run: the order ``g`` of the suffix
(its first four bytes, then a digest of the anchor), the digest ``h`` of all bytes of the run, and where it first
starts. Arrays are bucketed tables in the order of ``g``. Long matches are found by merging arrays on equal ``g``
and ``h`` and not by common prefixes of neighbours; an array of all suffixes would be over twenty times the text.

Documents come in batches by ascending identifier. A new batch is sorted into an array and merge-scanned against
the levels: a run whose ``(g, h)`` a level or the batch has from earlier is a repeat as a whole; one whose anchor
is known with other bytes is open. Levels of equal size are merged, so there are as many levels as the number of
batches has binary digits. Bucketed levels are neither shuffled nor gathered again.

Open runs, the edges of repeated passages, are settled byte by byte: blocks of eight windows with the same core
are brought together and their windows compared by the few bytes around the core.

Defined results: a null text is empty; texts shorter than ``length`` bytes are kept whole; strings are judged on
the input; of rows that repeat an identifier the first in the input is the earlier one; null identifiers come
first; an empty table gives an empty result; other columns are ignored; long texts are worked on in chunks.
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from foliogrid.llm.common import discard, materialize, numbered, table, unpacked
from foliogrid.llm.words import mixed

LENGTH, GRAM, BATCHES = 100, 24, 4
#: Bytes of text that a task works on at a time.
CHUNK = 1 << 20
#: Frequent runs that a task remembers.
TASK_RUNS = 100_000
#: Windows of a block, and bytes that all windows of a block have.
BLOCK = 8
BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=2)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    return _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)


class Rolling:
    """Digests of any stretches of a buffer from sums of its bytes times powers of an odd base."""

    def __init__(self, buffer: np.ndarray):
        size = 1 << max(16, int(len(buffer) + 1).bit_length())
        power, self.inverse = _tables(size)
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * power[: len(buffer)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:-k]) * self.inverse[:n])


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every stretch of ``w`` values."""
    n = len(v) - w + 1
    padded = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def chunks(texts: list[bytes], overlap: int, limit: int):
    """Groups of pieces ``(text number, offset, bytes)`` of about ``limit`` bytes; pieces of one text overlap."""
    group, held = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - overlap, 1), limit):
            piece = text[at : at + limit + overlap]
            if held and held + len(piece) > limit:
                yield group
                group, held = [], 0
            group.append((i, at, piece))
            held += len(piece)
    if group:
        yield group


def anchored_runs(group, length: int, gram: int):
    """``text number, start, anchor offset, windows, g, h`` of the runs in a group of pieces, in order."""
    buffer = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    if len(buffer) < length:
        return None
    roll = Rolling(buffer)
    grams = roll.grams(gram)
    place = np.uint64((1 << 24) - 1)
    least = sliding_min((grams & ~place) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    anchor = (least & place).astype(np.int64)
    sizes = np.array([len(p) for _, _, p in group])
    owner = np.repeat(np.arange(len(group)), sizes)[: len(anchor)]
    begin = np.cumsum(sizes) - sizes
    start = np.arange(len(anchor))
    inside = start + length <= (begin + sizes)[owner]
    start, anchor, owner = start[inside], anchor[inside], owner[inside]
    if not len(start):
        return None
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    s, x, o = start[first], anchor[first], owner[first]
    # first four bytes of the suffix above a digest of the anchor; the sign turned, so that it sorts as bytes do
    eight = np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,))
    g = ((eight[x].astype(np.uint64) >> np.uint64(32) << np.uint64(32)) | (grams[x] >> np.uint64(32))) ^ np.uint64(1 << 63)
    h = mixed(roll(s, s + n - 1 + length) + ((x - s) * 256 + n).astype(np.uint64))
    text = np.array([i for i, _, _ in group])[o]
    return text, s - begin[o] + np.array([at for _, at, _ in group])[o], x - s, n, g, h


def _packed(start, offset, n):
    """Start, anchor offset and number of windows in one integer."""
    return (start << 16) | (offset << 8) | n


def suffix_entries(docs: DataFrame, length: int, gram: int, chunk: int = CHUNK) -> DataFrame:
    """``id, row, g, h, pos, again`` of every run of ``docs(id, row, body)``.

    ``again`` marks runs that repeat one of the same chunk, or of the same task if they are frequent; they are known to be repeats and their ``g`` is
    replaced by a scattered value, so that no task gathers them.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        # runs that chunks of this task had several times, and the smallest identifier of each
        seen, least = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            texts = [unpacked(t) for t in batch.column(2).to_pylist()]
            order = batch.column(0).cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            for group in chunks(texts, length - 1, chunk):
                found = anchored_runs(group, length, gram)
                if found is None:
                    continue
                text, start, offset, n, g, h = found
                key = mixed(g + h * np.uint64(3))
                by = np.lexsort((np.arange(len(key)), order[text], key))
                again = np.zeros(len(key), bool)
                again[by[1:]] = key[by[1:]] == key[by[:-1]]
                if len(seen):
                    at = np.minimum(np.searchsorted(seen, key), len(seen) - 1)
                    again |= (seen[at] == key) & (order[text] > least[at])
                if len(seen) > TASK_RUNS:
                    seen, least = seen[:0], least[:0]
                # the first of each run that the chunk has again
                ahead = by[:-1][(key[by[1:]] == key[by[:-1]]) & np.append(True, key[by[1:-1]] != key[by[:-2]])] if len(by) > 1 else by[:0]
                seen, least = np.concatenate([seen, key[ahead]]), np.concatenate([least, order[text[ahead]]])
                both = np.lexsort((least, seen))
                seen, least = seen[both], least[both]
                once = np.append(True, seen[1:] != seen[:-1])[: len(seen)]
                seen, least = seen[once], least[once]
                pos = _packed(start, offset, n)
                g = np.where(again, mixed(key + pos.astype(np.uint64) * np.uint64(2) + text.astype(np.uint64)), g)
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(g.astype(np.int64)), pa.array(h.astype(np.int64)), pa.array(pos), pa.array(again)], ["id", "row", "g", "h", "pos", "again"])

    return docs.mapInArrow(run, f"id {kind}, row long, g long, h long, pos long, again boolean")


@contextmanager
def joined_within_buckets(spark: SparkSession):
    """Lets joins on the anchor and more keys use that both sides are bucketed by the anchor."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class LevelFamily:
    """Suffix-array levels as bucketed tables; sizes are powers of two in batches."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels = spark, []  # (size, table name)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, df: DataFrame) -> str:
        """Every task has one bucket, so a level is one sorted file a bucket."""
        name = f"foliogrid_level_{uuid.uuid4().hex}"
        with joined_within_buckets(self.spark):
            df.write.bucketBy(self.buckets, "g").sortBy("g").saveAsTable(name)
        return name

    def insert(self, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Merge-scan a batch against all levels and add it; returns its ``(repeats, open)`` runs, written.

        ``open`` also has the runs of the levels whose anchors the batch has with other bytes.
        """
        anchor = W.partitionBy("g")
        order = W.partitionBy("g", "h").orderBy("id", "row", "pos")
        sorted_ = entries.repartition(self.buckets, "g").withColumn("nth", F.row_number().over(order))
        sorted_ = sorted_.withColumns({"known": F.col("again") | (F.col("nth") > 1), "shared": F.min("h").over(anchor) != F.max("h").over(anchor)})
        for _, name in self.levels:
            level = self.spark.table(name).filter("NOT known")
            same = level.select("g", "h", F.lit(True).alias("has_run"))
            near = level.groupBy("g").agg(F.lit(True).alias("has_anchor"))
            sorted_ = sorted_.join(same, ["g", "h"], "left").join(near, "g", "left")
            sorted_ = sorted_.withColumns({"known": F.col("known") | F.coalesce("has_run", F.lit(False)), "shared": F.col("shared") | F.coalesce("has_anchor", F.lit(False))}).drop("has_run", "has_anchor")
        mine = self._write(sorted_.select("id", "row", "g", "h", "pos", "known", "shared"))
        batch = self.spark.table(mine)
        repeats = materialize(batch.filter("known").select("row", "pos"), "repeat-runs")
        own = batch.filter("NOT known AND shared")
        open_, anchors = own.select("row", "pos"), own.select("g").distinct()
        for _, name in self.levels:
            open_ = open_.union(self.spark.table(name).filter("NOT known").join(anchors, "g", "left_semi").select("row", "pos"))
        open_ = materialize(open_, "open-runs")
        self.levels.append((1, mine))
        return repeats, open_

    def settle(self) -> None:
        """Merge equal-sized levels until all sizes differ."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, old), (_, new) = self.levels[-2:]
            left = self.spark.table(old).filter("NOT known").select("g", "h", "id", "row", "pos")
            right = self.spark.table(new).filter("NOT known").select("g", "h", F.col("id").alias("i"), F.col("row").alias("r"), F.col("pos").alias("p"))
            both = left.join(right, ["g", "h"], "full").select(F.coalesce("id", "i").alias("id"), F.coalesce("row", "r").alias("row"), "g", "h", F.coalesce("pos", "p").alias("pos"), F.lit(False).alias("known"))
            self.levels[-2:] = [(2 * size, self._write(both))]
            for name in (old, new):
                self.spark.sql(f"DROP TABLE {name}")

    def drop(self) -> None:
        for _, name in self.levels:
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches covered by the given ones."""
    if not len(starts):
        return starts, ends
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


def outcome(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str]:
    """``n_bytes, n_removed, n_spans, kept_sha256`` with the given stretches taken out."""
    starts, ends = merged(starts, ends)
    digest, at = hashlib.sha256(), 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        digest.update(raw[at:s])
        at = e
    digest.update(raw[at:])
    return len(raw), int((ends - starts).sum()), len(starts), digest.hexdigest()


def _unpacked(pos) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pos = np.array(pos or [], np.int64)
    return pos >> 16, (pos >> 8) & 255, pos & 255


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RESULT_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string())


def first_pass(docs: DataFrame, length: int) -> DataFrame:
    """Result of documents without open runs; the others keep their text for the second pass."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for raw, repeats, open_ in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if open_:
                    rows.append((None, None, None, None, raw))
                else:
                    s, _, n = _unpacked(repeats)
                    rows.append((*outcome(unpacked(raw), s, s + n - 1 + length), None))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            keep = [pa.array([b if o else None for b, o in zip(batch.column(i).to_pylist(), batch.column(4).to_pylist(), strict=True)], pa.list_(pa.int64())) for i in (3, 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, (*RESULT_TYPES, pa.binary()), strict=True)), *keep], ["id", "row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "raw", "repeats", "open"])

    return docs.mapInArrow(run, f"id {kind}, row long, {RESULT}, raw binary, repeats array<long>, open array<long>")


def open_blocks(docs: DataFrame, length: int) -> DataFrame:
    """``id, row, key, left, right, at, lo, hi``: blocks of up to eight windows of the open runs.

    ``key`` is the digest of what all windows of the block have; ``left`` and ``right`` hold the bytes beside it,
    nearest first; window j starts at ``at - j``.
    """
    kind = docs.schema["id"].dataType.simpleString()
    core = length - BLOCK + 1

    def blocks(raw: bytes, pos):
        start, offset, n = _unpacked(pos)
        x, most, least = start + offset, offset, offset - n + 1
        first, count = least // BLOCK, most // BLOCK - least // BLOCK + 1
        run = np.repeat(np.arange(len(x)), count)
        q = first[run] + np.arange(len(run)) - (np.cumsum(count) - count)[run]
        at = x[run] - q * BLOCK
        return at, q, np.maximum(least[run] - q * BLOCK, 0), np.minimum(most[run] - q * BLOCK, BLOCK - 1)

    def run(batches):
        for batch in batches:
            texts, opens = map(unpacked, batch.column(2).to_pylist()), batch.column(3).to_pylist()
            for i, (raw, pos) in enumerate(zip(texts, opens, strict=True)):
                at, q, lo, hi = blocks(raw, pos)
                buffer = np.frombuffer(raw, np.uint8)
                keys = np.empty(len(at), np.uint64)
                # digests of the cores, a bounded stretch of text at a time
                by = np.argsort(at, kind="stable")
                for a in range(0, int(at.max()) + 1, CHUNK):
                    here = by[np.searchsorted(at[by], a) : np.searchsorted(at[by], a + CHUNK)]
                    if len(here):
                        keys[here] = Rolling(buffer[a : a + CHUNK + core])(at[here] - a, at[here] - a + core)
                keys = mixed(keys + q.astype(np.uint64))
                left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                for j in range(BLOCK - 1):
                    left |= np.where(j < hi, buffer[np.maximum(at - 1 - j, 0)].astype(np.int64) << (8 * j), 0)
                    right |= np.where(j < BLOCK - 1 - lo, buffer[np.minimum(at + core + j, len(buffer) - 1)].astype(np.int64) << (8 * j), 0)
                owner = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(keys.astype(np.int64)), pa.array(left), pa.array(right), pa.array(at), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["id", "row", "key", "left", "right", "at", "lo", "hi"])

    return docs.mapInArrow(run, f"id {kind}, row long, key long, left long, right long, at long, lo int, hi int")


def _first_bytes(c: str, n: Column) -> Column:
    """The first n bytes that ``c`` holds."""
    return F.col(c).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (n * 8).cast("int")) - 1)


def repeated_windows(blocks: DataFrame) -> DataFrame:
    """``row, starts``: windows of the blocks that also start earlier."""
    shared = blocks.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("key"))).filter("n > 1").drop("n")
    windows = shared.withColumn("j", F.explode(F.sequence("lo", "hi"))).withColumn("start", F.col("at") - F.col("j"))
    windows = windows.withColumns({"l": _first_bytes("left", F.col("j")), "r": _first_bytes("right", F.lit(BLOCK - 1) - F.col("j"))})
    nth = F.row_number().over(W.partitionBy("key", "j", "l", "r").orderBy("id", "row", "start"))
    return windows.select("row", "start", nth.alias("nth")).filter("nth > 1").groupBy("row").agg(F.collect_list("start").alias("starts"))


def second_pass(docs: DataFrame, length: int) -> DataFrame:
    """Results of documents with open runs."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for raw, repeats, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, _, n = _unpacked(repeats)
                more = np.array(starts or [], np.int64)
                rows.append(outcome(unpacked(raw), np.concatenate([s, more]), np.concatenate([s + n - 1 + length, more + length])))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, RESULT_TYPES, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.mapInArrow(run, f"id {kind}, {RESULT}")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_bytes, n_removed, n_spans, kept_sha256``. Identifiers are integers; others are refused."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer, as repeats are judged in the order of documents")
    if not 8 <= gram <= length <= 255 or chunk + length > 1 << 24:
        raise ValueError("windows have up to 255 bytes, anchors 8 at least and chunks less than 16 MB")
    spark = docs.sparkSession
    rows = numbered(docs, id_col, text_col, "repeat-rows")
    at = [i / batches for i in range(1, batches)]
    cuts = sorted(set(rows.filter("id IS NOT NULL").select(F.col("id").cast("double").alias("x")).approxQuantile("x", at, 0.01))) if at else []
    family, found = LevelFamily(spark), []
    try:
        for i in range(len(cuts) + 1):
            part = F.lit(True)
            if i:
                part = part & (F.col("id") > cuts[i - 1])
            if i < len(cuts):
                part = part & ((F.col("id") <= cuts[i]) | (F.col("id").isNull() if i == 0 else F.lit(False)))
            family.settle()
            found.append(family.insert(suffix_entries(rows.filter(part), length, gram, chunk)))
    finally:
        family.drop()
    repeats, open_ = (reduce(DataFrame.union, x) for x in zip(*found, strict=True))
    lists = repeats.withColumn("open", F.lit(False)).union(open_.withColumn("open", F.lit(True)))
    lists = lists.groupBy("row").agg(F.collect_list(F.when(~F.col("open"), F.col("pos"))).alias("repeats"), F.collect_set(F.when(F.col("open"), F.col("pos"))).alias("open"))
    judged = materialize(first_pass(rows.join(lists, "row", "left").select("id", "row", "body", "repeats", "open"), length), "first-pass")
    discard(rows, *(x for pair in found for x in pair))
    left = judged.filter("raw IS NOT NULL")
    windows = repeated_windows(open_blocks(left.select("id", "row", "raw", "open"), length))
    done = second_pass(left.select("row", "id", "raw", "repeats").join(windows, "row", "left").select("id", "raw", "repeats", "starts"), length)
    return judged.filter("raw IS NULL").select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256").union(done).withColumnRenamed("id", id_col)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES: dict[str, str] = {}
