"""What the corpus operators share: table readers, the shared folder and salted lookups."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliogrid.functions.storage import discard, materialize, shared_dir

__all__ = ["SALTS", "ascii_lower", "discard", "free_name", "is_small", "lookup", "materialize", "numbered", "salt_of", "shared_dir", "slices", "table", "unpacked", "whole_text"]

#: Rows of one key are dealt over this many sub-keys where a key may be hot.
SALTS = 256

#: Bytes up to which a written table is broadcast; beyond them it is shuffled.
BROADCAST_BYTES = 32 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_small(written: DataFrame, row_bytes: int) -> bool:
    return written.count() * row_bytes <= BROADCAST_BYTES


def lookup(written: DataFrame, row_bytes: int) -> DataFrame:
    """A written table for the small side of a join: to be broadcast if its rows are few enough."""
    return F.broadcast(written) if is_small(written, row_bytes) else written


def salt_of(*cols: Column | str, salts: int = SALTS) -> Column:
    """A sub-key spread over ``salts`` values by the content of ``cols``."""
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def numbered(docs: DataFrame, id_col: str, text_col: str, label: str) -> DataFrame:
    """``id, row, body`` with a row number and the compressed text, written once: what is planned later has the same numbers."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack(t or b"") for t in batch.column(2).cast(pa.binary()).to_pylist()], pa.binary())], ["id", "row", "body"])

    rows = docs.select(F.col(id_col), F.monotonically_increasing_id(), F.col(text_col)).mapInArrow(run, f"id {kind}, row long, body binary")
    return materialize(rows, label, "none")


def unpacked(body: bytes | None) -> bytes:
    """A text that ``numbered`` compressed."""
    return zstandard.decompress(body) if body else b""


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"__{base}{i or ''}" for i in range(len(taken) + 1)) if n.lower() not in taken)


def whole_text(name: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def slices(buffers: list, limit: int = 1 << 20):
    """Index ranges of ``buffers`` whose sizes add up to about ``limit`` bytes, so that work memory stays bounded."""
    start, held = 0, 0
    for i, b in enumerate(buffers):
        if held and held + len(b) > limit:
            yield start, i
            start, held = i, 0
        held += len(b)
    if start < len(buffers):
        yield start, len(buffers)
