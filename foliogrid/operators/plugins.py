"""User-supplied stages: a registry of DataFrame transforms, pipelines, and isolated batch functions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliogrid.functions.scalars import text_status

Transform = Callable[[DataFrame], DataFrame]
_METHODS: dict[str, Transform] = {}


def register_method(name: str, fn: Transform) -> None:
    if name in _METHODS:
        raise ValueError(f"method {name!r} is registered already")
    _METHODS[name] = fn


def available() -> list[str]:
    return sorted(_METHODS)


def create(name: str) -> Transform:
    if name not in _METHODS:
        raise ValueError(f"unknown method {name!r}; known: {', '.join(available())}")
    return _METHODS[name]


def compose(stages: list[str | Transform]) -> Transform:
    """One transform that applies the stages in order."""
    steps = [create(s) if isinstance(s, str) else s for s in stages]
    return lambda df: reduce(DataFrame.transform, steps, df)


def _laid(made: list[pd.DataFrame], at: list[np.ndarray], names: list[str], n: int) -> pd.DataFrame:
    """Frames put at their rows of ``n``; rows that none has are null, and whole numbers stay exact."""
    if not made:
        return pd.DataFrame({c: [None] * n for c in names})
    rows = pd.concat(made, ignore_index=True) if len(made) > 1 else made[0]
    if len(rows) < n:
        rows = rows.astype({c: object for c in names if rows[c].dtype.kind in "iub"})
    return rows.set_axis(np.concatenate(at), axis=0).reindex(range(n))


def _keyed(rows: pd.DataFrame, key: str, batch: pd.DataFrame) -> pd.DataFrame:
    rows.insert(0, key, batch[key].to_numpy())
    return rows


def isolated(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str, batched: bool = False) -> DataFrame:
    """``fn`` on every row by itself within Arrow batches; a row that raises is a row with its error and keeps no other row back.

    ``schema`` describes what ``fn`` returns for a one-row frame; ``key``, ``status`` and ``error`` are added. If
    ``batched``, ``fn`` gets whole batches and gives a row for each of their rows, in order; a batch that raises, or
    that comes back with another number of rows, is halved until the rows at fault stand alone.
    """
    names = [part.split()[0] for part in schema.split(",")]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # row spans not yet settled, the first last; what was made of spans, their rows, and the errors of single rows
            n = len(batch)
            open_ = [(0, n)] if batched and n else [(i, i + 1) for i in reversed(range(n))]
            made, at, status, errors = [], [], np.full(n, "ok", object), np.full(n, None, object)
            while open_:
                lo, hi = open_.pop()
                try:
                    got = fn(batch.iloc[lo:hi])[names]
                    if len(got) != hi - lo:
                        raise ValueError(f"{len(got)} rows for {hi - lo}")
                    made.append(got)
                    at.append(np.arange(lo, hi))
                except Exception as e:  # noqa: BLE001 - the contract is to record any failure
                    if hi - lo > 1:
                        half = lo + (hi - lo) // 2
                        open_ += [(half, hi), (lo, half)]
                    else:
                        status[lo], errors[lo] = "failed", f"{type(e).__name__}: {e}"
            if n:
                yield _laid(made, at, names, n).assign(status=status, error=errors).pipe(_keyed, key, batch)

    return df.mapInPandas(run, f"`{key}` {kind}, {schema}, status string, error string")


def fixture_provider(answers: DataFrame) -> Transform:
    """A translation provider that looks its answers up; unknown keys fail."""
    return lambda asked: asked.join(answers.select("cache_key", "answer"), "cache_key", "left")


def recognise(crops: DataFrame, fn: Callable[[str], tuple[str, float | None]], key: str = "region", payload: str = "payload") -> DataFrame:
    """OCR by a user function; a confidence that is not finite is null; a crop whose function raises is ``failed``."""
    kind = crops.schema[key].dataType.simpleString()

    def attempt(crop: str) -> tuple[str | None, float | None, str | None]:
        try:
            return *fn(crop), None
        except Exception as e:  # noqa: BLE001 - the contract is to record any failure
            return None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [attempt(p) for p in batch[payload]]
            sure = [c if c is not None and math.isfinite(c) else None for _, c, _ in got]
            yield pd.DataFrame({key: batch[key], "text": [t for t, _, _ in got], "confidence": pd.array(sure, dtype="Float64"), "error": [e for _, _, e in got]})

    return crops.select(key, payload).mapInPandas(run, f"`{key}` {kind}, text string, confidence double, error string").withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise(text_status(F.col("text"))))
