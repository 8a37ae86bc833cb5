"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a linear function of features of its whole text. The weights are learnt from preference
pairs (a good and a bad document) by logistic loss on the difference of their features; the cut is the quantile
of the fitted scores that leaves out the share of bad documents among the labelled ones. Scores are moved so
that the cut lies at ``CUT`` and squeezed into 0..1. At most ``FIT_ROWS`` labelled rows, picked by hash of their
identifier, are fitted on; every document is scored.

Defined results: a null text is empty; an empty text gets the score of all-zero counts; a null identifier is
scored and not held out; of conflicting labels the lowest counts; without labels of both kinds every score is
0.5; an empty table gives an empty result; other columns are ignored; long texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliogrid.llm.common import table

#: Labelled rows and preference pairs that the model is fitted on, at most.
FIT_ROWS, FIT_PAIRS = 6_000, 60_000
FOLDS, CUT = 5, 0.3
PUNCTUATION = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
UPPER, LOWER, DIGITS = slice(65, 91), slice(97, 123), slice(48, 58)


def features(raw: bytes) -> list[float]:
    """Shape of one text: character classes, word and line statistics, repetition."""
    n = max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    n_words = max(len(words), 1)
    seen = Counter(words)
    top = seen.most_common(1)[0][1] if seen else 0
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    head = [
        np.log1p(len(raw)), np.log1p(len(words)), counts[UPPER].sum() / n, counts[LOWER].sum() / n, counts[DIGITS].sum() / n, counts[128:].sum() / n, counts[32] / n,
        (len(seen) + 4) / (n_words + 4), max(top - 1, 0) / (n_words + 4), sum(map(eq, words, words[1:])) / (n_words + 4), sizes.mean() / 10, sizes.std() / 10, sizes.max() / 100,
        np.log1p(len(lines)), len(set(lines)) / len(lines), len(raw) / len(lines) / 1000, sum(v for v in seen.values() if v > 3) / (n_words + 4),
    ]
    marks = counts[PUNCTUATION] / (n_words + 4)
    return [float(x) for x in (*head, *np.sqrt(marks))]



def fit_ranking(x: np.ndarray, good: np.ndarray, pairs: int = FIT_PAIRS, steps: int = 300, ridge: float = 1e-3, seed: int = 11):
    """``(mean, scale, weights, cut)`` of the pairwise model, or None unless both labels are there."""
    pos, neg = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(pos) or not len(neg):
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(pos, pairs)] - z[rng.choice(neg, pairs)]
    w, m, v = np.zeros(z.shape[1]), 0.0, 0.0
    for t in range(1, steps + 1):
        g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(0) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return mean, scale, w, float(np.quantile(z @ w, len(neg) / len(x)))


def fold_of(id_col: str, folds: int = FOLDS) -> Column:
    """crc32 of the identifier as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def _features_of(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["x array<double>"])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            x = pa.array([features(t or b"") for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], x], [*keep, "x"])

    return docs.select(*keep, text_col).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS):
    """The pairwise model, fitted on labelled rows outside fold 0. Gathers ``fit_rows`` short rows at most."""
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("__y"))
    picked = known.filter(fold_of("__id") != 0).orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    rows = docs.select(id_col, text_col).join(F.broadcast(picked), F.col(id_col) == F.col("__id")).select("__id", "__y", text_col)
    got = sorted(_features_of(rows, text_col, ["__id", "__y"]).collect())
    return fit_ranking(np.array([r["x"] for r in got]), np.array([r["__y"] == 1 for r in got])) if got else None


def _scores(model, texts: list[bytes | None], cut: float) -> np.ndarray:
    """Score of each text; 0.5 without a model."""
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    mean, scale, w, at = model
    z = np.clip((np.array([features(t or b"") for t in texts]) - mean) / scale, -8, 8)
    return 1 / (1 + np.exp(-np.clip(z @ w - at + np.log(cut / (1 - cut)), -30, 30)))


def score_documents(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``id_col, held_out, score, predicted`` of every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            score = _scores(model, batch.column(2).cast(pa.binary()).to_pylist(), cut)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= cut).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    held = F.coalesce(fold_of(id_col) == 0, F.lit(False))
    return docs.select(id_col, held.alias("held_out"), text_col).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that ``score_documents`` predicts to be good, with all their columns; a map, without a shuffle."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array(_scores(model, texts, cut) >= cut, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
