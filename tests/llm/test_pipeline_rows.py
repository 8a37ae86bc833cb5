"""Every stage of the pipeline on odd rows and empty tables."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as CP
from tests.conftest import DATA

CLASHES = ("id", "row", "body", "n", "sig", "digest", "key", "rep", "component", "kept", "score", "seed", "h", "item_id", "piece", "whole")
LONG = "long words of a text that goes on " * 12_000
ROWS = [(1, "a few plain words", "en", "s", 17), (1, "a few plain words", "en", "s", 17), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "lone text", "en", "s", 9), (4, LONG, "en", "s", 1), (5, LONG + "end", "en", "s", 1), (5, "other text of five", None, "s", 1), (6, " \n\t", "en", "s", 3)]


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(7) for c in CLASHES})
    stages = dict(CP.STAGES)
    seen = {name: stages[name](spark, docs, DATA) for name in stages}
    for name in list(stages)[:-1]:
        assert seen[name].columns == docs.columns, name
    texts = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    every = texts(docs)
    assert not texts(seen["quality"]) - every
    assert texts(seen["exact_dedup"]) == {(1, "a few plain words"): 1, **{k: n for k, n in every.items() if k[0] not in (1, 2, 3)}, (3, ""): 1}
    # the two long texts share nearly all shingles; repeated rows stay together; blank texts are linked with nothing
    assert texts(seen["near_dedup"]) == {k: n for k, n in every.items() if k != (5, LONG + "end")}
    assert texts(seen["decontamination"]) == every
    pieces = seen["packing"].collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in ROWS} and all(0 < r.length <= 1024 for r in pieces)
    ends = Counter()
    for r in pieces:
        ends[r.sequence_id] += r.length
    assert all(n <= 1024 for n in ends.values())


def test_stages_on_empty_tables(spark):
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in CP.STAGES:
        out = stage(spark, empty, DATA)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == empty.columns
