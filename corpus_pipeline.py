"""From raw documents to packed training sequences.

``STAGES`` lists the steps in order; each takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the last
keep the columns of ``documents``. ``run`` writes each result as Parquet in the shared folder and reads it again,
so a lost executor costs the stage at hand at most.

Each stage takes what its operator's docstring defines: null texts are empty texts, empty tables give empty
results, extra columns pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from foliogrid.functions.storage import intermediates, shared_dir
from foliogrid.llm.common import table
from foliogrid.llm.decontaminate import drop_contaminated
from foliogrid.llm.exact_dedup import drop_exact_copies
from foliogrid.llm.near_dedup import drop_near_copies
from foliogrid.llm.packing import pack_documents
from foliogrid.llm.quality import keep_good, train


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut; the classifier is fitted on ``labels``."""
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return drop_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with ``benchmark``."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier, the minhashes and the tokenizer are not SQL; the tests hold ``run`` against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage writes on its way is deleted when its result has been written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with intermediates(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
