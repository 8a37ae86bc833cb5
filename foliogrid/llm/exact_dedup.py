"""Exact dedup by content sort.

Sampled splitters range-partition the texts by their first bytes. Within a range an external sort by the whole text
brings equal texts together, and each text is compared in full with its neighbour: a run of equal neighbours is a
group. Splitters are drawn from a bounded sample and told to the tasks as they are, so a lost task finds the same
ranges again.

Heat is met by digests, which never decide what is equal. A beginning so common that it is drawn as a splitter
several times is split further by the digest of the text. A text whose copies would fill a good part of a task, by
the sample, is dealt over several places of its range; each place keeps its own winner, and the winners of a range
are sorted and compared with their neighbours in full once more. There are at most a few of them for each partition of
the shuffle, so what they settle is broadcast. What the sample says moves rows between tasks only.

Defined results: a null text is empty; equal texts are one group whatever their other columns; rows that
repeat both identifier and text are one document, of which one row is kept; a null identifier wins only in a
group that has no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliogrid.llm.common import materialize, table, whole_text

#: Leading bytes of a text that take part in the splitters.
SPLIT_BYTES = 48
#: Ranges for each partition of the shuffle, rows sampled for each range, and ranges at most.
RANGES, SAMPLED, MOST_RANGES = 4, 25, 40_000
#: A text is dealt over several places if its copies fill this part of a partition, and if they are that many at least.
HOT_PARTS, HOT_ROWS = 4, 200


def _split_key(text: Column, sha: Column) -> Column:
    """The first bytes and the digest, in hexadecimal: keys are ordered as the beginnings, then as the digests."""
    return F.concat(F.hex(F.substring(text.cast("binary"), 1, SPLIT_BYTES)), F.lit("/"), sha)


def _splitters(sample: DataFrame, step: int) -> list[str]:
    """Every ``step``-th key of a bounded sample with ``key, n``. The digest stays only on beginnings drawn several times."""
    line = W.orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    drawn = sample.select("key", F.floor(F.sum("n").over(line) / step).alias("at")).filter("at > 0").groupBy("at").agg(F.min("key").alias("key"))
    keys = sorted({r.key for r in drawn.select("key").collect()})
    heads = Counter(k.split("/")[0] for k in keys)
    return [k if heads[k.split("/")[0]] > 1 else k.split("/")[0] + "/" for k in keys]


def _range_of(key: Column, splitters: list[str]) -> Column:
    """How many of the sorted splitters are not greater than ``key``, found by halving steps."""
    if not splitters:
        return F.lit(0)
    bounds, n = F.split(F.lit(",".join(splitters)), ","), len(splitters)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(n.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(bounds, at + step - 1) <= key), at + step).otherwise(at))


def _runs(rows: DataFrame, where: list[str], order, best) -> DataFrame:
    """Adds ``wins, run, run_keep, run_n`` to rows with ``id, body, n, hot``; ``body`` is left to hot winners only.

    Within ``where`` the rows are sorted by text and identifier, and each text is compared in full with the one before.
    """
    sorted_ = W.partitionBy(*where).orderBy("body", order("id"))
    compared = rows.withColumn("wins", ~F.coalesce(F.lag("body").over(sorted_) == F.col("body"), F.lit(False)))
    runs = compared.withColumn("run", F.sum(F.col("wins").cast("int")).over(sorted_.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy(*where, "run")
    return runs.withColumn("body", F.when(F.col("hot") & F.col("wins"), F.col("body"))).withColumns({"run_keep": best("id").over(run), "run_n": F.sum("n").over(run)})


def _judged(docs: DataFrame, id_col: str, text_col: str, keep: str, payload: list[str]) -> DataFrame:
    """``id, sha, keep_id, group_size, kept`` of every row, with the ``payload`` columns (the text among them) in ``whole``."""
    best, order = (F.max, F.desc_nulls_last) if keep == "max" else (F.min, F.asc_nulls_last)
    text = whole_text(text_col)
    total, tasks = docs.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges, quota = min(RANGES * tasks, MOST_RANGES), max(total // (HOT_PARTS * tasks), HOT_ROWS)
    part = min(1.0, SAMPLED * ranges / max(total, 1))
    sampled = docs.sample(fraction=part, seed=0) if part < 1 else docs
    sample = materialize(sampled.select(F.sha2(text, 256).alias("sha"), _split_key(text, F.sha2(text, 256)).alias("key")).groupBy("key", "sha").agg(F.count(F.lit(1)).alias("n")), "exact-sample")
    splitters = _splitters(sample, max(int(total * part) // ranges, 1))
    hot = sample.filter(F.col("n") > quota * part).select("sha", F.ceil(F.col("n") / (quota * part)).cast("int").alias("places"))
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("sha"), text.alias("body"), F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(payload))).alias("whole"))
    dealt = rows.join(F.broadcast(hot), "sha", "left").select("id", "sha", "whole", F.col("places").isNotNull().alias("hot"), _range_of(_split_key(F.col("body"), F.col("sha")), splitters).alias("range"), F.coalesce(F.pmod(F.xxhash64("id"), F.col("places")) + 1, F.lit(0)).cast("int").alias("place"))
    # the text travels once, within the payload
    ranged = dealt.repartition("range", "place").withColumns({"body": F.coalesce(F.col(f"whole.c{payload.index(text_col)}"), F.lit("")), "n": F.lit(1).cast("long")})
    if payload == [text_col]:
        ranged = ranged.drop("whole")
    local = materialize(_runs(ranged, ["range", "place"], order, best).drop("n"), "exact-runs", "zstd")
    winners = local.filter("hot AND wins").select("range", "place", F.col("run").alias("part"), "id", "body", "hot", F.col("run_n").alias("n"))
    settled = _runs(winners, ["range"], order, best).select("range", "place", F.col("part").alias("run"), F.col("wins").alias("wins_all"), F.col("run_keep").alias("keep_all"), F.col("run_n").alias("n_all"))
    whole = local.drop("body").join(F.broadcast(materialize(settled, "exact-settled")), ["range", "place", "run"], "left")
    pick = lambda one, several: F.when(F.col("hot"), F.col(several)).otherwise(F.col(one))
    return whole.withColumns({"keep_id": pick("run_keep", "keep_all"), "group_size": pick("run_n", "n_all"), "kept": F.col("wins") & (~F.col("hot") | F.coalesce("wins_all", F.lit(False)))})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    ``keep`` is ``max`` or ``min``: which identifier of equal texts stays.
    """
    return _judged(docs, id_col, text_col, keep, [text_col]).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, one per text, with all their columns."""
    kept = _judged(docs, id_col, text_col, keep, docs.columns).filter("kept")
    return kept.select(*(F.col(f"whole.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLES = {
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """
}
