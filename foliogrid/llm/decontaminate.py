"""Benchmark decontamination by spaced seeds.

Two fixed masks select six word positions each and ignore those between. For a stretch of ``SPAN`` words with at
most ``SUBSTITUTIONS`` other words, whichever they are, one of the masks finds equal words at one of its places
(all pairs of places are tried in the tests). Equal hashes of test and training words are hits; around each hit
the aligned words are compared in full. All of it is DataFrame expressions.

Defined results: words are lower-cased as Unicode has it; null identifiers are identifiers like others; documents that
share one are one; a null text is empty and overlaps nothing; items of fewer than ``SPAN`` words must occur whole
and unchanged; items of fewer words than the shortest mask give no seed and are looked for by the hash of all their
words in order; items without words are no evidence; a repeated row adds nothing; an
item that repeats words is compared at every alignment and the best one counts (ties: first in the document);
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliogrid.llm.common import free_name, lookup, materialize, table, whole_text

SPAN, SUBSTITUTIONS = 13, 2
MASKS = ((0, 1, 2, 3, 5, 6), (0, 2, 3, 8, 9, 10))
#: Up to so many test seeds (16 bytes each and a few of overhead) the test side is broadcast; beyond it is shuffled.
BROADCAST_SEEDS = 1_000_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_hashes(texts: DataFrame, id_col: str, text_col: str, out_id: str) -> DataFrame:
    """``out_id, h``: hashes of the words of each text, lower-cased, without punctuation."""
    words = F.array_remove(F.split(F.lower(whole_text(text_col)), NOT_WORD), "")
    return texts.select(F.col(id_col).alias(out_id), words.alias("words")).select(out_id, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))


def _seeds(h: Column, mask: tuple[int, ...], salt: int) -> Column:
    """The seed at every place where the mask fits."""
    last = F.size(h) - mask[-1] - 1
    at = lambda i: F.xxhash64(F.lit(salt), *(F.get(h, i + p) for p in mask))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<bigint>"))


def seeded(hashed: DataFrame, place: str) -> DataFrame:
    """One row per seed: the columns of ``hashed``, ``place`` and ``seed``."""
    first = F.greatest(F.size("h") - MASKS[0][-1], F.lit(0))
    both = F.concat(*(_seeds(F.col("h"), m, i) for i, m in enumerate(MASKS)))
    each = hashed.select("*", F.posexplode(both).alias("__at", "seed"))
    return each.withColumn(place, F.when(F.col("__at") < first, F.col("__at")).otherwise(F.col("__at") - first)).drop("__at")


def _verified(hits: DataFrame) -> DataFrame:
    """Keeps hits (``h, i, item_h, j``) that lie in a stretch of enough equal words; adds the aligned overlap."""
    shift, n = F.col("i") - F.col("j"), F.size("item_h")
    need = F.least(n, F.lit(SPAN))
    allowed = F.when(n >= SPAN, SUBSTITUTIONS).otherwise(0)
    same = hits.withColumn("eq", F.transform("item_h", lambda x, p: F.coalesce(F.when(p + shift >= 0, F.get("h", p + shift)) == x, F.lit(False)).cast("int")))
    good = F.exists(
        F.sequence(F.greatest(F.col("j") - need + 1, F.lit(0)), F.least(F.col("j"), n - need)),
        lambda s: F.aggregate(F.slice("eq", s + 1, need), F.lit(0), lambda a, x: a + x) >= need - allowed,
    )
    matched = F.aggregate("eq", F.lit(0), lambda a, x: a + x)
    return same.filter(good).select("doc_id", "item_id", shift.alias("shift"), matched.alias("matched"), n.alias("item_words"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """One row per document and item that overlap: ``doc_id, item_id, doc_word, matched, item_words, coverage``.

    ``doc_word`` is the word of the document at which the item would begin, ``matched`` the equal words at the
    best alignment.
    """
    # items are told apart by a row number, written once, as identifiers may be null or repeated
    test = materialize(word_hashes(items, item_id_col, item_text_col, "item_id").withColumn("item", F.monotonically_increasing_id()), "test-items")
    whole = test.withColumnRenamed("h", "item_h")
    test_seeds = seeded(test, "j").select("seed", "item", "j")
    train = word_hashes(docs, id_col, text_col, "doc_id")
    if test_seeds.count() <= broadcast_seeds:
        hits = seeded(train, "i").join(F.broadcast(test_seeds), "seed").join(F.broadcast(whole), "item")
    else:
        near = seeded(train, "i").select("doc_id", "i", "seed").join(test_seeds, "seed").groupBy("doc_id", "item", (F.col("i") - F.col("j")).alias("shift")).agg(F.collect_set("j").alias("js"))
        found = near.select("doc_id", "item", "shift", F.explode("js").alias("j")).withColumn("i", F.col("shift") + F.col("j"))
        back = train.withColumnRenamed("doc_id", "__id")
        hits = found.join(back, F.col("doc_id").eqNullSafe(F.col("__id"))).join(whole, "item")
    best = F.max(F.struct("matched", (-F.col("shift")).alias("back"), "item_words")).alias("b")
    out, short = _verified(hits).groupBy("doc_id", "item_id").agg(best), _short_items(train, test)
    if short is not None:
        out = out.union(short).groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return out.select(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_id_col), (-F.col("b.back")).cast("long").alias("doc_word"), F.col("b.matched").cast("long").alias("matched"), F.col("b.item_words").cast("long").alias("item_words"), (F.col("b.matched") / F.col("b.item_words")).alias("coverage"))


def _short_items(train: DataFrame, test: DataFrame) -> DataFrame | None:
    """``doc_id, item_id, b`` of items that are shorter than any mask and stand in a document, at their first place; none if there are no such items."""
    short = test.filter(F.size("h").between(1, min(m[-1] for m in MASKS)))
    lengths = sorted(r[0] for r in short.select(F.size("h")).distinct().collect())  # a handful: shorter than a mask
    if not lengths:
        return None

    def grams(n: int) -> Column:
        seed = lambda i: F.struct(i.alias("i"), F.xxhash64(F.lit(n), F.slice("h", i + 1, n)).alias("seed"))
        return F.when(F.size("h") >= n, F.transform(F.sequence(F.lit(0), F.size("h") - n), seed)).otherwise(F.array().cast("array<struct<i:int,seed:bigint>>"))

    every = F.concat(*map(grams, lengths))
    places = train.select("doc_id", "h", F.explode(every).alias("g")).select("doc_id", "h", "g.i", "g.seed")
    items = materialize(short.select("item_id", F.col("h").alias("item_h"), F.xxhash64(F.size("h"), "h").alias("seed")), "short-items")
    hits = places.join(lookup(items, 120), "seed").filter(F.slice("h", F.col("i") + 1, F.size("item_h")) == F.col("item_h"))
    n = F.size("item_h")
    return hits.groupBy("doc_id", "item_id").agg(F.max(F.struct(n.alias("matched"), (-F.col("i")).alias("back"), n.alias("item_words"))).alias("b"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """The documents that overlap no item, with all their columns."""
    key = free_name(docs, "bad")
    bad = contamination(docs, items, id_col, text_col, **columns).select(F.col(id_col).alias(key)).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(key)), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES: dict[str, str] = {}
