"""MinHash near-dedup with tensored banding.

Each document has two small collections of hashes, ``SIDE`` each; a hash stands for ``ROWS`` minhashes. A table
key is made of one hash of either collection, so ``SIDE * SIDE`` keys cost ``2 * SIDE * ROWS`` minhashes. Two
sets of similarity s share a key unless they agree on no hash of a collection: at 0.8 that is about 4 in 10,000
for one pair, and far less for a group.

Equal sets are one vertex, named by one of their rows; identifiers come in at the very end. Within a key, members are first compared with its most central member only; the links
so confirmed are contracted to components, and only members of keys that hold several components go on: exact
prefix filters leave the few pairs of them that may still be links. So a group of copies costs a comparison or
two for each member, and no link between different sets is left out. Every link is confirmed on the full sets.

Defined results: a null or empty text, or one of white space, has no shingles and is linked with nothing; fewer
words than a shingle make one shingle; equal sets are linked; identifiers are of any type that has an order; rows
that repeat an identifier are judged one by one, by their own texts, and rows that repeat a text as well are kept or
dropped together; a null identifier is linked with nothing and stays; an empty table gives an empty result; other
columns are ignored; long texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliogrid.llm.common import discard, materialize, numbered, slices, table, unpacked
from foliogrid.llm.setjoin import may_match, prefix_length, rare_first, rarity_sketch, viable
from foliogrid.llm.words import mixed, shingle_sets
from foliogrid.operators.graph import connected_components

SIDE, ROWS = 12, 3
SHINGLE, PERCENT = 5, 80


def _minhashes(values: np.ndarray, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` minhashes of every set; sets lie one after the other in ``values``."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)
    out = np.empty((len(starts), n), np.uint64)
    for i in range(n):
        out[:, i] = np.minimum.reduceat(values * a[i] + b[i], starts)
    return out


def signatures(rows: DataFrame, shingle: int, side: int = SIDE, per_hash: int = ROWS) -> DataFrame:
    """``id, row, digest, n, sig, a, b`` of numbered rows: md5 of the text, set size, digest of the set and the two collections."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw = [unpacked(t) for t in batch.column(2).to_pylist()]
            for lo, hi in slices(raw):
                values, sizes = shingle_sets(raw[lo:hi], shingle)
                ends = np.cumsum(sizes)
                sig = [xxhash.xxh3_128_digest(values[e - n : e]) if n else None for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                ab = np.zeros((len(sizes), 2 * side), np.uint64)
                if len(values):
                    mins = _minhashes(values, (ends - sizes)[sizes > 0], 2 * side * per_hash, 20)
                    acc = np.zeros((len(mins), 2 * side), np.uint64)
                    for j in range(per_hash):
                        acc = mixed(acc + mins[:, j::per_hash])
                    ab[sizes > 0] = acc
                ab = ab.astype(np.int64)
                lists = [pa.array(list(x), pa.list_(pa.int64())) for x in (ab[:, :side], ab[:, side:])]
                digests = pa.array([hashlib.md5(t).digest() for t in raw[lo:hi]], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:2]), digests, pa.array(sizes, pa.int64()), pa.array(sig, pa.binary()), *lists], ["id", "row", "digest", "n", "sig", "a", "b"])

    return rows.select("id", "row", "body").mapInArrow(run, f"id {kind}, row long, digest binary, n long, sig binary, a array<long>, b array<long>")


def full_sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``id, s``: the distinct shingles of the rows whose numbers are in ``wanted``."""

    def run(batches):
        for batch in batches:
            raw = [unpacked(t) for t in batch.column(1).to_pylist()]
            for lo, hi in slices(raw):
                values, sizes = shingle_sets(raw[lo:hi], shingle)
                s = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), s], ["id", "s"])

    return rows.select(F.col("row").alias("id"), "body").join(wanted, "id", "left_semi").mapInArrow(run, "id long, s array<long>")


def table_keys(sets: DataFrame, side: int = SIDE) -> DataFrame:
    """``key, rep, n``: one row for each pair of a hash of either collection."""
    left = sets.select("rep", "n", "b", F.posexplode("a").alias("i", "x"))
    both = left.select("rep", "n", "i", "x", F.posexplode("b").alias("j", "y"))
    return both.select(F.xxhash64("i", "j", "x", "y").alias("key"), "rep", "n")


def _compatible(l: str, r: str, percent: int):
    """Sizes that allow the similarity."""
    return (F.least(l, r) * 100 >= F.greatest(l, r) * percent) & (F.col(l) > 0)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``l, r`` whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("id").alias("l"), F.col("s").alias("sl")), "l")
    both = left.join(sets.select(F.col("id").alias("r"), F.col("s").alias("sr")), "r")
    shared = F.size(F.array_intersect("sl", "sr"))
    return both.select("l", "r", shared.alias("shared"), (F.size("sl") + F.size("sr")).alias("total")).filter(F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * percent).select("l", "r")


def _crossing(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members of keys that hold more than one component, with ``c``."""
    named = members.join(components.select(F.col("node").alias("rep"), F.col("component")), "rep", "left")
    key = W.partitionBy("key")
    named = named.withColumn("c", F.coalesce("component", "rep")).drop("component")
    return named.withColumns({"c0": F.min("c").over(key), "c1": F.max("c").over(key)}).filter("c0 <> c1").drop("c0", "c1")


def _crossing_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets ``(id, s, c)`` of different components that prefix, length and places do not rule out.

    Members of a component mostly share their frequent shingles; those of other components differ in rare ones,
    so few pairs get this far however large the components are.
    """
    sketch = rarity_sketch(sets.select(F.explode("s").alias("token"), F.lit(1).alias("n")))

    def run(batches):
        for batch in batches:
            s = batch.column(2)
            for lo in range(0, batch.num_rows, 256):
                prefixes, sizes = [], []
                for one in s.slice(lo, 256):
                    keys = np.sort(rare_first(one.values.to_numpy().view(np.uint64), sketch.value))
                    prefixes.append(keys[: prefix_length(np.array(len(keys)), percent)].astype(np.int64))
                    sizes.append(len(keys))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 256), batch.column(1).slice(lo, 256), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))], ["h", "c", "n", "prefix"])

    rows = sets.select("id", "c", "s").mapInArrow(run, "h long, c long, n int, prefix array<long>")
    token = W.partitionBy("token")
    shared = viable(rows.select("h", "c", "n", F.posexplode("prefix").alias("i", "token")), percent).withColumns({"c0": F.min("c").over(token), "c1": F.max("c").over(token)})
    members = materialize(shared.filter("c0 <> c1").select("token", F.col("h").alias("l"), "c", "n", "i"), "near-prefixes")
    twin = members.select("token", F.col("l").alias("r"), F.col("c").alias("rc"), F.col("n").alias("m"), F.col("i").alias("j"))
    return members.join(twin, "token").filter((F.col("c") < F.col("rc")) & may_match("n", "i", "m", "j", percent)).select("l", "r").distinct()


def _judged(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """One row per document: ``id, digest, n, component, kept``, the digest being the md5 of the text."""
    texts = numbered(docs, id_col, text_col, "near-texts")
    sigs = materialize(signatures(texts, shingle, side, rows), "near-signatures")
    named = sigs.filter("n > 0 AND id IS NOT NULL")
    sets = named.groupBy("sig").agg(F.min("row").alias("rep"), F.min("id").alias("least"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    # members of keys that more than one set has, unless their sizes rule out both neighbours in size
    by_size = W.partitionBy("key").orderBy("n", "rep")
    near = (F.lag("n").over(by_size) * 100 >= F.col("n") * percent) | (F.lead("n").over(by_size) * percent <= F.col("n") * 100)
    members = materialize(table_keys(sets, side).select("key", "rep", "n", near.alias("near"), F.count(F.lit(1)).over(W.partitionBy("key")).alias("size")).filter("near").drop("near"), "near-members")
    full = materialize(full_sets(texts, members.select(F.col("rep").alias("id")).distinct(), shingle), "near-sets")
    central = members.groupBy("rep").agg(F.sum("size").alias("central"))
    key = W.partitionBy("key")
    hub = F.max(F.struct("central", (-F.col("rep")).alias("back"), "n")).over(key)
    starred = materialize(members.select("key", "rep", "n").join(central, "rep").withColumn("hub", hub).select("rep", "n", (-F.col("hub.back")).alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.central").alias("central")).filter("rep <> hub").distinct(), "near-stars").filter(_compatible("n", "hub_n", percent))
    # first the most central hub of each member, then the other hubs it is not yet joined with, then all that is left
    first = starred.groupBy("rep").agg(F.max(F.struct("central", (-F.col("hub")).alias("back"))).alias("h")).select(F.col("rep").alias("l"), (-F.col("h.back")).alias("r"))
    first = materialize(first, "near-pairs")
    links_1 = materialize(confirmed(first, full, percent), "near-links")
    found_1 = materialize(connected_components(links_1), "near-components")
    other = starred.select(F.col("rep").alias("l"), F.col("hub").alias("r"))
    for side_of in ("l", "r"):
        names = found_1.select(F.col("node").alias(side_of), F.col("component").alias(f"c{side_of}"))
        other = other.join(names, side_of, "left").withColumn(f"c{side_of}", F.coalesce(f"c{side_of}", side_of))
    other = materialize(other.filter("cl <> cr").select("l", "r"), "near-pairs")
    links_2 = materialize(confirmed(other, full, percent), "near-links")
    found_2 = materialize(connected_components(links_1.union(links_2)), "near-components")
    rest = materialize(_crossing(members, found_2).select(F.col("rep").alias("id"), "c").distinct(), "near-rest")
    last = _crossing_pairs(full.join(rest, "id"), percent)
    tested = other.union(other.select("r", "l"))
    last = materialize(last.join(tested, ["l", "r"], "left_anti"), "near-pairs")
    links_3 = materialize(confirmed(last, full, percent), "near-links")
    found = materialize(connected_components(links_1.union(links_2).union(links_3)), "near-components")
    # equal sets: the component of each, and the smallest identifier of a component
    rooted = materialize(sets.select("sig", "rep", "least").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "least", F.coalesce("component", "rep").alias("root")), "near-roots")
    spread = materialize(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("sig", "component"), "near-spread")
    discard(texts, members, full, starred, first, links_1, found_1, other, links_2, found_2, rest, last, links_3, found, rooted)
    out = sigs.select("id", "digest", "n", "sig").join(spread, "sig", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id"))
    return out.select("id", "digest", "n", component.alias("component")).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def near_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """One row per document: ``id_col, n_shingles, component_id, kept``."""
    found = _judged(docs, shingle, percent, id_col, text_col, side, rows)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` that represent their component, with all their columns. Rows are told by identifier and text."""
    gone = _judged(docs, id_col=id_col, text_col=text_col, **parameters).filter(~F.col("kept")).select(F.col("id").alias("__gone_id"), "digest").distinct()
    same = (docs[id_col] == gone["__gone_id"]) & (F.unhex(F.md5(F.coalesce(docs[text_col], F.lit("")))) == gone["digest"])
    return docs.join(gone, same, "left_anti")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), shingle=2)


QUERIES = {"op8_near_dedup": op8_near_dedup}
ORACLES: dict[str, str] = {}
