"""Connected components and spanning forests of graphs given as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliogrid.functions.storage import discard, materialize


def _nearest(edges: DataFrame, label: str) -> DataFrame:
    """``u, m``: the smallest neighbour of each vertex. Written, so that the join to it can split hot vertices."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m")), label)


def connected_components(edges: DataFrame, left: str = "l", right: str = "r") -> DataFrame:
    """``node, component`` of every vertex on an edge; the component is its smallest vertex.

    Alternates the large-star and small-star steps until the edges no longer change, which takes a number of
    rounds that grows with the logarithm of the longest chain. Each round's edges are written to the shared
    folder and deleted after the next. Self loops keep their vertex; null vertices are left out; repeated edges count once.
    """
    pairs = edges.select(F.col(left).alias("x"), F.col(right).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    loops = materialize(pairs.filter("x = y").select("x").distinct(), "cc-loops")
    star = materialize(pairs.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "cc-edges")
    mark = None
    while True:
        old = star
        # large star: every larger neighbour of u moves to the smallest of u and its neighbours
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _nearest(both, "cc-least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialize(large, "cc-large")
        # small star: every smaller neighbour of u, and u itself, moves to the smallest of them
        small = _nearest(large, "cc-small")
        moved = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = materialize(moved.union(small.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        discard(old, least, large, small)
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    found = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.select(F.col("x").alias("node"), F.col("x").alias("component")).join(found.union(roots), "node", "left_anti")
    return found.union(roots).union(alone)


def _hooked(best: DataFrame) -> DataFrame:
    """``c, p``: the root of the tree that each component joins by its best edge, found by doubling pointers."""
    hook = best.select("c", F.col("b.other").alias("p"))
    back = hook.select(F.col("c").alias("c2"), F.col("p").alias("p2"))
    # two components that chose the same edge point at each other: the smaller one is the root
    first = hook.join(back, F.col("p") == F.col("c2")).select("c", F.when((F.col("p2") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
    names = materialize(first, "forest-names")
    while True:
        up = names.select(F.col("c").alias("c2"), F.col("p").alias("p2"))
        above = materialize(names.join(up, F.col("p") == F.col("c2")).select("c", F.col("p2").alias("p"), (F.col("p") != F.col("p2")).alias("moved")), "forest-names")
        discard(names)
        names = above.select("c", "p")
        if above.filter("moved").isEmpty():
            return names


def spanning_forest(edges: DataFrame, left: str = "l", right: str = "r", order: list[str] | None = None) -> DataFrame:
    """The edges that a walk over all of them in ``order`` (then by their ends) would take to join two parts.

    Boruvka rounds: every component takes its first edge to another one, components are contracted, edges within one
    are dropped. Components at least halve in a round, whatever the degree of a vertex: its edges are combined before
    they are shuffled. The result has the columns of ``edges``; self loops, null ends and repeated edges are left out.
    """
    ends = [F.col(left), F.col(right)]
    own = [c for c in edges.columns if c not in (left, right)]
    rows = edges.filter(ends[0].isNotNull() & ends[1].isNotNull() & (ends[0] != ends[1])).dropDuplicates([left, right])
    key = F.struct(*(F.col(c) for c in order or []), F.least(*ends).alias("a"), F.greatest(*ends).alias("b"), ends[0].alias("u"))
    open_ = materialize(rows.select(key.alias("k"), F.struct(left, right, *own).alias("e"), ends[0].alias("cu"), ends[1].alias("cv")), "forest-edges")
    schema, taken = edges.select(left, right, *own).schema, []
    while not open_.isEmpty():
        side = lambda c, other: open_.select(F.col(c).alias("c"), F.struct("k", "e", F.col(other).alias("other")).alias("b"))  # noqa: B023, E731
        best = materialize(side("cu", "cv").union(side("cv", "cu")).groupBy("c").agg(F.min_by("b", "b.k").alias("b")), "forest-best")
        taken.append(materialize(best.select("b.k", "b.e").dropDuplicates(["k"]).select("e.*"), "forest"))
        names = _hooked(best)
        rest = open_
        for c in ("cu", "cv"):
            rest = rest.join(names.select(F.col("c").alias(c), F.col("p").alias(f"{c}_root")), c).drop(c).withColumnRenamed(f"{c}_root", c)
        rest = materialize(rest.filter("cu <> cv").select("k", "e", "cu", "cv"), "forest-edges")
        discard(open_, best, names)
        open_ = rest
    out = edges.sparkSession.createDataFrame([], schema)
    for part in taken:
        out = out.union(part)
    return out
