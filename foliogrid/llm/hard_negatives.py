"""Hard-negative mining by matrix products in a residue number system.

Vectors of integers are scored against a stated set of anchors. A product of two blocks is not formed in wide integers:
each block is reduced modulo a few primes below 256, the residues, centred on zero, are multiplied in float32, where
sums over ``COLUMNS`` columns stay below 2^24 and are exact, and the signed scores come back from their residues by
Chinese remaindering in mixed radix. As many primes are taken as the largest norm asks for: no score can be longer
than the squares of its two vectors allow.

Anchors and rows are dealt into blocks of bounded bytes, and every pair of blocks is one cell of a grid. A first pass
finds the positives of each anchor among the rows of its label. A second one keeps, in each cell, the best rows of
other labels within the window below each positive's score. Best lists of the cells are merged by rank.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; vectors shorter
than others are as if zeros followed; an empty vector scores zero; ties go to the smaller identifier, a null
identifier behind all, then to the earlier row; rows that repeat an identifier are rows of their own, as anchors as
well; an anchor without positives, and a positive without a row in its window, give nothing; an empty table gives an
empty result; other columns are ignored. Vectors whose squares add up to 2^60 or more are refused with an error, as
their scores could leave a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliogrid.llm.common import materialize, table

#: Columns that are summed before they are reduced again: 1024 * 125 * 125 < 2^24.
COLUMNS = 1024
PRIMES = [p for p in range(251, 100, -2) if all(p % q for q in range(3, 16, 2))]
#: Squares of a vector that may not be reached, as five times a score must fit into a long.
NORM_LIMIT = 1 << 60
#: Bytes of the vectors of a block of rows, and of anchors, at eight a component.
ROW_BYTES, ANCHOR_BYTES = 32 << 20, 8 << 20
#: Rows and anchors that are scored at once within a cell.
ROW_STEP, ANCHOR_STEP = 4096, 512


def moduli(bound: int) -> list[int]:
    """Primes whose product tells all integers from ``-bound`` to ``bound`` apart."""
    out, product = [], 1
    for p in PRIMES:
        if product > 2 * bound:
            break
        out.append(p)
        product *= p
    return out or PRIMES[:1]


def _balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues between -p/2 and p/2 of whole numbers in float64."""
    return x - p * np.rint(x / p)


def residues(matrix: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """The centred residues of an integer matrix, a float32 matrix for each prime."""
    return [((matrix + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def exact_scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The integer products of all rows of two matrices that are given by their residues."""
    digits: list[np.ndarray] = []
    total, product = np.zeros((len(a[0]), len(b[0])), np.int64), 1
    for k, p in enumerate(primes):
        rest = np.zeros(total.shape)
        for at in range(0, a[k].shape[1], COLUMNS):
            rest += _balanced((a[k][:, at : at + COLUMNS] @ b[k][:, at : at + COLUMNS].T).astype(np.float64), p)
        # the digit of p is what the digits before it leave, over their product
        known = np.zeros(total.shape)
        for q, digit in zip(reversed(primes[:k]), reversed(digits), strict=True):
            known = _balanced(known * q + digit, p)
        digits.append(_balanced(_balanced(rest - known, p) * pow(product, -1, p), p))
        total += digits[-1].astype(np.int64) * product
        product *= p
    return total


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of integers as the rows of a matrix, zeros behind the shorter ones."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    sizes, out = lists.value_lengths().to_numpy(zero_copy_only=False), np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _first(group: np.ndarray, score: np.ndarray, place: np.ndarray, keep: int) -> np.ndarray:
    """Which entries are among the ``keep`` best of their group: by score, then by place."""
    order = np.lexsort((place, -score, group))
    g = group[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return order[rank < keep]


class _Cell:
    """A block of anchors and a block of rows, rows in order of their identifiers."""

    def __init__(self, left: pa.Table, right: pa.Table, width: int, primes: list[int]):
        self.right = right.sort_by([("id", "ascending"), ("row", "ascending")])
        self.left, self.primes = left, primes
        self.a, self.b = _matrix(left["q"], width), _matrix(self.right["q"], width)
        labels = np.concatenate([left["label"].to_numpy(), self.right["label"].to_numpy()])
        codes = np.unique(labels, return_inverse=True)[1]
        self.a_label, self.b_label = codes[: len(self.a)], codes[len(self.a) :]

    def scored(self, anchors: np.ndarray, rows: np.ndarray):
        """Anchors, rows and scores of one step after the other."""
        for i in range(0, len(anchors), ANCHOR_STEP):
            some = anchors[i : i + ANCHOR_STEP]
            a = residues(self.a[some], self.primes)
            for j in range(0, len(rows), ROW_STEP):
                part = rows[j : j + ROW_STEP]
                yield some, part, exact_scores(a, residues(self.b[part], self.primes), self.primes)

    def positives(self, keep: int) -> tuple[np.ndarray, ...]:
        """Anchor, row and score of the best other rows of each anchor's label."""
        a_row, b_row, found = self.left["row"].to_numpy(), self.right["row"].to_numpy(), []
        for label in np.unique(self.a_label):
            rows = np.flatnonzero(self.b_label == label)
            for some, part, score in self.scored(np.flatnonzero(self.a_label == label), rows):
                at = np.partition(score, -keep - 1, axis=1)[:, -keep - 1] if len(part) > keep else score.min(axis=1, initial=0)
                i, j = np.nonzero((score >= at[:, None]) & (a_row[some][:, None] != b_row[part]))
                best = _first(some[i], score[i, j], part[j], keep)
                found.append((some[i][best], part[j][best], score[i, j][best]))
        return self.best(found, lambda x: x[0], keep)

    def negatives(self, keep: int) -> tuple[np.ndarray, ...]:
        """Anchor, row, score and positive of the best rows of other labels in the window of each positive."""
        limits = self.left["limits"].to_pylist()
        most = max(map(len, limits))
        scores = np.array([x + [x[-1]] * (most - len(x)) for x in limits], np.int64)
        there, found = np.array([len(x) for x in limits]), []
        for some, part, score in self.scored(np.arange(len(self.a)), np.arange(len(self.b))):
            of = scores[some]
            i, j = np.nonzero((score <= of.max(axis=1)[:, None]) & (5 * score >= 4 * of.min(axis=1)[:, None]) & (self.a_label[some][:, None] != self.b_label[part]))
            value = score[i, j]
            for k in range(most):
                fits = (value <= of[i, k]) & (5 * value >= 4 * of[i, k]) & (there[some[i]] > k)
                x, y, v = some[i[fits]], part[j[fits]], value[fits]
                best = _first(x, v, y, keep)
                found.append((x[best], y[best], v[best], np.full(len(best), k)))
        return self.best(found, lambda x: x[0] * most + x[3], keep)

    def best(self, found: list, group, keep: int) -> tuple[np.ndarray, ...]:
        """The ``keep`` best of each group over all steps."""
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        all_ = [np.concatenate(x) for x in zip(*found, strict=True)]
        kept = _first(group(all_), all_[2], all_[1], keep)
        return tuple(x[kept] for x in all_)


def _grid(anchors: DataFrame, rows: DataFrame, across: int, down: int, cell, schema: str) -> DataFrame:
    """``cell`` over every pair of a block of anchors and a block of rows."""
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("g", block(across)).withColumn("h", every(down)).groupBy("g", "h")
    right = rows.withColumn("h", block(down)).withColumn("g", every(across)).groupBy("g", "h")
    return left.cogroup(right).applyInArrow(cell, schema)


def _integers(vectors: DataFrame, vector_col: str, scale: float) -> tuple[Column, Column]:
    """Whether a vector takes part, and its components as integers: the floors of ``scale`` times each."""
    vector = F.col(vector_col)
    whole = F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))
    return whole, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def mine_hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` says which rows are anchors. A positive is one of the best other rows of the anchor's label; negatives
    are the best rows of other labels that score from 80 to 100 percent of the positive.
    """
    spark, kinds = vectors.sparkSession, vectors.schema
    id_kind, label_kind = (kinds[c].dataType.simpleString() for c in (id_col, label_col))
    whole, integers = _integers(vectors, vector_col, scale)
    valid = vectors.filter(F.col(label_col).isNotNull() & whole)
    read = valid.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), integers.alias("q"))
    norm = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = materialize(read, "hard-rows")
    n, n_anchors, width, bound = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("q")), F.max(norm)).first()
    if (bound or 0) >= NORM_LIMIT:
        raise ValueError(f"vectors of {bound:.3g} in squares: scores could leave a long")
    width, primes = max(width or 0, 1), moduli(int(bound or 0) + 1)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    block = lambda held: max(1, held // (8 * width))
    across, down = max(1, -(-n_anchors // block(ANCHOR_BYTES))), max(1, -(-n // block(ROW_BYTES)), min(4 * parts, n // 256))
    # the components travel in as few bytes as the largest norm allows
    narrow = "smallint" if (bound or 0) < 1 << 30 else "int"
    blocks = rows.select("row", "id", "label", F.col("q").cast(f"array<{narrow}>").alias("q"), "anchor")

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.schema([("a", pa.int64()), ("id", right["id"].type), ("row", pa.int64()), ("score", pa.int64())]).empty_table()
        cell = _Cell(left, right, width, primes)
        i, j, score, *_ = cell.positives(positives)
        return pa.table({"a": left["row"].take(i), "id": cell.right["id"].take(j), "row": cell.right["row"].take(j), "score": pa.array(score)})

    def below(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.schema([("a", pa.int64()), ("k", pa.int32()), ("id", right["id"].type), ("row", pa.int64()), ("score", pa.int64())]).empty_table()
        cell = _Cell(left, right, width, primes)
        i, j, score, k = cell.negatives(negatives)
        return pa.table({"a": left["row"].take(i), "k": pa.array(k, pa.int32()), "id": cell.right["id"].take(j), "row": cell.right["row"].take(j), "score": pa.array(score)})

    best = lambda *group: F.row_number().over(W.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
    asked = blocks.filter("anchor").drop("anchor")
    found = _grid(asked, blocks.drop("anchor"), across, down, near, f"a long, id {id_kind}, row long, score long").withColumn("k", best("a")).filter(F.col("k") <= positives)
    known = materialize(found.select("a", (F.col("k") - 1).alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "hard-positives")
    limits = known.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("k", "positive_score"))).alias("p")).select(F.col("a").alias("row"), F.col("p.positive_score").alias("limits"))
    wanted = materialize(asked.join(limits, "row"), "hard-anchors")
    hard = _grid(wanted, blocks.drop("anchor"), across, down, below, f"a long, k int, id {id_kind}, row long, score long").withColumn("rank", best("a", "k")).filter(F.col("rank") <= negatives)
    named = wanted.select(F.col("row").alias("a"), F.col("id").alias("anchor_id")).join(known, "a")
    return hard.join(named, ["a", "k"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
_FITS = "80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score"
ORACLES = {
    "op13_hard_negatives": f"""
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scores AS (
            SELECT a.vec_id AS a, r.vec_id AS r, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
            FROM e a, e r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
        p AS (
            SELECT a, r, score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, r) <= 5)
        SELECT p.a AS anchor_id, p.r AS positive_id, row_number() OVER (PARTITION BY p.a, p.r ORDER BY n.score DESC, n.r)::INTEGER AS rank,
               n.r AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM p JOIN scores n ON p.a = n.a AND NOT n.same AND {_FITS}
        QUALIFY rank <= 5
    """
}
