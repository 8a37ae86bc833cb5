"""Masks as pixel relations ``(image_id, y, x, v)`` and as row runs ``(image_id, y, x0, x1)``, half open."""

from __future__ import annotations

from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliogrid.functions.storage import materialize
from foliogrid.operators.graph import connected_components


def to_runs(pixels: DataFrame, keys: tuple[str, ...] = ("image_id", "y")) -> DataFrame:
    """Maximal stretches of pixels of each row; repeated pixels count once."""
    distinct = pixels.select(*keys, "x").distinct()
    island = F.col("x") - F.row_number().over(W.partitionBy(*keys).orderBy("x"))
    return distinct.withColumn("island", island).groupBy(*keys, "island").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("island")


def from_runs(runs: DataFrame) -> DataFrame:
    return runs.withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1))).drop("x0", "x1")


def merge_runs(runs: DataFrame, keys: tuple[str, ...] = ("image_id", "y")) -> DataFrame:
    """Maximal runs of what the given ones cover; runs that overlap or touch become one, empty ones go.

    One pass over the runs of a row in order: a run begins a new one if it begins behind all ends so far.
    """
    line = W.partitionBy(*keys).orderBy("x0", "x1")
    ends = F.max("x1").over(line.rowsBetween(W.unboundedPreceding, -1))
    marked = runs.select(*keys, "x0", "x1").filter("x0 < x1").withColumn("new", F.coalesce((F.col("x0") > ends).cast("int"), F.lit(1)))
    part = marked.withColumn("part", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    return part.groupBy(*keys, "part").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("part")


def covered(runs: DataFrame, depths: list[str], keys: tuple[str, ...] = ("image_id", "y")) -> DataFrame:
    """``keys, x0, x1`` and, for each of ``depths``, how much of it lies on every stretch between neighbouring ends.

    A sweep over the ends of the runs of a row: each adds its amount where it begins and takes it away where it ends.
    """
    ends = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("sign")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("sign"))))
    line = W.partitionBy(*keys).orderBy("x")
    steps = runs.filter("x0 < x1").select(*keys, *depths, ends.alias("e")).groupBy(*keys, F.col("e.x").alias("x")).agg(*(F.sum(F.col(c) * F.col("e.sign")).alias(c) for c in depths))
    upto = line.rowsBetween(W.unboundedPreceding, 0)
    return steps.select(*keys, F.col("x").alias("x0"), F.lead("x").over(line).alias("x1"), *(F.sum(c).over(upto).alias(c) for c in depths)).filter("x1 IS NOT NULL")


def mask_encoding(pixels: DataFrame) -> DataFrame:
    """Colour encoding of ``(image_id, b, g, r)`` pages: all-white-empty, magenta-text, black-text or near-black-only."""
    white = (F.col("b") >= 230) & (F.col("g") >= 230) & (F.col("r") >= 230)
    magenta = (F.col("r") >= 180) & (F.col("g") <= 80) & (F.col("b") >= 180)
    black = (F.col("r") <= 25) & (F.col("g") <= 25) & (F.col("b") <= 25)
    seen = pixels.groupBy("image_id").agg(F.bool_and(white).alias("all_white"), F.bool_or(magenta).alias("magenta"), F.bool_or(black).alias("black"), F.bool_or(white).alias("white"))
    code = F.when(F.col("all_white"), "all-white-empty").when(F.col("magenta"), "magenta-text").when(F.col("black"), "black-text").when(~F.col("white"), "near-black-only").otherwise("all-white-empty")
    return seen.select("image_id", code.alias("encoding"))


def binary_gate(pixels: DataFrame, keep: int = 8) -> DataFrame:
    """``image_id, ok, offending``: values other than 0 and 255, the first few of them listed."""
    bad = pixels.select("image_id", "v").distinct().groupBy("image_id").agg(F.array_sort(F.collect_set(F.when(~F.col("v").isin(0, 255), F.col("v")))).alias("bad"))
    text = F.concat(F.array_join(F.slice("bad", 1, keep).cast("array<string>"), ", "), F.when(F.size("bad") > keep, ", ...").otherwise(""))
    return bad.select("image_id", (F.size("bad") == 0).alias("ok"), text.alias("offending"))


def align(pixels: DataFrame, sizes: DataFrame, width: int, height: int, canvas: tuple[int, int]) -> DataFrame:
    """Pixels at the aligned size with ``rule``: identity, crop-topleft for the known canvas, else wrong_size."""
    rule = F.when((F.col("w") == width) & (F.col("h") == height), "identity").when((F.col("w") == canvas[0]) & (F.col("h") == canvas[1]), "crop-topleft").otherwise("wrong_size")
    return pixels.join(sizes.select("image_id", rule.alias("rule")), "image_id").filter((F.col("rule") == "wrong_size") | ((F.col("x") < width) & (F.col("y") < height)))


def resize_nearest(pixels: DataFrame, sizes: DataFrame, width: int, height: int) -> DataFrame:
    """Nearest-neighbour resize of images with known ``(image_id, w, h)``; each target pixel looks up one source."""
    grid = sizes.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    target = grid.select("image_id", F.col("x").alias("tx"), F.col("y").alias("ty"), F.floor(F.col("x") * F.col("w") / width).cast("int").alias("x"), F.floor(F.col("y") * F.col("h") / height).cast("int").alias("y"))
    return target.join(pixels, ["image_id", "x", "y"]).select("image_id", F.col("ty").alias("y"), F.col("tx").alias("x"), "v")


def threshold(pixels: DataFrame, at: float, inclusive: bool = False) -> DataFrame:
    above = F.col("v") >= at if inclusive else F.col("v") > at
    return pixels.withColumn("v", F.when(above, 255).otherwise(0))


def collapse_labels(classes: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes mapped to 0 or 255, and the distinct classes that the mapping lacks."""
    m = F.broadcast(mapping)
    return classes.join(m, "cls"), classes.select("cls").distinct().join(m, "cls", "left_anti")


def histogram(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    return pixels.groupBy(key, "v").agg(F.count(F.lit(1)).alias("n"))


def otsu(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """``key, threshold`` with the largest between-class variance; ties go to the lowest value.

    Works on the histogram, 256 rows an image at most.
    """
    upto = W.partitionBy(key).orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy(key)
    h = histogram(pixels, key).withColumns({"n0": F.sum("n").over(upto), "s0": F.sum(F.col("n") * F.col("v")).over(upto), "nt": F.sum("n").over(every), "st": F.sum(F.col("n") * F.col("v")).over(every)})
    n1, s1 = F.col("nt") - F.col("n0"), F.col("st") - F.col("s0")
    gap = F.col("s0") / F.col("n0") - s1 / n1
    between = F.when(n1 > 0, F.col("n0").cast("double") * n1 * gap * gap).otherwise(0.0)
    ranked = h.withColumn("between", F.round(between, 3)).withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("between"), "v")))
    return ranked.filter("r = 1").select(key, F.col("v").alias("threshold"))


def binarise(pixels: DataFrame, thresholds: DataFrame, inverse: bool = False, key: str = "image_id") -> DataFrame:
    above = F.col("v") > F.col("threshold")
    return pixels.join(thresholds, key).withColumn("v", F.when(~above if inverse else above, 255).otherwise(0)).drop("threshold")


def kmeans2(pixels: DataFrame, key: str = "image_id", rounds: int = 20) -> DataFrame:
    """``key, c0, c1, n0, n1, foreground``: two clusters of the values of each image.

    Centres begin at the extremes; a value goes to the nearer one (ties to the first); rounds stop before the
    update that would barely move both. The smaller cluster is the foreground, the brighter one on a tie, none
    with a single value. All rounds run inside one expression over the histogram.
    """
    bins = histogram(pixels, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("v").cast("double").alias("v"), "n"))).alias("h"))

    def part(h: Column, c0: Column, c1: Column, first: bool, value: bool) -> Column:
        near = lambda b: F.abs(b["v"] - c0) <= F.abs(b["v"] - c1)
        mine = (lambda b: near(b)) if first else (lambda b: ~near(b))
        return F.aggregate(F.filter(h, mine), F.lit(0.0), lambda a, b: a + (b["v"] * b["n"] if value else b["n"].cast("double")))

    def close(a: Column, b: Column) -> Column:
        return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)

    def step(s: Column, _: Column) -> Column:
        c0, c1 = s["c0"], s["c1"]
        n0, n1 = part(F.col("h"), c0, c1, True, False), part(F.col("h"), c0, c1, False, False)
        m0 = F.when(n0 > 0, part(F.col("h"), c0, c1, True, True) / n0).otherwise(c0)
        m1 = F.when(n1 > 0, part(F.col("h"), c0, c1, False, True) / n1).otherwise(c1)
        stop = s["done"] | (close(m0, c0) & close(m1, c1))
        return F.struct(F.when(stop, c0).otherwise(m0).alias("c0"), F.when(stop, c1).otherwise(m1).alias("c1"), stop.alias("done"))

    start = F.struct(F.col("h")[0]["v"].alias("c0"), F.element_at("h", -1)["v"].alias("c1"), F.lit(False).alias("done"))
    end = bins.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)).select(key, "h", F.col("s.c0").alias("c0"), F.col("s.c1").alias("c1"))
    out = end.withColumns({"n0": part(F.col("h"), F.col("c0"), F.col("c1"), True, False).cast("long"), "n1": part(F.col("h"), F.col("c0"), F.col("c1"), False, False).cast("long")})
    which = F.when(F.size("h") <= 1, None).when(F.col("n0") < F.col("n1"), 0).otherwise(1)
    return out.select(key, "c0", "c1", "n0", "n1", which.cast("int").alias("foreground"))


def normalise_mask(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """Pixels as 0/255 by the two clusters of their image."""
    near0 = F.abs(F.col("v") - F.col("c0")) <= F.abs(F.col("v") - F.col("c1"))
    mine = F.when(F.col("foreground").isNull(), False).otherwise(F.when(near0, 0).otherwise(1) == F.col("foreground"))
    return pixels.join(kmeans2(pixels, key), key).withColumn("v", F.when(mine, 255).otherwise(0)).select(*pixels.columns)


def _weights(block: int, gaussian: bool) -> list[float]:
    from math import exp

    r = block // 2
    if not gaussian:
        return [1.0 / block] * block
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    raw = [exp(-((i - r) ** 2) / (2 * sigma * sigma)) for i in range(block)]
    return [x / sum(raw) for x in raw]


def _box_sums(df: DataFrame, across: str, along: str, value: str, r: int, out: str) -> DataFrame:
    """Sums of ``2 r + 1`` neighbours on a line, its ends repeated: differences of one running sum, whatever ``r`` is."""
    line = W.partitionBy("image_id", across).orderBy(along)
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    at, last = F.row_number().over(line) - 1, F.count(F.lit(1)).over(whole) - 1
    df = df.withColumns({"__sum": F.sum(value).over(line.rowsBetween(W.unboundedPreceding, 0)), "__all": F.sum(value).over(whole), "__at": at, "__last": last, "__a": F.first(value).over(whole), "__z": F.last(value).over(whole)})
    inside = F.coalesce(F.lead("__sum", r).over(line), F.col("__all")) - F.coalesce(F.lag("__sum", r + 1).over(line), F.lit(0.0))
    outside = F.col("__a") * F.greatest(F.lit(r) - F.col("__at"), F.lit(0)) + F.col("__z") * F.greatest(F.col("__at") + r - F.col("__last"), F.lit(0))
    return df.withColumn(out, inside + outside).drop("__sum", "__all", "__at", "__last", "__a", "__z")


def local_mean(pixels: DataFrame, block: int, gaussian: bool = False) -> DataFrame:
    """Adds ``mean``: weighted mean of the block around each pixel, edges repeated; a row pass and a column pass.

    Images must be complete rectangles. A plain mean comes from two running sums, so its cost does not grow with the
    block; only the gaussian one gathers the block's line for each pixel.
    """
    weights, r = _weights(block, gaussian), block // 2
    start = pixels.withColumn("__v", F.col("v").cast("double"))
    if not gaussian:
        sums = _box_sums(_box_sums(start, "y", "x", "__v", r, "__h"), "x", "y", "__h", r, "__s")
        return sums.withColumn("mean", F.col("__s") / (block * block)).drop("__v", "__h", "__s")

    def blur(df: DataFrame, across: str, along: str, value: str, out: str) -> DataFrame:
        line = W.partitionBy("image_id", across).orderBy(along)
        whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        near = F.collect_list(value).over(line.rowsBetween(-r, r))
        # what the frame lacks at the edges is the first or the last value of the line
        at, last = F.row_number().over(line) - 1, F.count(F.lit(1)).over(whole) - 1
        df = df.withColumns({"__near": near, "__at": at, "__last": last, "__a": F.first(value).over(whole), "__z": F.last(value).over(whole)})
        full = F.concat(F.array_repeat("__a", F.greatest(F.lit(r) - F.col("__at"), F.lit(0))), F.col("__near"), F.array_repeat("__z", F.greatest(F.col("__at") + r - F.col("__last"), F.lit(0)).cast("int")))
        total = F.aggregate(F.zip_with(full, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return df.withColumn(out, total).drop("__near", "__at", "__last", "__a", "__z")

    return blur(blur(start, "y", "x", "__v", "__h"), "x", "y", "__h", "mean").drop("__v", "__h")


def adaptive_threshold(pixels: DataFrame, block: int, c: float, gaussian: bool = False) -> DataFrame:
    """255 where the value is at most the local mean less ``c``; ``block`` is odd and at least 3."""
    if block < 3 or block % 2 == 0:
        raise ValueError("block must be odd and at least 3")
    dark = F.col("v") <= F.col("mean") - c
    return local_mean(pixels, block, gaussian).withColumn("v", F.when(dark, 255).otherwise(0)).drop("mean")


def denoise(pixels: DataFrame, mode: str) -> DataFrame:
    """3x3 gaussian (rounded half to even) or median, edges repeated."""
    if mode == "gaussian":
        w = [0.25, 0.5, 0.25]
        return _stencil(pixels, lambda vs: F.bround(reduce(lambda a, b: a + b, [vs[i][j] * (w[i] * w[j]) for i in range(3) for j in range(3)]), 0).cast("int"))
    return _stencil(pixels, lambda vs: F.array_sort(F.array(*[v for row in vs for v in row]))[4])


def _stencil(pixels: DataFrame, combine) -> DataFrame:
    """Applies ``combine`` to the 3x3 values around each pixel: one window along rows, one along columns."""
    row, col = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    v = F.col("v")
    three = pixels.withColumn("t", F.array(F.coalesce(F.lag(v).over(row), v), v, F.coalesce(F.lead(v).over(row), v)))
    t = F.col("t")
    nine = three.withColumn("n", F.array(F.coalesce(F.lag(t).over(col), t), t, F.coalesce(F.lead(t).over(col), t)))
    vs = [[F.col("n")[i][j] for j in range(3)] for i in range(3)]
    return nine.withColumn("v", combine(vs)).select(*pixels.columns)


def kernel(shape: str, size: int) -> list[tuple[int, int]]:
    """Offsets (dy, dx) of a rect, cross or ellipse kernel of odd size."""
    r = size // 2
    every = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    if shape == "rect":
        return every
    if shape == "cross":
        return [(dy, dx) for dy, dx in every if dy == 0 or dx == 0]
    if shape == "ellipse":
        half = lambda dy: round(r * (1 - (dy / r) ** 2) ** 0.5) if r else 0
        return [(dy, dx) for dy, dx in every if abs(dx) <= half(dy)]
    raise ValueError(f"unknown kernel shape {shape!r}")


def _lines(shape: str, size: int) -> list[tuple[int, int, int]]:
    """``dy, a, b`` of each line of a kernel, which reaches from ``a`` to ``b``."""
    lines: dict[int, list[int]] = {}
    for dy, dx in kernel(shape, size):
        lines.setdefault(dy, []).append(dx)
    return [(dy, min(xs), max(xs)) for dy, xs in lines.items()]


def _per_line(runs: DataFrame, lines: list[tuple[int, int, int]]) -> DataFrame:
    """Every run once for each line of a kernel, with ``dy, a, b``."""
    each = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(a).alias("a"), F.lit(b).alias("b")) for dy, a, b in lines)))
    return runs.select("image_id", "y", "x0", "x1", each.alias("o")).select("image_id", "y", "x0", "x1", "o.*")


def dilate_runs(runs: DataFrame, shape: str, size: int, iterations: int, width: int, height: int) -> DataFrame:
    """Runs grown by the kernel and cut at the canvas: each is widened once for every line of the kernel."""
    lines = _lines(shape, size)
    for _ in range(iterations):
        grown = _per_line(runs, lines).select("image_id", (F.col("y") + F.col("dy")).alias("y"), F.greatest(F.lit(0), F.col("x0") + F.col("a")).alias("x0"), F.least(F.lit(width), F.col("x1") + F.col("b")).alias("x1"))
        runs = merge_runs(grown.filter(F.col("y").between(0, height - 1)))
    return runs


def erode_runs(runs: DataFrame, shape: str, size: int, iterations: int, width: int, height: int) -> DataFrame:
    """What of maximal runs has the whole kernel, as far as it is on the canvas, on ink.

    A run is narrowed for every line of the kernel; what is left is on ink for that line, and stays where all lines
    that are on the canvas agree.
    """
    lines = _lines(shape, size)
    for _ in range(iterations):
        x0, x1 = F.col("x0"), F.col("x1")
        begin, end = F.when(x0 <= 0, F.lit(0)).otherwise(x0 - F.col("a")), F.when(x1 >= width, F.lit(width)).otherwise(x1 - F.col("b"))
        left = _per_line(runs, lines).select("image_id", (F.col("y") - F.col("dy")).alias("y"), F.greatest(F.lit(0), begin).alias("x0"), F.least(F.lit(width), end).alias("x1"), F.lit(1).alias("depth"))
        needed = reduce(lambda p, q: p + q, [(F.col("y") + dy).between(0, height - 1).cast("int") for dy, _, _ in lines])
        deep = covered(left.filter(F.col("y").between(0, height - 1)), ["depth"]).filter(F.col("depth") == needed)
        runs = merge_runs(deep)
    return runs


def dilate(pixels: DataFrame, shape: str, size: int | None, iterations: int | None, width: int, height: int) -> DataFrame:
    """Ink pixels ``(image_id, y, x)`` grown by the kernel and cut at the canvas; 0 iterations change nothing."""
    if size is None or iterations is None:
        raise ValueError("size and iterations of a dilation must be set")
    return from_runs(dilate_runs(to_runs(pixels), shape, size, iterations, width, height))


def erode(pixels: DataFrame, shape: str, size: int, iterations: int, width: int, height: int) -> DataFrame:
    """Ink pixels all of whose kernel neighbours within the canvas are ink."""
    return from_runs(erode_runs(to_runs(pixels), shape, size, iterations, width, height))


def morphology(pixels: DataFrame, opened: int, closed: int, size: int, width: int, height: int, shape: str = "rect") -> DataFrame:
    """Opening, then closing, each repeated as often as told; all of it on runs."""
    runs = to_runs(pixels)
    if opened:
        runs = dilate_runs(erode_runs(runs, shape, size, opened, width, height), shape, size, opened, width, height)
    if closed:
        runs = erode_runs(dilate_runs(runs, shape, size, closed, width, height), shape, size, closed, width, height)
    return from_runs(runs)


#: Rows of an image that one task labels at a time.
STRIP = 64


def _label_strip(table: pa.Table) -> pa.Table:
    """The runs of one strip with ``local``: the smallest ``code`` of their component within it. Codes grow with row and place."""
    order = sorted(zip(*(table[c].to_pylist() for c in ("y", "x0", "x1", "code")), strict=True))
    parent = list(range(len(order)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    above: list[int] = []
    for y, same in groupby(range(len(order)), key=lambda i: order[i][0]):
        row, at = list(same), 0
        if above and order[above[0]][0] == y - 1:
            for i in row:
                # runs of the row above that end before this one begins are done with
                while at < len(above) and order[above[at]][2] < order[i][1]:
                    at += 1
                for j in above[at:]:
                    if order[j][1] > order[i][2]:
                        break
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
        above = row
    columns = list(zip(*order, strict=True))
    out = {c: pa.array(columns[k], table[c].type) for k, c in enumerate(("y", "x0", "x1", "code"))}
    return pa.table({"image_id": table["image_id"], **out, "local": pa.array([order[root(i)][3] for i in range(len(order))], pa.int64())})


def label_runs(runs: DataFrame, strip: int = STRIP) -> DataFrame:
    """Maximal runs with ``label`` of their 8-connected component: a number that grows with row and place of its first run.

    Two runs of neighbouring rows touch, corners included, if each begins no later than the other ends. Strips of rows
    are labelled by themselves; only components that touch over the border of two strips are a problem of the whole
    graph, whose nodes are numbers in order of image and label.
    """
    kind = runs.schema["image_id"].dataType.simpleString()
    coded = runs.select("image_id", F.col("y").cast("long").alias("y"), F.col("x0").cast("long").alias("x0"), F.col("x1").cast("long").alias("x1"), (F.col("y") * F.lit(1 << 31) + F.col("x0")).cast("long").alias("code"))
    strips = coded.withColumn("strip", F.floor(F.col("y") / strip)).groupBy("image_id", "strip")
    local = materialize(strips.applyInArrow(_label_strip, f"image_id {kind}, y long, x0 long, x1 long, code long, local long"), "strips")
    upper = local.filter(F.pmod("y", F.lit(strip)) == strip - 1).select("image_id", (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("local").alias("l"))
    lower = local.filter(F.pmod("y", F.lit(strip)) == 0).select("image_id", "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("local").alias("r"))
    edges = materialize(upper.join(lower, ["image_id", "y"]).filter("a0 <= b1 AND b0 <= a1").select("image_id", "l", "r").distinct(), "strip-edges")
    ends = edges.select("image_id", F.col("l").alias("local")).union(edges.select("image_id", F.col("r").alias("local"))).distinct()
    nodes = materialize(ends.repartitionByRange("image_id", "local").sortWithinPartitions("image_id", "local").withColumn("node", F.monotonically_increasing_id()), "strip-nodes")
    for end in "lr":
        edges = edges.join(nodes.select("image_id", F.col("local").alias(end), F.col("node").alias(f"n{end}")), ["image_id", end])
    found = connected_components(edges, "nl", "nr")
    roots = found.join(nodes, "node").join(nodes.select(F.col("node").alias("component"), F.col("local").alias("label")), "component").select("image_id", "local", "label")
    out = local.join(roots, ["image_id", "local"], "left")
    return out.select("image_id", "y", "x0", "x1", F.coalesce("label", "local").alias("label"))


def component_stats(labelled: DataFrame) -> DataFrame:
    """Area and box of every component of labelled runs."""
    g = labelled.groupBy("image_id", "label").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"), F.min("x0").alias("x"), F.min("y").alias("y"), F.max("x1").alias("xe"), (F.max("y") + 1).alias("ye"))
    return g.select("image_id", "label", "area", "x", "y", (F.col("xe") - F.col("x")).alias("w"), (F.col("ye") - F.col("y")).alias("h"))


def ink_spread(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and columns with ink, ink, and the share of the box that it fills."""
    g = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("ink"), F.count_distinct("y").alias("rows"), F.count_distinct("x").alias("cols"), (F.max("y") - F.min("y") + 1).alias("bh"), (F.max("x") - F.min("x") + 1).alias("bw"))
    return g.select(*keys, "ink", "rows", "cols", (F.col("ink") / (F.col("bh") * F.col("bw"))).alias("fill"))


def overlay_classes(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Pixels of either mask with ``cls``: both, missed (truth only) or extra (prediction only)."""
    keys = ["image_id", "y", "x"]
    both = gt.select(*keys, F.lit(True).alias("g")).join(pred.select(*keys, F.lit(True).alias("p")), keys, "full_outer")
    return both.select(*keys, F.when(F.col("g") & F.col("p"), "both").when(F.col("g"), "missed").otherwise("extra").alias("cls"))


def footprint_overlap(before: DataFrame, after: DataFrame, mask: DataFrame, tolerance: int = 8) -> DataFrame:
    """Per image: share of the mask that changed and share of the change that lies in the mask."""
    keys = ["image_id", "y", "x"]
    changed = before.select(*keys, F.col("v").alias("a")).join(after.select(*keys, F.col("v").alias("b")), keys).filter(F.abs(F.col("a") - F.col("b")) > tolerance).select(*keys, F.lit(1).alias("c"))
    both = changed.join(mask.select(*keys, F.lit(1).alias("m")), keys, "full_outer")
    n = both.groupBy("image_id").agg(F.count("c").alias("changed"), F.count("m").alias("mask"), F.count_if(F.col("c").isNotNull() & F.col("m").isNotNull()).alias("both"))
    return n.select("image_id", "changed", "mask", (F.col("both") / F.greatest("mask", F.lit(1))).alias("mask_changed"), (F.col("both") / F.greatest("changed", F.lit(1))).alias("change_in_mask"))


def landing(new: DataFrame, old: DataFrame, k: int, width: int, height: int) -> DataFrame:
    """Per image the share of new ink within ``k`` pixels of old ink; both are widened and compared as runs."""
    runs = to_runs(new)
    near = dilate_runs(to_runs(old), "rect", 2 * k + 1, 1, width, height)
    ink = runs.groupBy("image_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("ink"))
    hit = ink.join(overlap_runs(runs, near), "image_id", "left")
    return hit.select("image_id", (F.coalesce("tp", F.lit(0)) / F.col("ink")).alias("landed"))


def overlap_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Common pixels ``tp`` per image of two run relations ``(image_id, y, x0, x1)``: one sweep over the ends of each row."""
    both = left.select("image_id", "y", "x0", "x1", F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select("image_id", "y", "x0", "x1", F.lit(0), F.lit(1)))
    return covered(both, ["l", "r"]).filter("l > 0 AND r > 0").groupBy("image_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("tp"))
