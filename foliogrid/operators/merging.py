"""Merging of boxes in link order, where a merge may be refused by what the group would become.

Whether a link is taken depends on the merges before it, so links are folded in order, ``(l, r)`` ascending. Only the
links of one proximity component can touch each other's groups. Small pages are folded within their row. Components of
the other pages are dealt over the cluster, each sorted as boxes, then links, and folded while it streams by: a task
holds the boxes of one component at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliogrid.functions.storage import materialize
from foliogrid.operators import pages as PG
from foliogrid.operators.ranks import exact_quantiles
from foliogrid.operators.spatial import BOX, axis_overlap_gate, near_pairs, page_groups, pair_ends


@dataclass(frozen=True)
class GroupGate:
    """What the box of a merged group has to meet: ink over box, sum of its members' boxes over box, box over that sum."""

    min_fill: float | None = None
    min_box_fill: float | None = None
    max_growth: float | None = None

    def admits(self, box: int, ink: int, own: int) -> bool:
        if self.min_fill is not None and ink / max(1, box) < self.min_fill:
            return False
        if self.min_box_fill is not None and own / max(1, box) < self.min_box_fill:
            return False
        return self.max_growth is None or box <= self.max_growth * own


class _Groups:
    """Groups of one component: a forest over labels, and of each root the box, ink and own area of its members."""

    def __init__(self, gate: GroupGate):
        self.gate, self.parent, self.of = gate, {}, {}

    def add(self, label, x, y, w, h, area) -> None:
        self.parent[label] = label
        self.of[label] = (x, y, x + w, y + h, area, w * h)

    def root(self, label):
        while self.parent[label] != label:
            self.parent[label] = label = self.parent[self.parent[label]]
        return label

    def link(self, l, r) -> bool:
        a, b = sorted((self.root(l), self.root(r)))
        if a == b:
            return False
        p, q = self.of[a], self.of[b]
        x0, y0, x1, y1 = min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3])
        ink, own = p[4] + q[4], p[5] + q[5]
        if not self.gate.admits((x1 - x0) * (y1 - y0), ink, own):
            return False
        self.parent[b] = a
        self.of[a] = (x0, y0, x1, y1, ink, own)
        del self.of[b]
        return True


#: A gate on a pair: a function of its boxes as structs, or a column over those of ``near_pairs``, which keeps pages from being folded in their row.
PairGate = Callable[[Column, Column], Column] | Column | None
Variants = dict[str, tuple[PairGate, GroupGate]]


def _pages(boxes: DataFrame, variants: Variants, most: int) -> PG.Pages:
    return PG.by_page(boxes, ("area",), 0 if any(isinstance(g, Column) for g, _ in variants.values()) else most)


class _Fold:
    """Boxes and links of a batch of pages, folded for all variants at once: the first links of all pages, then the second ones, and so on.

    Each array has the boxes of the batch once for each variant. At the root of a group are the corners, ink, own
    area and number of its members; a root is its group's first box.
    """

    def __init__(self, boxes: pa.ListArray, near: pa.ListArray, gates: list[GroupGate]):
        self.at = boxes.offsets.to_numpy() - boxes.offsets[0].as_py()
        self.n, self.kinds = self.at[-1], len(gates)
        flat = boxes.flatten()
        field = lambda c: np.tile(flat.field(c).to_numpy(zero_copy_only=False), self.kinds)
        self.label = flat.field("label")
        x, y, w, h = (field(c) for c in BOX)
        self.x0, self.y0, self.x1, self.y1, self.ink, self.own, self.members = x, y, x + w, y + h, field("area"), w * h, np.ones(len(x), "int64")
        self.parent = np.arange(len(x))
        bound = lambda c: np.array([np.nan if (v := getattr(g, c)) is None else v for g in gates], float)
        self.bounds = [bound(c) for c in ("min_fill", "min_box_fill", "max_growth")]
        ends, each = near.flatten(), near.offsets.to_numpy() - near.offsets[0].as_py()
        page = np.repeat(np.arange(len(near)), np.diff(each))
        turn = np.arange(len(page)) - each[:-1][page]
        by_turn = np.argsort(turn, kind="stable")
        l, r = (self.at[:-1][page] + ends.field(c).to_numpy() for c in "lr")
        allowed = ends.field("allowed").flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(-1, self.kinds)
        for some in np.split(by_turn, np.cumsum(np.bincount(turn))[:-1]) if len(turn) else []:
            link, kind = np.nonzero(allowed[some])
            self._take(l[some][link] + kind * self.n, r[some][link] + kind * self.n, kind)

    def root(self, box: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[box]
            if (up == box).all():
                return box
            box = up

    def _take(self, l: np.ndarray, r: np.ndarray, kind: np.ndarray) -> None:
        """Links of different groups: no two are of the same page and variant."""
        l, r = self.root(l), self.root(r)
        other = l != r
        a, b, kind = np.minimum(l, r)[other], np.maximum(l, r)[other], kind[other]
        corners = [np.minimum(v[a], v[b]) for v in (self.x0, self.y0)] + [np.maximum(v[a], v[b]) for v in (self.x1, self.y1)]
        box = (corners[2] - corners[0]) * (corners[3] - corners[1])
        ink, own, members = (v[a] + v[b] for v in (self.ink, self.own, self.members))
        fill, box_fill, growth = (v[kind] for v in self.bounds)
        # a bound that is not set is no number, and nothing is below or above it
        keep = ~((ink / np.maximum(1, box) < fill) | (own / np.maximum(1, box) < box_fill) | (box > growth * own))
        self.parent[b[keep]] = a[keep]
        for v, new in zip((self.x0, self.y0, self.x1, self.y1, self.ink, self.own, self.members), (*corners, ink, own, members), strict=True):
            v[a[keep]] = new[keep]

    def rows(self, names: pa.Array, pages: pa.Array, roots: bool) -> list[pa.Array]:
        """``variant, page`` and label and group of every box, or box, ink and members of every group."""
        every = np.arange(len(self.parent))
        told = np.flatnonzero(self.parent == every) if roots else every
        kind, box = np.divmod(told, max(1, self.n))
        of = [names.take(pa.array(kind)), pages.take(pa.array(np.searchsorted(self.at, box, "right") - 1))]
        if roots:
            return [*of, pa.array(((self.x1 - self.x0) * (self.y1 - self.y0))[told]), pa.array(self.ink[told]), pa.array(self.members[told])]
        return [*of, self.label.take(pa.array(box)), self.label.take(pa.array(self.root(every) % max(1, self.n)))]


def _folds(few: DataFrame, distance: int, variants: Variants, roots: bool) -> DataFrame:
    """``variant, page, label, grp`` of every box of the pages that are a row, or ``variant, page, box, ink, members`` of every group."""
    # with a gate that is a column there are no such pages
    boxes, names, gates = F.col("boxes"), list(variants), [g for _, g in variants.values()]
    allowed = lambda e: F.array(*(F.lit(True) if g is None or isinstance(g, Column) else F.coalesce(g(boxes[e["l"]], boxes[e["r"]]), F.lit(False)) for g, _ in variants.values()))
    near = F.transform(PG.links(boxes, distance), lambda e: F.struct(e["l"].alias("l"), e["r"].alias("r"), allowed(e).alias("allowed")))
    page, box = few.schema["page"].dataType.simpleString(), few.schema["boxes"].dataType.elementType
    kind = {c: box[c].dataType.simpleString() for c in box.names}
    schema = f"variant string, page {page}, " + (f"box {kind['x']}, ink {kind['area']}, members long" if roots else f"label {kind['label']}, grp {kind['label']}")
    columns = ["variant", "page", *(("box", "ink", "members") if roots else ("label", "grp"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(_Fold(batch.column(1), batch.column(2), gates).rows(pa.array(names, pa.string()), batch.column(0), roots), columns)

    return few.select("page", "boxes", near.alias("near")).mapInArrow(run, schema)


def gated_groups(boxes: DataFrame, distance: int, variants: Variants, most: int = PG.MOST) -> DataFrame:
    """``variant, page, label, grp`` of every box after the near pairs were taken in order, as far as both gates admit.

    All variants are folded over the same links.
    """
    pages = _pages(boxes, variants, most)
    few = _folds(pages.few, distance, variants, roots=False)
    return few if pages.many is None else few.unionByName(_streamed(pages.many, distance, variants))


def _streamed(boxes: DataFrame, distance: int, variants: Variants) -> DataFrame:
    """``gated_groups`` with components dealt over the cluster: what a gate on pairs says of a link travels with it."""
    gates = [g(*pair_ends()) if callable(g) and not isinstance(g, Column) else g for g, _ in variants.values()]
    allowed = F.array(*(F.lit(True) if g is None else F.coalesce(g, F.lit(False)) for g in gates)).alias("allowed")
    pairs = materialize(near_pairs(boxes, distance, extra=[allowed]), "merge-pairs")
    near = materialize(page_groups(boxes.select("page", "label", *BOX, "area"), pairs), "merge-components")
    part = near.select("page", F.col("label").alias("l"), "grp")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    label = near.schema["label"].dataType
    members = near.select("page", "grp", F.lit(0).alias("kind"), F.col("label").alias("l"), none(label, "r"), none("array<boolean>", "allowed"), *(F.col(c).cast("long").alias(c) for c in (*BOX, "area")))
    links = pairs.join(part, ["page", "l"]).select("page", "grp", F.lit(1).alias("kind"), "l", "r", "allowed", *(none("long", c) for c in (*BOX, "area")))
    rows = members.union(links).repartition("page", "grp").sortWithinPartitions("page", "grp", "kind", "l", "r")
    names = list(variants)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = lambda: [_Groups(g) for _, g in variants.values()]
        now, groups, kinds = None, fresh(), None

        def told() -> pa.RecordBatch:
            labels = list(groups[0].parent)
            columns = [[n for n in names for _ in labels], [now[0]] * (len(names) * len(labels)), labels * len(names), [g.root(x) for g in groups for x in labels]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["variant", "page", "label", "grp"])

        for batch in batches:
            kinds = (pa.string(), batch.schema.field(0).type, *[batch.schema.field(3).type] * 2)
            for page, grp, kind, l, r, taken, *box in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (page, grp) != now:
                    if groups[0].parent:
                        yield told()
                    now, groups = (page, grp), fresh()
                for i, g in enumerate(groups):
                    if not kind:
                        g.add(l, *box)
                    elif taken[i]:
                        g.link(l, r)
        if groups[0].parent:
            yield told()

    variants = {n: (None, g) for n, (_, g) in variants.items()}  # columns stay on the driver
    page, name = (near.schema[c].dataType.simpleString() for c in ("page", "label"))
    return rows.mapInArrow(run, f"variant string, page {page}, label {name}, grp {name}")


def strategies() -> Variants:
    """The strategies that are compared by default: gate on a pair, gate on a group."""
    return {
        "proximity": (None, GroupGate()),
        "axis": (axis_overlap_gate, GroupGate()),
        "fill_20": (None, GroupGate(min_fill=0.20)),
        "fill_35": (None, GroupGate(min_fill=0.35)),
        "axis_fill_20": (axis_overlap_gate, GroupGate(min_fill=0.20)),
        "axis_fill_35": (axis_overlap_gate, GroupGate(min_fill=0.35)),
    }


def _with_fill(groups: DataFrame) -> DataFrame:
    return groups.withColumn("fill", F.col("ink") / F.greatest(F.lit(1), F.col("box")))


def merged_groups(boxes: DataFrame, grouped: DataFrame) -> DataFrame:
    """``variant, page, grp, box, ink, members, fill`` of every group."""
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    box = ((right - F.min("x")) * (bottom - F.min("y"))).alias("box")
    groups = grouped.join(boxes, ["page", "label"]).groupBy("variant", "page", "grp").agg(box, F.sum("area").alias("ink"), F.count(F.lit(1)).alias("members"))
    return _with_fill(groups)


def merge_report(boxes: DataFrame, distance: int, page_px: int, variants: Variants | None = None, most: int = PG.MOST) -> DataFrame:
    """Per strategy: groups, merged ones, low percentiles of their fill, share of thin ones, large boxes and the largest share of a page."""
    variants = variants or strategies()
    pages = _pages(boxes, variants, most)
    wanted = ["variant", "box", "members", "fill"]
    groups = _with_fill(_folds(pages.few, distance, variants, roots=True)).select(*wanted)
    if pages.many is not None:
        groups = groups.union(merged_groups(pages.many, _streamed(pages.many, distance, variants)).select(*wanted))
    groups = materialize(groups, "merge-groups")
    share = F.col("box") / page_px
    counts = groups.groupBy("variant").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("members") > 1).alias("merged"), F.avg((F.col("fill") < 0.05).cast("double")).alias("thin_share"), F.count_if(share > 0.05).alias("over_5"), F.count_if(share > 0.20).alias("over_20"), F.max(share).alias("largest_share"))
    fills = exact_quantiles(groups, ["variant"], {"fill": F.col("fill")}, (0.01, 0.10))
    return counts.join(fills.select("variant", F.col("p1").alias("fill_p1"), F.col("p10").alias("fill_p10")), "variant")
