"""Queries of masks, boxes, graphs and morphology, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliogrid.operators import masks as MK
from foliogrid.operators import merging as MG
from foliogrid.operators import spatial as SP
from foliogrid.plans.q_core import rounded
from foliogrid.plans.views import Views, oracle

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return add


@query("src4_to_runs", "SELECT image_id, y, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS island FROM (SELECT DISTINCT image_id, y, x FROM v_ink)) GROUP BY image_id, y, island")
def src4(spark, d):
    return MK.to_runs(Views(spark, d).ink())


@query("src4_from_runs", "SELECT DISTINCT image_id, y, x FROM v_ink")
def src4b(spark, d):
    return MK.from_runs(MK.to_runs(Views(spark, d).ink()))


@query("jn10_overlap_runs", "SELECT image_id, count(*) AS tp FROM (SELECT DISTINCT image_id, y, x FROM v_ink WHERE kind = 'click') JOIN (SELECT DISTINCT image_id, y, x FROM v_ink WHERE kind = 'error') USING (image_id, y, x) GROUP BY 1")
def jn10(spark, d):
    ink = Views(spark, d).ink()
    return MK.overlap_runs(MK.to_runs(ink.filter("kind = 'click'")), MK.to_runs(ink.filter("kind = 'error'")))


@query("prj4_mask_encoding", "SELECT image_id, CASE WHEN aw THEN 'all-white-empty' WHEN mg THEN 'magenta-text' WHEN bk THEN 'black-text' WHEN NOT wh THEN 'near-black-only' ELSE 'all-white-empty' END AS encoding FROM (SELECT user_id % 40 AS image_id, bool_and(b >= 230 AND g >= 230 AND r >= 230) AS aw, bool_or(r >= 180 AND g <= 80 AND b >= 180) AS mg, bool_or(r <= 25 AND g <= 25 AND b <= 25) AS bk, bool_or(b >= 230 AND g >= 230 AND r >= 230) AS wh FROM (SELECT user_id, least(255, CAST(floor(value * 3) AS INTEGER)) AS b, 255 - event_id % 256 AS g, least(255, CAST(floor(value * 2) AS INTEGER)) AS r FROM events) GROUP BY 1)")
def prj4(spark, d):
    e = Views(spark, d).table("events")
    return MK.mask_encoding(e.select((F.col("user_id") % 40).alias("image_id"), F.least(F.lit(255), F.floor(F.col("value") * 3)).alias("b"), (255 - F.col("event_id") % 256).alias("g"), F.least(F.lit(255), F.floor(F.col("value") * 2)).alias("r")))


@query("prj5_binary_gate", "SELECT 'u' || user_id AS image_id, count(*) FILTER (v NOT IN (0, 255)) = 0 AS ok, coalesce(array_to_string(list_slice(list_sort(list(DISTINCT v) FILTER (v NOT IN (0, 255))), 1, 8), ', '), '') || CASE WHEN count(DISTINCT v) FILTER (v NOT IN (0, 255)) > 8 THEN ', ...' ELSE '' END AS offending FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN CAST(least(255, floor(value)) AS INTEGER) ELSE 255 END AS v FROM events) GROUP BY 1")
def prj5(spark, d):
    e = Views(spark, d).table("events")
    return MK.binary_gate(e.select(F.concat(F.lit("u"), "user_id").alias("image_id"), F.when(F.col("event_type") == "error", F.least(F.lit(255), F.floor("value"))).otherwise(255).cast("int").alias("v")))


@query("prj6_align", "SELECT image_id, rule, count(*) AS n FROM (SELECT 'u' || user_id AS image_id, dayofyear(ts) AS y, hour(ts) AS x, CASE user_id % 3 WHEN 0 THEN 'identity' WHEN 1 THEN 'crop-topleft' ELSE 'wrong_size' END AS rule FROM events) WHERE rule = 'wrong_size' OR (x < 20 AND y < 25) GROUP BY ALL")
def prj6(spark, d):
    e = Views(spark, d).table("events").select("user_id", F.concat(F.lit("u"), "user_id").alias("image_id"), F.dayofyear("ts").alias("y"), F.hour("ts").alias("x"))
    sizes = e.groupBy("image_id").agg(F.min(F.when(F.col("user_id") % 3 == 0, 20).when(F.col("user_id") % 3 == 1, 24).otherwise(7)).alias("w"), F.min(F.when(F.col("user_id") % 3 == 0, 25).when(F.col("user_id") % 3 == 1, 31).otherwise(7)).alias("h"))
    return MK.align(e, sizes, 20, 25, (24, 31)).groupBy("image_id", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("agg8_histogram", "SELECT image_id, v, count(*) AS n FROM v_pixels GROUP BY ALL")
def agg8(spark, d):
    return MK.histogram(Views(spark, d).pixels())


OTSU = "SELECT image_id, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(CASE WHEN nt > n0 THEN n0::DOUBLE * (nt - n0) * pow(s0::DOUBLE / n0 - (st - s0)::DOUBLE / (nt - n0), 2) ELSE 0 END, 3) DESC, v) AS r FROM (SELECT image_id, v, sum(n) OVER u AS n0, sum(n * v) OVER u AS s0, sum(n) OVER (PARTITION BY image_id) AS nt, sum(n * v) OVER (PARTITION BY image_id) AS st FROM (SELECT image_id, v, count(*) AS n FROM v_pixels GROUP BY ALL) WINDOW u AS (PARTITION BY image_id ORDER BY v))) WHERE r = 1"


@query("agg9_otsu", OTSU)
def agg9(spark, d):
    return MK.otsu(Views(spark, d).pixels())


@query("agg9_binarise", f"SELECT image_id, CASE WHEN v > threshold THEN 255 ELSE 0 END AS v, count(*) AS n FROM v_pixels JOIN ({OTSU}) USING (image_id) GROUP BY ALL")
def agg9b(spark, d):
    p = Views(spark, d).pixels()
    return MK.binarise(p, MK.otsu(p)).groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))


@query("agg10_kmeans2", "WITH RECURSIVE h AS (SELECT image_id, v::DOUBLE AS v, count(*)::DOUBLE AS n FROM v_pixels GROUP BY ALL), k(image_id, i, c0, c1, done) AS (SELECT image_id, 0, min(v), max(v), false FROM h GROUP BY 1 UNION ALL SELECT image_id, i + 1, CASE WHEN stop THEN c0 ELSE m0 END, CASE WHEN stop THEN c1 ELSE m1 END, stop FROM (SELECT *, done OR (abs(m0 - c0) <= 1e-8 + 1e-5 * abs(c0) AND abs(m1 - c1) <= 1e-8 + 1e-5 * abs(c1)) AS stop FROM (SELECT k.image_id AS image_id, k.i AS i, k.c0 AS c0, k.c1 AS c1, k.done AS done, coalesce(sum(h.v * h.n) FILTER (abs(h.v - k.c0) <= abs(h.v - k.c1)) / sum(h.n) FILTER (abs(h.v - k.c0) <= abs(h.v - k.c1)), k.c0) AS m0, coalesce(sum(h.v * h.n) FILTER (abs(h.v - k.c0) > abs(h.v - k.c1)) / sum(h.n) FILTER (abs(h.v - k.c0) > abs(h.v - k.c1)), k.c1) AS m1 FROM k JOIN h USING (image_id) WHERE k.i < 20 GROUP BY k.image_id, k.i, k.c0, k.c1, k.done))) SELECT k.image_id, round(c0, 6) AS c0, round(c1, 6) AS c1, CAST(sum(n) FILTER (abs(v - c0) <= abs(v - c1)) AS BIGINT) AS n0, CAST(sum(n) FILTER (abs(v - c0) > abs(v - c1)) AS BIGINT) AS n1, CASE WHEN sum(n) FILTER (abs(v - c0) <= abs(v - c1)) < sum(n) FILTER (abs(v - c0) > abs(v - c1)) THEN 0 ELSE 1 END AS foreground FROM k JOIN h USING (image_id) WHERE i = 20 GROUP BY k.image_id, c0, c1")
def agg10(spark, d):
    return rounded(MK.kmeans2(Views(spark, d).pixels()), "c0", "c1", digits=6)


GRID = "SELECT event_type AS image_id, day AS y, hour AS x, coalesce(v, 0) AS v FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN (SELECT unnest(generate_series(1, 30)) AS day) CROSS JOIN (SELECT unnest(generate_series(0, 23)) AS hour) LEFT JOIN (SELECT event_type, dayofyear(ts) AS day, hour(ts) AS hour, CAST(least(255, floor(sum(value) / 2)) AS INTEGER) AS v FROM events GROUP BY ALL) USING (event_type, day, hour)"


def grid(v: Views):
    """Complete 30 x 24 images: one pixel for each hour of each day."""
    e = v.table("events")
    full = e.select(F.col("event_type").alias("image_id")).distinct().withColumn("y", F.explode(F.sequence(F.lit(1), F.lit(30)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(23))))
    got = e.groupBy(F.col("event_type").alias("image_id"), F.dayofyear("ts").alias("y"), F.hour("ts").alias("x")).agg(F.least(F.lit(255), F.floor(F.sum("value") / 2)).cast("int").alias("v"))
    return full.join(got, ["image_id", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


@query("win9_adaptive_threshold", f"WITH g AS ({GRID}), o AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest([-1, 0, 1]) AS i) a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS i) b), m AS (SELECT g.image_id, g.y, g.x, any_value(g.v) AS v, sum(q.v) AS s FROM g CROSS JOIN o JOIN g q ON q.image_id = g.image_id AND q.y = least(greatest(g.y + o.dy, 1), 30) AND q.x = least(greatest(g.x + o.dx, 0), 23) GROUP BY ALL) SELECT image_id, y, x, CASE WHEN 9 * v <= s - 18.5 * 9 THEN 255 ELSE 0 END AS v FROM m".replace("GROUP BY ALL) SELECT image_id, y, x, CASE", "GROUP BY g.image_id, g.y, g.x) SELECT image_id, y, x, CASE"))
def win9(spark, d):
    return MK.adaptive_threshold(grid(Views(spark, d)), 3, 18.5)


def blurred(radius: int, weight: str) -> str:
    """Weighted sum ``s`` of the block around each pixel of the grid, edges repeated; ``weight`` speaks of ``i``."""
    o = f"(SELECT i, {weight} AS w FROM (SELECT unnest(generate_series(-{radius}, {radius})) AS i))"
    return f"SELECT g.image_id, g.y, g.x, any_value(g.v) AS v, sum(a.w * b.w * q.v) / sum(a.w * b.w) AS s FROM ({GRID}) g CROSS JOIN {o} a CROSS JOIN {o} b JOIN ({GRID}) q ON q.image_id = g.image_id AND q.y = least(greatest(g.y + a.i, 1), 30) AND q.x = least(greatest(g.x + b.i, 0), 23) GROUP BY g.image_id, g.y, g.x"


@query("win9_adaptive_gaussian", f"SELECT image_id, y, x, CASE WHEN v <= s - 4.25 THEN 255 ELSE 0 END AS v FROM ({blurred(2, 'exp(-i * i / (2 * 1.1 * 1.1))')})")
def win9g(spark, d):
    return MK.adaptive_threshold(grid(Views(spark, d)), 5, 4.25, gaussian=True)


@query("win10_denoise_gaussian", f"SELECT image_id, y, x, CAST(round_even(s, 0) AS INTEGER) AS v FROM ({blurred(1, '2 - abs(i)')})")
def win10g(spark, d):
    return MK.denoise(grid(Views(spark, d)), "gaussian")


@query("win10_denoise_median", f"WITH g AS ({GRID}), o AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest([-1, 0, 1]) AS i) a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS i) b) SELECT g.image_id, g.y, g.x, CAST(median(q.v) AS INTEGER) AS v FROM g CROSS JOIN o JOIN g q ON q.image_id = g.image_id AND q.y = least(greatest(g.y + o.dy, 1), 30) AND q.x = least(greatest(g.x + o.dx, 0), 23) GROUP BY g.image_id, g.y, g.x")
def win10m(spark, d):
    return MK.denoise(grid(Views(spark, d)), "median")


@query("prj7_resize_nearest", f"WITH g AS (SELECT image_id, y - 1 AS y, x, v FROM ({GRID})) SELECT q.image_id, t.y, t.x, q.v FROM (SELECT a.i AS y, b.i AS x FROM (SELECT unnest(generate_series(0, 44)) AS i) a CROSS JOIN (SELECT unnest(generate_series(0, 17)) AS i) b) t JOIN g q ON q.x = t.x * 24 // 18 AND q.y = t.y * 30 // 45")
def prj7(spark, d):
    g = grid(Views(spark, d)).withColumn("y", F.col("y") - 1)
    sizes = g.select("image_id").distinct().select("image_id", F.lit(24).alias("w"), F.lit(30).alias("h"))
    return MK.resize_nearest(g, sizes, 18, 45)


INK = "SELECT DISTINCT image_id, y - 1 AS y, x FROM v_ink"


def ink(spark, d):
    return Views(spark, d).ink().select("image_id", (F.col("y") - 1).alias("y"), "x").distinct()


@query("mor1_dilate", f"SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM ({INK}), (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx) WHERE y + dy BETWEEN 0 AND 29 AND x + dx BETWEEN 0 AND 23")
def mor1(spark, d):
    return MK.dilate(ink(spark, d), "cross", 3, 1, 24, 30)


@query("mor2_open", f"WITH i AS ({INK}), o AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest([-1, 0, 1]) AS i) a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS i) b), e AS (SELECT i.image_id, i.y, i.x FROM i CROSS JOIN o LEFT JOIN i q ON q.image_id = i.image_id AND q.y = i.y + dy AND q.x = i.x + dx WHERE i.y + dy BETWEEN 0 AND 29 AND i.x + dx BETWEEN 0 AND 23 GROUP BY ALL HAVING count(*) = count(q.y)) SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM e CROSS JOIN o WHERE y + dy BETWEEN 0 AND 29 AND x + dx BETWEEN 0 AND 23")
def mor2(spark, d):
    return MK.morphology(ink(spark, d), 1, 0, 3, 24, 30)


@query("mor2_close", f"WITH i AS ({INK}), o AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest([-1, 0, 1]) AS i) a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS i) b), d AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM i CROSS JOIN o WHERE y + dy BETWEEN 0 AND 29 AND x + dx BETWEEN 0 AND 23) SELECT d.image_id, d.y, d.x FROM d CROSS JOIN o LEFT JOIN d q ON q.image_id = d.image_id AND q.y = d.y + dy AND q.x = d.x + dx WHERE d.y + dy BETWEEN 0 AND 29 AND d.x + dx BETWEEN 0 AND 23 GROUP BY ALL HAVING count(*) = count(q.y)")
def mor2c(spark, d):
    return MK.morphology(ink(spark, d), 0, 1, 3, 24, 30)


@query("mor3_ink_spread", "SELECT image_id, kind, count(*) AS ink, count(DISTINCT y) AS rows, count(DISTINCT x) AS cols, round(count(*)::DOUBLE / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1)), 9) AS fill FROM v_ink GROUP BY ALL")
def mor3(spark, d):
    return rounded(MK.ink_spread(Views(spark, d).ink(), ["image_id", "kind"]), "fill")


@query("agg23_footprint", f"WITH g AS ({GRID}), a AS (SELECT * FROM g WHERE image_id = 'click'), b AS (SELECT * FROM g WHERE image_id = 'view'), c AS (SELECT y, x FROM a JOIN b USING (y, x) WHERE abs(a.v - b.v) > 8), m AS (SELECT y, x FROM g WHERE image_id = 'error' AND v > 0) SELECT 'page' AS image_id, (SELECT count(*) FROM c) AS changed, (SELECT count(*) FROM m) AS mask, round((SELECT count(*) FROM c JOIN m USING (y, x))::DOUBLE / greatest((SELECT count(*) FROM m), 1), 9) AS mask_changed, round((SELECT count(*) FROM c JOIN m USING (y, x))::DOUBLE / greatest((SELECT count(*) FROM c), 1), 9) AS change_in_mask")
def agg23(spark, d):
    g = grid(Views(spark, d))
    one = lambda kind: g.filter(F.col("image_id") == kind).withColumn("image_id", F.lit("page"))
    return rounded(MK.footprint_overlap(one("click"), one("view"), one("error").filter("v > 0")), "mask_changed", "change_in_mask")


@query("agg25_landing", "WITH o AS (SELECT DISTINCT image_id, y - 1 AS y, x FROM v_ink WHERE kind = 'click'), n AS (SELECT DISTINCT image_id, y - 1 AS y, x FROM v_ink WHERE kind = 'view') SELECT image_id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.image_id = n.image_id AND abs(o.y - n.y) <= 1 AND abs(o.x - n.x) <= 1) THEN 1.0 ELSE 0.0 END), 9) AS landed FROM n GROUP BY 1")
def agg25(spark, d):
    i = Views(spark, d).ink().withColumn("y", F.col("y") - 1)
    return rounded(MK.landing(i.filter("kind = 'view'"), i.filter("kind = 'click'"), 1, 24, 30), "landed")


LABELS = f"WITH RECURSIVE i AS ({INK}), p AS (SELECT *, y * 100 + x AS id FROM i), e AS (SELECT a.image_id, a.id AS a, b.id AS b FROM p a JOIN p b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1), r(image_id, id, root) AS (SELECT image_id, id, id FROM p UNION SELECT r.image_id, e.b, r.root FROM r JOIN e ON e.image_id = r.image_id AND e.a = r.id), l AS (SELECT image_id, id, min(root) AS root FROM r GROUP BY ALL)"


@query("grf2_label_runs", f"{LABELS} SELECT image_id, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM p JOIN l USING (image_id, id) GROUP BY image_id, root")
def grf2(spark, d):
    """Also AGG-11: area and box of every 8-connected component."""
    return MK.component_stats(MK.label_runs(MK.to_runs(ink(spark, d)))).drop("label")


# --- boxes and graphs ---

GAPS = "greatest(l.x - (r.x + r.w), r.x - (l.x + l.w), 0)", "greatest(l.y - (r.y + r.h), r.y - (l.y + l.h), 0)"
PAIRS = f"SELECT l.page, l.label AS l, r.label AS r FROM v_boxes l JOIN v_boxes r ON l.page = r.page AND l.label < r.label AND {GAPS[0]} < 12 AND {GAPS[1]} < 12"


@query("prj11_box_gaps", f"SELECT l.page, l.label AS l, r.label AS r, {GAPS[0]} AS hgap, {GAPS[1]} AS vgap FROM v_boxes l JOIN v_boxes r ON l.page = r.page AND l.label < r.label")
def prj11(spark, d):
    from foliogrid.functions.scalars import box_gaps

    b = Views(spark, d).boxes().select("page", "label", "x", "y", "w", "h")
    l, r = (b.withColumnsRenamed({c: f"{p}{c}" for c in ("label", "x", "y", "w", "h")}) for p in "lr")
    h, v = box_gaps(*(F.col(f"{p}{c}") for p in "lr" for c in "xywh"))
    return l.join(r, "page").filter("llabel < rlabel").select("page", F.col("llabel").alias("l"), F.col("rlabel").alias("r"), h.alias("hgap"), v.alias("vgap"))


@query("jn9_near_pairs", PAIRS)
def jn9(spark, d):
    return SP.near_pairs(Views(spark, d).boxes(), 12)


RULE = "(least({0}.w, {0}.h) <= 3 AND greatest({0}.w, {0}.h) >= 20)"


@query("grf5_gated_pairs", f"{PAIRS} AND ({GAPS[0]} = 0 OR {GAPS[1]} = 0) AND NOT {RULE.format('l')} AND NOT {RULE.format('r')}")
def grf5(spark, d):
    return SP.near_pairs(Views(spark, d).boxes(), 12, gate=SP.axis_overlap_gate() & SP.not_rule_gate(3, 20))


def fold(pair: str, group: str, name: str = "") -> str:
    """Boxes of each page after its links were taken in order: ``g`` has the group of each label, ``took`` the links that joined two.

    ``group`` speaks of ``box``, ``ink`` and ``own``, the sums of the two groups ``a`` and ``b`` of a link.
    """
    members = lambda what: f"[{what}[i] FOR i IN range(1, len(g) + 1) IF g[i] = a OR g[i] = b]"
    box = f"(list_max({members('x1')}) - list_min({members('x0')})) * (list_max({members('y1')}) - list_min({members('y0')}))"
    return f"""
        k{name} AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY l, r) AS no, l, r FROM ({PAIRS} AND {pair})),
        f{name}(page, no, g, took, x0, y0, x1, y1, inks, owns) AS (
            SELECT page, 0::BIGINT, list(label ORDER BY label), []::BIGINT[], list(x ORDER BY label), list(y ORDER BY label), list(x + w ORDER BY label), list(y + h ORDER BY label), list(area ORDER BY label), list(w * h ORDER BY label)
            FROM v_boxes GROUP BY page
            UNION ALL
            SELECT page, no, CASE WHEN a <> b AND {group} THEN [CASE WHEN q = b THEN a ELSE q END FOR q IN g] ELSE g END, CASE WHEN a <> b AND {group} THEN list_append(took, no) ELSE took END, x0, y0, x1, y1, inks, owns
            FROM (SELECT *, greatest(1, {box}) AS box, list_sum({members('inks')}) AS ink, list_sum({members('owns')}) AS own
                  FROM (SELECT f.* EXCLUDE (no), k.no, least(g[k.l], g[k.r]) AS a, greatest(g[k.l], g[k.r]) AS b FROM f{name} f JOIN k{name} k ON k.page = f.page AND k.no = f.no + 1))),
        e{name} AS MATERIALIZED (SELECT page, g, took FROM f{name} QUALIFY row_number() OVER (PARTITION BY page ORDER BY no DESC) = 1)"""


AXIS = f"({GAPS[0]} = 0 OR {GAPS[1]} = 0)"
GATED = {
    "box_fill": ("true", "own / box >= 0.6", lambda: (None, MG.GroupGate(min_box_fill=0.6))),
    "growth": ("true", "box <= 1.4::DOUBLE * own", lambda: (None, MG.GroupGate(max_growth=1.4))),
    "rule_box_fill": (f"NOT {RULE.format('l')} AND NOT {RULE.format('r')}", "own / box >= 0.5", lambda: (lambda l, r: SP.not_rule_gate(3, 20, l, r), MG.GroupGate(min_box_fill=0.5))),
    "hub": (" AND ".join(f"greatest({e}.w, {e}.h)::DOUBLE / greatest(1, least({e}.w, {e}.h)) <= 4" for e in "lr"), "true", lambda: (lambda l, r: SP.not_hub_gate(4, l, r), MG.GroupGate())),
    "axis_fill": (AXIS, "ink / box >= 0.35", lambda: (SP.axis_overlap_gate, MG.GroupGate(min_fill=0.35))),
}


@query("grf5_gated_groups", "WITH RECURSIVE " + ", ".join(fold(p, g, f"_{n}") for n, (p, g, _) in GATED.items()) + " " + " UNION ALL ".join(f"SELECT '{n}' AS variant, page, unnest(range(1, len(g) + 1)) AS label, unnest(g) AS grp FROM e_{n}" for n in GATED))
def grf5g(spark, d):
    """Groups under gates that look at what a merge would make."""
    return MG.gated_groups(Views(spark, d).boxes(), 12, {n: make() for n, (_, _, make) in GATED.items()})


STRATEGIES = {"proximity": ("true", "true"), "axis": (AXIS, "true"), "fill_20": ("true", "ink / box >= 0.2"), "fill_35": ("true", "ink / box >= 0.35"), "axis_fill_20": (AXIS, "ink / box >= 0.2"), "axis_fill_35": (AXIS, "ink / box >= 0.35")}
MERGED = " UNION ALL ".join(f"SELECT '{n}' AS variant, page, unnest(range(1, len(g) + 1)) AS label, unnest(g) AS grp FROM e_{n}" for n in STRATEGIES)


@query("grf5_merge_report", "WITH RECURSIVE " + ", ".join(fold(p, g, f"_{n}") for n, (p, g) in STRATEGIES.items()) + f", m AS (SELECT variant, count(*) AS members, (max(x + w) - min(x)) * (max(y + h) - min(y)) AS box, sum(area) AS ink FROM ({MERGED}) JOIN v_boxes USING (page, label) GROUP BY variant, page, grp) SELECT variant, count(*) AS groups, count(*) FILTER (members > 1) AS merged, round(avg(CASE WHEN ink / greatest(1, box) < 0.05 THEN 1.0 ELSE 0.0 END), 9) AS thin_share, count(*) FILTER (box / 16800 > 0.05) AS over_5, count(*) FILTER (box / 16800 > 0.2) AS over_20, round(max(box / 16800), 9) AS largest_share, round(quantile_cont(ink / greatest(1, box), 0.01), 9) AS fill_p1, round(quantile_cont(ink / greatest(1, box), 0.1), 9) AS fill_p10 FROM m GROUP BY 1")
def grf5r(spark, d):
    """The merge strategies side by side."""
    return rounded(MG.merge_report(Views(spark, d).boxes(), 12, 16800), "thin_share", "largest_share", "fill_p1", "fill_p10")


SPANNING = f"WITH RECURSIVE {fold('true', 'true')}, s AS MATERIALIZED (SELECT page, k.l, k.r FROM (SELECT page, unnest(took) AS no FROM e) JOIN k USING (page, no))"


@query("grf6_spanning_links", f"{SPANNING} SELECT page, l, r FROM s")
def grf6s(spark, d):
    return SP.near_spanning_links(Views(spark, d).boxes(), 12)


@query("grf6_chain_edges", f"{SPANNING}, n AS MATERIALIZED (SELECT page, unnest(range(1, len(g) + 1)) AS label, unnest(g) AS grp FROM e), b AS MATERIALIZED (SELECT page, grp, count(*) AS members, (max(x + w) - min(x)) * (max(y + h) - min(y)) AS box FROM n JOIN v_boxes USING (page, label) GROUP BY page, grp QUALIFY row_number() OVER (PARTITION BY page ORDER BY box DESC, grp) = 1), i AS MATERIALIZED (SELECT s.*, greatest(x.x - (y.x + y.w), y.x - (x.x + x.w), 0) AS h, greatest(x.y - (y.y + y.h), y.y - (x.y + x.h), 0) AS v FROM s JOIN n ON n.page = s.page AND n.label = s.l JOIN b ON b.page = n.page AND b.grp = n.grp JOIN v_boxes x ON x.page = s.page AND x.label = s.l JOIN v_boxes y ON y.page = s.page AND y.label = s.r), o AS (SELECT page, label, count(*) AS degree FROM (SELECT page, l AS label FROM i UNION ALL SELECT page, r FROM i) GROUP BY page, label QUALIFY row_number() OVER (PARTITION BY page ORDER BY degree DESC, label) = 1), t AS (SELECT page, count(*) AS edges, median(h)::DOUBLE AS h_median, max(h) AS h_max, median(v)::DOUBLE AS v_median, max(v) AS v_max, count(*) FILTER (h > 0 AND v > 0) AS diagonal FROM i GROUP BY 1) SELECT b.page, b.grp, members, round(box / 16800, 9) AS box_share, coalesce(edges, 0) AS edges, o.label AS hub, coalesce(o.degree, 0) AS hub_degree, round(greatest(q.w, q.h) / greatest(1, least(q.w, q.h)), 9) AS hub_aspect, round(q.area / greatest(1, q.w * q.h), 9) AS hub_fill, h_median, h_max, v_median, v_max, coalesce(diagonal, 0) AS diagonal FROM b LEFT JOIN t USING (page) LEFT JOIN o USING (page) LEFT JOIN v_boxes q ON q.page = o.page AND q.label = o.label")
def grf6c(spark, d):
    """The links that hold the largest group of each page together, and the box with most of them."""
    return rounded(SP.near_chain_edges(Views(spark, d).boxes(), 12, 16800), "box_share", "hub_aspect", "hub_fill")


GROUPS = f"p AS ({PAIRS}), r(page, label, root) AS (SELECT page, label, label FROM v_boxes UNION SELECT r.page, CASE WHEN p.l = r.label THEN p.r ELSE p.l END, r.root FROM r JOIN p ON p.page = r.page AND (p.l = r.label OR p.r = r.label)), g AS (SELECT page, label, min(root) AS grp FROM r GROUP BY ALL)"


@query("grf1_components", f"WITH RECURSIVE {GROUPS} SELECT page, label, grp FROM g")
def grf1(spark, d):
    return SP.near_groups(Views(spark, d).boxes(), 12)


@query("agg12_merge_regions", f"WITH RECURSIVE {GROUPS} SELECT page, grp, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, sum(area) AS area, count(*) AS merged_from FROM g JOIN v_boxes USING (page, label) GROUP BY ALL")
def agg12(spark, d):
    return SP.near_regions(Views(spark, d).boxes(), 12)


@query("grf3_filter_components", "SELECT page, label, CASE WHEN area < 60 THEN 'below_min_area' WHEN area > 500 THEN 'above_max_area' END AS reason FROM v_boxes")
def grf3(spark, d):
    return SP.filter_components(Views(spark, d).boxes(), 60, 500).select("page", "label", "reason")


@query("grf3_filter_aspect", "SELECT page, label FROM v_boxes WHERE area >= 50 AND w::DOUBLE / greatest(h, 1) <= 3")
def grf3a(spark, d):
    return SP.filter_by_aspect(Views(spark, d).boxes(), 50, 3.0).select("page", "label")


REGIONS = f"""b AS (SELECT * FROM v_boxes WHERE area BETWEEN 40 AND 700), p AS (SELECT l.page, l.label AS l, r.label AS r FROM b l JOIN b r ON l.page = r.page AND l.label < r.label AND {GAPS[0]} < 12 AND {GAPS[1]} < 12), r(page, label, root) AS (SELECT page, label, label FROM b UNION SELECT r.page, CASE WHEN p.l = r.label THEN p.r ELSE p.l END, r.root FROM r JOIN p ON p.page = r.page AND (p.l = r.label OR p.r = r.label)), g AS (SELECT page, label, min(root) AS grp FROM r GROUP BY ALL), m AS (SELECT page, grp, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, sum(area) AS area, count(*) AS merged_from FROM g JOIN b USING (page, label) GROUP BY ALL)"""


@query("grf4_extract_regions", f"WITH RECURSIVE {REGIONS} SELECT page, row_number() OVER (PARTITION BY page ORDER BY -(2 * x + w), 2 * y + h, -(w * h), y, x, grp) AS region_id, x, y, w, h, area, merged_from, CASE WHEN w >= h THEN 'horizontal' ELSE 'vertical' END AS orientation, (x < 5 OR y < 5 OR x + w + 5 > 140 OR y + h + 5 > 120) AS clipped FROM m")
def grf4(spark, d):
    """Also WIN-6: region ids in reading order."""
    b = Views(spark, d).boxes()
    regions, _ = SP.extract_regions(b, b, 40, 700, 12, 5, 140, 120)
    return regions.select("page", "region_id", "x", "y", "w", "h", "area", "merged_from", "orientation", "clipped")


@query("grf4_outcomes", "SELECT o.o_orderkey AS page, CASE WHEN any_value(b.page) IS NULL THEN 'empty_mask' WHEN count(*) FILTER (b.area BETWEEN 40 AND 700) = 0 THEN 'no_text_region_detected' ELSE 'ok' END AS outcome FROM orders o LEFT JOIN v_boxes b ON b.page = o.o_orderkey GROUP BY 1")
def grf4o(spark, d):
    v = Views(spark, d)
    return SP.extract_regions(v.boxes(), v.table("orders").select(F.col("o_orderkey").alias("page")), 40, 700, 0)[1]


@query("grf6_chain_report", f"WITH RECURSIVE {GROUPS}, s AS (SELECT page, grp, count(*) AS n, sum(area) AS a FROM g JOIN v_boxes USING (page, label) GROUP BY ALL), q AS (SELECT page, max(n) AS largest_group, round(max(a)::DOUBLE / sum(a), 9) AS largest_share, count(*) AS groups FROM s GROUP BY 1), d AS (SELECT page, label, count(*) AS d FROM (SELECT page, l AS label FROM p UNION ALL SELECT page, r FROM p) GROUP BY ALL) SELECT page, groups, largest_group, largest_share, coalesce((SELECT sum(d) // 2 FROM d WHERE d.page = q.page), 0)::BIGINT AS links, coalesce((SELECT max(d) FROM d WHERE d.page = q.page), 0) AS max_degree FROM q")
def grf6(spark, d):
    return rounded(SP.near_chain_report(Views(spark, d).boxes(), 12), "largest_share")


@query("jn11_components_in_box", f"WITH RECURSIVE {REGIONS}, q AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY -(2 * x + w), 2 * y + h, -(w * h), y, x, grp) AS region_id FROM m) SELECT q.page, q.region_id, c.label FROM q JOIN v_boxes c ON c.page = q.page AND c.x < q.x + q.w AND q.x < c.x + c.w AND c.y < q.y + q.h AND q.y < c.y + c.h")
def jn11(spark, d):
    return SP.components_in_regions(Views(spark, d).boxes(), 40, 700, 12)


SWEEP = f"""b AS (SELECT c.config, c.distance, v.* FROM v_boxes v, (VALUES ('a', 20, 0), ('b', 60, 6), ('c', 120, 12)) c(config, min_area, distance) WHERE v.area >= c.min_area), p AS (SELECT l.config, l.page, l.label AS l, r.label AS r FROM b l JOIN b r ON l.config = r.config AND l.page = r.page AND l.label < r.label AND {GAPS[0]} < l.distance AND {GAPS[1]} < l.distance), r(config, page, label, root) AS (SELECT config, page, label, label FROM b UNION SELECT r.config, r.page, CASE WHEN p.l = r.label THEN p.r ELSE p.l END, r.root FROM r JOIN p ON p.config = r.config AND p.page = r.page AND (p.l = r.label OR p.r = r.label)), g AS (SELECT config, page, label, min(root) AS grp FROM r GROUP BY ALL), m AS (SELECT config, page, grp, (max(x + w) - min(x)) * (max(y + h) - min(y)) AS size, coalesce(sum(area) FILTER (flag = 'R'), 0) * 100 < sum(area) AS no FROM g JOIN b USING (config, page, label) GROUP BY ALL)"""


@query("agg20_region_sweep", f"WITH RECURSIVE {SWEEP} SELECT config, count(*) AS regions, count(*) FILTER (no) AS false_regions, count(*) FILTER (NOT no) AS true_regions, round(median(size)::DOUBLE, 6) AS median_box, round(quantile_cont(size::DOUBLE, 0.95), 6) AS p95_box FROM m GROUP BY 1")
def agg20(spark, d):
    cells = spark.createDataFrame([("a", 20, 0), ("b", 60, 6), ("c", 120, 12)], "config string, min_area int, distance int")
    boxes = Views(spark, d).boxes().withColumn("true_area", F.when(F.col("flag") == "R", F.col("area")).otherwise(0))
    return rounded(SP.region_sweep(boxes, cells), "median_box", "p95_box", digits=6)


@query("grf6_link_gaps", f"SELECT page, count(*) AS links, median(h)::DOUBLE AS h_median, max(h) AS h_max, median(v)::DOUBLE AS v_median, max(v) AS v_max, count(*) FILTER (h > 0 AND v > 0) AS diagonal FROM (SELECT l.page, {GAPS[0]} AS h, {GAPS[1]} AS v FROM v_boxes l JOIN v_boxes r ON l.page = r.page AND l.label < r.label AND {GAPS[0]} < 12 AND {GAPS[1]} < 12) GROUP BY 1")
def grf6g(spark, d):
    b = Views(spark, d).boxes()
    return SP.link_gaps(b, SP.near_pairs(b, 12))


@query("agg24_centroids", "WITH g AS (SELECT DISTINCT image_id, y, x FROM v_ink WHERE kind IN ('click', 'view', 'error')), n AS (SELECT DISTINCT image_id, y, x FROM v_ink WHERE kind IN ('purchase', 'signup')), q AS (SELECT i.image_id, k AS region_id, k * 12 AS l FROM (SELECT DISTINCT image_id FROM v_ink) i, (VALUES (0), (1)) t(k)), a AS (SELECT q.image_id, region_id, avg(x) AS cx, avg(y) AS cy, count(*) AS c FROM q JOIN g ON g.image_id = q.image_id AND g.x >= l AND g.x < l + 12 AND g.y BETWEEN 1 AND 30 GROUP BY ALL), b AS (SELECT q.image_id, region_id, avg(x) AS cx, avg(y) AS cy, count(*) AS c FROM q JOIN n ON n.image_id = q.image_id AND n.x >= l AND n.x < l + 12 AND n.y BETWEEN 1 AND 30 GROUP BY ALL) SELECT image_id, region_id, round(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)), 9) AS \"offset\", round(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) / sqrt(1044.0::DOUBLE), 9) AS relative FROM a JOIN b USING (image_id, region_id) WHERE a.c >= 2 AND b.c >= 2")
def agg24(spark, d):
    from foliogrid.operators.diagnostics import centroid_offset

    i = Views(spark, d).ink()
    part = lambda *kinds: i.filter(F.col("kind").isin(*kinds)).select("image_id", "y", "x").distinct()
    regions = i.select("image_id").distinct().withColumn("region_id", F.explode(F.array(F.lit(0), F.lit(1)))).select("image_id", "region_id", (F.col("region_id") * 12).alias("left"), F.lit(1).alias("top"), F.lit(12).alias("width"), F.lit(30).alias("height"))
    return rounded(centroid_offset(part("click", "view", "error"), part("purchase", "signup"), regions, 2), "offset", "relative")
