"""Queries of expressions, catalogue joins, metrics, selection and set operations, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliogrid.functions import scalars as S
from foliogrid.operators import catalog as C
from foliogrid.operators import metrics as M
from foliogrid.operators import selection as SEL
from foliogrid.plans.views import METHODS, Views, oracle

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    """Register a query and, if SQL can express it, its statement."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return add


def rounded(df, *cols, digits: int = 9):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def methods(spark, *extra):
    return spark.createDataFrame([(m,) for m in (*METHODS, *extra)], "method string")


# --- expressions ---


@query("prj1_image_id", "SELECT doc_id, image_id, split_part(image_id, '/', 1) AS manga, substr(image_id, strpos(image_id, '/') + 1) AS stem FROM v_pages")
def prj1(spark, d):
    manga, stem = S.split_image_id(F.col("image_id"))
    return Views(spark, d).pages().select("doc_id", "image_id", manga.alias("manga"), stem.alias("stem"))


@query("prj2_norm_method", "SELECT DISTINCT replace(lower(o_orderpriority), '-', '_') AS method, o_orderpriority FROM orders")
def prj2(spark, d):
    return Views(spark, d).table("orders").select(S.norm_method(F.lower("o_orderpriority")).alias("method"), "o_orderpriority").distinct()


@query("prj3_scores", "SELECT method, image_id, round(iou, 9) AS iou, round(\"precision\", 9) AS \"precision\", round(recall, 9) AS recall, round(f1, 9) AS f1 FROM v_metrics")
def prj3(spark, d):
    return rounded(Views(spark, d).metrics().select("method", "image_id", "iou", "precision", "recall", "f1"), "iou", "precision", "recall", "f1")


@query("prj8_threshold", "SELECT event_id, CASE WHEN floor(least(255, value)) > 127 THEN 255 ELSE 0 END AS above, CASE WHEN floor(least(255, value)) >= 127 THEN 255 ELSE 0 END AS at_least FROM events")
def prj8(spark, d):
    from foliogrid.operators.masks import threshold

    p = Views(spark, d).pixels().select(F.col("pixel").alias("event_id"), "v")
    return threshold(p, 127).withColumnRenamed("v", "above").join(threshold(p, 127, True).withColumnRenamed("v", "at_least"), "event_id")


@query("prj9_collapse_labels", "SELECT label AS cls, count(*) AS n, CASE WHEN label IN (1, 2) THEN 255 ELSE 0 END AS v FROM embeddings WHERE label < 6 GROUP BY label")
def prj9(spark, d):
    from foliogrid.operators.masks import collapse_labels

    mapping = spark.createDataFrame([(c, 255 if c in (1, 2) else 0) for c in range(6)], "cls int, v int")
    known, _ = collapse_labels(Views(spark, d).table("embeddings").select(F.col("label").cast("int").alias("cls")), mapping)
    return known.groupBy("cls", "v").agg(F.count(F.lit(1)).alias("n"))


@query("prj9_unmapped_labels", "SELECT DISTINCT label AS cls FROM embeddings WHERE label NOT IN (0, 1, 2, 3, 4, 5)")
def prj9u(spark, d):
    from foliogrid.operators.masks import collapse_labels

    mapping = spark.createDataFrame([(c, 0) for c in range(6)], "cls int, v int")
    return collapse_labels(Views(spark, d).table("embeddings").select(F.col("label").cast("int").alias("cls")), mapping)[1]


@query("prj10_geometry", "SELECT p_partkey, CAST(ceil(h / 32.0) * 32 AS BIGINT) AS padded_h, CAST(ceil(w / 32.0) * 32 AS BIGINT) AS padded_w, CAST(ceil(h / 32.0) * 32 AS BIGINT) - h AS pad_h, CAST(ceil(w / 32.0) * 32 AS BIGINT) - w AS pad_w, CAST(least(greatest(round_even(h * (1024.0::DOUBLE / greatest(h, w)), 0), 1), 1024) AS BIGINT) AS new_h, CAST(least(greatest(round_even(w * (1024.0::DOUBLE / greatest(h, w)), 0), 1), 1024) AS BIGINT) AS new_w FROM (SELECT p_partkey, p_partkey % 1999 + 1 AS h, p_size * 37 + 1 AS w FROM part)")
def prj10(spark, d):
    h, w = (F.col("p_partkey") % 1999 + 1).cast("long"), (F.col("p_size") * 37 + 1).cast("long")
    p = Views(spark, d).table("part").select("p_partkey", h.alias("h"), w.alias("w"))
    return p.select("p_partkey", *(c.alias(k) for g in (S.pad_geometry(F.col("h"), F.col("w"), 32), S.letterbox_geometry(F.col("h"), F.col("w"), 1024)) for k, c in g.items()))


BOXES = "page, label, x, y, w, h"


@query("prj12_crop", f"SELECT {BOXES}, greatest(x - 5, 0) AS crop_x, greatest(y - 5, 0) AS crop_y, least(x + w + 5, 120) - greatest(x - 5, 0) AS crop_w, least(y + h + 5, 100) - greatest(y - 5, 0) AS crop_h, (x - 5 < 0 OR y - 5 < 0 OR x + w + 5 > 120 OR y + h + 5 > 100) AS clipped FROM v_boxes")
def prj12(spark, d):
    b = Views(spark, d).boxes().select("page", "label", "x", "y", "w", "h")
    return b.withColumns(S.crop_geometry(*(F.col(c) for c in "xywh"), 5, 120, 100))


@query("prj13_expand", f"SELECT {BOXES}, greatest(x - 3, 0) AS ex, greatest(y - 3, 0) AS ey, least(x + w + 3, 120) - greatest(x - 3, 0) AS ew, least(y + h + 3, 100) - greatest(y - 3, 0) AS eh FROM v_boxes")
def prj13(spark, d):
    b = Views(spark, d).boxes().select("page", "label", "x", "y", "w", "h")
    return b.withColumns(S.expand_box(*(F.col(c) for c in "xywh"), 3, 120, 100))


@query("prj14_orientation", "SELECT page, label, CASE WHEN w >= h THEN 'horizontal' ELSE 'vertical' END AS orientation FROM v_boxes")
def prj14(spark, d):
    return Views(spark, d).boxes().select("page", "label", S.orientation(F.col("w"), F.col("h")).alias("orientation"))


@query("prj15_reading_order", "SELECT page, label, row_number() OVER (PARTITION BY page ORDER BY -(2 * x + w), 2 * y + h, -(w * h), y, x, label) AS manga_order, row_number() OVER (PARTITION BY page ORDER BY 2 * x + w, 2 * y + h, -(w * h), y, x, label) AS western_order FROM v_boxes")
def prj15(spark, d):
    from pyspark.sql import Window as W

    place = lambda order: F.row_number().over(W.partitionBy("page").orderBy(*S.reading_key(*(F.col(c) for c in "xywh"), order), "label"))
    return Views(spark, d).boxes().select("page", "label", place("manga").alias("manga_order"), place("western").alias("western_order"))


@query("prj16_box_features", "SELECT page, label, round(w::DOUBLE / greatest(h, 1), 9) AS aspect, round(area::DOUBLE / greatest(w * h, 1), 9) AS fill, round((w * h)::DOUBLE / 12000, 9) AS page_share, round(sqrt((w * w + h * h)::DOUBLE), 9) AS diagonal FROM v_boxes")
def prj16(spark, d):
    f = S.box_features(F.col("w"), F.col("h"), F.col("area"), 12000)
    return Views(spark, d).boxes().select("page", "label", *(F.round(c, 9).alias(k) for k, c in f.items()))


@query("prj17_page_status", "SELECT conv_id, CASE WHEN n = 0 THEN 'no_text_regions' WHEN no_pred THEN 'missing_prediction_mask' WHEN no_inp THEN 'missing_inpainting_output' WHEN no_ren THEN 'missing_ocr_translation_output' WHEN bad_ocr THEN 'region_ocr_failure' WHEN bad_tr THEN 'region_translation_failure' WHEN bad_re THEN 'rendering_failure' ELSE 'valid' END AS status FROM (SELECT conv_id, count(*) FILTER (role <> 'system') AS n, conv_id % 9 = 1 AS no_pred, conv_id % 9 = 2 AS no_inp, conv_id % 9 = 3 AS no_ren, coalesce(bool_or(length(text) < 60) FILTER (role <> 'system'), false) AS bad_ocr, coalesce(bool_or(role = 'assistant' AND length(text) > 4000), false) AS bad_tr, coalesce(bool_or(turn = 7 AND role <> 'system'), false) AS bad_re FROM conversations GROUP BY conv_id)")
def prj17(spark, d):
    c = Views(spark, d).table("conversations")
    region = F.struct(
        F.when(F.char_length("text") < 60, "failed").otherwise("ok").alias("ocr_status"),
        F.when((F.col("role") == "assistant") & (F.char_length("text") > 4000), "failed").otherwise("ok").alias("translation_status"),
        F.when(F.col("turn") == 7, "failed").otherwise("ok").alias("render_status"),
    )
    pages = c.groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") != "system", region)).alias("regions"))
    there = lambda k: F.when(F.col("conv_id") % 9 != k, F.lit("x"))
    return pages.select("conv_id", S.page_status(F.col("regions"), there(1), there(2), there(3)).alias("status"))


@query("prj18_licence_class", "SELECT p_partkey, CASE WHEN code = 'none' OR weights = 'none' THEN 'none' WHEN code <> weights THEN 'differ' ELSE 'same' END AS licence FROM (SELECT p_partkey, CASE WHEN p_size < 5 THEN 'none' ELSE split_part(p_name, ' ', 1) END AS code, CASE WHEN p_size > 40 THEN split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 1) END AS weights FROM part)")
def prj18(spark, d):
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    p = Views(spark, d).table("part").select("p_partkey", F.when(F.col("p_size") < 5, "none").otherwise(first).alias("code"), F.when(F.col("p_size") > 40, second).otherwise(first).alias("weights"))
    return p.select("p_partkey", S.licence_class(F.col("code"), F.col("weights")).alias("licence"))


@query("prj20_identifiers", "SELECT doc_id, regexp_matches(image_id, '^[^/\\\\]+/[^/\\\\]+$') AS image_ok, regexp_matches(stem, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AS run_ok, regexp_matches(sha256(stem), '^[0-9a-f]{64}$') AS sha_ok, regexp_matches(md5(stem), '^[0-9a-f]{40}$') AS rev_ok FROM v_pages")
def prj20(spark, d):
    p = Views(spark, d).pages()
    return p.select("doc_id", S.is_image_id(F.col("image_id")).alias("image_ok"), S.is_run_id(F.col("stem")).alias("run_ok"), S.is_sha256(F.sha2("stem", 256)).alias("sha_ok"), S.is_revision(F.md5("stem")).alias("rev_ok"))


@query("prj21_redact", "SELECT conv_id, turn, sha256(replace(text, 'the', '[redacted]')) AS digest, contains(text, 'the') AS refused FROM conversations")
def prj21(spark, d):
    c = Views(spark, d).table("conversations")
    return c.select("conv_id", "turn", F.sha2(S.redact(F.col("text"), "the"), 256).alias("digest"), S.refuses_secret(F.col("text"), "the").alias("refused"))


PADDED = "CASE WHEN turn % 5 = 4 THEN chr(10) || '  ' WHEN turn % 2 = 0 THEN chr(9) || role || ' ' || chr(10) ELSE role END"


@query("prj22_length_ratio", rf"SELECT conv_id, turn, length(a) AS src_len, length(b) AS dst_len, round(length(b)::DOUBLE / length(a), 9) AS ratio, round(length(b) * 0.5::DOUBLE / length(a), 9) AS visual FROM (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS a, regexp_replace({PADDED}, '^\s+|\s+$', '', 'g') AS b FROM conversations) WHERE a <> '' AND b <> ''")
def prj22(spark, d):
    c = Views(spark, d).table("conversations")
    ratios = c.select("conv_id", "turn", *(v.alias(k) for k, v in S.length_ratio(F.col("text"), F.expr(PADDED)).items()))
    return rounded(ratios.filter("ratio IS NOT NULL"), "ratio", "visual")


REFERENCE = "CASE doc_id % 7 WHEN 0 THEN '/' || image_id WHEN 1 THEN 'outputs/../' || image_id WHEN 2 THEN 'private/' || image_id WHEN 3 THEN 'outputs' WHEN 4 THEN 'outputs/raw/' || image_id WHEN 5 THEN 'C:/' || image_id ELSE 'outputs/' || image_id END"


@query("prj23_reference_gate", f"SELECT doc_id, CASE WHEN r LIKE '/%' OR regexp_matches(r, '^[A-Za-z]:/') THEN 'absolute' WHEN list_contains(string_split(r, '/'), '..') THEN 'traversal' WHEN split_part(r, '/', 1) NOT IN ('outputs', 'data') THEN 'unknown_root' WHEN strpos(r, '/') = 0 THEN 'empty' WHEN r LIKE 'outputs/raw/%' THEN 'forbidden' ELSE 'ok' END AS verdict FROM (SELECT doc_id, {REFERENCE} AS r FROM v_pages)")
def prj23(spark, d):
    p = Views(spark, d).pages().select("doc_id", F.expr(REFERENCE).alias("r"))
    return p.select("doc_id", S.classify_reference(F.col("r"), ["outputs", "data"], ["outputs/raw"]).alias("verdict"))


@query("prj24_status_map", "SELECT CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'F' THEN 'failed' ELSE 'pending' END AS status, count(*) AS n FROM orders GROUP BY 1")
def prj24(spark, d):
    raw = F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "F", "failed").otherwise("pending")
    return Views(spark, d).table("orders").select(S.map_status(raw).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("prj26_backoff", "SELECT o_orderkey, array_to_string(list_transform(generate_series(1, n), lambda k: CAST(least(0.25 * pow(2, k - 1), 3.0) AS DOUBLE)::VARCHAR), ',') AS waits FROM (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS n FROM orders)")
def prj26(spark, d):
    n = F.substring("o_orderpriority", 1, 1).cast("int")
    o = Views(spark, d).table("orders").select("o_orderkey", n.alias("n"))
    return o.select("o_orderkey", F.array_join(S.backoff_schedule(F.col("n"), 0.25, 3.0).cast("array<string>"), ",").alias("waits"))


@query("fn2_cache_key", "SELECT conv_id, turn, sha256('[\"' || replace(replace(replace(text, '\\\\', '\\\\\\\\'), '\"', '\\\\\"'), chr(10), '\\\\n') || '\",\"' || role || '\",\"fixture\",\"m1\"]') AS cache_key FROM conversations".replace("\\\\", "\\"))
def fn2(spark, d):
    c = Views(spark, d).table("conversations")
    return c.select("conv_id", "turn", S.cache_key("text", "role", F.lit("fixture"), F.lit("m1")).alias("cache_key"))


BLANK = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query("fn12_text_status", f"SELECT CASE WHEN regexp_full_match(text, '{BLANK}*') THEN 'empty' ELSE 'ok' END AS status, count(*) AS n FROM (SELECT coalesce(text, '') AS text FROM documents UNION ALL SELECT repeat(chr(12288), doc_id % 3) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN chr(160) ELSE lang END FROM documents) GROUP BY 1")
def fn12(spark, d):
    docs = Views(spark, d).table("documents")
    blank = docs.select(F.expr("concat(repeat('\u3000', cast(doc_id % 3 as int)), '\n', CASE WHEN doc_id % 2 = 0 THEN '\u00a0' ELSE lang END)").alias("text"))
    return docs.select("text").union(blank).groupBy(S.text_status(F.col("text")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("snk4_artifact_path", "SELECT doc_id, 'outputs/run-1/otsu/telea/' || image_id || '.png' AS path FROM v_pages")
def snk4(spark, d):
    p = Views(spark, d).pages()
    return p.select("doc_id", S.artifact_path(F.lit("outputs"), F.lit("run-1"), F.lit("otsu"), F.lit("telea"), F.col("image_id")).alias("path"))


WRAP = f"""WITH RECURSIVE t AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(text, '{BLANK}+'), lambda x: x <> '') AS words FROM conversations), p AS (SELECT conv_id, turn, flatten(list_transform(words, lambda w: list_transform(generate_series(0, (length(w) - 1) // 24), lambda i: substr(w, i * 24 + 1, 24)))) AS pieces, text FROM t), r(conv_id, turn, k, line, done, widest) AS (SELECT conv_id, turn, 1, length(pieces[1]), 0, 0 FROM p WHERE len(pieces) > 0 UNION ALL SELECT r.conv_id, r.turn, r.k + 1, CASE WHEN r.line + 1 + length(p.pieces[r.k + 1]) <= 24 THEN r.line + 1 + length(p.pieces[r.k + 1]) ELSE length(p.pieces[r.k + 1]) END, CASE WHEN r.line + 1 + length(p.pieces[r.k + 1]) <= 24 THEN r.done ELSE r.done + 1 END, CASE WHEN r.line + 1 + length(p.pieces[r.k + 1]) <= 24 THEN r.widest ELSE greatest(r.widest, r.line) END FROM r JOIN p USING (conv_id, turn) WHERE r.k < len(p.pieces)) SELECT r.conv_id, r.turn, r.done + 1 AS n_lines, greatest(r.widest, r.line) AS widest FROM r JOIN p USING (conv_id, turn) WHERE r.k = len(p.pieces) UNION ALL SELECT conv_id, turn, 1, length(text) FROM p WHERE len(pieces) = 0"""


@query("fn11_wrap_text", WRAP)
def fn11(spark, d):
    c = Views(spark, d).table("conversations")
    return c.select("conv_id", "turn", S.wrap_text(F.col("text"), 24).alias("lines")).select("conv_id", "turn", F.size("lines").alias("n_lines"), F.array_max(F.transform("lines", lambda x: F.char_length(x))).alias("widest"))


# --- joins ---


@query("jn1_pair", "SELECT m.doc_id, m.manga, m.stem, r.path AS raw_path FROM v_masks m JOIN (SELECT manga, stem, max(image_id || '.png') AS path FROM v_pages GROUP BY ALL) r USING (manga, stem)")
def jn1(spark, d):
    v = Views(spark, d)
    return C.pair(v.masks().select("doc_id", "manga", "stem"), v.pages().withColumn("path", F.concat("image_id", F.lit(".png"))))


@query("jn2_orphans", "SELECT 'mask' AS kind, manga, stem FROM v_masks m WHERE NOT EXISTS (SELECT 1 FROM v_pages p WHERE p.manga = m.manga AND p.stem = m.stem) UNION ALL SELECT 'page', manga, stem FROM v_pages p WHERE NOT EXISTS (SELECT 1 FROM v_masks m WHERE p.manga = m.manga AND p.stem = m.stem)")
def jn2(spark, d):
    v = Views(spark, d)
    m, p = v.masks().select("manga", "stem"), v.pages().select("manga", "stem")
    return C.orphans(m, p).select(F.lit("mask").alias("kind"), "manga", "stem").union(C.orphans(p, m).select(F.lit("page"), "manga", "stem"))


@query("jn3_stem_mismatch", "SELECT m.manga || '/' || m.stem AS mask_id, p.manga || '/' || m.stem AS page_id FROM v_masks m JOIN v_pages p ON lower(m.stem) = lower(p.stem) AND m.manga <> p.manga WHERE NOT EXISTS (SELECT 1 FROM v_pages q WHERE q.manga = m.manga AND q.stem = m.stem)")
def jn3(spark, d):
    v = Views(spark, d)
    m, p = v.masks().select("manga", "stem"), v.pages().select("manga", "stem")
    return C.stem_mismatches(C.orphans(m, p), p)


@query("jn4_folder_mismatch", "SELECT page_id, mask_id FROM (SELECT p.image_id AS page_id, m.manga || '/' || m.stem AS mask_id, row_number() OVER (PARTITION BY p.image_id ORDER BY m.manga, m.stem) AS r FROM v_pages p JOIN v_masks m ON lower(m.stem) = lower(p.stem) AND m.manga <> p.manga WHERE NOT EXISTS (SELECT 1 FROM v_masks q WHERE q.manga = p.manga AND q.stem = p.stem)) WHERE r = 1")
def jn4(spark, d):
    v = Views(spark, d)
    m, p = v.masks().select("manga", "stem"), v.pages().select("manga", "stem")
    return C.folder_mismatches(C.orphans(p, m), m)


@query("jn5_exactly_one", "SELECT o.o_custkey AS cust, count(*) AS n, CASE WHEN any_value(k.pages) IS NULL THEN 'no_page' WHEN any_value(k.pages) > 1 THEN 'ambiguous' ELSE 'mapped' END AS outcome FROM orders o LEFT JOIN (SELECT user_id, count(*) AS pages FROM events GROUP BY 1) k ON o.o_custkey = k.user_id GROUP BY o.o_custkey")
def jn5(spark, d):
    v = Views(spark, d)
    out = C.map_exactly_one(v.table("orders").select(F.col("o_custkey").alias("cust")), v.table("events").select(F.col("user_id").alias("cust")), ["cust"])
    return out.groupBy("cust", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("jn6_identity", "SELECT s.conv_id, s.turn, s.quoted IS NOT DISTINCT FROM i.sha256 AS agrees FROM (SELECT conv_id, turn, sha256(text || CASE WHEN turn = 3 THEN 'x' ELSE '' END) AS quoted FROM conversations) s LEFT JOIN (SELECT conv_id, turn, sha256(text) AS sha256 FROM conversations WHERE role <> 'system') i USING (conv_id, turn)")
def jn6(spark, d):
    c = Views(spark, d).table("conversations").withColumn("image_id", F.concat_ws("/", "conv_id", "turn"))
    side = c.select("conv_id", "turn", "image_id", F.sha2(F.concat("text", F.when(F.col("turn") == 3, "x").otherwise("")), 256).alias("quoted"))
    return C.check_identity(side, c.filter("role <> 'system'").select("image_id", F.sha2("text", 256).alias("sha256"))).select("conv_id", "turn", "agrees")


@query("jn7_failed_counts", "SELECT method, count(DISTINCT image_id) AS failed FROM v_failures f WHERE EXISTS (SELECT 1 FROM v_metrics m WHERE m.method = f.method AND m.image_id = f.image_id) GROUP BY method")
def jn7(spark, d):
    v = Views(spark, d)
    return M.failed_counts(v.failures(), v.metrics())


@query("jn8_case_lists", "SELECT q.method, CASE WHEN r.method IS NOT NULL THEN coalesce(s.n, 0) END AS n_success, CASE WHEN r.method IS NOT NULL THEN coalesce(f.n, 0) END AS n_failed FROM (VALUES ('adaptive'), ('components'), ('edges'), ('otsu'), ('mser')) q(method) LEFT JOIN (SELECT DISTINCT method FROM v_metrics) r USING (method) LEFT JOIN (SELECT method, count(DISTINCT image_id) AS n FROM v_metrics m WHERE NOT EXISTS (SELECT 1 FROM v_failures f WHERE f.method = m.method AND f.image_id = m.image_id) GROUP BY 1) s USING (method) LEFT JOIN (SELECT method, count(DISTINCT image_id) AS n FROM v_failures GROUP BY 1) f USING (method)")
def jn8(spark, d):
    v = Views(spark, d)
    return C.case_lists(v.metrics(), v.failures(), methods(spark, "mser"))


@query("jn15_sweep_grid", "SELECT method, algorithm, manga, count(*) AS n FROM v_pages, (VALUES ('adaptive'), ('components'), ('edges'), ('otsu')) m(method), (VALUES ('telea'), ('ns')) a(algorithm) GROUP BY ALL")
def jn15(spark, d):
    grid = C.sweep_grid(Views(spark, d).pages().select("manga"), methods(spark), spark.createDataFrame([("telea",), ("ns",)], "algorithm string"))
    return grid.groupBy("method", "algorithm", "manga").agg(F.count(F.lit(1)).alias("n"))


@query("jn16_folds", "SELECT doc_id, CASE WHEN manga = 'src19' THEN 'unknown_book' WHEN lang = 'es' THEN 'unreadable_fold' WHEN doc_id % 5 <> CAST(substr(manga, 4) AS INTEGER) % 5 THEN 'wrong_fold' ELSE 'ok' END AS verdict FROM v_pages")
def jn16(spark, d):
    folds = spark.createDataFrame([(f"src{i}", i % 5) for i in range(19)], "manga string, fold int")
    p = Views(spark, d).pages().withColumn("fold_attribution", F.when(F.col("lang") == "es", "none").otherwise(F.concat(F.lit("fold_"), F.col("doc_id") % 5)))
    return C.check_folds(p, folds).select("doc_id", "verdict")


@query("jn17_signature_diff", "SELECT coalesce(a.page, b.page) AS page, coalesce(a.label, b.label) AS label, CASE WHEN a.page IS NULL THEN 'added' WHEN b.page IS NULL THEN 'removed' WHEN a.x = b.x AND a.w = b.w THEN 'unchanged' ELSE 'changed' END AS change FROM (SELECT * FROM v_boxes WHERE flag <> 'A') a FULL JOIN (SELECT page, label, x + CASE WHEN h > 12 THEN 1 ELSE 0 END AS x, w FROM v_boxes WHERE flag <> 'R') b USING (page, label)")
def jn17(spark, d):
    b = Views(spark, d).boxes()
    new = b.filter("flag <> 'R'").withColumn("x", F.col("x") + F.when(F.col("h") > 12, 1).otherwise(0))
    return C.signature_diff(b.filter("flag <> 'A'"), new, ["page", "label"], ["x", "w"])


@query("jn18_presence", "SELECT c.c_custkey AS image_id, coalesce(bool_or(o.o_orderstatus = 'F'), false) AS \"has_F\", coalesce(bool_or(o.o_orderstatus = 'O'), false) AS \"has_O\" FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
def jn18(spark, d):
    v = Views(spark, d)
    files = v.table("orders").select(F.col("o_custkey").alias("image_id"), F.col("o_orderstatus").alias("kind"))
    return C.artifact_presence(v.table("customer").select(F.col("c_custkey").alias("image_id")), files, ["F", "O"])


@query("jn19_run_links", "SELECT event_id, CASE WHEN c.c_custkey IS NULL THEN 'missing_source' WHEN c.c_nationkey <> e.k THEN 'method_mismatch' ELSE 'ok' END AS verdict FROM (SELECT event_id, user_id * 20 AS u, event_id % 25 AS k FROM events) e LEFT JOIN customer c ON c.c_custkey = e.u")
def jn19(spark, d):
    v = Views(spark, d)
    runs = v.table("events").select("event_id", (F.col("user_id") * 20).alias("source_run"), (F.col("event_id") % 25).alias("method"))
    return C.check_run_links(runs, v.table("customer").select(F.col("c_custkey").alias("run_id"), F.col("c_nationkey").alias("method"))).select("event_id", "verdict")


# --- metrics ---


@query("agg2_summary", "SELECT method, count(*) AS n_images, round(avg(iou), 9) AS mean_iou, round(avg(\"precision\"), 9) AS mean_precision, round(avg(recall), 9) AS mean_recall, round(avg(f1), 9) AS mean_f1, round(stddev_pop(iou), 9) AS std_iou, round(avg(inference_time_seconds), 9) AS mean_time FROM v_metrics GROUP BY method")
def agg2(spark, d):
    return rounded(M.summarize(Views(spark, d).metrics()), "mean_iou", "mean_precision", "mean_recall", "mean_f1", "std_iou", "mean_time")


STATS = ", ".join(f'round(avg("{c}"), 9) AS {c}_mean, round(stddev_pop("{c}"), 9) AS {c}_std' for c in M.SCORES)
SCORED = f"SELECT method, 'scored' AS status, {STATS}, round(avg(inference_time_seconds), 9) AS time_mean, round(sum(inference_time_seconds), 6) AS time_total, count(DISTINCT image_id) - coalesce(any_value(n), 0) AS success, coalesce(any_value(n), 0) AS failed FROM v_metrics LEFT JOIN (SELECT method, count(DISTINCT image_id) AS n FROM v_failures GROUP BY 1) USING (method) GROUP BY method"


def _compared(df):
    return rounded(rounded(df, *(f"{c}_{s}" for c in M.SCORES for s in ("mean", "std")), "time_mean"), "time_total", digits=6)


@query("agg3_scored", SCORED)
def agg3(spark, d):
    v = Views(spark, d)
    return _compared(M.scored(v.metrics(), v.failures()))


@query("agg4_compare", f"SELECT *, CAST(NULL AS VARCHAR) AS reason FROM ({SCORED}) UNION ALL BY NAME SELECT 'mser' AS method, 'not_run' AS status, 'no masks' AS reason")
def agg4(spark, d):
    v = Views(spark, d)
    return _compared(M.compare(v.metrics(), v.failures(), spark.createDataFrame([("mser", "no masks")], "method string, reason string")))


@query("prj19_flatten_comparison", f"SELECT method, iou_mean, iou_std, f1_mean, f1_std FROM ({SCORED})")
def prj19(spark, d):
    v = Views(spark, d)
    nested = _compared(M.scored(v.metrics(), v.failures())).select("method", F.struct(F.struct(F.col("iou_mean").alias("mean"), F.col("iou_std").alias("std")).alias("iou"), F.struct(F.col("f1_mean").alias("mean"), F.col("f1_std").alias("std")).alias("f1")).alias("m"))
    return nested.select("method", *(F.col(f"m.{c}.{s}").alias(f"{c}_{s}") for c in ("iou", "f1") for s in ("mean", "std")))


@query("agg1_confusion_runs", "WITH g AS (SELECT image_id, y, x FROM v_ink WHERE kind IN ('click', 'view')), p AS (SELECT DISTINCT image_id, y, x FROM v_ink WHERE kind IN ('view', 'purchase')) SELECT i.image_id, (SELECT count(*) FROM (SELECT DISTINCT image_id, y, x FROM g) a JOIN p USING (image_id, y, x) WHERE a.image_id = i.image_id) AS tp, (SELECT count(*) FROM p WHERE p.image_id = i.image_id AND NOT EXISTS (SELECT 1 FROM g WHERE g.image_id = p.image_id AND g.y = p.y AND g.x = p.x)) AS fp, (SELECT count(*) FROM (SELECT DISTINCT image_id, y, x FROM g) a WHERE a.image_id = i.image_id AND NOT EXISTS (SELECT 1 FROM p WHERE p.image_id = a.image_id AND p.y = a.y AND p.x = a.x)) AS fn FROM (SELECT DISTINCT image_id FROM v_ink) i")
def agg1(spark, d):
    from foliogrid.operators.masks import to_runs

    ink = Views(spark, d).ink()
    return M.confusion_of_runs(ink, to_runs(ink.filter("kind IN ('click', 'view')")), to_runs(ink.filter("kind IN ('view', 'purchase')")))


@query("agg22_macro", "SELECT method, round(avg(tp::DOUBLE / greatest(1, tp + fp)), 9) AS mean_precision, round(avg(tp::DOUBLE / greatest(1, tp + fn)), 9) AS mean_recall, round(avg(tp::DOUBLE / greatest(1, tp + fp + fn)), 9) AS mean_iou, count(*) FILTER (tp::DOUBLE / greatest(1, tp + fp) < 0.5) AS weak_pages, count(*) AS pages FROM v_conf GROUP BY method")
def agg22(spark, d):
    return rounded(M.macro_scores(Views(spark, d).metrics()), "mean_precision", "mean_recall", "mean_iou")


@query("agg27_catalog", "SELECT manga, count(DISTINCT stem) AS pages, min(stem) AS first, max(stem) AS last FROM v_pages GROUP BY manga")
def agg27(spark, d):
    return C.catalog(Views(spark, d).pages())


@query("agg28_dominant_run", "SELECT segment, run_id, pages FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY pages DESC, run_id) AS r FROM (SELECT c_mktsegment AS segment, o_orderpriority AS run_id, count(*) AS pages FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)) WHERE r = 1")
def agg28(spark, d):
    v = Views(spark, d)
    p = v.table("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("run_id"))
    return C.dominant_run(p, ["segment"])


@query("agg30_totals", "SELECT count(DISTINCT manga) AS mangas, count(*) AS pages, sum(n_chars) AS chars FROM v_pages")
def agg30(spark, d):
    return Views(spark, d).pages().agg(F.count_distinct("manga").alias("mangas"), F.count(F.lit(1)).alias("pages"), F.sum("n_chars").alias("chars"))


# --- selection ---


def _selected(rule: str) -> str:
    by = {"highest_iou_f1": "(iou + f1) / 2 DESC", "lowest_iou_f1": "(iou + f1) / 2", "most_false_positives": "fp DESC", "most_false_negatives": "fn DESC"}[rule]
    return f"SELECT method, image_id, rank FROM (SELECT method, image_id, row_number() OVER (PARTITION BY method ORDER BY {by}, image_id) AS rank FROM v_metrics) WHERE rank <= 5"


for _rule in SEL.RULES[:4]:
    query(f"win1_{_rule}", _selected(_rule))(lambda spark, d, rule=_rule: SEL.select_samples(Views(spark, d).metrics(), rule, 5).select("method", "image_id", "rank"))


@query("win1_shortfall", "SELECT method, count(*) FILTER (n <= 200) AS selected, greatest(200 - count(*) FILTER (n <= 200), 0) AS shortfall FROM (SELECT method, row_number() OVER (PARTITION BY method) AS n FROM v_metrics) GROUP BY method")
def win1s(spark, d):
    m = Views(spark, d).metrics()
    return SEL.shortfall(m, SEL.select_samples(m, "highest_iou_f1", 200), 200)


@query("win2_manual", "WITH f AS (SELECT image_id, min(doc_id) AS pos FROM (SELECT doc_id, source || '/' || CASE WHEN doc_id % 3 = 0 THEN 'xx' ELSE lang END AS image_id FROM documents) GROUP BY 1) SELECT method, image_id, rank, fp FROM (SELECT q.method, f.image_id, m.fp, row_number() OVER (PARTITION BY q.method ORDER BY f.pos) AS rank FROM (SELECT DISTINCT method FROM v_metrics) q CROSS JOIN f LEFT JOIN v_metrics m ON m.method = q.method AND m.image_id = f.image_id) WHERE rank <= 6")
def win2(spark, d):
    v = Views(spark, d)
    flags = v.table("documents").select(F.col("doc_id").alias("pos"), F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 3 == 0, "xx").otherwise(F.col("lang"))).alias("image_id"))
    return SEL.select_samples(v.metrics(), "manual", 6, flags).select("method", "image_id", "rank", "fp")


for _mode, _by in {"first": "image_id", "best": "f1 DESC, image_id DESC", "worst": "f1, image_id"}.items():
    query(f"win3_{_mode}", f"SELECT method, image_id, rank FROM (SELECT method, image_id, row_number() OVER (PARTITION BY method ORDER BY {_by}) AS rank FROM v_metrics) WHERE rank <= 7")(lambda spark, d, mode=_mode: SEL.select_pages(Views(spark, d).metrics(), mode, 7).select("method", "image_id", "rank"))


@query("win4_cases", "WITH r AS (SELECT method, image_id, row_number() OVER (PARTITION BY method ORDER BY f1 DESC, image_id) AS rank, count(*) OVER (PARTITION BY method) AS total FROM v_metrics m WHERE NOT EXISTS (SELECT 1 FROM v_failures f WHERE f.method = m.method AND f.image_id = m.image_id)) SELECT method, image_id, CASE WHEN rank <= 4 THEN 'good' ELSE 'average' END AS case_kind, rank FROM r WHERE rank <= 4 OR (rank > greatest((total - 4) // 2, 0) AND rank <= greatest((total - 4) // 2, 0) + 4) UNION ALL SELECT method, image_id, 'failure', NULL FROM v_failures")
def win4(spark, d):
    v = Views(spark, d)
    return SEL.case_entries(v.metrics(), v.failures(), 4)


@query("win5_typical", "SELECT method, image_id, rank FROM (SELECT method, image_id, row_number() OVER (PARTITION BY method ORDER BY round(abs(f1 - mean), 12), image_id) AS rank FROM v_metrics JOIN (SELECT method, avg(f1) AS mean FROM v_metrics GROUP BY 1) USING (method)) WHERE rank <= 5")
def win5(spark, d):
    return SEL.select_typical(Views(spark, d).metrics(), 5).select("method", "image_id", "rank")


@query("win11_worst", "SELECT method, image_id, f1 FROM (SELECT method, image_id, round(f1, 9) AS f1 FROM v_metrics) ORDER BY f1, method, image_id LIMIT 12")
def win11(spark, d):
    return SEL.worst(rounded(Views(spark, d).metrics().select("method", "image_id", "f1"), "f1"), "f1", 12, ["method", "image_id"])


@query("win12_canonical_order", "SELECT method, image_id, tp FROM v_metrics ORDER BY list_position(['otsu', 'edges'], method) NULLS LAST, method, image_id")
def win12(spark, d):
    return SEL.canonical_order(Views(spark, d).metrics().select("method", "image_id", "tp"), ["otsu", "edges"], then=("image_id",))


# --- set operations ---


@query("set1_admitted", "SELECT DISTINCT o_orderpriority AS method FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'O'")
def set1(spark, d):
    o = Views(spark, d).table("orders").withColumnRenamed("o_orderpriority", "method")
    return o.filter("o_orderstatus = 'F'").select("method").union(o.filter("o_orderstatus = 'O'").select("method")).distinct()


@query("set2_awaited", "SELECT DISTINCT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set2(spark, d):
    v = Views(spark, d)
    return v.table("customer").select("c_custkey").subtract(v.table("orders").select(F.col("o_custkey").alias("c_custkey")))


@query("set3_bad_values", "SELECT event_type AS image_id, count(DISTINCT v) FILTER (v NOT IN (0, 255)) = 0 AS ok, array_to_string(list_slice(list_sort(list(DISTINCT v) FILTER (v NOT IN (0, 255))), 1, 8), ', ') || CASE WHEN count(DISTINCT v) FILTER (v NOT IN (0, 255)) > 8 THEN ', ...' ELSE '' END AS offending FROM (SELECT event_type, CAST(least(255, floor(value)) AS INTEGER) AS v FROM events) GROUP BY 1")
def set3(spark, d):
    from foliogrid.operators.masks import binary_gate

    return binary_gate(Views(spark, d).pixels())


@query("set4_failed_scored", "SELECT image_id FROM v_failures INTERSECT SELECT image_id FROM v_metrics")
def set4(spark, d):
    v = Views(spark, d)
    return v.failures().select("image_id").intersect(v.metrics().select("image_id"))


@query("set6_overlay", "WITH g AS (SELECT image_id, y, x FROM v_ink WHERE kind = 'click'), p AS (SELECT image_id, y, x FROM v_ink WHERE kind = 'view') SELECT image_id, CASE WHEN p.y2 IS NOT NULL AND g.y1 IS NOT NULL THEN 'both' WHEN g.y1 IS NOT NULL THEN 'missed' ELSE 'extra' END AS cls, count(*) AS n FROM (SELECT *, y AS y1 FROM g) g FULL JOIN (SELECT *, y AS y2 FROM p) p USING (image_id, y, x) GROUP BY ALL")
def set6(spark, d):
    from foliogrid.operators.masks import overlay_classes

    ink = Views(spark, d).ink()
    return overlay_classes(ink.filter("kind = 'click'"), ink.filter("kind = 'view'")).groupBy("image_id", "cls").agg(F.count(F.lit(1)).alias("n"))
