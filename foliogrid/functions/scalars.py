"""Scalar expressions over pages, boxes, identifiers and texts; all are JVM-side Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of identifiers.
RUN_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*\z"
IMAGE_ID = r"^[^/\\]+/[^/\\]+\z"
SHA256 = r"^[0-9a-f]{64}\z"
REVISION = r"^[0-9a-f]{40}\z"
STATUS_MAP = {"ok": "success"}


def image_id(manga, stem) -> Column:
    return F.concat_ws("/", manga, stem)


def split_image_id(c) -> tuple[Column, Column]:
    """Manga and stem; the split is at the first slash."""
    parts = F.split(c, "/", 2)
    return parts[0], F.get(parts, 1)


def norm_method(c) -> Column:
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit("-"), F.lit("_"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / b)


def prf_iou(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """The four metrics; 1 each if both masks are empty, 0 for other zero denominators."""
    empty = (tp + fp + fn) == 0
    precision, recall, iou = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tp, tp + fp + fn)
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return {k: F.when(empty, 1.0).otherwise(v) for k, v in {"iou": iou, "precision": precision, "recall": recall, "f1": f1}.items()}


def pad_geometry(h: Column, w: Column, multiple: int) -> dict[str, Column]:
    """Sides rounded up to a multiple, and the padding."""
    up = lambda c: (F.ceil(c / multiple) * multiple).cast("long")
    return {"padded_h": up(h), "padded_w": up(w), "pad_h": up(h) - h, "pad_w": up(w) - w}


def letterbox_geometry(h: Column, w: Column, canvas: int) -> dict[str, Column]:
    """Size after scaling the longer side to the canvas: rounded half to even, at least 1, at most the canvas."""
    scale = F.lit(float(canvas)) / F.greatest(h, w)
    side = lambda c: F.least(F.greatest(F.bround(c * scale, 0), F.lit(1)), F.lit(canvas)).cast("long")
    return {"new_h": side(h), "new_w": side(w)}


def box_gaps(lx, ly, lw, lh, rx, ry, rw, rh) -> tuple[Column, Column]:
    """Horizontal and vertical gap of two boxes; 0 where they overlap on that axis."""
    zero = F.lit(0)
    return F.greatest(lx - (rx + rw), rx - (lx + lw), zero), F.greatest(ly - (ry + rh), ry - (ly + lh), zero)


def crop_geometry(x, y, w, h, pad: int, width, height) -> dict[str, Column]:
    """Padded box cut at the page; ``clipped`` tells whether the padded box left the page."""
    x0, y0, x1, y1 = x - pad, y - pad, x + w + pad, y + h + pad
    cx, cy = F.greatest(x0, F.lit(0)), F.greatest(y0, F.lit(0))
    return {
        "crop_x": cx, "crop_y": cy, "crop_w": F.least(x1, F.lit(width)) - cx, "crop_h": F.least(y1, F.lit(height)) - cy,
        "clipped": (x0 < 0) | (y0 < 0) | (x1 > width) | (y1 > height),
    }


def expand_box(x, y, w, h, amount: int, width, height) -> dict[str, Column]:
    """Box grown on all sides and cut at the page."""
    x0, y0 = F.greatest(x - amount, F.lit(0)), F.greatest(y - amount, F.lit(0))
    return {"ex": x0, "ey": y0, "ew": F.least(x + w + amount, F.lit(width)) - x0, "eh": F.least(y + h + amount, F.lit(height)) - y0}


def orientation(w, h) -> Column:
    return F.when(w >= h, "horizontal").otherwise("vertical")


def reading_key(x, y, w, h, order: str = "manga") -> list[Column]:
    """Sort keys of reading order: right to left for manga, else left to right; then top to bottom."""
    across = 2 * x + w
    return [-across if order == "manga" else across, 2 * y + h, -(w * h), y, x]


def box_features(w, h, area, page_area) -> dict[str, Column]:
    return {
        "aspect": w.cast("double") / F.greatest(h, F.lit(1)),
        "fill": area.cast("double") / F.greatest(w * h, F.lit(1)),
        "page_share": (w * h).cast("double") / page_area,
        "diagonal": F.hypot(w.cast("double"), h.cast("double")),
    }


def page_status(regions, prediction, inpainted, rendered) -> Column:
    """State of a page, the most fundamental condition first.

    ``regions`` is an array of structs with ``ocr_status, translation_status, render_status``.
    """
    bad = lambda field: F.exists(regions, lambda r: F.coalesce(r[field], F.lit("ok")) != "ok")
    return (
        F.when(F.coalesce(F.size(regions), F.lit(0)) <= 0, "no_text_regions")
        .when(F.isnull(prediction), "missing_prediction_mask")
        .when(F.isnull(inpainted), "missing_inpainting_output")
        .when(F.isnull(rendered), "missing_ocr_translation_output")
        .when(bad("ocr_status"), "region_ocr_failure")
        .when(bad("translation_status"), "region_translation_failure")
        .when(F.exists(regions, lambda r: F.coalesce(r["render_status"] == "failed", F.lit(False))), "rendering_failure")
        .otherwise("valid")
    )


def licence_class(code, weights) -> Column:
    """none: one of them is undeclared; differ: two terms apply; same."""
    return F.when((code == "none") | (weights == "none"), "none").when(code != weights, "differ").otherwise("same")


def is_run_id(c) -> Column:
    return F.regexp_like(c, F.lit(RUN_ID)) & (c != ".") & ~F.contains(c, F.lit(".."))


def is_image_id(c) -> Column:
    return F.regexp_like(c, F.lit(IMAGE_ID))


def is_sha256(c) -> Column:
    return F.regexp_like(c, F.lit(SHA256))


def is_revision(c) -> Column:
    return F.regexp_like(c, F.lit(REVISION))


def redact(c, secret: str) -> Column:
    """The text with every literal occurrence of the secret hidden."""
    return F.replace(c, F.lit(secret), F.lit("[redacted]")) if secret else c


def refuses_secret(c, secret: str) -> Column:
    return F.contains(c, F.lit(secret)) if secret else F.lit(False)


def length_ratio(src, dst) -> dict[str, Column]:
    """Length ratio of texts without white space around them, and the ratio of widths with latin letters half as wide.

    Of pairs of which either text is blank nothing is said: all four are null.
    """
    ends = F.lit(rf"\A[{BLANK}]+|[{BLANK}]+\z")
    both = ~is_blank(src) & ~is_blank(dst)
    a, b = (F.when(both, F.char_length(F.regexp_replace(c, ends, F.lit("")))) for c in (src, dst))
    return {"src_len": a, "dst_len": b, "ratio": b / F.greatest(a, F.lit(1)), "visual": b * 0.5 / F.greatest(a, F.lit(1))}


def classify_reference(c, roots: list[str], forbidden: list[str]) -> Column:
    """First rule that refuses an artifact reference ``root/tail``; ok if none does."""
    text = F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("\\"), F.lit("/"))
    root, tail = F.substring_index(text, "/", 1), F.regexp_extract(text, r"(?s)^[^/]*/(.*)$", 1)
    under = F.lit(False)
    for f in forbidden:
        under = under | (text == f) | text.startswith(f"{f}/")
    return (
        F.when(text.startswith("/") | text.rlike(r"^[A-Za-z]:/"), "absolute")
        .when(F.array_contains(F.split(text, "/"), ".."), "traversal")
        .when(~root.isin(roots), "unknown_root")
        .when(tail == "", "empty")
        .when(under, "forbidden")
        .otherwise("ok")
    )


def map_status(c) -> Column:
    """Stage vocabularies folded into one."""
    out = c
    for old, new in STATUS_MAP.items():
        out = F.when(c == old, new).otherwise(out)
    return out


def backoff_schedule(n: Column, initial: float, most: float) -> Column:
    """Waits before retries 1..n: doubling, bounded."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.least(F.lit(initial) * F.pow(F.lit(2.0), k - 1), F.lit(most))))


#: Characters that are white space, as members of a character class.
BLANK = r"\t-\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def is_blank(c) -> Column:
    """Null, empty, or white space only."""
    return F.regexp_like(F.coalesce(c, F.lit("")), F.lit(rf"\A[{BLANK}]*\z"))


def text_status(c) -> Column:
    return F.when(is_blank(c), "empty").otherwise("ok")


def canonical_json(*cols) -> Column:
    """JSON array of strings as a canonical text: control characters as lower-case escapes."""
    text = F.to_json(F.array(*(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols)))
    for code in [*range(0x0B, 0x0C), *range(0x0E, 0x20)]:
        text = F.replace(text, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return text


def cache_key(text, lang, provider, model) -> Column:
    """Content address of one request."""
    return F.sha2(canonical_json(text, lang, provider, model), 256)


def artifact_path(base, run_id, method, algorithm, image, suffix: str = ".png") -> Column:
    """Address of an artifact from its identity alone; null unless run and image are well formed."""
    return F.when(is_run_id(run_id) & is_image_id(image), F.concat(F.concat_ws("/", base, run_id, method, algorithm, image), F.lit(suffix)))


def wrap_text(text: Column, width: int) -> Column:
    """Lines of greedy wrapping to ``width`` characters; longer words are broken; a blank text is one line as it is."""
    words = F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != "")
    pieces = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.ceil(F.char_length(w) / width).cast("int") - 1), lambda i: F.substring(w, i * width + 1, F.lit(width)))))

    def add(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = F.char_length(last) + 1 + F.char_length(word) <= width
        joined = F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat_ws(" ", last, word)))
        return F.when(F.size(lines) == 0, F.array(word)).when(fits, joined).otherwise(F.concat(lines, F.array(word)))

    return F.when(is_blank(text), F.array(text)).otherwise(F.aggregate(pieces, F.array().cast("array<string>"), add))
