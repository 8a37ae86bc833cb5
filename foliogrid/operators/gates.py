"""Ordered quality gates as data: violations with a check number, first failures, and rule tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliogrid.functions.scalars import is_image_id

SECRET_NAMES = ("api_key", "authorization", "credential", "secret", "token")


@dataclass(frozen=True)
class Rule:
    """A row that meets ``bad`` breaks the rule."""

    category: str
    bad: Column
    reason: str


def intake(samples: DataFrame, rules: list[Rule]) -> DataFrame:
    """Each sample with the first rule that it breaks, as ``category, reason, check_no``; null if accepted."""
    first = F.coalesce(*(F.when(F.coalesce(r.bad, F.lit(False)), F.struct(F.lit(i).alias("no"), F.lit(r.category).alias("category"), F.lit(r.reason).alias("reason"))) for i, r in enumerate(rules, 1)))
    out = samples.withColumn("__first", first)
    return out.withColumns({"check_no": F.col("__first.no"), "category": F.col("__first.category"), "reason": F.col("__first.reason")}).drop("__first")


def violations(samples: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """All broken rules of all samples, one row each, from one scan."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(r.bad, F.lit(False)), F.struct(F.lit(i).alias("check_no"), F.lit(r.category).alias("category"), F.lit(r.reason).alias("reason"))) for i, r in enumerate(rules, 1))))
    return samples.select(*keys, F.explode(broken).alias("b")).select(*keys, "b.*")


def first_failure(found: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first violation of each group by check, then by the other keys; combined before the shuffle."""
    rest = [c for c in found.columns if c not in (*group, "check_no", *order)]
    first = found.groupBy(*group).agg(F.min(F.struct("check_no", *order, *rest)).alias("f"))
    return first.select(*group, "f.*")


def receipt(samples: DataFrame, rules: list[Rule], handoff: str, key: str) -> DataFrame:
    """All-or-nothing verdict of each hand-off: admitted, or refused with the first failing check."""
    every = samples.groupBy(handoff).agg(F.count(F.lit(1)).alias("n"))
    first = first_failure(violations(samples, rules, [handoff, key]), [handoff], [key])
    out = every.join(first, handoff, "left")
    return out.select(handoff, "n", F.when(F.col("check_no").isNull(), "admitted").otherwise("refused").alias("verdict"), "check_no", "category", key)


def dense_report(found: DataFrame, categories: list[str]) -> DataFrame:
    """Number of findings of every category, zero included."""
    dim = found.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    n = found.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(n, "category", "left").fillna(0, ["n"])


def check_run_record(runs: DataFrame) -> DataFrame:
    """Invariants of run records ``(run_id, ids array, statuses map, n_ok, n_failed)``."""
    ids, keys = F.col("ids"), F.map_keys("statuses")
    rules = [
        Rule("duplicate_ids", F.size(F.array_distinct(ids)) < F.size(ids), "an id is listed twice"),
        Rule("missing_status", F.size(F.array_except(ids, keys)) > 0, "an id has no status"),
        Rule("foreign_status", F.size(F.array_except(keys, ids)) > 0, "a status has no id"),
        Rule("unknown_status", F.exists(F.map_values("statuses"), lambda s: ~s.isin("ok", "success", "failed", "no_regions")), "a status is unknown"),
        Rule("negative_count", (F.col("n_ok") < 0) | (F.col("n_failed") < 0), "a count is negative"),
    ]
    return intake(runs, rules)


def check_sample(samples: DataFrame, algorithms: list[str]) -> DataFrame:
    """Invariants of sample records ``(image_id, algorithm, inpaint_algorithm, status, error)``."""
    rules = [
        Rule("bad_image_id", ~is_image_id(F.col("image_id")), "not manga/stem"),
        Rule("unknown_algorithm", ~F.col("algorithm").isin(algorithms), "algorithm is unknown"),
        Rule("algorithm_mismatch", F.col("algorithm") != F.col("inpaint_algorithm"), "the two algorithm fields differ"),
        Rule("unknown_status", ~F.col("status").isin("ok", "failed"), "status is unknown"),
        Rule("silent_failure", (F.col("status") == "failed") & (F.trim(F.coalesce("error", F.lit(""))) == ""), "failed without a message"),
    ]
    return intake(samples, rules)


def require_main_run(df: DataFrame) -> DataFrame:
    """Rows of ablations never enter the main comparison."""
    return df.filter(~F.coalesce("ablation", F.lit(False)))


def require_same_list(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Results whose page list is that of their run; others are told apart, not mixed in."""
    return results.join(runs.select("run_id", F.col("identity").alias("run_identity")), "run_id", "left").withColumn("same_list", F.col("identity").eqNullSafe(F.col("run_identity")))


def recheck_view(view: DataFrame, source: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Fields of a copied view that differ from their source: ``keys, field, actual, expected``."""
    text = lambda d, c: F.col(f"{d}.{c}").cast("string")
    both = view.alias("v").join(source.alias("s"), [F.col(f"v.{k}") == F.col(f"s.{k}") for k in keys])
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), text("v", c).alias("actual"), text("s", c).alias("expected")) for c in fields)))
    return both.select(*(F.col(f"v.{k}").alias(k) for k in keys), each.alias("e")).select(*keys, "e.*").filter("NOT (actual <=> expected)")


def verify_threshold(scores: DataFrame, at: float) -> DataFrame:
    """Per image of ``(image_id, p, inside)``: whether the cut gives the mask, else the cut that would.

    ``outcome`` is reproduced, recovered (``cut`` is midway between the sides), inconsistent or unrecoverable.
    """
    g = scores.groupBy("image_id").agg(F.bool_and((F.col("p") >= at) == F.col("inside")).alias("same"), F.max(F.when(~F.col("inside"), F.col("p"))).alias("top_out"), F.min(F.when(F.col("inside"), F.col("p"))).alias("low_in"))
    outcome = F.when(F.col("same"), "reproduced").when(F.col("top_out").isNull() | F.col("low_in").isNull(), "unrecoverable").when(F.col("top_out") < F.col("low_in"), "recovered").otherwise("inconsistent")
    out = g.withColumn("outcome", outcome)
    return out.select("image_id", "outcome", F.when(F.col("outcome") == "reproduced", F.lit(at)).when(F.col("outcome") == "recovered", (F.col("top_out") + F.col("low_in")) / 2).alias("cut"))


def missing_fields(df: DataFrame, paths: list[str], name: str = "missing") -> DataFrame:
    """Sorted failing paths of nested records; a missing container stands for all that it should hold."""

    def fails(path: str) -> Column:
        parts = path.split(".")
        checks = [F.when(F.col(".".join(parts[:i])).isNull(), ".".join(parts[:i])) for i in range(1, len(parts) + 1)]
        return F.coalesce(*checks)

    return df.withColumn(name, F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*map(fails, paths))))), ","))


def deviation_refusal(doc: Column) -> Column:
    """Why a JSON record is refused for its deviation: missing, not an object, or output changed; else null."""
    d = F.get_json_object(doc, "$.deviation")
    changes = F.lower(F.coalesce(F.get_json_object(doc, "$.deviation.changes_output"), F.lit("")))
    return F.when(d.isNull(), "missing").when(~F.startswith(F.ltrim(d), F.lit("{")), "not_an_object").when(~changes.isin("", "false", "0", "null", "[]", "{}"), "changes_output")


def secret_fields(pairs: DataFrame) -> DataFrame:
    """Fields ``(doc, path, value)`` that look like they hold a secret rather than the name of a variable."""
    leaf = F.lower(F.element_at(F.split("path", r"\."), -1))
    env = F.regexp_like("value", F.lit(r"^[A-Z][A-Z0-9_]*\z"))
    hit = F.lit(False)
    for name in SECRET_NAMES:
        hit = hit | (leaf == name) | leaf.endswith(f"_{name}")
    return pairs.filter(hit & ~F.coalesce(env, F.lit(True)))


def requirement_conflicts(requirements: DataFrame, installed: DataFrame) -> DataFrame:
    """Pinned ``name==version`` lines that are absent or of another version."""
    name, version = F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z0-9._-]+)\s*==", 1))), F.trim(F.regexp_extract("line", r"==\s*([^\s;#]+)", 1))
    pins = requirements.select("line", name.alias("name"), version.alias("pinned")).filter("name <> '' AND pinned <> ''")
    out = pins.join(installed.select(F.lower("name").alias("name"), F.col("version").alias("installed")), "name", "left")
    return out.withColumn("conflict", F.when(F.col("installed").isNull(), "missing").when(F.col("installed") != F.col("pinned"), "different")).filter("conflict IS NOT NULL")


def flatten_settings(configs: DataFrame) -> DataFrame:
    """Nested settings ``map<section, map<key, value>>`` as rows ``config, name, value``."""
    return configs.select("config", F.explode("settings").alias("section", "inner")).select("config", "section", F.explode("inner").alias("key", "value")).select("config", F.when(F.col("key") == "", F.col("section")).otherwise(F.concat_ws(".", "section", "key")).alias("name"), "value")


def nondeterminism_findings(docs: DataFrame) -> DataFrame:
    """Leaves ``(doc, path, value)`` that hold a clock time, a UUID or an absolute path."""
    clock = F.regexp_like("value", F.lit(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"))
    uid = F.regexp_like("value", F.lit(r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"))
    path = F.regexp_like("value", F.lit(r"^(/[^/\s]+){2,}|^[A-Za-z]:[\\/]"))
    return docs.withColumn("finding", F.when(clock, "clock").when(uid, "uuid").when(path, "absolute_path")).filter("finding IS NOT NULL")


def conformance(df: DataFrame, doc: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``doc, path, reason`` of every rule that a record breaks.

    A rule is ``(path, kind, argument)``: type, enum (comma list), pattern, min, max, min_length, min_items,
    required or const, compiled to a predicate. Absent values break ``required`` only.
    """

    def bad(path: str, kind: str, arg: str) -> Column:
        c = F.col(path)
        if kind == "required":
            return c.isNull()
        tests = {
            "enum": lambda: ~c.cast("string").isin(arg.split(",")), "const": lambda: c.cast("string") != arg, "pattern": lambda: ~F.regexp_like(c, F.lit(arg)),
            "min": lambda: c < float(arg), "exclusive_min": lambda: c <= float(arg), "max": lambda: c > float(arg), "min_length": lambda: F.char_length(c) < int(arg), "min_items": lambda: F.size(c) < int(arg),
            "type": lambda: F.lit(not dict(df.dtypes).get(path, "").startswith(arg)),
        }
        return c.isNotNull() & tests[kind]()

    each = F.array_compact(F.array(*(F.when(bad(*r), F.struct(F.lit(r[0]).alias("path"), F.lit(f"{r[1]} {r[2]}".strip()).alias("reason"))) for r in rules)))
    return df.select(F.col(doc).alias("doc"), F.explode(each).alias("v")).select("doc", "v.path", "v.reason")
