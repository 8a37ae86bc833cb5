"""Secret scans with corpus-wide ownership frequency.

Candidates are found by patterns in every whole text, with code-point offsets that come from the lengths of what
lies between matches. Every candidate value is then looked at across the corpus: in how many distinct
repositories and of how many distinct owners its digest occurs; values themselves are neither written nor shuffled. A value of many owners is a copied example; one that
stays with few owners and looks random is probably live. The value of a private key is its body, not its heading. All of it is DataFrame expressions.

Defined results: a null text is empty; null owners and repositories count as one unnamed owner; a repeated row
gives a repeated result; a document without candidates has zero counts, the digest of the empty string and
empty spans; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliogrid.llm.common import materialize, table, whole_text

BASE_KINDS = ("assign", "access", "hex")

# Kind, pattern, group that is the secret, least length of that group, plain strings of which a
# text must hold one (in lower case if folded) before the pattern is tried.
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, False, ("AKIA",)),
    ("hex", r"[0-9a-f]{24,}", 0, 24, False, ()),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28, False, ("eyJ",)),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\s{0,4}[A-Za-z]{1,20}-[A-Za-z]{1,20}:[^\n]{0,200}){0,4}([A-Za-z0-9+/=\s\\]*)(?:-----END [A-Z ]*PRIVATE KEY-----)?", 1, 0, False, ("PRIVATE KEY-----",)),
    ("prefixed", r"(?:gh[pousr]_|xox[abprs]-|sk_live_|rk_live_|AIza)[A-Za-z0-9_-]{16,}", 0, 20, False, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_", "rk_live_", "AIza")),
    ("userinfo", r"://[^\s/@:]{1,64}:([^\s/@:]{6,128})@", 1, 6, False, ("://",)),
)
ORDER = [p[0] for p in PATTERNS]

# Marks of made-up values.
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|sample|your[_-]|x{6,}|0{8,}|1234567"

#: Sub-keys of a value in the lookup of its frequency, and owners from which a value counts as copied about.
LOOKUP_SALTS = 16
COPIED_FROM = 3


def _matches(text: Column, folded: Column, pattern: str, group: int, fold: bool, needs: tuple[str, ...]) -> Column:
    """Array of matches, null if none: code points before the match since the last one, its length, and of its secret
    part the digest, length, variety of characters and whether it looks made up. The secret itself goes no further."""
    where = folded if fold else text
    has = F.lit(False)
    for need in needs:
        has = has | F.contains(where, F.lit(need))
    has = text.rlike(pattern) if not needs else has
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secrets = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.char_length(g).alias("gap"), F.char_length(h).alias("n"))), secrets, lambda x, s: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), F.sha2(s, 256).alias("digest"), F.char_length(s).alias("size"), F.size(F.array_distinct(F.split(s, ""))).alias("variety"), s.rlike(PLACEHOLDER).alias("made_up")))
    return F.when(has, zipped)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: all rows with a row number, and ``row, kind, start, end, digest, variety, made_up, owner, repo`` of every match."""
    text = whole_text(text_col)
    folded = F.lower(text)
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    repo = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols))
    found = F.filter(F.array(*(F.struct(F.lit(i).alias("k"), _matches(text, folded, p, g, fold, needs).alias("m")) for i, (_, p, g, _, fold, needs) in enumerate(PATTERNS))), lambda x: F.size(x["m"]) > 0)
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), owner.alias("owner"), repo.alias("repo"), found.alias("found")), "secret-rows")
    each = rows.filter(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("f")).select("row", "owner", "repo", F.col("f.k").alias("k"), F.posexplode("f.m").alias("i", "m"))
    upto = W.partitionBy("row", "k").orderBy("i")
    end = F.sum(F.col("m.gap") + F.col("m.n")).over(upto)
    least = F.element_at(F.array(*(F.lit(p[3]) for p in PATTERNS)), F.col("k") + 1)
    spans = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("m.n")).filter(F.col("m.size") >= least)
    return rows, spans.select("row", "k", F.element_at(F.array(*map(F.lit, ORDER)), F.col("k") + 1).alias("kind"), "start", "end", "m.digest", "m.variety", "m.made_up", "owner", "repo")


def ownership(spans: DataFrame) -> DataFrame:
    """``digest, n_owners, n_repos, n_spans`` over the corpus; every step combines before it shuffles."""
    by_repo = spans.groupBy("digest", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_spans"))


def classified(spans: DataFrame, copied_from: int = COPIED_FROM) -> DataFrame:
    """Spans with ``n_owners, n_repos`` and ``class``: copied, placeholder, weak or live."""
    spread = ownership(spans).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(LOOKUP_SALTS - 1))))
    known = spans.withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(LOOKUP_SALTS)).cast("int")).join(spread, ["digest", "salt"])
    kind = F.when(F.col("n_owners") >= copied_from, "copied").when(F.col("made_up"), "placeholder").when(F.col("variety") < 8, "weak").otherwise("live")
    return known.drop("salt").withColumn("class", kind)


def secret_report(docs: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """One row per document with counts, spans, the class of each span in the same order, and how many are live or copied."""
    rows, spans = find_secrets(docs, id_col, **columns)
    known = classified(materialize(spans, "secret-spans"))
    one = F.struct("start", "k", F.concat_ws(":", "kind", "start", "end").alias("s"), "class")
    shown = lambda c, part="s": F.concat_ws(",", F.transform(F.array_sort(c), lambda x: x[part]))
    by_row = known.groupBy("row").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE_KINDS),
        shown(F.collect_list(F.when(F.col("k") < len(BASE_KINDS), one))).alias("base"), shown(F.collect_list(one)).alias("spans"), shown(F.collect_list(one), "class").alias("span_classes"),
        F.count_if(F.col("class") == "live").alias("n_live"), F.count_if(F.col("class") == "copied").alias("n_copied"),
    )
    counts = [f"n_{k}" for k in BASE_KINDS] + ["n_live", "n_copied"]
    out = rows.select("row", id_col).join(by_row, "row", "left")
    return out.select(id_col, *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts), F.sha2(F.coalesce(F.col("base"), F.lit("")), 256).alias("base_sha256"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("spans", "span_classes")))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


QUERIES = {"op2_secrets": op2_secrets}
ORACLES: dict[str, str] = {}
