"""Which URLs belong to the corpus: rules, reasons, keep-first, guards, link audits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sparkloom.functions import urls as U


@dataclass(frozen=True)
class Bucket:
    """A named rule: the first bucket whose include is found decides; its exclude then means no bucket at all."""

    name: str
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()


def strict_patterns(patterns: Sequence[str]) -> list[str]:
    """Patterns as a single-quoted YAML scalar reads them: each backslash doubled, so classes match literal backslashes."""
    return [p.replace("\\", "\\\\") for p in patterns]


def bucket_of(path: Column, buckets: Sequence[Bucket]) -> Column:
    """The first matching bucket's name, null if its exclude matches too or none matches."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for b in buckets:
        out = out.when(U.any_match(path, list(b.include)), F.when(~U.any_match(path, list(b.exclude)), F.lit(b.name)))
    return out


def bucket_from_url(url: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The first (fragment, bucket) whose fragment the URL holds, else ""."""
    out = F.when(F.lit(False), "")
    for fragment, name in rules:
        out = out.when(F.lower(F.coalesce(url, F.lit(""))).contains(fragment), name)
    return out.otherwise("")


def classify(rows: DataFrame, buckets: Sequence[Bucket], exclude: Sequence[str], policy_bucket: str = "policies", policy_allow: Sequence[str] = ()) -> DataFrame:
    """Adds path, bucket and reason (kept, excluded, no_bucket, policy_not_listed) to URL rows."""
    path = U.path_of(F.col("url"))
    bucket = bucket_of(F.col("path"), buckets)
    reason = F.when(U.any_match(F.col("path"), list(exclude)), "excluded").when(F.col("bucket").isNull(), "no_bucket")
    if policy_allow:
        reason = reason.when((F.col("bucket") == policy_bucket) & ~U.any_match(F.col("path"), list(policy_allow)), "policy_not_listed")
    return rows.withColumn("path", path).withColumn("bucket", bucket).withColumn("reason", reason.otherwise("kept"))


def reason_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("reason").agg(F.count("*").alias("n"))


REASONS = ("kept", "excluded", "no_bucket", "policy_not_listed")


def observed_reasons(classified: DataFrame, seen: Observation) -> DataFrame:
    """The same rows; while they are written or read once, ``seen`` counts them by reason, so no second pass is needed.

    ``seen.get`` has a count for each of REASONS, ``all`` beside them.
    """
    counts = [F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in REASONS]
    return classified.observe(seen, F.count(F.lit(1)).alias("all"), *counts)


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Of rows that agree in ``keys`` the first in ``order``, all columns.

    One map-side combined aggregate: a hot key is reduced to a row a task before the exchange, so it needs no window over
    all its rows. Rows equal in the whole order are told apart by their other columns.
    """
    columns = rows.columns
    rank = F.struct(*[c if isinstance(c, Column) else F.col(c) for c in order])
    rest = [c for c in columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns) if rest else F.struct(*keys), F.struct(rank.alias("o"), *[F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(rest)])).alias("_r"))
    return best.select(*[F.col("_r")[c].alias(c) for c in columns])


SOURCE_ORDER = ("sitemap", "discovered", "manual")


def merge_sources(rows: DataFrame) -> DataFrame:
    """URL rows (url, lastmod, source, ordinal), one a URL: sitemap before discovered before manual, then by ordinal."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), F.col("source"))
    return keep_first(rows.filter("url is not null"), ["url"], [F.when(rank == 0, 99).otherwise(rank), "ordinal"])


def missing_urls(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """The required URLs that are not among the rows."""
    need = rows.sparkSession.createDataFrame([(u,) for u in required], "url string")
    return need.join(rows.select("url").distinct(), "url", "left_anti")


def require_urls(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """The rows; an error when they are read if a required URL is missing."""
    gone = missing_urls(rows, required).agg(F.count("*").alias("_gone"))
    checked = gone.select(F.assert_true(F.col("_gone") == 0, F.lit("required URLs are missing")).alias("_ok"))
    return rows.join(F.broadcast(checked), F.col("_ok").isNull()).drop("_ok")


def topic_matches(text: Column, any_of: Sequence[str], must_one_of: Sequence[str] = (), least: int = 2, ascii_words: bool = False) -> Column:
    """At least ``least`` distinct terms are found as whole words, or one of ``must_one_of``.

    ``ascii_words``: only ASCII letters, digits and ``_`` make words, so that any other character is a border.
    """
    before, after = ("(^|[^a-zA-Z0-9_])", "($|[^a-zA-Z0-9_])") if ascii_words else (r"\b", r"\b")

    def found(term: str) -> Column:
        quoted = "".join("\\" + c if not c.isalnum() and c not in " '" else c for c in term)
        return text.rlike(f"(?i){before}{quoted}{after}")

    n = sum((found(t).cast("int") for t in dict.fromkeys(any_of)), F.lit(0))
    out = n >= least
    for t in must_one_of:
        out = out | found(t)
    return F.coalesce(out, F.lit(False))


#: The buckets whose documents a topic filter looks at.
TOPIC_BUCKETS = ("policies", "policies-pdf", "uploads-pdf", "university-policies-pdf")


def topic_filter(docs: DataFrame, topics: dict[str, tuple[Sequence[str], Sequence[str]]], text: str = "text", ascii_words: bool = False, buckets: Sequence[str] | None = None) -> DataFrame:
    """Adds in_scope: whether any topic matches; what is out of scope goes to quarantine by a filter.

    ``buckets`` (TOPIC_BUCKETS, say) limits the filter to documents of these buckets; all others, those without a bucket too, are in scope.
    """
    out = F.lit(False)
    for any_of, must in topics.values():
        out = out | topic_matches(F.col(text), any_of, must, ascii_words=ascii_words)
    if buckets is not None:
        out = out | ~F.coalesce(F.col("bucket").isin(list(buckets)), F.lit(False))
    return docs.withColumn("in_scope", out)


def link_targets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct absolute-path targets of markdown links."""
    return docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\]\((/[^)#?\s]+)"), F.lit(1))).alias("target")).select(F.rtrim(F.col("target"), F.lit("/")).alias("target")).distinct()


def link_gap(links: DataFrame, present: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Linked paths (target) that are not present (path) and not excluded."""
    have = present.select(U.audit_path(F.col("path")).alias("target")).distinct()
    return links.filter(~U.any_match(F.col("target"), list(exclude))).join(have, "target", "left_anti")


def top_prefixes(paths: DataFrame, k: int = 15) -> DataFrame:
    """The most frequent first path segments; equal counts in lexicographic order."""
    seg = F.concat(F.lit("/"), F.element_at(F.split(F.regexp_replace("target", "^/+", ""), "/"), 1))
    return paths.groupBy(seg.alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(k)


def changed(pages: DataFrame, state: DataFrame) -> DataFrame:
    """Pages (url, html) that are new or whose content hash differs from the state's; with the hash."""
    now = pages.withColumn("content_sha1", F.sha1(F.coalesce(F.col("html"), F.lit(""))))
    return now.join(state.select("url", "content_sha1").distinct(), ["url", "content_sha1"], "left_anti")


def next_state(pages: DataFrame, state: DataFrame, fetched: str) -> DataFrame:
    """The state after a run: fetched pages replace their entries, others stay."""
    now = pages.select("url", F.coalesce(F.col("etag"), F.lit(None).cast("string")).alias("etag") if "etag" in pages.columns else F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.sha1(F.coalesce(F.col("html"), F.lit(""))).alias("content_sha1"), F.lit(fetched).alias("last_fetch"), F.lit(0).alias("_age"))
    old = state.select("url", "etag", "last_modified", "content_sha1", "last_fetch", F.lit(1).alias("_age"))
    return keep_first(now.unionByName(old), ["url"], ["_age"]).drop("_age")


def rank_within(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Adds each row's place within its keys."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
