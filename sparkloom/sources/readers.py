"""Readers: sitemaps, markdown with front matter, JSON lines, CSV, YAML, PDF bytes, vector tables, HTTP hook."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.snapshots import read_snapshot

CHUNK_SCHEMA = "id string, source_url string, title string, bucket string, tags array<string>, headings array<string>, section_heading string, text string, is_table boolean, section string, term string, has_deadline_words boolean"
STATE_SCHEMA = "url string, etag string, last_modified string, content_sha1 string, last_fetch string"
#: Child sitemaps that are left out; names tried on a new host.
SKIPPED_SITEMAPS = ("taxonomies", "users")
SITEMAP_NAMES = ("sitemap.xml", "sitemap_index.xml", "wp-sitemap.xml")


#: What is read of either kind of sitemap; other elements are left out. Prefixes of names are ignored.
SITEMAP_SCHEMA = "url array<struct<loc:string,lastmod:string>>, sitemap array<struct<loc:string>>, _broken string"


def _parsed(files: DataFrame) -> DataFrame:
    """Sitemap files (sitemap, xml) with their XML as a struct; comments are dropped, entities and CDATA are read as the XML reader does."""
    plain = F.regexp_replace(F.regexp_replace("xml", r"(?s)<!--.*?-->", ""), r"\A\s+", "")
    options = {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "true"}
    return files.select("sitemap", "xml", F.from_xml(plain, SITEMAP_SCHEMA, options).alias("_x"))


def broken_sitemaps(files: DataFrame) -> DataFrame:
    """The files (sitemap, xml) that are no well-formed XML; they give no URL."""
    return _parsed(files).filter("xml is not null and (_x is null or _x._broken is not null)").select("sitemap", "xml")


def sitemap_urls(files: DataFrame) -> DataFrame:
    """(sitemap, url, lastmod, ordinal) of urlset documents (sitemap, xml); a file that isn't one gives no row; a missing lastmod is ""."""
    rows = _parsed(files).filter("_x._broken is null").select("sitemap", F.posexplode("_x.url").alias("ordinal", "e"))
    text = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", ""))
    return rows.select("sitemap", text("e.loc").alias("url"), text("e.lastmod").alias("lastmod"), "ordinal").filter("url <> ''")


def sitemap_children(files: DataFrame) -> DataFrame:
    """(sitemap, child, ordinal) of sitemapindex documents; children of skipped kinds are left out."""
    rows = _parsed(files).filter("_x._broken is null").select("sitemap", F.posexplode("_x.sitemap").alias("ordinal", "e"))
    rows = rows.select("sitemap", F.regexp_replace(F.coalesce("e.loc", F.lit("")), r"^\s+|\s+$", "").alias("child"), "ordinal")
    ok = F.col("child") != ""
    for s in SKIPPED_SITEMAPS:
        ok = ok & ~F.col("child").contains(s)
    return rows.filter(ok)


def expand_sitemaps(start: DataFrame, files: DataFrame) -> DataFrame:
    """Start sitemaps (sitemap) with indexes replaced by their children; others pass through; each once."""
    kids = start.join(sitemap_children(files), "sitemap")
    plain = start.join(kids.select("sitemap").distinct(), "sitemap", "left_anti")
    return plain.select("sitemap").unionByName(kids.select(F.col("child").alias("sitemap"))).distinct()


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of whole text files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def split_front_matter(files: DataFrame) -> DataFrame:
    """(path, text) as meta map and md: the "key: value" lines between leading --- lines, quotes off; none: an empty map."""
    pattern = r"(?s)\A﻿?---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)(.*)\z"
    head = F.regexp_extract("text", pattern, 1)
    lines = F.filter(F.split(head, "\r?\n"), lambda x: x.rlike(r"^\w[\w-]*\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(\w[\w-]*)\s*:", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^\w[\w-]*\s*:", "")), r"""^['"]|['"]$""", "").alias("v")))
    return files.select("path", F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)).alias("meta"), F.when(F.col("text").rlike(pattern), F.regexp_extract("text", pattern, 2)).otherwise(F.col("text")).alias("md"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown documents (source_url, source_title, bucket, tags, md); PDF stubs, table exports and quarantined files are left out."""
    files = read_files(spark, path, "*.md").filter(~F.col("path").rlike(r"-pdf\.md$|-tables\.md$|/_out_of_scope/"))
    m = split_front_matter(files)
    get = lambda k: F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit(""))
    tags = F.filter(F.transform(F.split(F.regexp_replace(get("tags"), r"[\[\]'\"]", ""), ","), lambda t: F.trim(t)), lambda t: t != "")
    return m.select(get("source_url").alias("source_url"), get("source_title").alias("source_title"), get("bucket").alias("bucket"), tags.alias("tags"), "md", "path")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON lines; blank lines are skipped, a broken one is an error."""
    return spark.read.schema(CHUNK_SCHEMA).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)


def read_table_rows(spark: SparkSession, path: str) -> DataFrame:
    """Table rows of all ``*-table-rows.jsonl`` files below a folder."""
    schema = "type string, url string, section_heading string, text string, meta struct<table:boolean,bucket:string,term:string,session:string,final_withdraw:string,waitlist_ends:string,desc:string,headers:array<string>,full_md:string,has_deadline_words:boolean>"
    rows = spark.read.schema(schema).option("pathGlobFilter", "*-table-rows.jsonl").option("recursiveFileLookup", True).json(path)
    return rows.select("url", "section_heading", "text", "meta.bucket", "meta.term", "meta.has_deadline_words")


def read_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The written index: its current version, or the one with that number."""
    return read_snapshot(spark, path, version)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header as text columns; a byte-order mark is dropped, columns it lacks are null."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    return raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns])


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ["id", "question", "expected_substring", "category", "expected_answer", "expected_source_url"])


def read_eval_results(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv(spark, path, ["id", "question", "category", "substring_match", "EM", "F1", "intent", "source_correct", "primary_url"])
    return rows.select("id", "question", "category", F.col("substring_match").cast("int").alias("substring_match"), F.col("EM").cast("int").alias("em"), F.col("F1").cast("double").alias("f1"), "intent", F.col("source_correct").try_cast("int").alias("source_correct"), "primary_url")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Fetch state from a JSON object url -> {etag, last_modified, content_sha1, last_fetch}; a missing or broken file is empty."""
    try:
        entries = json.loads(Path(path).read_text(encoding="utf-8"))
        rows = [(u, *(v.get(k) for k in ("etag", "last_modified", "content_sha1", "last_fetch"))) for u, v in entries.items()]
    except (OSError, ValueError, AttributeError):
        rows = []
    return spark.createDataFrame(rows, STATE_SCHEMA)


def read_config(path: str) -> dict:
    """A YAML file on the driver."""
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed questions of a YAML file: seed_no, topic, question, must_any, prefer_any, max_answer_chars."""
    seeds = read_config(path).get("seeds", [])
    rows = [(i, s.get("topic"), s.get("question"), s.get("must_any") or [], s.get("prefer_any") or [], s.get("max_answer_chars", 900)) for i, s in enumerate(seeds)]
    return spark.createDataFrame(rows, "seed_no int, topic string, question string, must_any array<string>, prefer_any array<string>, max_answer_chars int")


def read_pdfs(spark: SparkSession, path: str, extract: Callable[[bytes], str]) -> DataFrame:
    """(path, text) of PDF files through a pluggable extractor; a file that it can't read has null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for raw in b["content"]:
                try:
                    out.append(extract(bytes(raw)))
                except Exception:  # any failure of the extractor is that file's
                    out.append(None)
            yield pd.DataFrame({"path": b["path"], "text": out})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "path string, text string")


def pdf_of_stub(path: Column, processed: str, raw: str) -> Column:
    """A stub's path to its PDF's: processed folder to raw folder, "-pdf.md" to ".pdf"."""
    return F.regexp_replace(F.replace(path, F.lit(processed), F.lit(raw)), r"-pdf\.md$", ".pdf")


def fetch(urls: DataFrame, get: Callable[[str, str | None, str | None], tuple[str | None, str]]) -> DataFrame:
    """url, html, status by a pluggable client: get(url, etag, last_modified) -> (body or None, "ok" | "not-modified" | "error").

    One call a URL; a client's exception is that row's error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for u, e, m in zip(b["url"], b["etag"], b["last_modified"], strict=True):
                try:
                    rows.append((u, *get(u, e, m)))
                except Exception:
                    rows.append((u, None, "error"))
            yield pd.DataFrame(rows, columns=["url", "html", "status"])

    have = urls.columns
    cols = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("url", "etag", "last_modified")]
    return urls.select(*cols).mapInPandas(run, "url string, html string, status string")


def preview(chunks: DataFrame, n: int = 3, size: int = 400) -> DataFrame:
    """The first chunks by id with the start of their text; a report."""
    return chunks.orderBy("id").limit(n).withColumn("text", F.substring("text", 1, size))
