"""Writers: CSV and JSON lines, markdown with front matter, vector tables, evaluation results, state."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators.selection import keep_first
from sparkloom.sources.snapshots import write_snapshot


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def front_matter(meta: dict[str, Column], md: Column) -> Column:
    """A markdown document: "key: 'value'" lines between --- lines, then the text."""
    lines = [F.concat(F.lit(f"{k}: '"), F.replace(X.as_text(v), F.lit("'"), F.lit("\\'")), F.lit("'")) for k, v in meta.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), md)


def index_rows(chunks: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """What an index keeps of chunks: ids once (the first), texts, flat metadata (lists joined; tags too), the vector if given."""
    flat = chunks.select(
        "id", F.col("text").alias("document"), X.as_text(F.col("source_url")).alias("url"), X.as_text(F.col("title")).alias("title"), X.as_text(F.col("bucket")).alias("bucket"), X.list_as_text(F.col("headings")).alias("headings"),
        X.as_text(F.col("section_heading")).alias("section_heading"), X.as_text(F.col("section")).alias("section"), X.as_text(F.col("term")).alias("term"), F.coalesce("is_table", F.lit(False)).alias("is_table"),
        F.coalesce("is_table", F.lit(False)).alias("table"), (F.coalesce("has_deadline_words", F.lit(False)) if "has_deadline_words" in chunks.columns else F.lit(False)).alias("has_deadline_words"), X.list_as_text(F.col("tags")).alias("tags"),
    )
    flat = keep_first(flat, ["id"], ["url", "document"])
    return flat if vectors is None else flat.join(vectors.select("id", "embedding"), "id")


def write_index(chunks: DataFrame, path: str, vectors: DataFrame | None = None) -> int:
    """Replaces the index by a new version, a folder a bucket, so that a search in one bucket reads only that folder; its number.

    Readers of the version before keep their rows (``readers.read_index``).
    """
    return write_snapshot(index_rows(chunks, vectors), path, ("bucket",))


def eval_rows(judged: DataFrame) -> DataFrame:
    """The evaluation table as text columns: F1 with three decimals, an unknown source as ""."""
    return judged.select(
        "id", "question", "category", F.col("substring_match").cast("string").alias("substring_match"), F.col("em").cast("string").alias("EM"), F.format_string("%.3f", "f1").alias("F1"), "intent",
        F.coalesce(F.col("source_correct").cast("string"), F.lit("")).alias("source_correct"), X.as_text(F.col("primary_url")).alias("primary_url"),
    )


def write_knowledge(items: DataFrame, json_path: str, csv_path: str) -> None:
    """Items as JSON lines, and as CSV with headings joined by "; "."""
    write_json(items, json_path)
    write_csv(items.withColumn("headings", F.array_join("headings", "; ")), csv_path)


def write_state(state: DataFrame, path: str) -> None:
    """The state as a JSON object for tools that want one; a site's state is bounded by its URL list."""
    entries = {r["url"]: {k: r[k] for k in ("etag", "last_modified", "content_sha1", "last_fetch")} for r in state.toLocalIterator()}
    Path(path).write_text(json.dumps(entries, indent=2, sort_keys=True), encoding="utf-8")


def write_quarantine(docs: DataFrame, kept: str, dropped: str) -> None:
    """In-scope documents and the others (in_scope) to two tables."""
    docs.filter("in_scope").write.mode("overwrite").parquet(kept)
    docs.filter("not in_scope").write.mode("overwrite").parquet(dropped)


def accuracy_bars(by_category: DataFrame) -> DataFrame:
    """The bar chart's data: category and mean accuracy, falling."""
    return by_category.select("category", "accuracy").orderBy(F.desc("accuracy"), "category")
