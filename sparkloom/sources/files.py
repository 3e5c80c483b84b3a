"""Files of their own: markdown documents and sections with front matter, downloads with their stubs. Tasks write them, a file a row."""

from __future__ import annotations

import shutil
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions import urls as U
from sparkloom.sources.http import AGENT, TIMEOUT, _store
from sparkloom.sources.writers import front_matter

#: The text of a stub, and the tags of documents that come from sections and downloads.
STUB_TEXT, SECTION_TAG, PDF_TAG = "(PDF content not yet extracted)", "catalog-section", "pdf"
WRITTEN = "path string, bytes long, error string"


def place_of(url: Column, extension: str | None = None) -> Column:
    """A URL's path as a relative file path; segments that would lead out of the folder are left out; null for a null URL."""
    return F.when(url.isNotNull(), F.array_join(F.filter(F.split(U.file_path(url, "", extension), "/"), lambda x: ~x.isin("", ".", "..")), "/"))


def _put(store, path: str, fill: Callable) -> int:
    """A file that is whole or not there: filled under another name, then moved into place, so a rerun task writes it again."""
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        fill(out)
        size = out.tell()
    store.move(part, path)
    return size


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (path, value) as text files below a folder, when the result (path, bytes, error) is read; of rows with one path the last written stays."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for b in batches:
            out = []
            for path, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = (value or "").encode("utf-8", "surrogatepass")
                out.append((path, _put(store, f"{root}/{path}", lambda f, raw=raw: f.write(raw)), None))
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "bytes", "error"), r)) for r in out], pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("error", pa.string())]))

    return rows.filter("path is not null").select("path", "value").mapInArrow(write, WRITTEN)


def _tags(tags: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))


def _document(meta: dict[str, Column], tags: Column, md: Column) -> Column:
    """Front matter with a list of tags, then the text."""
    whole = front_matter(meta, F.lit(""))
    head = F.substring(whole, F.lit(1), F.length(whole) - F.length(F.lit("\n---\n\n")))
    return F.concat(head, F.lit("\ntags: "), _tags(F.coalesce(tags, F.array().cast("array<string>"))), F.lit("\n---\n\n"), F.coalesce(md, F.lit("")))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents (source_url, source_title, bucket, tags, md) as files (path, value): the URL's path with ".md"."""
    meta = {c: F.col(c) for c in docs.columns if c not in ("md", "tags")}
    return docs.select(place_of(F.col("source_url"), ".md").alias("path"), _document(meta, F.col("tags"), F.col("md")).alias("value"))


def section_files(sections: DataFrame, bucket: str) -> DataFrame:
    """Sections (url, title, text) as files: the page's path, "__" and the fragment, tagged as sections, the title as a heading."""
    base, fragment = F.substring_index("url", "#", 1), F.regexp_extract("url", "#(.*)$", 1)
    stem = F.regexp_replace(place_of(base, ".md"), r"\.md$", "")
    title = X.as_text(F.col("title"))
    meta = {"source_url": F.col("url"), "source_title": title, "bucket": F.lit(bucket)}
    body = F.concat(F.when(title != "", F.concat(F.lit("## "), title, F.lit("\n\n"))).otherwise(""), X.as_text(F.col("text")))
    return sections.select(F.concat(stem, F.when(fragment != "", F.concat(F.lit("__"), fragment)).otherwise(""), F.lit(".md")).alias("path"), _document(meta, F.array(F.lit(bucket), F.lit(SECTION_TAG)), body).alias("value"))


def pdf_stubs(urls: DataFrame) -> DataFrame:
    """Stubs (path, value) of PDF URLs (url, bucket): the URL's path with "-pdf.md"."""
    pdf = urls.filter(F.lower("url").endswith(".pdf"))
    stem = F.regexp_replace(place_of(F.col("url"), ".pdf"), r"(?i)\.pdf$", "")
    meta = {"source_url": F.col("url"), "source_title": F.lit(""), "bucket": F.col("bucket")}
    return pdf.select(F.concat(stem, F.lit("-pdf.md")).alias("path"), _document(meta, F.array(F.col("bucket"), F.lit(PDF_TAG)), F.lit(STUB_TEXT)).alias("value"))


def open_http(url: str):
    return urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=TIMEOUT)


def download(urls: DataFrame, folder: str, open_url: Callable = open_http) -> DataFrame:
    """Streams each URL's bytes into a file below a folder when the result (path, bytes, error) is read; a failure is that row's error and leaves no file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for b in batches:
            out = []
            for url, path in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    with open_url(url) as body:
                        out.append((path, _put(store, f"{root}/{path}", lambda f, body=body: shutil.copyfileobj(body, f, 1 << 16)), None))
                except Exception as e:
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "bytes", "error"), r)) for r in out], pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("error", pa.string())]))

    rows = urls.filter("url is not null").select("url", place_of(F.col("url")).alias("path")).filter("path is not null")
    return rows.mapInArrow(write, WRITTEN)
