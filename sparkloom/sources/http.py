"""Pages over HTTP as a data source: a partition a host, conditional requests, "not-modified" rows.

    write_url_list(state, path)
    spark.dataSource.register(PageSource)
    spark.read.format("pages").option("list", path).load()

The list (url, etag, last_modified) lies in a folder a host, so the driver names hosts only and a task asks one host for one page
after another, with a pause. A request carries the ETag and Last-Modified that the list knows. ``transport`` "file" answers from files
below ``root`` (host/path, "index.html" for a folder), with their content's digest as ETag; it stands in for a network.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, status string, code int, html string, etag string, last_modified string, error string"
AGENT, TIMEOUT, PAUSE = "sparkloom", 60, 0.2


def write_url_list(urls: DataFrame, path: str) -> None:
    """URLs (url, and etag and last_modified where known) as a folder a host; rows that are no URL are left out, each URL stands once."""
    have = urls.columns
    cols = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("url", "etag", "last_modified")]
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    urls.select(*cols).dropDuplicates(["url"]).withColumn("host", host).filter("host is not null").write.mode("overwrite").partitionBy("host").option("ignoreNullFields", True).json(path)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class Host(InputPartition):
    def __init__(self, folder: str):
        super().__init__(folder)
        self.folder = folder


class PageSource(DataSource):
    """Options: list, transport (http, file), root, pause (seconds between requests), timeout, agent."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        if "list" not in options:
            raise ValueError("the option list is missing")

    def partitions(self) -> list[Host]:
        from pyarrow import fs

        store, root = _store(self.options["list"])
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [Host(f.path) for f in sorted(found, key=lambda f: f.path) if f.base_name.startswith("host=")]

    def asked(self, folder: str) -> Iterator[dict]:
        """The host's URLs, a line at a time."""
        from pyarrow import fs

        store, _ = _store(self.options["list"])
        for f in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda f: f.path):
            if f.base_name.endswith(".json"):
                with store.open_input_stream(f.path) as raw:
                    rest = b""
                    while chunk := raw.read(1 << 16):
                        *lines, rest = (rest + chunk).split(b"\n")
                        yield from (json.loads(x) for x in lines if x)
                    if rest:
                        yield json.loads(rest)

    def read(self, partition: Host) -> Iterator[tuple]:
        if not hasattr(partition, "folder"):
            return  # a list without hosts
        get = self.from_file if self.options.get("transport") == "file" else self.from_http
        for row in self.asked(partition.folder):
            url = row["url"]
            try:
                code, body, etag, modified = get(url, row.get("etag"), row.get("last_modified"))
                yield url, "not-modified" if code == 304 else "ok" if code < 300 else "error", code, body if code < 300 else None, etag, modified, None if code < 400 else f"HTTP {code}"
            except Exception as e:  # a failed request is that row's error
                yield url, "error", None, None, None, None, f"{type(e).__name__}: {e}"

    def from_http(self, url: str, etag: str | None, modified: str | None) -> tuple:
        time.sleep(float(self.options.get("pause", PAUSE)))
        headers = {"User-Agent": self.options.get("agent", AGENT)} | ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": modified} if modified else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=float(self.options.get("timeout", TIMEOUT))) as r:
                return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), r.headers.get("ETag"), r.headers.get("Last-Modified")
        except urllib.error.HTTPError as e:
            return e.code, None, e.headers.get("ETag") or etag, e.headers.get("Last-Modified") or modified

    def from_file(self, url: str, etag: str | None, modified: str | None) -> tuple:
        from pyarrow import fs

        at = urlsplit(url)
        store, root = _store(self.options["root"])
        parts = [p for p in unquote(at.path).split("/") if p not in ("", ".", "..")]
        path = "/".join([root, (at.hostname or "").lower(), *parts, *(["index.html"] if at.path.endswith("/") or not parts else [])])
        if store.get_file_info(path).type != fs.FileType.File:
            return 404, None, None, None
        with store.open_input_stream(path) as f:
            body = f.read()
        own = f'"{hashlib.sha1(body).hexdigest()}"'
        return (304, None, own, modified) if etag == own else (200, body.decode("utf-8", "replace"), own, modified)
