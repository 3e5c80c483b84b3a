"""Discovery: links of seed pages that belong to the corpus, and sitemaps of hosts seen for the first time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import urls as U
from sparkloom.operators import html as H
from sparkloom.sources.readers import SITEMAP_NAMES, fetch


def harvest_links(parsed: DataFrame, domain: str, hosts: Sequence[str], allow: Sequence[str] = (), block: Sequence[str] = (), plain_prefix: str = "catalog.") -> DataFrame:
    """Distinct URLs that parsed pages (url, links) link to: made absolute, normalised, on a listed host, on an allowed path."""
    hrefs = parsed.select("url", F.explode("links").alias("href")).distinct()
    found = hrefs.select(U.normalize_url(H.resolve(F.col("href"), F.col("url")), domain, plain_prefix).alias("url")).filter("url is not null")
    return found.filter(U.allowed_host(F.col("url"), list(hosts)) & U.allowed_path(U.path_of(F.col("url")), list(allow), list(block))).distinct()


def new_hosts(found: DataFrame, known: Sequence[str]) -> DataFrame:
    """Hosts of URLs that aren't known yet."""
    return found.select(U.host_of(F.col("url")).alias("host")).filter(F.col("host").isNotNull() & ~F.col("host").isin(list(known))).distinct()


def probe_sitemaps(hosts: DataFrame, get: Callable[[str, str | None, str | None], tuple[str | None, str]], names: Sequence[str] = SITEMAP_NAMES) -> DataFrame:
    """host, sitemap, xml: of each host the first of the usual sitemap names that answers with a sitemap."""
    tries = hosts.select("host", F.posexplode(F.array(*[F.concat(F.lit("https://"), F.col("host"), F.lit(f"/{n}")) for n in names])).alias("n", "url"))
    got = fetch(tries, get).filter("status = 'ok' and html is not null").filter(F.col("html").contains("<urlset") | F.col("html").contains("<sitemapindex"))
    hits = tries.join(got.select("url", "html"), "url")
    best = hits.groupBy("host").agg(F.min_by(F.struct(F.col("url").alias("sitemap"), F.col("html").alias("xml")), "n").alias("b"))
    return best.select("host", "b.sitemap", "b.xml")


def fetch_plan(urls: DataFrame, state: DataFrame, render_prefixes: Sequence[str] = (), table_prefixes: Sequence[str] = (), table_patterns: Sequence[str] = ()) -> DataFrame:
    """URL rows with what a fetch needs: etag and last_modified of the state, whether to render, to extract tables, or to read a PDF."""
    u = F.col("url")
    have = state.select("url", "etag", "last_modified").dropDuplicates(["url"])
    return urls.join(have, "url", "left").withColumns({"needs_render": U.has_prefix(u, list(render_prefixes)), "needs_tables": U.has_prefix(u, list(table_prefixes)) | U.any_match(u, list(table_patterns)), "is_pdf": F.lower(U.path_of(u)).endswith(".pdf")})
