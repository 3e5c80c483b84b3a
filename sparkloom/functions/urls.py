"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(F.trim(url), F.lit("PATH")), F.lit(""))


def normalize_url(url: Column, domain: str, plain_prefix: str = "catalog.") -> Column:
    """scheme://host/path of a URL in the domain (a plain suffix test), or null.

    Hosts that end in ``plain_prefix + domain`` get http, the domain's others https. A path whose last segment has no
    dot gets a final slash; query and fragment go.
    """
    host, path = host_of(url), path_of(url)
    scheme = F.when(host.endswith(plain_prefix + domain), "http").when(host.endswith(domain), "https")
    last = F.element_at(F.split(path, "/"), -1)
    tail = F.when((path != "") & ~path.endswith("/") & ~last.contains("."), F.concat(path, F.lit("/"))).otherwise(path)
    return F.concat(scheme, F.lit("://"), host, tail)


def without_query(url: Column) -> Column:
    """scheme://host/path as written, or null for a relative URL."""
    scheme = F.try_parse_url(F.trim(url), F.lit("PROTOCOL"))
    host = F.try_parse_url(F.trim(url), F.lit("HOST"))
    return F.concat(F.lower(scheme), F.lit("://"), host, path_of(url))


def file_path(url: Column, base: str, extension: str | None = None) -> Column:
    """Where a page is kept: base/path, an empty last segment as ``index``, the extension swapped if one is given."""
    path = F.regexp_replace(path_of(url), "^/+", "")
    path = F.when((path == "") | path.endswith("/"), F.concat(path, F.lit("index"))).otherwise(path)
    if extension is not None:
        path = F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(extension))
    return F.concat(F.lit(base.rstrip("/") + "/"), path)


def audit_path(url: Column) -> Column:
    """Without scheme, host, query and final slashes."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(url, r"^https?://[^/]+", ""), r"\?.*$", ""), F.lit("/"))


def allowed_host(url: Column, hosts: list[str]) -> Column:
    return F.coalesce(host_of(url).isin([h.lower() for h in hosts]), F.lit(False))


def any_match(c: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found; false without patterns."""
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def allowed_path(path: Column, allow: list[str], block: list[str]) -> Column:
    """A block pattern wins; without allow patterns all else is allowed."""
    return ~any_match(path, block) & (any_match(path, allow) if allow else F.lit(True))


def has_prefix(url: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | url.startswith(p)
    return out
