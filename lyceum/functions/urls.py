"""Addresses and page slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text

PAGE = r"(?i)\.(?:md|ipynb|myst|rst)$"


def page_slug(path: Column | str) -> Column:
    """A page's address inside the site; null for files that are no pages, empty for the home page."""
    p = F.regexp_replace(text(path), r"^\./", "")
    stem = F.regexp_replace(p, PAGE, "")
    stem = F.regexp_replace(stem, r"(?i)(?:^|/)(?:index|readme)$", "")
    return F.when(p.rlike(PAGE), F.lower(F.replace(stem, F.lit("_"), F.lit("-"))))


def decoded(c: Column) -> Column:
    """Percent-decoding that leaves plus signs alone; text that can't be decoded stays."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def normalize_address(address: Column | str) -> Column:
    bare = F.regexp_replace(text(address), r"[?#].*$", "")
    out = F.regexp_replace(decoded(bare), "^/+|/+$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)(?:^|/)index\.html?$", ""), r"(?i)\.html?$", "")
    return F.lower(F.regexp_replace(out, "^/+|/+$", ""))


def site_path(url: Column | str) -> Column:
    """The path of a full address."""
    return F.regexp_replace(text(url), "^[a-z]+://[^/]*", "")


def suffixes(address: Column) -> Column:
    """An address and what is left of it without its first parts, longest first, then the empty one."""
    parts = F.filter(F.split(address, "/"), lambda p: p != "")
    own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 1 << 30), "/"))
    return F.when(F.size(parts) > 0, own).otherwise(F.array(F.lit("")))


def encoded(segment: Column) -> Column:
    return F.replace(F.url_encode(segment), F.lit("+"), F.lit("%20"))


def source_url(site: str, path: Column | str, location: Column | str) -> Column:
    """Where a source is shown: pages by slug with a closing slash, other files directly, PDF pages by number."""
    slug = page_slug(path)
    quoted = lambda c: F.array_join(F.transform(F.split(c, "/"), encoded), "/")
    page = F.regexp_extract(text(location), r"^page (\d+)$", 1)
    anchor = F.when(F.lower(text(path)).endswith(".pdf") & (page != ""), F.concat(F.lit("#page="), page)).otherwise("")
    base = F.lit(site.rstrip("/") + "/")
    return F.when(slug == "", base).when(slug.isNotNull(), F.concat(base, quoted(slug), F.lit("/"))).otherwise(F.concat(base, quoted(F.regexp_replace(text(path), r"^\./", "")), anchor))


def asset_prefix(path: Column | str) -> Column:
    """The way from a page back to the site's root."""
    return F.repeat(F.lit("../"), F.length(text(path)) - F.length(F.replace(text(path), F.lit("/"), F.lit(""))))
