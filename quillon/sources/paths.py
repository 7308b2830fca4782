"""Path columns: normal form, exclusion, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SUFFIX = r"\.[^./]*$"


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(path, _SUFFIX, "")


def normal_path(path: Column) -> Column:
    """Without suffix and leading slash."""
    return F.regexp_replace(without_suffix(path), "^/", "")


def excluded(path: Column, exclude: list[str]) -> Column:
    """Whether the path is one of ``exclude`` (suffixes aside) or lies below it."""
    import re

    own = without_suffix(path)
    hit = F.lit(False)
    for e in exclude:
        bare = re.sub(_SUFFIX, "", e).rstrip("/")
        hit = hit | (own == bare) | own.startswith(bare + "/")
    return hit


def title_or_name(title: Column, path: Column) -> Column:
    """The title, else the last part of the path."""
    return F.coalesce(title, F.element_at(F.split(path, "/"), -1))


def url_path(url: Column) -> Column:
    """The path of a URL, without query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def site_documents(rows: DataFrame, exclude: list[str], body: str = "body", title: str = "title", path: str = "path") -> DataFrame:
    """``body, title, path`` of a site's documents, without the excluded ones."""
    p = F.col(path)
    return rows.filter(~excluded(p, exclude)).select(F.col(body).alias("body"), title_or_name(F.col(title), without_suffix(p)).alias("title"), normal_path(p).alias("path"))
