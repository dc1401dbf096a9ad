"""Repair of links that people typed."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_scheme(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


def clean_url(c: Column) -> Column:
    """An absolute http(s) link, or null.  Without a scheme, a value with a dot and no blank gets https."""
    t = F.trim(c)
    whole = F.when(has_scheme(t), t).when(~t.rlike(r"\s") & t.contains("."), F.concat(F.lit("https://"), t))
    scheme = F.lower(F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.\-]*:(.*)$", 1)
    ok = scheme.isin("http", "https") & rest.rlike(r"^//[^/?#\s]+")
    return F.when(ok, F.concat(scheme, F.lit(":"), F.replace(rest, F.lit(" "), F.lit("%20"))))


def etag(body: Column) -> Column:
    """A strong entity tag: half of the body's SHA-256, in quotes."""
    return F.concat(F.lit('"'), F.substring(F.sha2(body, 256), 1, 32), F.lit('"'))


def etag_matches(header: Column, tag: Column) -> Column:
    """Whether an If-None-Match header names the tag: a list, a star, or weak forms."""
    return F.exists(F.split(header, ","), lambda h: (F.trim(h) == "*") | (F.regexp_replace(F.trim(h), "^W/", "") == tag))
