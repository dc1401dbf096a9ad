"""Names, slugs and fingerprints as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Typographic characters and what they fold to.
FOLD_FROM = "\u2018\u2019\u02bc\u201c\u201d\u2013\u2014\u2212\u00a0\u200b"
FOLD_TO = "'''\"\"---  "


def fold_name(c: Column) -> Column:
    """Lower case, plain quotes and dashes, single blanks: how names are compared."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, FOLD_FROM, FOLD_TO)), r"(?U)\s+", " "))


def fingerprint(kind: Column, upstream_id: Column) -> Column:
    return F.concat(kind, F.lit(":"), upstream_id)


def slugify(c: Column) -> Column:
    """Letters and digits; blanks, dashes, underscores and slashes in a row become one dash; all else goes."""
    kept = F.regexp_replace(F.lower(c), r"[^a-z0-9 \-_/]", "")
    return F.btrim(F.regexp_replace(kept, r"[ \-_/]+", "-"), F.lit("-"))


def venue_slug(c: Column) -> Column:
    """Every run of anything but letters and digits becomes one dash."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), F.lit("-"))
