"""The state by SQL: temporary views over a snapshot, and the engine's text functions as SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.markup import targets
from ..sources.html import card_rows
from . import store

VIEWS = ("events", "event_fingerprints", "event_categories", "groups", "venues", "sources")


@F.udtf(returnType="pos int, href string", useArrow=True)
class PageLinks:
    """The link targets of a page in order, as written."""

    def eval(self, html: str):
        for i, href in enumerate(targets(html or "")):
            yield i + 1, href


@F.udtf(returnType="pos int, week string, has_time boolean, datetime string, place string", useArrow=True)
class PageCards:
    """The schedule cards of a page."""

    def eval(self, html: str):
        yield from card_rows(html or "")


def register_functions(spark: SparkSession) -> None:
    """``page_links`` and ``page_cards`` as table functions; ``html_text``, ``html_unescape``, ``local_day`` and ``venue_slug`` as functions."""
    spark.udtf.register("page_links", PageLinks)
    spark.udtf.register("page_cards", PageCards)
    spark.udf.register("html_text", text.html_text)
    spark.udf.register("html_unescape", text.html_unescape)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION local_day(at TIMESTAMP_NTZ) RETURNS DATE RETURN to_date(convert_timezone('UTC', 'America/Chicago', at))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION venue_slug(name STRING) RETURNS STRING RETURN btrim(regexp_replace(lower(name), '[^a-z0-9]+', '-'), '-')")


def register_views(snapshots: store.Snapshots) -> tuple[str, ...]:
    """Temporary views over the version in force, as far as it has them: which were made.

    ``events`` has a row's own columns, times as starts_at and ends_at and its
    place as venue_name and room; what it is made of and its categories are rows
    of ``event_fingerprints`` and ``event_categories``.
    """
    state, made = snapshots.read(), []
    if state is None:
        return ()
    have = set(state.columns)
    names = {"start": "starts_at", "end": "ends_at"}
    cols = [F.col(c).alias(names.get(c, c)) for c in state.columns if c not in ("sources", "categories", "venue")]
    if "venue" in have:
        cols.append((F.col("venue.name") if state.schema["venue"].dataType.typeName() == "struct" else F.col("venue")).alias("venue_name"))
    frames = {"events": state.select(*cols), "event_fingerprints": store.provenance(state)}
    if "categories" in have:
        frames["event_categories"] = store.category_rows(state)
    frames |= {t: df for t in (store.GROUPS, store.VENUES, store.SOURCES) if (df := snapshots.read(t)) is not None}
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
        made.append(name)
    return tuple(made)
