"""A training corpus from ``documents``: toxic texts go, near copies go, benchmark leaks go, sources are mixed, tokens are written.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``docs``, whatever they are, as long
as doc_id, text and source are among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import decontaminate, jaccard, mixing, token_files, toxicity
from feedloom.llm.shared import row_key, stored, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; null and empty texts stay, repeated rows share their fate, an empty table stays empty."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score, offending = unused(docs, "score", "offending")
    return toxicity.score(docs, model, (score, offending)).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group by 5-word shingles and a similarity of 0.8, the row of least doc_id stays, one without an id if none has one.

    Rows that are equal in doc_id and text are one; texts without words are in no group.
    """
    groups = stored(jaccard.near_groups(docs, words=5, percent=80, keyed=True), "near-groups")
    a, b = unused(docs, "a", "b")
    gone = groups.filter("key <> head").select(F.col("key.a").alias(a), F.col("key.b").alias(b)).distinct()
    rows = docs.withColumns(dict(zip((a, b), row_key("doc_id", "text"), strict=True)))
    # Equal rows meet in map-side aggregates before the exchange; the join reads the same partitions.
    return rows.dropDuplicates([a, b]).join(gone, [a, b], "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item's window go; null and empty texts have none, repeated rows share their fate."""
    a, b = unused(docs, "a", "b")
    keys = row_key("doc_id", "text")
    bad = decontaminate.contamination(docs.select(F.struct(*keys).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = bad.filter("contaminated").select("doc_id.*").toDF(a, b).distinct()
    return docs.withColumns(dict(zip((a, b), keys, strict=True))).join(bad, [a, b], "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or up to three times; those without words stay once.

    Rows that are equal in all columns are one row times their copies.
    """
    a, b, total = unused(docs, "a", "b", "total")
    taken = mixing.mixed_rows(docs, key=docs.columns).groupBy("a", "b").agg(F.sum("total").alias(total)).filter(F.col(total) > 0).withColumnsRenamed({"a": a, "b": b})
    rows = docs.withColumns(dict(zip((a, b), row_key(*docs.columns), strict=True))).dropDuplicates([a, b])
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col(total))).alias(total)
    return rows.join(taken, [a, b]).select(*docs.columns, times).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder; returns doc_id, start, n_tokens and ids_crc32 as read from them; null and empty texts are the end id alone."""
    return token_files.encoded(docs, ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: Learned scores, hashed rounding and token files have no SQL: tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
