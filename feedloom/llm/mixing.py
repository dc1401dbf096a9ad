"""Mixing sources to target weights by entropy balancing (operator 6).

Rates r that stay closest to 1 in entropy, each document counted by its words,
while every source's words meet its target, are exp(lambda of the source).  The
convex dual is the sum over sources of words * exp(lambda) - target * lambda.
Every document has one source, so its Hessian is diagonal and the dual falls into
one equation a source: all are solved at once, each by Newton steps in an
expression over its own row of sums, and no source reaches the driver.  Rates then
become whole copies, so that each source's words follow its target.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, row_key, stored, table

WEIGHTS = (5, 2, 1)
MOST = 3
#: Newton steps of a source: it moves by 1 at most in each, and ends quadratically.
STEPS = 60
#: Parts of a source and size, so that one that many documents share is ordered by many tasks; rows in a part of the largest size at most.
PARTS, ROWS_A_TASK = 64, 1 << 17


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with their rank by code point, null last: by ranges, so that any number of sources can be ranked."""
    order = F.col("source").asc_nulls_last()
    rows = stored(sources.orderBy(order).withColumn("pid", F.spark_partition_id()), "mix-sources")
    before = rows.groupBy("pid").agg(F.count("*").alias("c"))  # a row for each partition
    before = before.select("pid", (F.sum("c").over(Window.orderBy("pid")) - F.col("c")).alias("before"))
    place = F.row_number().over(Window.partitionBy("pid").orderBy(order))
    return rows.withColumn("place", place).join(F.broadcast(before), "pid").withColumn("rank", F.col("before") + F.col("place") - F.lit(1)).drop("pid", "before", "place")


def water_level(sources: DataFrame, most: int = MOST) -> float:
    """What a weight of 1 gets when no source gets more than ``most`` times its own size ``s`` and the excess goes to the others by weight ``w``.

    Raising the level caps more sources, so it is raised until it caps no more;
    each round is a sum over the sources.  Infinite if all are capped.
    """
    total, level = None, 0.0
    while True:
        capped = F.col("w") * F.lit(level) > most * F.col("s")
        got = sources.agg(F.sum("s").alias("t"), F.sum(F.when(~capped, F.col("w"))).alias("open"), F.coalesce(F.sum(F.when(capped, most * F.col("s"))), F.lit(0)).alias("gone")).first()
        total = float(got.t or 0)
        if got.open is None:
            return math.inf
        new = (total - got.gone) / got.open
        if new <= level:
            return level
        level = new


def newton(size: Column, target: Column, steps: int = STEPS) -> Column:
    """lambda with size * exp(lambda) = target: the gradient is size * exp(lambda) - target, the curvature size * exp(lambda)."""
    now = lambda x: size * F.exp(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), lambda x, _: x + F.least(F.lit(1.0), (target - now(x)) / now(x)))


def _extras(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one source, larger sizes first: how many documents of each size get a copy more, so that the words keep to the target."""
    pdf = pdf.sort_values("size", ascending=False)
    want = took = 0.0
    extra = []
    for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"], strict=True):
        base = math.floor(rate + 1e-9)
        want += rate * size * n
        k = 0 if size == 0 or rate - base < 1e-9 else min(n, max(0, round((want - took) / size - base * n)))
        took += size * (base * n + k)
        extra.append(k)
    return pdf.assign(extra=extra)[["sid", "size", "extra"]]


def shares(rows: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, sid, source_size, target, rate, n) of each source of ``rows`` (source, size, m)."""
    per = ranked(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("s"), F.sum("m").alias("n")))
    per = stored(per.withColumn("w", F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int"))), "mix-ranks")
    level = water_level(per, most)
    own = (F.lit(most) * F.col("s")).cast("double")
    per = per.withColumn("target", own if math.isinf(level) else F.least(F.col("w") * F.lit(level), own))
    rate = F.when(F.col("s") > 0, F.least(F.lit(float(most)), F.exp(newton(F.col("s").cast("double"), F.col("target"))))).otherwise(F.lit(1.0))
    return stored(per.select("source", F.col("rank").alias("sid"), F.col("s").alias("source_size"), "target", rate.alias("rate"), "n"), "mix-shares")


def mixed_rows(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, key: list[str] | None = None) -> DataFrame:
    """Equal rows together: doc_id, a and b (hashes of the ``key`` columns), m of them, and ``total``, the copies that they come to.

    Also source, size, source_size, target and rate.  Rows are counted within
    the partition that reads them, so a row that a third of the table repeats is
    one row a partition here.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    a, b = row_key(*(key or ["doc_id", "text", "source"]))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), a.alias("a"), b.alias("b"), F.spark_partition_id().alias("pid"))
    rows = stored(rows.groupBy(*rows.columns).agg(F.count("*").alias("m")), "mix-sizes")
    per = shares(rows, weights, most)
    count = per.agg(F.sum("n")).first()[0]
    if not count:
        return rows.select("*", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(1.0).alias("rate"), F.lit(0).cast("long").alias("total"))
    rows = rows.withColumnRenamed("source", "name").join(per.drop("n"), F.col("name").eqNullSafe(F.col("source"))).drop("name")
    cells = rows.groupBy("sid", "size", "rate").agg(F.sum("m").alias("n"))
    extras = stored(cells.groupBy("sid").applyInPandas(_extras, "sid long, size long, extra long"), "mix-extras")
    # A size that a third of all rows share is dealt into parts by hash; each part gets its portion of the size's extra copies.
    rows = rows.withColumn("part", F.pmod(F.xxhash64("a", "pid"), F.lit(max(PARTS, math.ceil(count / ROWS_A_TASK)))))
    portion = rows.groupBy("sid", "size", "part").agg(F.sum("m").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("sid", "size").orderBy("part"))
    of_all = F.sum("n").over(Window.partitionBy("sid", "size"))
    portion = portion.withColumns({"upto": up_to, "of": of_all}).join(extras, ["sid", "size"])
    portion = portion.select("sid", "size", "part", (F.expr("(upto * extra) div of") - F.expr("((upto - n) * extra) div of")).alias("extra"))
    before = F.sum("m").over(Window.partitionBy("sid", "size", "part").orderBy("a", "b", "pid")) - F.col("m")
    out = rows.withColumn("before", before).join(portion, ["sid", "size", "part"])
    more = F.least(F.col("m"), F.greatest(F.lit(0), F.col("extra") - F.col("before")))
    total = F.when(F.col("size") == 0, F.col("m")).otherwise(F.floor(F.col("rate") + F.lit(1e-9)) * F.col("m") + more)
    return out.select("doc_id", "source", "size", "a", "b", "pid", "m", "source_size", "target", "rate", total.cast("long").alias("total"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """Copies of each document so that sources come to their weights' shares.

    ``docs`` needs doc_id, text and source; a null source is one of its own, last
    in order; other columns are not read.  A size is the number of words of the
    whole text, 0 for a null or empty one; documents without words take nothing
    and keep one copy.  Returns doc_id, source, size, source_size, target, rate,
    copies and taken = copies * size, a row for each row of ``docs``.  Copies are
    the rate rounded down or up, so ``most`` at most; ties are broken by hashes
    of the row, so reruns agree, and of equal rows any may have a copy more.  An
    empty table gives no rows.
    """
    rows = mixed_rows(docs, weights, most).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - F.lit(1))))
    copies = F.expr("total div m") + (F.col("i") < F.expr("total % m")).cast("long")
    return rows.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op6_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents`` with weights 5, 2, 1 repeating."""
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")
