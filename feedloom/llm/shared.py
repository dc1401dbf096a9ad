"""Session helpers: written tables that cut lineage, and input sizes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of the contracts: runs of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; where it is unset, a temporary one, but only if driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="feedloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again: lineage is cut and lost executors cost nothing."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: dict[str, Any] = {}


def kept(owner: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task, of one owner at a time: workers outlive stages, and what one stage left is freed by the next."""
    got = _KEPT.get(owner)
    if got is None:
        got = make()
        _KEPT.clear()
        _KEPT[owner] = got
    return got


def row_key(*cols: str) -> list[Column]:
    """Two hashes of some columns that tell rows apart: 128 bits together."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("again"), *reversed(cols))]


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each made longer until no column of ``df`` has it."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the input's size; it never runs a job for tables in files."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 1 << 36


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of a value's decimal text, modulo n; null counts as empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(n)
