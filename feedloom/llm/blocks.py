"""Counting across a corpus without a row for each item.

Documents are dealt into blocks of bounded size.  A block sends each bucket (a
range of hash values) one row with the distinct hashes that it holds there; the
bucket answers each block with those that more than one place holds.  However
often a key occurs, a bucket receives it once from each block, so hot keys and
groups of copies don't make large tasks.  Text is shuffled once: each later step
cogroups the same exchange with the answers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import input_bytes, stored

U = np.uint64
PACK = "bucket int, block int, keys binary, many binary"
ANSWER = "block int, keys binary"


#: Blocks at least, so that small inputs use all cores as well.
FEWEST = 64


def n_blocks(docs: DataFrame) -> int:
    """Blocks of 4 MB of input at least and 64 MB at most, growing with the root of the input; never fewer than FEWEST."""
    size = input_bytes(docs)
    return max(FEWEST, math.ceil(size / min(64 << 20, max(4 << 20, math.isqrt(size << 14)))))


def replayable(docs: DataFrame, *cols: str) -> DataFrame:
    """``docs`` if it is a plain scan of files, whose exchanges Spark recognizes and reuses; else ``cols`` (doc_id and text), written once.

    Several steps read the documents; without reuse each would compute all that comes before it again.
    """
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.getClass().getSimpleName() in ("Project", "Filter"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() == "LogicalRelation" and _placed(docs):
        return docs
    return stored(docs.select(*cols or ("doc_id", "text")), "documents")


def _place(docs: DataFrame) -> list[Column]:
    at = docs.metadataColumn("_metadata")
    return [at["file_path"], at["row_index"]]


def _placed(docs: DataFrame) -> bool:
    """Whether a row's file and its number there can be read."""
    try:
        docs.select(*_place(docs)).schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def block(docs: DataFrame, n: int) -> Column:
    """A row's block, by its file and its number there: equal rows spread, however many, and every scan says the same, however it is split."""
    return F.pmod(F.xxhash64(*_place(docs)), F.lit(n)).cast("int").alias("block")


def dealt(docs: DataFrame, n: int) -> DataFrame:
    """doc_id and text with their block, of :func:`replayable` documents."""
    return docs.select(block(docs, n), F.col("doc_id").cast("long").alias("doc_id"), "text").repartition(n, "block")


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)


def packs(block: int, h: np.ndarray, n: int) -> pa.Table:
    """One row for each bucket: the distinct hashes, sorted, and a bit for each that the block holds more than once."""
    keys, count = np.unique(h, return_counts=True)
    many = count > 1
    cuts = np.searchsorted(bucket_of(keys, n), np.arange(n + 1))
    full = np.flatnonzero(np.diff(cuts))
    at = [(int(cuts[i]), int(cuts[i + 1])) for i in full]
    return pa.table({
        "bucket": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), block), pa.int32()),
        "keys": pa.array([keys[a:b].tobytes() for a, b in at], pa.binary()), "many": pa.array([np.packbits(many[a:b]).tobytes() for a, b in at], pa.binary()),
    })


def repeated(t: pa.Table) -> pa.Table:
    """A bucket's answers: to each block, which of its hashes occur more than once in all."""
    parts = [np.frombuffer(x.as_buffer(), U) for x in t["keys"]]
    many = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(p)).astype(bool) for x, p in zip(t["many"], parts, strict=True)]
    h = np.concatenate(parts)
    keys, back, count = np.unique(h, return_inverse=True, return_counts=True)
    hit = count > 1
    hit[back[np.concatenate(many)]] = True
    out, at = [], 0
    for p in parts:
        out.append(p[hit[back[at : at + len(p)]]].tobytes())
        at += len(p)
    keep = [i for i, x in enumerate(out) if x]
    return pa.table({"block": pa.array([t["block"][i].as_py() for i in keep], pa.int32()), "keys": pa.array([out[i] for i in keep], pa.binary())})


def answers(packed: DataFrame) -> DataFrame:
    return packed.groupBy("bucket").applyInArrow(repeated, ANSWER)


def keys_of(t: pa.Table) -> np.ndarray:
    """All answered hashes of a block, sorted."""
    got = [np.frombuffer(x.as_buffer(), U) for x in t["keys"]]
    return np.sort(np.concatenate(got)) if got else np.zeros(0, U)


def held(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of h are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(h), bool)
    i = np.searchsorted(keys, h)
    i[i == len(keys)] = 0
    return keys[i] == h


def block_of(t: pa.Table) -> int | None:
    return t["block"][0].as_py() if t.num_rows else None
