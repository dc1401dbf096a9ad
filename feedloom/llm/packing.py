"""Best-fit packing of token sequences (operator 13).

Documents are range-sorted by length, longest first, which gives each its rank
among those as long.  Packing then goes by bulk steps: all documents of one length
look for the smallest gap that takes them (the successor of their length among the
gaps, in order), those of lowest rank get it, the others go on to the next gap,
the gaps shrink, and the next length follows.  A step handles runs of equal
documents and equal gaps, so what it works on is bounded by the lengths that fit a
sequence and not by the documents.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, table
from .textops import U, mix
from .token_files import NAME, encoder

CAPACITY = 2048
#: Words that a worker's encoder remembers, some 100 bytes each.
WORDS = 2_500_000
#: Rows of a range, and ranks that are joined under one key.
RANGE, RANKS = 1 << 18, 4096
PIECE = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "key": pa.int64()}
MOVE = "length long, lo long, hi long, first long, each long, offset long"


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens: only more than ``capacity`` are cut, and then the first piece takes what is over."""
    over = n % capacity
    return [n] if n <= capacity else ([over] if over else []) + [capacity] * (n // capacity)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Each document's pieces with their tokens' number and checksum, written once; ``key`` orders pieces of one length."""
    kinds = PIECE | ({"ids": pa.list_(pa.int32())} if ids else {})

    def run(batches):
        from pyspark import TaskContext

        encode, part, seen = encoder(tokenizer, WORDS), U(TaskContext.get().partitionId()) << U(40), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows, out = batch.slice(i, 512), []
                for doc_id, raw in zip(rows.column(0).to_pylist(), encode(rows.column(1).to_pylist()), strict=True):
                    got, start = np.frombuffer(raw, encode.kind).astype("<u4"), 0
                    for k, n in enumerate(cuts(len(got), capacity)):
                        own = got[start : start + n]
                        out.append((doc_id, k, start, n, zlib.crc32(own.tobytes()), 0, *[own] * ids))
                        start += n
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)]
                cols[5] = pa.array(mix(part + np.arange(seen, seen + len(out), dtype=U)).view(np.int64))
                seen += len(out)
                yield pa.RecordBatch.from_arrays(cols, list(kinds))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, key long" + ", ids array<int>" * ids), "token-pieces")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (length, key and others), written in ranges of falling length, with ``rank`` among those as long, from 0.

    Keys are spread hashes, so a length that a third of the rows share fills many ranges.
    """
    n = max(1, -(-rows.count() // RANGE))
    ordered = rows.repartitionByRange(n, F.desc("length"), "key").sortWithinPartitions(F.desc("length"), "key")
    at = rows.columns.index("length")

    def number(batches):
        from pyspark import TaskContext

        pid, last, next_ = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column(at).to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], size[1:] != size[:-1]]))
            place = np.arange(len(size)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(size)]])))
            if size[0] == last:
                place[: begins[1] if len(begins) > 1 else len(size)] += next_
            last, next_ = size[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64()), pa.array(np.full(len(size), pid), pa.int32())], [*b.schema.names, "place", "pid"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    written = stored(ordered.mapInArrow(number, f"{kinds}, place long, pid int"), "packing-ranges")
    # A range has few lengths, so there are about as many of these rows as ranges and lengths together.
    per = written.groupBy("length", "pid").agg(F.count("*").alias("n"))
    before = per.alias("a").join(per.alias("b"), (F.col("a.length") == F.col("b.length")) & (F.col("b.pid") < F.col("a.pid")), "left")
    before = before.groupBy(F.col("a.length").alias("length"), F.col("a.pid").alias("pid")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return written.join(before, ["length", "pid"]).withColumn("rank", F.col("before") + F.col("place")).drop("before", "place", "pid")


def best_fit(lengths: list[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Moves (length, lo, hi, first, each, offset) of best-fit over (length, number of documents), longest first.

    Documents of ranks lo to hi - 1 go to sequences from ``first`` on, ``each`` to
    one, side by side from ``offset``.  A run of gaps ends at most as often as
    distinct lengths fit a sequence, and a length splits one run and begins two, so
    moves are bounded by the capacity alone.
    """
    gaps: list[deque] = [deque() for _ in range(capacity + 1)]
    moves, opened = [], 0

    def put(length: int, lo: int, first: int, many: int, each: int, gap: int) -> int:
        moves.append((length, lo, lo + many * each, first, each, capacity - gap))
        if gap > each * length:
            gaps[gap - each * length].append((first, many))
        return lo + many * each

    for length, count in sorted(lengths, reverse=True):
        lo = 0
        for gap in range(length, capacity):
            mine, each = gaps[gap], gap // length
            # Those that fill up go to smaller gaps, which this length may not reach again: each took all that fit.
            while mine and lo < count:
                first, many = mine.popleft()
                full = min(many, (count - lo) // each)
                if full:
                    lo = put(length, lo, first, full, each, gap)
                if full < many and lo < count:
                    lo = put(length, lo, first + full, 1, count - lo, gap)
                    full += 1
                if full < many:
                    mine.appendleft((first + full, many - full))
            if lo == count:
                break
        each = capacity // length
        if full := (count - lo) // each:
            lo, opened = put(length, lo, opened, full, each, capacity), opened + full
        if lo < count:
            put(length, lo, opened, 1, count - lo, capacity)
            opened += 1
    return moves


def moves_of(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The moves of all lengths of ``rows``: one task sees a row for each length, ``capacity`` of them at most."""

    def run(t: pa.Table) -> pa.Table:
        got = list(zip(*best_fit(list(zip(t["length"].to_pylist(), t["n"].to_pylist(), strict=True)), capacity), strict=True)) or [()] * 6
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("length", "lo", "hi", "first", "each", "offset"), got, strict=True)})

    per = rows.groupBy("length").agg(F.count("*").alias("n"))
    return stored(per.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: run(t), MOVE), "packing-moves")


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens, as few as best-fit finds: a row for each piece.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids
    if wanted.  Null and empty texts are the end id alone; texts count whole,
    however long, and those of more tokens than a sequence are cut; rows with null
    or repeated ids, and repeated rows, are packed each; pieces that tie in length
    are interchangeable; an empty table gives no rows; other columns are not read.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(NAME)
    rows = ranked(token_pieces(docs, tokenizer, capacity, ids))
    moves = moves_of(rows, capacity)
    spans = moves.withColumn("bin", F.explode(F.sequence(F.expr(f"lo div {RANKS}"), F.expr(f"(hi - 1) div {RANKS}")))).withColumnRenamed("length", "size")
    rows = rows.withColumn("bin", F.expr(f"rank div {RANKS}"))
    met = rows.alias("r").join(spans.alias("s"), (F.col("r.length") == F.col("s.size")) & (F.col("r.bin") == F.col("s.bin")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return met.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.expr("(rank - lo) div each")).alias("sequence_id"), (F.col("offset") + nth % F.col("each") * F.col("length")).alias("offset"), *["ids"] * ids,
    )


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 2,048 tokens."""
    return packed(table(spark, sf_dir, "documents"))
