"""Embedding whitening by tall-skinny QR (operator 11).

Sums of whole numbers are exact, so rows are centred without loss.  Each partition
reduces its centred rows to a triangular factor, factors are stacked and reduced
again along a tree, and the singular values and right vectors of the last factor
whiten; the covariance of the input is never formed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, table
from .vectors import matrix

COMPONENTS = 32
#: Fixed values of the contract: an entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this count as this, so that they are whole numbers of 64 bits.
FURTHEST = float(1 << 61)
#: Factors that one task stacks, and rows that are reduced at a time.
FAN, ROWS = 16, 4096
NODE = "node long, data binary"


def finite(col: str = "embedding") -> Column:
    """Not null, and without null or non-finite entries; zeros are fine."""
    ok = F.forall(col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return F.col(col).isNotNull() & F.coalesce(ok, F.lit(False))


def whole(batch: pa.RecordBatch) -> np.ndarray:
    """The entries of a batch's vectors (its last column) as whole numbers."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * matrix(batch.column(batch.num_columns - 1))) + SHIFT, -FURTHEST, FURTHEST).astype(np.int64)


@dataclass
class Whitening:
    """What whitens: rows n, exact sums S of each dimension, unit directions as columns, their eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    basis: np.ndarray
    values: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: 64 bits where they suffice, else Python's whole numbers."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, *map(abs, self.sums), 0)
        wide = most >= 1 << 61
        return (x.astype(object) if wide else x) * self.n - np.array(self.sums, object if wide else np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(np.float64)

    def squares(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S) ** 2; None beyond 64 bits."""
        z = self.deviations(x)
        if z.dtype == object or int(np.abs(z).max(initial=0)) ** 2 * x.shape[1] >= 1 << 63:
            z = z.astype(object)
        got = (z * z).sum(1).tolist()
        return [int(v) if v < 1 << 63 else None for v in got]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.basis / np.sqrt(self.values)


def tree(leaves: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One value of a row (node, data) from each partition, merged FAN at a time in the order of their nodes; one value reaches the driver."""
    rows = stored(leaves, "tree-leaves")
    last = rows.agg(F.max("node")).first()[0]
    if last is None:
        return None

    def step(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        return pa.table({"node": pa.array([t["node"][0].as_py() // FAN], pa.int64()), "data": pa.array([merge(t["data"].to_pylist())], pa.binary())})

    while True:
        rows = rows.groupBy(F.expr(f"node div {FAN}").alias("up")).applyInArrow(step, NODE)
        last //= FAN
        if not last:
            return rows.first()["data"]


def _leaf(data: bytes | None) -> pa.RecordBatch:
    from pyspark import TaskContext

    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([data], pa.binary())], ["node", "data"])


def reduced(r: np.ndarray) -> np.ndarray:
    """The triangular factor of some rows; fewer rows than columns stay as many."""
    return np.linalg.qr(r, mode="r") if len(r) else r


def _blocks(batches, rows: int = ROWS):
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def exact_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """(n, sums of each dimension), in halves of 32 bits that no partition can overflow."""

    def run(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in _blocks(batches):
            x = whole(b)
            n += len(x)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])

    big = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    got = vectors.mapInArrow(run, "dim int, n long, high long, low long").groupBy("dim").agg(F.sum("n").alias("n"), big("high"), big("low")).collect()  # a row for each dimension
    return (got[0]["n"] if got else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in sorted(got, key=lambda r: r["dim"])]


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """Directions of largest variance of ``vectors`` (one column of arrays of d entries); None without rows.

    Directions without variance (to double precision) cannot be whitened and are left out.
    """
    n, sums = exact_sums(vectors, d)
    if not n:
        return None
    blank = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)

    def factor(batches):
        r = np.zeros((0, d))
        for b in _blocks(batches):
            r = reduced(np.vstack([r, blank.centred(whole(b))]))
        if len(r):
            yield _leaf(r.tobytes())

    stack = lambda parts: reduced(np.vstack([np.frombuffer(p).reshape(-1, d) for p in parts])).tobytes()
    r = np.frombuffer(tree(vectors.mapInArrow(factor, NODE), stack)).reshape(-1, d)
    _, s, v = np.linalg.svd(r, full_matrices=False)
    keep = np.flatnonzero(s > s.max(initial=0) * d * 16 * np.finfo(float).eps)[:components]
    v = v[keep] * np.where(v[keep, np.abs(v[keep]).argmax(1)] < 0, -1.0, 1.0)[:, None] if len(keep) else v[:0]
    return Whitening(n, sums, np.ascontiguousarray(v.T), s[keep] ** 2 / n, float((s**2).sum() / n))


Moments = tuple[int, np.ndarray, np.ndarray]


def together(a: Moments, b: Moments) -> Moments:
    """Rows, mean and scatter around it of two sets of rows."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _pack(m: Moments) -> bytes:
    return np.int64(m[0]).tobytes() + m[1].tobytes() + m[2].tobytes()


def _unpack(raw: bytes, k: int) -> Moments:
    x = np.frombuffer(raw, np.float64, k + k * k, 8)
    return int(np.frombuffer(raw, np.int64, 1)[0]), x[:k], x[k:].reshape(k, k)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest entry by which the covariance of the whitened rows, centred before multiplying, differs from the identity."""
    k = len(model.values)
    if not k:
        return 0.0

    def run(batches):
        got = None
        for b in _blocks(batches):
            w = model.whiten(whole(b))
            mean = w.mean(0)
            one = len(w), mean, (w - mean).T @ (w - mean)
            got = one if got is None else together(got, one)
        if got:
            yield _leaf(_pack(got))

    def merge(parts: list[bytes]) -> bytes:
        out = _unpack(parts[0], k)
        for p in parts[1:]:
            out = together(out, _unpack(p, k))
        return _pack(out)

    n, _, scatter = _unpack(tree(vectors.mapInArrow(run, NODE), merge), k)
    return float(np.abs(scatter / n - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float]:
    """(rows, model, identity error): vec_id, deviation and ``whitened``, an array of the components, of each usable row of ``vectors``.

    Vectors that are null, hold null or non-finite entries, or have another
    length than most (the longer of two lengths that tie) take no part; null and
    repeated vec_ids each keep their row; ties of eigenvalues go by the
    factorization; entries beyond 2**61 count as that; a deviation beyond 64 bits
    is null; constant vectors have no component, and their array is empty; no
    usable row gives no rows; other columns are not read.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = f"array<{element if element in ('float', 'double') else 'double'}>"
    rows = vectors.filter(finite()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    empty = "vec_id long, deviation long, whitened array<double>"
    if sizes is None or not sizes["d"]:
        return vectors.sparkSession.createDataFrame([], empty), None, 0.0
    rows = rows.filter(F.size("embedding") == sizes["d"])
    only = rows.select("embedding")
    model = fit(only, sizes["d"], components)
    error = identity_error(only, model)
    k = len(model.values)

    def run(batches):
        for b in _blocks(batches):
            x = whole(b)
            w = model.whiten(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(w.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.squares(x), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(run, empty), model, error


def op11_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable ``embeddings`` on the 32 directions of largest variance, a row for each component."""
    rows, model, error = whitened(table(spark, sf_dir, "embeddings"))
    part = [float(v / model.trace) for v in model.values] if model is not None else []
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    return each.select(
        "vec_id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(model.n if model is not None else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*map(F.lit, part or [0.0])), F.col("pos")).alias("explained"), F.lit(error).alias("identity_error"),
    )
