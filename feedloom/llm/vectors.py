"""Approximate nearest neighbours by a hierarchical k-means tree (operator 7).

The tree is fitted on a bounded sample and every vector is put into a leaf.  A
query visits leaves best bin first: a priority queue holds the branches not yet
taken, by their centroids' inner product with it, or by their distance.  Leaf
visits widen until, for queries set apart for it, recall against brute force
reaches the goal; of the two orders the one that gets there sooner is used.

Rows that are equal in id and vector are one row with its copies: a query leaves
out one copy of itself, and each of its copies gets the same list.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, table

#: Vectors to fit the tree on, and queries to calibrate with, at most: those with the smallest hashes of vec_id.
FIT, PROBES = 20_000, 400
#: Vectors that a leaf should get of all, and of the fitted ones at least.
BRANCH, LEAF, LEAST_LEAF = 8, 128, 8
GOAL = 0.95
TOP, EVERY = 20, 20
#: Vectors, and queries, that meet in one task.
CHUNK = 4096
#: A row and its copies; the key tells rows of one id apart.
CLASS = ("vec_id", "key", "copies", "embedding")


class Tree:
    """Centroids of nodes; children of each; leaves are numbered from 0."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 7):
        self.centre, self.kids, self.leaf = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [[]], [-1]
        rng, todo, self.leaves = np.random.default_rng(seed), [(0, np.arange(len(x)))], 0
        while todo:
            node, rows = todo.pop()
            part = self._split(x[rows], branch, rng) if len(rows) > leaf else None
            if part is None:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for k in np.unique(part):
                self.centre.append(x[rows[part == k]].mean(0))
                self.kids.append([])
                self.leaf.append(-1)
                self.kids[node].append(len(self.centre) - 1)
                todo.append((len(self.centre) - 1, rows[part == k]))
        self.centre = np.array(self.centre)
        self.half = (self.centre * self.centre).sum(1) / 2
        self.none = np.zeros(len(self.centre))

    @staticmethod
    def _split(x: np.ndarray, k: int, rng) -> np.ndarray | None:
        """Lloyd's iterations; None if the vectors can't be told apart."""
        own = np.unique(x, axis=0)
        if len(own) < 2:
            return None
        c = own[rng.choice(len(own), min(k, len(own)), replace=False)]
        for _ in range(10):
            part = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
            c = np.array([x[part == j].mean(0) if (part == j).any() else c[j] for j in range(len(c))])
        return part if len(np.unique(part)) > 1 else None

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at every node the nearest centroid."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            c = self.centre[self.kids[node]]
            best = np.argmin((c * c).sum(1) - 2 * x[rows] @ c.T, axis=1)
            todo += [(kid, rows[best == j]) for j, kid in enumerate(self.kids[node]) if (best == j).any()]
        return out

    def visits(self, q: np.ndarray, most: int, near: bool = False) -> list[int]:
        """Up to ``most`` leaves, best bin first: by inner product, or by distance if ``near``."""
        queue, out, less = [(0.0, 0)], [], self.half if near else self.none
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                continue
            kids = self.kids[node]
            for s, kid in zip((self.centre[kids] @ q - less[kids]).tolist(), kids, strict=True):
                heapq.heappush(queue, (-s, kid))
        return out


def usable(col: str = "embedding") -> Column:
    """Not null, no null or non-finite component, not all zero."""
    ok = F.forall(col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return F.col(col).isNotNull() & (F.size(col) > 0) & F.coalesce(ok, F.lit(False)) & F.exists(col, lambda v: v != 0)


def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def rows_of(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, keys, copies and vectors."""
    return (*(np.asarray(t.column(c).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(c).to_numpy()) for c in ("vec_id", "key", "copies")), matrix(t.column("embedding")))


def best(queries, vectors, top: int, allowed=None) -> pa.Table:
    """Each query's ``top`` among some vectors, ties to the smaller id, never its own row; scores do not depend on the block's shape.

    Both are as from :func:`rows_of`; ``allowed`` masks (query, vector) pairs.
    """
    (q_ids, q_keys, _, q), (v_ids, v_keys, v_copies, v) = queries, vectors
    ids, keys, scores, copies, counts = [], [], [], [], []
    for i in range(0, len(q_ids), 64):
        x = q[i : i + 64]
        rough = x @ v.T
        own = (q_ids[i : i + 64, None] == v_ids[None, :]) & (q_keys[i : i + 64, None] == v_keys[None, :])
        rough[own & (v_copies == 1)[None, :] | (False if allowed is None else ~allowed[i : i + 64])] = -np.inf
        k = min(top, len(v_ids))
        floor = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
        floor = np.where(np.isfinite(floor), floor - 1e-9 * (1 + np.abs(floor)), -np.finfo(float).max)
        row, col = np.nonzero(rough >= floor[:, None])
        s = (v[col] * x[row]).sum(1)
        o = np.lexsort((v_ids[col], -s, row))
        orow, row = row, row[o]
        first = np.searchsorted(row, np.arange(len(x)))
        keep = np.arange(len(o)) - first[row] < top
        ids.append(v_ids[col[o]][keep])
        keys.append(v_keys[col[o]][keep])
        scores.append(-s[o][keep])
        copies.append(np.minimum(v_copies[col] - own[orow, col], top)[o][keep])
        counts.append(np.bincount(row[keep], minlength=len(x)))
    off = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1)
    join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
    pairs = pa.StructArray.from_arrays([join(scores, pa.float64()), join(ids, pa.int64()), join(keys, pa.int64()), join(copies, pa.int64())], ["s", "id", "key", "copies"])
    return pa.Table.from_arrays([pa.array(q_ids, pa.int64()), pa.array(q_keys, pa.int64()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pairs)], schema=KIND)


FOUND = "query_id long, key long, found array<struct<s: double, id: long, key: long, copies: long>>"
KIND = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("found", pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64()), ("key", pa.int64()), ("copies", pa.int64())])))])


def _merged(found: DataFrame, top: int) -> DataFrame:
    """Each query's ``top`` of what its bins have found, a row with several copies as often as it has."""
    near = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, top)
    each = F.flatten(F.transform(near, lambda x: F.array_repeat(F.struct(x["s"].alias("s"), x["id"].alias("id"), x["key"].alias("key")), x["copies"].cast("int"))))
    return found.groupBy("query_id", "key").agg(F.slice(each, 1, top).alias("found"))


def brute(queries: DataFrame, vectors: DataFrame, top: int) -> DataFrame:
    """Exact neighbours of a bounded number of queries: each block of vectors is compared with all of them."""
    held = shared_value(queries, rows_of(queries.select(*CLASS).toArrow()))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, CHUNK):
                c = b.slice(i, CHUNK)
                if len(held.value[0]) and c.num_rows:
                    yield from best(held.value, rows_of(c), top).to_batches()

    return _merged(vectors.select(*CLASS).mapInArrow(run, FOUND), top)


def shared_value(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, goal: float = GOAL, info: dict | None = None) -> DataFrame:
    """Each query's nearest vectors found: query_id, rank, vec_id, score (inner product).

    Both inputs need vec_id and embedding, arrays of floats or doubles; other
    columns are not read.  Vectors that are null, zero, of another length than
    most, or hold null or non-finite components take no part; a query never
    finds its own row; ties go to the smaller id, whatever the block; of rows that
    repeat a vec_id each has a list of its own, without itself and with the others.
    Empty inputs give no rows.  The tree's leaves grow in number with the vectors, as far
    as the fitted ones allow.  ``info`` receives the leaves, the visits chosen
    and the recall measured.
    """
    spark, info = vectors.sparkSession, {} if info is None else info
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = f"array<{element if element in ('float', 'double') else 'double'}>"
    one = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")]
    pick = lambda df: df.filter(F.col("vec_id").isNotNull() & usable()).select(*one)
    grouped = lambda df: df.groupBy("vec_id", "embedding").agg(F.count("*").alias("copies")).withColumn("key", F.xxhash64("embedding")).select(*CLASS)
    vectors, queries = pick(vectors), pick(queries)
    sizes = vectors.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors, queries = (df.filter(F.size("embedding") == sizes["d"]) for df in (vectors, queries))
    queries = stored(grouped(queries), "ann-queries")
    first = lambda df, n: df.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id", "embedding").limit(n)
    sample = matrix(first(vectors, FIT).select("embedding").toArrow()["embedding"])
    tree = Tree(sample, leaf=max(LEAST_LEAF, min(LEAF, LEAF * len(sample) // sizes["count"])))
    held = shared_value(vectors, tree)

    def put(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.assign(matrix(b.column("embedding"))), pa.int32())], [*CLASS, "leaf"])

    fields = f"vec_id long, key long, copies long, embedding {kind}"
    placed = stored(grouped(vectors).mapInArrow(put, f"{fields}, leaf int"), "ann-leaves")
    probes = first(queries, PROBES)
    truth = brute(probes, placed, top).select("query_id", F.col("key").alias("query_key"), F.explode("found").alias("x")).select("query_id", "query_key", F.col("x.id").alias("vec_id"), F.col("x.key").alias("key"))
    truth = truth.join(placed.select("vec_id", "key", "leaf"), ["vec_id", "key"]).select("query_id", "query_key", "leaf").toPandas()
    got = probes.toArrow()
    visits, near, recall = tree.leaves + 1, False, 1.0
    for by_distance in (False, True):
        order = {
            (i, k): {leaf: r for r, leaf in enumerate(tree.visits(x, tree.leaves, by_distance))} for i, k, x in zip(got["vec_id"].to_pylist(), got["key"].to_pylist(), matrix(got["embedding"]), strict=True)
        }
        ranks = np.array([order[i, k][leaf] for i, k, leaf in zip(truth["query_id"], truth["query_key"], truth["leaf"], strict=True)])
        n = min(4, tree.leaves)
        while n < tree.leaves and len(ranks) and (ranks < n).mean() < goal:
            n = min(tree.leaves, n + max(1, n // 8))
        if n < visits:
            visits, near, recall = n, by_distance, float((ranks < n).mean()) if len(ranks) else 1.0
    info |= {"leaves": tree.leaves, "visits": visits, "near": near, "recall": recall}

    # Leaves that follow each other share a bin of CHUNK vectors; one with more has several, by hash.  A row for each leaf reaches the driver.
    plan, now, full = [], 0, 0
    for leaf, n in sorted((r.leaf, r.n) for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()):
        many = -(-n // CHUNK)
        if full and full + n > CHUNK:
            now, full = now + 1, 0
        plan.append((leaf, now, many))
        full += n
        if many > 1:
            now, full = now + many, 0
    bins = {leaf: range(bin_, bin_ + many) for leaf, bin_, many in plan}

    def go(batches):
        """A row for each bin that a query goes to, with the leaves that it visits there."""
        for b in batches:
            rows, at, leaves = [], [], []
            for i, x in enumerate(matrix(b.column("embedding"))):
                there: dict[int, list[int]] = {}
                for leaf in held.value.visits(x, visits, near):
                    for bin_ in bins.get(leaf, ()):
                        there.setdefault(bin_, []).append(leaf)
                rows += [i] * len(there)
                at += there.keys()
                leaves += there.values()
            of = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(c.take(of) for c in b.columns), pa.array(leaves, pa.list_(pa.int32()))], ["bin", *CLASS, "leaf"])

    # Written queries may be one small file; a task takes some hundreds.
    dealt = queries.repartition(max(1, min(20_000, -(-queries.count() // 256))), "vec_id", "key")
    visits_to = stored(dealt.mapInArrow(go, f"bin int, {fields}, leaf array<int>"), "ann-visits")
    plan = F.broadcast(spark.createDataFrame(plan, "leaf int, bin int, many int"))
    # A bin's queries come in parts as well, and its vectors to each part.
    parts = F.broadcast(visits_to.groupBy("bin").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("qn")))
    part = F.pmod(F.xxhash64("vec_id", "key"), F.col("qn")).cast("int")
    left = placed.join(plan, "leaf").withColumn("bin", F.col("bin") + F.pmod(F.xxhash64("vec_id", "key"), F.col("many")).cast("int")).join(parts, "bin")
    left = left.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qn") - 1))).select("bin", "q", *CLASS, "leaf")
    right = visits_to.join(parts, "bin").select("bin", part.alias("q"), *CLASS, "leaf")

    def meet(v: pa.Table, q: pa.Table) -> pa.Table:
        if not v.num_rows or not q.num_rows:
            return KIND.empty_table()
        leaf, lists = v["leaf"].to_numpy(), q["leaf"].combine_chunks()
        went = np.zeros((q.num_rows, held.value.leaves), bool)
        went[np.repeat(np.arange(q.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
        here, leaf = np.unique(leaf, return_inverse=True)
        return best(rows_of(q), rows_of(v), top, went[:, here][:, leaf])

    key = ["bin", "q"]
    found = _merged(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, FOUND), top)
    # Copies of a query have the same list.
    found = found.join(queries.select(F.col("vec_id").alias("query_id"), "key", F.col("copies").cast("int").alias("copies")), ["query_id", "key"])
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    out = found.select("query_id", F.posexplode("found").alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op7_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20, among all ``embeddings``."""
    v = table(spark, sf_dir, "embeddings")
    return search(v, v.filter(F.col("vec_id") % EVERY == 0))
