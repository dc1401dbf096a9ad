"""Connected components of links: in one task up to a fixed number of links, else by alternating large and small stars over DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Links that one task settles at most (some 200 MB); more go by stars, with the same result.
IN_TASK = 1 << 20


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v): every node's neighbours (larger ones, or smaller ones) move to its least neighbour."""
    if large:
        e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Written, so that both sides of the join are plain exchanges: only then does Spark split a hub's rows.
    least = stored(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    near = e.join(least, "u")
    if large:
        near = near.filter("v > u")
    else:
        near = near.unionByName(least.select("u", F.col("u").alias("v"), "m"))
    return near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches over the links (u, v)."""
    label = np.arange(n)
    while len(u):
        least = np.minimum(label[u], label[v])
        for x in (label[u], label[v]):
            np.minimum.at(label, x, least)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
    return label


def _settled(links: pa.Table) -> pa.Table:
    """(node, root) of the links' nodes."""
    both = pa.chunked_array([*links["u"].chunks, *links["v"].chunks])
    nodes = pc.unique(both)
    nodes = nodes.take(pc.array_sort_indices(nodes))
    at = pc.index_in(both, nodes).to_numpy()
    root = roots(at[: links.num_rows], at[links.num_rows :], len(nodes))
    return pa.table({"node": nodes, "root": nodes.take(pa.array(root))})


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """(node, root): root is the least node of the component.  ``links`` has columns u and v of one ordered type; isolated nodes have no row.

    ``most`` overrides how many links one task settles.  The rounds of stars go
    on until nothing moves; each brings every component nearer to one star.
    """
    e = stored(links.filter("u <> v").select("u", "v"), "links")
    kind = e.schema["u"].dataType.simpleString()
    if e.count() <= (IN_TASK if most is None else most):

        def run(batches):
            got = [b for b in batches if b.num_rows]
            if got:
                yield from _settled(pa.Table.from_batches(got)).to_batches()

        return e.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")
    e = stored(e.distinct(), "links")
    before = None
    while True:
        e = stored(_star(_star(e, True), False), "stars")
        # Every node but the roots points once at a root when nothing moves: the edges' digest stays.
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
