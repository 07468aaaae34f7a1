"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is an aggregation and an equi-join on the edge table, so that no
neighbourhood is collected.  Edges go to the shared folder between steps.  A table
of at most ONE_TASK_EDGES edges is solved by one executor task instead, with arrays of a
few dozen bytes an edge: many rounds of shuffles over few rows cost more than they share out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .spark_io import cut

ONE_TASK_EDGES = 1_000_000


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and the least node of each one's component: hook roots to lesser ones, then jump pointers, until nothing moves."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _solve(batches):
    parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    if parts:
        nodes, least = least_labels(*(np.concatenate(c) for c in zip(*parts)))
        for k in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + (1 << 16)]), pa.array(least[k : k + (1 << 16)])], names=["node", "component"])


def _least(arcs: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours."""
    return arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return arcs.join(_least(arcs), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    linked = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component) for every node of `links` (columns u, v: long); component is its least node.

    Null ends and self links are ignored, repeated links count once, an empty table gives an empty one.
    The number of rounds grows with the logarithm of the node count.
    """
    edges = cut(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    if state[0] <= one_task_edges:
        ship(links.sparkSession)
        return edges.coalesce(1).mapInArrow(_solve, "node long, component long")
    while state[0]:
        edges = cut(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
