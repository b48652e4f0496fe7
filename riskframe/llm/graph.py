"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.session import cut_lineage


#: Edges that one task handles; smaller tables use fewer tasks than the shuffle has partitions.
TASK_EDGES = 25_000


def _both(e: DataFrame) -> DataFrame:
    return e.select(F.inline(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")),
                                     F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def _to_minimum(e: DataFrame, keep) -> DataFrame:
    """Link neighbours to the smallest node seen from ``a`` (itself included)."""
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    low = low.select("a", F.least("a", "m").alias("m"))
    return e.join(low, "a").where(keep).select(F.col("b").alias("u"), "m").union(low.select(F.col("a").alias("u"), "m"))


def components(links: DataFrame, max_rounds: int = 60, tasks: int | None = None) -> DataFrame:
    """``links(a, b)`` -> ``(node, component)``, the smallest reachable node.

    Each round links every node's larger neighbours to its smallest one, then
    its smaller neighbours, until nothing changes: O(log^2 n) rounds, each two
    aggregations with map-side combine and two joins.  Lineage is cut by a
    reliable checkpoint per round, ``links`` evaluated once.  Self-links give a
    component of one; null ends are ignored; an empty table gives an empty result.
    ``tasks`` bounds the files that ``links`` are first written to.
    """
    e = every = cut_lineage(links.where("a IS NOT NULL AND b IS NOT NULL").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tasks)
    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    sign = signature(e)                    # stars come out of a round as they went in
    for _ in range(max_rounds):
        tasks = 1 + sign[0] // TASK_EDGES
        e = e.coalesce(tasks)
        big = _to_minimum(_both(e), F.col("b") > F.col("a")).coalesce(tasks)
        big = big.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks)
        small = _to_minimum(big, F.lit(True)).coalesce(tasks)
        new = cut_lineage(small.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks))
        now = signature(new)
        if now == sign:
            break
        e, sign = new, now
    else:
        raise RuntimeError("components: no fixed point")
    roots = e.select(F.col("b").alias("node")).distinct()
    alone = every.where("a = b").select(F.col("a").alias("node"))
    lone = roots.unionByName(alone).distinct().join(e.select(F.col("a").alias("node")), "node", "left_anti")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        lone.select("node", F.col("node").alias("component")))


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new
