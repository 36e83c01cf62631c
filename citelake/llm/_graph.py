"""Connected components by joins: labels never leave the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm._common import materialize, release


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, component) for each id in ``edges`` (a, b): the smallest id reachable.

    Alternating large-star and small-star steps: each node links its larger, then its
    smaller neighbours to the smallest one.  Both keep the components; the number of rounds
    grows with the logarithm of the size.  A star's sums are aggregated before they are
    shuffled, and each step's edges are written and counted.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # now each edge points from the larger to the smaller end
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(small, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialize(linked.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(now)
        now = new
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components have not converged in {rounds} rounds")
    nodes = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what ``linked`` (left x right) joins, at most one for each row and column:
    each to the least component reachable."""
    row, column = np.nonzero(linked)
    # a component stands at several rows and columns: number them
    names, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = place[: len(left)][row], place[len(left) :][column]
    root = np.arange(len(names))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(root)))
    return names[moved], names[root[moved]]
