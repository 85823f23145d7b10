"""Connected components by rounds of contraction, as joins and aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(src, dst), of long ids -> node, root: one row per node of an edge; root is some node of its component.

    In each round every node moves to the least of itself and its neighbours, and edges follow their ends; edges that
    become loops go. "Least" is by id in the first round, so stars around their smallest node collapse at once, and by
    a hash that changes with the round afterwards, so long chains shrink by a constant factor. All steps are joins and
    minima that are combined before the shuffle; nothing is collected, and each round's tables are written to the
    shared folder. Loops, null ends and repeated edges are allowed and change nothing.
    """
    edges = edges.filter("src is not null and dst is not null and src != dst")
    edges = written(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        k = len(moves)
        rank = (lambda c: F.col(c)) if k == 0 else (lambda c, k=k: F.xxhash64(F.col(c), F.lit(k)))
        ends = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = ends.groupBy(F.col("src").alias("node")).agg(F.min(F.struct(rank("dst").alias("rank"), F.col("dst").alias("to"))).alias("best"))
        own = F.struct(rank("node").alias("rank"), F.col("node").alias("to"))
        move = written(least.select("node", F.least("best", own)["to"].alias("to")), "moves")
        moves.append(move)
        a, b = move.toDF("src", "a"), move.toDF("dst", "b")
        moved = edges.join(a, "src").join(b, "dst").filter("a != b")
        edges = written(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges")
    if not moves:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    out = moves[-1].toDF("node", "root")
    for move in reversed(moves[:-1]):
        later = out.toDF("to", "root")
        out = written(move.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "roots")
    return out


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 edges (node, smallest node of its component) with the components of the edges i-j over 0..n-1."""
    label = np.arange(n)
    i, j = np.asarray(i), np.asarray(j)
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]
