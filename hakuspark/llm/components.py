"""Connected components of a distributed graph."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hakuspark.llm.common import drop_stored, stored

#: A graph contracted to at most so many edges is finished by union-find in one task.
LOCAL_EDGES = 50_000


def roots(parent: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The root of each node in a forest of parents."""
    at = parent[of]
    while True:
        up = parent[at]
        if (up == at).all():
            return at
        at = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the trees of a[i] and b[i] for every i, in place; smaller roots win."""
    while len(a):
        ra, rb = roots(parent, a), roots(parent, b)
        apart = ra != rb
        if not apart.any():
            return
        lo, hi = np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
        a, b = lo, hi
        np.minimum.at(parent, hi, lo)


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, and for each the smallest node of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = np.arange(len(nodes))
    unite(parent, at[: len(a)], at[len(a) :])
    return nodes, nodes[roots(parent, np.arange(len(nodes)))]


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) for every node of the edges (a, b): nodes are connected if their roots are equal.

    Rounds of contraction: every node moves to the neighbour, or itself, of least hash (salted by the round), and
    edges are rewritten and made distinct. Each round shrinks the graph by a constant factor in expectation, reads
    and writes tables of its size only, and takes the least neighbour by partial aggregation, so that no node's
    edges need to meet. What is left, once it has at most local_edges edges, is one bounded task.
    """
    flat = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, moves = stored(flat(edges), "edges"), []
    while (n := edges.count()) > local_edges:
        order = lambda c, k=len(moves): F.xxhash64(F.lit(k), c)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(order(F.col("b")).alias("h"), F.col("b").alias("b"))).alias("m"))
        stays: Column = order(F.col("a")) <= F.col("m.h")
        moves.append(stored(least.select(F.col("a").alias("node"), F.when(stays, F.col("a")).otherwise(F.col("m.b")).alias("root")), "moves"))
        for side in ("a", "b"):
            edges_ = edges if side == "a" else edges_
            edges_ = edges_.join(moves[-1].select(F.col("node").alias(side), F.col("root").alias(f"_{side}")), side)
        old, edges = edges, stored(flat(edges_.select(F.col("_a").alias("a"), F.col("_b").alias("b"))), "edges")
        drop_stored(old)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if held := list(batches):
            rest = pd.concat(held)
            node, root = local_components(rest["a"].to_numpy(), rest["b"].to_numpy())
            yield pd.DataFrame({"node": node, "root": root})

    last = stored(edges.coalesce(1).mapInPandas(finish, "node long, root long"), "roots") if n else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        on = second.select(F.col("node").alias("_at"), F.col("root").alias("_to"))
        return first.join(on, F.col("root") == F.col("_at"), "left").select("node", F.coalesce("_to", "root").alias("root"))

    return reduce(then, [*moves, last])
