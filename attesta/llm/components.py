"""Connected components: a local forest in numpy, and alternating star steps over a DataFrame of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.shared import Scratch


def local_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node index reachable from each of n nodes, by hooking roots and halving paths in whole arrays."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        live = a != b
        if not live.any():
            break
        u, v, a, b = u[live], v[live], a[live], b[live]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges(u long, v long)``; component is the smallest reachable node.

    Alternates large-star and small-star steps until the edge set no longer changes, which it does after a number of rounds
    that grows with the logarithm of the longest path. Each step keeps at most one row for each edge. The minimum of a node's neighbours
    is a table before it is joined, so the rows of a hub meet in a partial minimum and in a join of two plain exchanges, which
    adaptive execution splits.
    """
    spark = edges.sparkSession
    cur = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    cur = scratch.table(cur, f"{name}0")

    def digest(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen, k = digest(cur), 0
    if not seen[0]:
        return spark.createDataFrame([], "node long, component long")
    while True:
        k += 1
        both = cur.union(cur.select("v", "u")).toDF("u", "v")
        low = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}{k}low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", "m")).where("u <> v").distinct()
        nxt = scratch.table(small, f"{name}{k}")
        got = digest(nxt)
        scratch.drop(f"{name}{k - 1}", f"{name}{k}low")
        cur = nxt
        if got == seen:
            break
        seen = got
    low = cur.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return low.union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().join(low.select("node"), "node", "left_anti"))
