"""Connected components of a graph whose links are rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.sources.session import materialize, scratch_tables


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every linked node, the root being the smallest node of its component.

    Rounds of large-star and small-star steps over the rows: each node hangs its larger neighbours, then
    its smaller ones, on the smallest node it knows. A round's links are written to the shared folder, so
    lost executors cost one round at most, and nothing but two numbers a round reaches the driver. Minima
    are combined before they are shuffled; the joins read written tables, so a hot root is split. The result is
    a written table, and the rounds' tables are deleted.
    """
    with scratch_tables(links.sparkSession):
        current = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
        current = materialize(current, "links")
        before = None
        while True:
            both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.where("v > u").join(materialize(least, "least"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = materialize(large.where("u != v").distinct(), "large")
            least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
            small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            current = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
            state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
            if state == before:
                break
            before = state
        roots = current.select(F.col("v").alias("u"), "v").distinct()
        found = current.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))
        return materialize(found, "components", keep=True)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as the links (a, b) do, at most one per node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            break
        low = np.minimum(rx, ry)
        np.minimum.at(root, rx, low)
        np.minimum.at(root, ry, low)
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]
