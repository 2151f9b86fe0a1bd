"""Connected components of links between numbers, by contraction in Spark rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Links that one executor task may solve at once (16 bytes each); more are contracted first.
LOCAL_LINKS = 200_000


def label(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a-b, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while (jumped := new[new] != new).any():
            new[jumped] = new[new[jumped]]
        new = new[root]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _solve(batches):
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if parts:
        nodes, roots = label(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])


def connected(links: DataFrame, n_nodes: int | None = None) -> DataFrame:
    """(a, b) links of bigints to (node, root): a root for every node that has a link.

    While there are more links than one task may hold, a round sends every node
    to the neighbour (or itself) with the least hash, keeps the links between
    what is left, and checkpoints; hashes make a round shrink long chains as
    well as stars. Each node sends one combined row a task, so a node with most
    of the links is no hot spot. What a round maps is joined back at the end.
    ``n_nodes``, if known, says in how many files links and maps are kept.
    """
    links, maps, turn = saved(links.where("a <> b").select("a", "b").distinct(), n_nodes), [], 0
    while links.count() > LOCAL_LINKS:
        turn += 1
        both = links.union(links.select("b", "a")).union(links.select("a", "a"))
        both = both.union(links.select("b", "b")).toDF("node", "near")
        order = F.struct(F.xxhash64("near", F.lit(turn)).alias("h"), F.col("near"))
        step = saved(both.groupBy("node").agg(F.min(order)["near"].alias("to")), n_nodes)
        maps.append(step)
        moved = links.join(step.toDF("a", "ta"), "a").join(step.toDF("b", "tb"), "b")
        links = moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        links = saved(links, n_nodes)
    roots = links.repartition(1).mapInArrow(_solve, "node bigint, root bigint")
    for step in reversed(maps):
        there = step.join(roots.toDF("to", "r"), "to", "left")
        roots = there.select("node", F.coalesce("r", "to").alias("root"))
    return roots
