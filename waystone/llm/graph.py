"""Connected components by neighbourhood minimum and pointer jumping, all on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Scratch


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each batch as stars with the same components: (node, smallest node of its component there)."""
    for batch in batches:
        u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            # both ends and their roots take the smaller root
            for to in (a, b, root[a], root[b]):
                np.minimum.at(new, to, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["u", "v"])


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of the links (a, b), root being the smallest node reachable. Self links and repeats
    are fine; links of null are for the caller to leave out.

    Links are first contracted batch by batch. Then each round takes the smallest label among a node and its neighbours
    and the label of that label, so a path of n nodes needs about log n rounds. Each round is written to the shared
    folder, so lost executors cost one round.
    """
    stars = links.select(F.col("a").cast("bigint").alias("u"), F.col("b").cast("bigint").alias("v")).mapInArrow(_stars, "u bigint, v bigint").filter("u <> v").distinct()
    edges = scratch.small(stars.union(stars.select("v", "u")))
    labels = scratch.small(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "node"))
    while True:
        near = edges.join(labels, edges.v == labels.node).groupBy("u").agg(F.min("root").alias("low"))
        hooked = labels.join(near, labels.node == near.u).select("node", "root", F.least("root", "low").alias("low"))
        # a root adopts the smallest label that any of its members sees
        roots = hooked.groupBy("root").agg(F.min("low").alias("best"))
        met = scratch.small(hooked.join(roots, "root").select("node", "root", F.least("low", "best").alias("new")))
        jump = met.select(F.col("node").alias("to"), F.col("new").alias("next"))
        low = F.least("new", F.coalesce("next", "new"))
        now = scratch.small(met.join(jump, met["new"] == jump["to"], "left").select("node", low.alias("root"), (F.col("root") > low).alias("moved")))
        labels = now.select("node", "root")
        if now.filter("moved").isEmpty():
            return labels
