"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every end of the edges (a, b): comp is the least node of its component.

    Every node takes the least label among its neighbours and itself, then the label of its label; labels of
    a chain thus spread by doubling.  A round is written to the shared folder, so no lineage piles up.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialise(both)
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("least"))
        met = labels.join(near, "node", "left").select("node", "comp", F.least("comp", F.coalesce("least", "comp")).alias("next"))
        hop = labels.select(F.col("node").alias("next"), F.col("comp").alias("jump"))
        new = materialise(met.join(hop, "next", "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("comp"), (F.least("next", F.coalesce("jump", "next")) != F.col("comp")).alias("moved")))
        moved = new.where("moved").limit(1).collect()
        discard(labels)
        labels = new.select("node", "comp")
        labels.scratch_path = new.scratch_path
        if not moved:
            discard(both)
            return labels
