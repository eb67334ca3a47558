"""Connected components of an undirected graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components", rounds: int = 60) -> DataFrame:
    """(id, comp) for every node of `edges` (u, v): comp is the smallest id reachable.

    Each round takes the smallest label among a node and its neighbours, then the label of
    that label, so a path of n nodes needs about log n rounds. Minima are combined before
    the shuffle, so a node with very many neighbours costs no single task its rows. Labels
    stay in tables of the shared folder; only a count comes to the driver.
    """
    both = scratch.keep(f"{name}-edges", edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct())
    labels = scratch.keep(f"{name}-0", both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("comp")))
    for i in range(1, rounds):
        near = both.join(labels.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id")).agg(F.min("comp").alias("near"))
        stepped = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        new = scratch.keep(f"{name}-{i}", stepped.join(up, "comp", "left").select("id", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "old"))
        moved = new.where("comp <> old").limit(1).count()
        scratch.drop(f"{name}-{i - 1}")
        labels = new.select("id", "comp")
        if not moved:
            scratch.drop(f"{name}-edges")
            return labels
    raise RuntimeError(f"no fixed point after {rounds} rounds")
