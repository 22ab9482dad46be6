"""Connected components of large graphs by contraction.

Each round hooks every node to the least of itself and its neighbours, follows the hooks to
their ends, and contracts the edges: what is left joins different ends.  Only nodes
without a smaller neighbour remain, at most half of them, so the rounds are as many as the
logarithm of the nodes at the worst, and edges shrink from round to round.  The least node
of a component never hooks, so it is the end that remains.

Rounds are cut by reliable checkpoints; nothing but flags reaches the driver.  Both sides of
each join are checkpointed tables, so they are plain exchanges and Spark can split the
partition of a hub or of a large component.

Defined results: repeated edges and loops change nothing; null ends take no part; a graph
without edges gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.plans.storage import checkpoint


def _ends(hooks: DataFrame, max_rounds: int) -> DataFrame:
    """(node, end): hooks followed until they end, each step doubling its reach."""
    for _ in range(max_rounds):
        ahead = hooks.select(F.col("node").alias("_t"), F.col("end").alias("_e"))
        stepped = checkpoint(hooks.join(ahead, F.col("end") == F.col("_t")).select("node", F.col("_e").alias("end"), (F.col("_e") != F.col("end")).alias("_moved")))
        hooks = stepped.select("node", "end")
        if stepped.where("_moved").isEmpty():
            return hooks
    raise RuntimeError("hooks did not end")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable."""
    pair = lambda x, y: (F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
    pairs = checkpoint(edges.where(F.col(a) != F.col(b)).select(*pair(a, b)).distinct())
    labels = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("end")))
        ends = _ends(hooks, max_rounds)
        if labels is None:
            labels = ends.withColumnRenamed("end", "component")
        else:
            moved = labels.join(ends, F.col("component") == ends["node"], "left").select(labels["node"], F.coalesce("end", "component").alias("component"))
            labels = checkpoint(moved)
        of = lambda c: ends.select(F.col("node").alias(c), F.col("end").alias(f"_{c}"))  # noqa: E731, B023
        pairs = checkpoint(pairs.join(of("u"), "u").join(of("v"), "v").where("_u <> _v").select(*pair("_u", "_v")).distinct())
        if pairs.isEmpty():
            return labels.select("node", "component")
    raise RuntimeError("components did not settle")
