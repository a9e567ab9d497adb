"""Connected components over links, by minimum labels and pointer jumping on distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudspark.llm.common import discard, lookup, materialize


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Rows (node, root) for all nodes of ``links`` (a, b); root is the smallest node of the component.

    Each round hooks every root to the smallest root next to it and then halves the paths, so that the number of
    rounds grows with the logarithm of the longest chain. All steps are equi-joins and minima; minima are combined
    before the shuffle. Links whose ends have met are left out of the next round, so the tables shrink.

    Defined results: no links give no rows; repeated links and links of a node with itself change nothing; a link with a
    null end is none. Other columns of ``links`` are not read.
    """
    links = links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    ends = links.union(links.select("b", "a")).toDF("node", "other")
    labels = materialize(ends.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("root")), "labels")
    links = materialize(links.filter("a <> b").distinct(), "links")
    for _ in range(max_rounds):
        # contract: links between roots
        by_a = labels.withColumnsRenamed({"node": "a", "root": "ra"})
        by_b = labels.withColumnsRenamed({"node": "b", "root": "rb"})
        met = links.join(by_a, "a").join(by_b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        old, links = links, materialize(met, "links")
        # hook: each root to its smallest neighbour, then one jump for all nodes; a large component shares one root
        sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        hook = materialize(links.groupBy("b").agg(F.min("a").alias("to")).withColumnRenamed("b", "root").join(sizes, "root"), "hook")
        hooked = materialize(lookup(labels, hook, "root", "n").select("node", F.coalesce("to", "root").alias("root")), "labels")
        discard(old, labels, hook)
        sizes = hooked.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        up = materialize(hooked.filter("node <> root").select(F.col("node").alias("root"), F.col("root").alias("up")).join(sizes, "root"), "up")
        if up.isEmpty() and links.isEmpty():  # no root has a parent of its own
            discard(up, links)
            return hooked
        labels = materialize(lookup(hooked, up, "root", "n").select("node", F.coalesce("up", "root").alias("root")), "labels")
        discard(hooked, up)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
