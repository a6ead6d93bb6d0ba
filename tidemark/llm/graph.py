"""Connected components by joins: labels take the least of their neighbours' and then
jump to their label's label, until no label changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, comp: the least node that each node can reach. Nothing is
    collected; rounds grow with the logarithm of the longest chain, about."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = stored(both, "edges")
    labels = old = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.least("comp", "near").alias("next"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        new = step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("comp"), "was")
        new = stored(new, "labels")
        changed = new.filter("comp <> was").limit(1).count()
        discard(old)
        old, labels = new, new.select("node", "comp")
        if not changed:
            discard(both)
            return labels
