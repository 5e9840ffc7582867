"""Connected components of an edge list, by smallest labels and pointer jumping; only counts reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of ``edges`` (a, b): comp is the smallest node it is connected with."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        # the smallest label among neighbours, then the label's own label
        of = labels.select(F.col("node").alias("b"), F.col("comp").alias("near"))
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        met = labels.join(near, "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        up = met.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        new = stored(met.join(up, "comp", "left").select("node", "old", F.least("comp", F.coalesce("top", "comp")).alias("comp")), "labels")
        labels = new.select("node", "comp")
        if not new.filter("old <> comp").limit(1).count():
            return labels
