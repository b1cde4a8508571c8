"""Connected components of a table of links, as DataFrame rounds with tables in the shared folder between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, component (the smallest node that can be reached) for nodes that have a link.

    Each round takes the smallest label among neighbours and then the label of one's label, so that the rounds grow
    with the logarithm of a chain's length. Each round is written out, and only a count comes to the driver.
    """
    links = edges.where("a <> b")
    links = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = stored(links.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        heard = links.join(labels, links["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        lower = labels.join(heard, labels["node"] == heard["a"]).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        lower = stored(lower, "lower")
        up = lower.select(F.col("node").alias("via"), F.col("label").alias("top"))
        new = stored(lower.join(up, lower["label"] == up["via"]).select("node", "old", F.col("top").alias("label")), "labels")
        if new.where("label <> old").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
