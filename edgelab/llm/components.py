"""Connected components of a link table, by least labels with pointer jumping; all tables stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of a link, the least node that links reach. Rounds are logarithmic in the
    longest shortest path; each ends in a table in the shared folder. Loops and repeated links do no harm; a null end drops a link."""
    with common.scratch(links.sparkSession) as keep:
        return keep(_labels(links, a, b))


def _labels(links: DataFrame, a: str, b: str) -> DataFrame:
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    edges = common.materialise(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = common.materialise(edges.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("component")), "labels")
    while True:
        near = edges.join(labels, edges["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["u"]).select("node", F.col("component").alias("before"), F.least("component", "near").alias("lower"))
        jump = labels.select(F.col("node").alias("parent"), F.col("component").alias("above"))
        new = common.materialise(lower.join(jump, F.col("lower") == F.col("parent"), "left").select("node", "before", F.least("lower", "above").alias("component")), "labels")
        labels = new.select("node", "component")
        labels._edgelab_path = new._edgelab_path
        if new.filter("before <> component").isEmpty():
            return labels
