"""Connected components of a distributed edge list by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occura.llm.common import Workspace, lookup


def components(edges: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(a, b) edges → one row (node, label) per node that has an edge, label being the smallest node it can reach.

    Every round takes the smallest label among the neighbours, then follows the label's own label; the state is
    written to the shared folder each time, and only the number of changed rows comes to the driver.  The edges of one node,
    and the nodes of one label, are spread over many tasks.  Repeated edges and loops change nothing.
    """
    materialize = (work or Workspace(edges.sparkSession, "components")).materialize
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        heard = lookup(both, labels.withColumnRenamed("node", "b"), ["b"], "a").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        lower = materialize(labels.join(heard, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label")), "lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = materialize(lookup(lower, jump, ["label"], "node", "left").select("node", "old", F.coalesce(F.least("label", "further"), "label").alias("label")), "labels")
        changed = after.filter("label <> old").count()
        labels = after.select("node", "label")
        if not changed:
            return labels
