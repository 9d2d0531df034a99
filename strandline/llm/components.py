"""Connected components by DataFrame operations only.

Every node takes the smallest label among its neighbours and then, by pointer jumping, its
label's label; rounds grow with the logarithm of a path's length. Labels are written to the
shared folder each round, so lineage stays short and a lost executor costs one round at most.
Minima are combined before each shuffle, and joins are plain joins of two written tables,
so adaptive execution can split a hot label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) undirected edges, of any orderable type -> (node, component), component the least node.

    Loops, repeated edges and rows with a null end are harmless; no edges give no rows.
    """
    edges = edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("m"))
        hooked = materialize(
            labels.join(near, "node").select("node", F.least("component", "m").alias("component"), (F.col("m") < F.col("component")).alias("moved")), "hooked"
        )
        if not hooked.filter("moved").limit(1).count():
            discard(both, hooked)
            return labels
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("top"))
        before, labels = labels, materialize(hooked.join(up, "component").select("node", F.col("top").alias("component")), "labels")
        discard(before, hooked)
