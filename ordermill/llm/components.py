"""Connected components by smallest reachable id: label exchange with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.llm.rows import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every end of an edge; the component is its smallest node.

    Each round takes the smallest label among a node's neighbours (a partial aggregate, so a hub
    sends one row per task) and then the label of that label, which halves long chains. Labels
    rest in the shared folder between rounds; the driver only sees whether any moved. Edges
    with a null end and loops are ignored.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    both = stored(pairs.union(pairs.select("y", "x")).distinct(), "edges")
    labels = stored(
        both.groupBy(F.col("x").alias("node"))
        .agg(F.min("y").alias("near"))
        .select("node", F.least("node", "near").alias("component")),
        "labels",
    )
    while True:
        seen = labels.select(F.col("node").alias("y"), F.col("component").alias("other"))
        near = both.join(seen, "y").groupBy(F.col("x").alias("node")).agg(
            F.min("other").alias("near")
        )
        lower = labels.join(near, "node", "left").select(
            "node",
            F.col("component").alias("before"),
            F.least("component", "near").alias("component"),
        )
        # every label is itself a node, so the inner join keeps all rows
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("root"))
        moved = (F.col("root") < F.col("before")).alias("moved")
        nxt = stored(
            lower.join(jump, "component").select("node", F.col("root").alias("component"), moved),
            "labels",
        )
        labels = nxt.select("node", "component")
        if nxt.filter("moved").isEmpty():
            return labels
