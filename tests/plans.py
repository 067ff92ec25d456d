"""What a query's plan did, as its own counts tell after it has run."""

from __future__ import annotations

from pyspark.sql import DataFrame


def most_joined(df: DataFrame) -> int:
    """Run ``df``; the most rows that one of its joins gave."""
    df.collect()
    found = [0]

    def walk(node) -> None:
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().get("numOutputRows").get().value())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return max(found)
