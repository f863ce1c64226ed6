"""Connected components of a table of links, by contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelaudit.llm.storage import materialize

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` (a, b) to (node, label): the label is the least node of the component. Only nodes with links are returned.

    Each round points every node at the least of its neighbours, then at what that one points at, and contracts the links to
    where their ends point; links inside a contracted node go. So links shrink round by round, and chains in about the
    logarithm of their length. Every round is written to the shared folder; only whether links are left reaches the
    driver. Joins are plain ones on exchanges, so Spark can split a label that has very many rows.
    """
    links = materialize(edges.filter("a <> b").select("a", "b").distinct(), f"{name}-links")
    labels = None
    for _ in range(MAX_ROUNDS):
        both = links.union(links.select("b", "a"))
        near = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("mid")), f"{name}-near")
        up = near.select(F.col("node").alias("mid"), F.col("mid").alias("top"))
        moved = materialize(near.join(up, "mid").select("node", F.least("mid", "top").alias("label")), f"{name}-moved")
        if labels is None:
            labels = moved
        else:
            labels = labels.withColumnRenamed("label", "old").join(moved.select(F.col("node").alias("old"), "label"), "old", "left")
            labels = materialize(labels.select("node", F.coalesce("label", "old").alias("label")), f"{name}-labels")
        for end in ("a", "b"):
            links = links.join(moved.select(F.col("node").alias(end), F.col("label").alias(f"to_{end}")), end)
        links = materialize(links.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).filter("a <> b").distinct(), f"{name}-links")
        if links.limit(1).count() == 0:
            return labels
    raise RuntimeError("links are left; raise MAX_ROUNDS")
