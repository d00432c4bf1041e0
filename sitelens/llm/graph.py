"""Connected components of a table of links, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.storage import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links(a, b)``: the label is the smallest node of the component.

    Each round hooks every node to its smallest neighbour, follows the hook
    once more, and replaces both ends of all links by where they lead, which
    shrinks the graph until no link is left.  A round's tables are written to
    the shared folder; only whether links remain comes to the driver.
    """
    ends = links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
    edges = written(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "links")
    labels = edges.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()
    while not edges.isEmpty():
        hooks = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p"))
        follow = hooks.select(F.col("u").alias("p"), F.col("p").alias("q"))
        moved = written(hooks.join(follow, "p").select("u", F.col("q").alias("to")), "hooks")
        at = lambda name, to: moved.select(F.col("u").alias(name), F.col("to").alias(to))
        labels = written(labels.join(at("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        shrunk = edges.join(at("u", "x"), "u").join(at("v", "y"), "v").select(F.col("x").alias("u"), F.col("y").alias("v"))
        edges = written(shrunk.where("u <> v").distinct(), "links")
    return labels


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after further ``links(a, b)`` between nodes that ``labels`` may or may not have.

    Only what joins different components is looked at: both ends are replaced
    by their labels first, so what is left is as small as the change.
    """
    at = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
    ends = ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).where("a <> b").distinct()
    ends = written(ends, "label-links")
    if ends.isEmpty():
        return labels
    over = components(ends)
    moved = labels.join(over.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    moved = moved.select("node", F.coalesce("to", "label").alias("label"))
    fresh = over.join(labels.select("node"), "node", "left_anti").select("node", "label")
    return written(moved.unionByName(fresh), "labels")
