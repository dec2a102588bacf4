"""Connected components of a link table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """`s, c` for every end of `links(a, b)`: c is the smallest end reachable.

    Each round a node takes the smallest label around it, then its label's label; the number of rounds
    grows with the logarithm of the longest path. Labels are written out after each round.
    """
    edges = common.saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "component-edges")
    labels = common.saved(edges.groupBy(F.col("a").alias("s")).agg(F.least(F.min("b"), F.col("s")).alias("c")), "component-labels")
    for _ in range(most_rounds):
        jumped = common.saved(_stepped(edges, labels), "component-labels")
        changed = jumped.where("c <> before").limit(1).count()
        common.removed(labels)
        labels = jumped.select("s", "c")
        if not changed:
            common.removed(edges)
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def nearby(links: DataFrame, rounds: int = 3) -> DataFrame:
    """`s, c` for every end of `links(a, b)`: c is an end of the same component, in small components the same for all.

    Some `rounds` of what `components` does until it settles; the reach doubles with each.
    """
    edges = common.saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "nearby-edges")
    labels = common.saved(edges.groupBy(F.col("a").alias("s")).agg(F.least(F.min("b"), F.col("s")).alias("c")), "nearby-labels")
    for _ in range(rounds):
        stepped, before = common.saved(_stepped(edges, labels).drop("before"), "nearby-labels"), labels
        common.removed(before)
        labels = stepped
    common.removed(edges)
    return labels


def _stepped(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """`s, c, before`: the smallest label around, then that label's label."""
    around = edges.join(labels.withColumnRenamed("s", "b"), "b").groupBy(F.col("a").alias("s")).agg(F.min("c").alias("least"))
    stepped = labels.join(around, "s").select("s", F.least("c", "least").alias("c"), F.col("c").alias("before"))
    own = stepped.select(F.col("s").alias("c"), F.col("c").alias("next"))
    return stepped.join(own, "c", "left").select("s", F.coalesce(F.least("c", "next"), "c").alias("c"), "before")


def merged_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` of components after further `links(a, b)`: only the components that the links touch are walked again.

    Takes the place of the table `labels`, which is deleted.
    """
    ends = links.select(F.col("a").alias("s")).union(links.select("b")).distinct()
    known = common.saved(ends.join(labels.withColumnRenamed("c", "old"), "s", "left"), "component-ends")
    place = known.select("s", F.coalesce("old", "s").alias("c"))
    between = (links.join(place.select(F.col("s").alias("a"), F.col("c").alias("x")), "a")
               .join(place.select(F.col("s").alias("b"), F.col("c").alias("y")), "b").where("x <> y"))
    merged = components(between.select(F.col("x").alias("a"), F.col("y").alias("b")))
    # ends that had no link before are components of their own
    every = labels.unionByName(known.where("old is null").select("s", F.col("s").alias("c")))
    out = common.saved(every.join(merged.select(F.col("s").alias("c"), F.col("c").alias("new")), "c", "left")
                       .select("s", F.coalesce("new", "c").alias("c")), "component-labels")
    common.removed(labels, known, merged)
    return out
