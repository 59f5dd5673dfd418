"""Connected components and set-similarity links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b): the smallest node of each connected component.

    Each round a label falls to the smallest of its neighbours' labels, and to that label's own label, so chains
    halve.  Every round is written and read anew, so its plan stays as small as the first; rounds end when no
    label changes.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = cut(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("least"))
        fell = label.join(near, F.col("node") == F.col("a")).select("node", F.least("component", "least").alias("to"), F.col("component").alias("was"))
        jump = label.select(F.col("node").alias("to"), F.col("component").alias("then"))
        new = cut(fell.join(jump, "to").select("node", F.least("to", "then").alias("component"), "was"))
        label = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return label


def closure(edges: DataFrame) -> DataFrame:
    """All (a, b) with a path from a to b over ``edges`` (a, b), by doubling: each round joins paths with paths."""
    reach = cut(edges.select("a", "b").distinct())
    count = reach.count()
    while True:
        onward = reach.select(F.col("a").alias("via"), F.col("b").alias("end"))
        reach = cut(reach.union(reach.join(onward, F.col("b") == F.col("via")).select("a", F.col("end").alias("b"))).distinct())
        if (grown := reach.count()) == count:
            return reach
        count = grown


def _prefixes(sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The sets without repeats or empty ones, and (item, node, size) of the items that a similar set must share.

    Two sets with a Jaccard similarity of ``least`` or more share an item among the first size - ceil(least * size) + 1
    of each, items being in one order for all, rare ones first.
    """
    sets = cut(sets.where(F.size("items") > 0).select("node", F.array_distinct("items").alias("items")))
    items = sets.select("node", F.size("items").alias("size"), F.explode("items").alias("item"))
    often = items.groupBy("item").agg(F.count("*").alias("n")).where("n > 1")
    order = Window.partitionBy("node").orderBy("n", "item")
    shared = items.join(often, "item").withColumns({"place": F.row_number().over(order), "shared": F.count("*").over(Window.partitionBy("node"))})
    # Items that no other set has come first of all.
    place = F.col("place") + F.col("size") - F.col("shared")
    return sets, cut(shared.where(place <= F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1).select("item", "node", "size"))


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets have the similarity."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")
    common = F.size(F.array_intersect("items_a", "items_b"))
    return both.where(common >= least * (F.size("items_a") + F.size("items_b") - common) - 1e-9).select("a", "b")


def _fits(least: float) -> Column:
    return F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-9


def similar_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b, of all rows (node, items) whose item sets have a Jaccard similarity of ``least`` or more.

    Sets that share one of their rarest items are compared.  Empty sets match nothing.  For classes of similar sets
    use ``similar_components``, which doesn't list all pairs of a class.
    """
    sets, prefix = _prefixes(sets, least)
    side = lambda x: prefix.select("item", F.col("node").alias(x), F.col("size").alias(f"size_{x}"))
    return _similar(side("a").join(side("b"), "item").where((F.col("a") < F.col("b")) & _fits(least)).select("a", "b").distinct(), sets, least)


def similar_components(sets: DataFrame, least: float) -> DataFrame:
    """(node, component) of the connected components of rows (node, items) whose sets are similar; others have none.

    Not all pairs are listed.  Equal sets are one node.  Then every set is compared with one set of each of its
    rarest items, the one met first there, and what is similar becomes one class; so a group of near copies costs a
    comparison for each member and item.  Last, sets of different classes that share such an item are compared:
    pairs within a class can't change it.  The result is that of all pairs.
    """
    one = cut(sets.where(F.size("items") > 0).select("node", F.array_sort(F.array_distinct("items")).alias("items")))
    first = cut(one.groupBy("items").agg(F.min("node").alias("node"), F.count("*").alias("n")))
    sets, prefix = _prefixes(first.select("node", "items"), least)
    lead = prefix.groupBy("item").agg(F.min(F.struct("node", "size")).alias("lead")).select("item", F.col("lead.node").alias("a"), F.col("lead.size").alias("size_a"))
    star = prefix.select("item", F.col("node").alias("b"), F.col("size").alias("size_b")).join(lead, "item").where((F.col("a") != F.col("b")) & _fits(least)).select("a", "b").distinct()
    links = cut(_similar(star, sets, least))
    label = components(links)
    of = prefix.join(label, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
    of = cut(of)
    classes = of.select("item", "class").distinct()
    apart = classes.select("item", F.col("class").alias("class_a")).join(classes.select("item", F.col("class").alias("class_b")), "item").where("class_a < class_b")
    side = lambda x: of.select("item", F.col("class").alias(f"class_{x}"), F.col("node").alias(x), F.col("size").alias(f"size_{x}"))
    pairs = side("a").join(apart, ["item", "class_a"]).join(side("b"), ["item", "class_b"])
    rest = _similar(pairs.where(_fits(least)).select("a", "b").distinct(), sets, least)
    same = one.join(first.where("n > 1").select("items", F.col("node").alias("a")), "items").where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b"))
    return components(links.unionByName(rest).unionByName(same))
