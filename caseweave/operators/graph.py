"""Components of a table of links, and roots of a table of parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.checkpoint import materialize


def _roots(up: DataFrame) -> DataFrame:
    """node, to: each node's root in a forest of node -> to, where a root points at itself; by pointer jumping."""
    up = materialize(up)
    while True:
        over = up.select(F.col("node").alias("n2"), F.col("to").alias("t2")).filter("n2 <> t2")
        nxt = materialize(up.join(over, up["to"] == over["n2"], "left").select("node", F.coalesce("t2", "to").alias("to"), F.col("t2").isNotNull().alias("moved")))
        up = nxt.select("node", "to")
        if nxt.filter("moved").isEmpty():
            return up


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of each node in links (a, b).

    Rounds of contraction: each root hooks onto its smallest neighbour if that is smaller, the trees are flattened,
    links inside a tree go. Rounds grow with the logarithm of the nodes, and each is written down, so lineage stays
    short. The result doesn't depend on any order of rows."""
    both = links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct()
    left, label = materialize(both), None
    while not left.isEmpty():
        up = _roots(left.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("to")))
        if label is None:
            label = up.select("node", F.col("to").alias("component"))
        else:
            new = up.select(F.col("node").alias("r"), F.col("to").alias("t"))
            label = materialize(label.join(new, label["component"] == new["r"], "left").select("node", F.coalesce("t", "component").alias("component")))
        one, two = up.select(F.col("node").alias("a"), F.col("to").alias("ra")), up.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        left = materialize(left.join(one, "a").join(two, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    return label if label is not None else both.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)


def thread_roots(messages: DataFrame, rounds: int = 24) -> DataFrame:
    """id, root, steps of each message (id, parent): the walk along parents that are in the corpus.

    A null or missing parent ends the walk. After `rounds` doublings (2 ** rounds steps) what still walks is a cycle:
    its root is the smallest id on it, whatever the start, and steps is null."""
    m = messages.select("id", "parent")
    have = m.select(F.col("id").alias("p")).distinct()
    up = m.join(have, F.col("parent") == F.col("p"), "left").select(F.col("id").alias("node"), F.coalesce("p", "id").alias("to"))
    up = materialize(up.select("node", "to", (F.col("node") != F.col("to")).cast("long").alias("steps"), F.least("node", "to").alias("low")))
    for _ in range(rounds):
        over = up.select(F.col("node").alias("n2"), F.col("to").alias("t2"), F.col("steps").alias("s2"), F.col("low").alias("l2"))
        up = materialize(up.join(over, up["to"] == over["n2"]).select("node", F.col("t2").alias("to"), (F.col("steps") + F.col("s2")).alias("steps"), F.least("low", "l2").alias("low"), (F.col("s2") > 0).alias("moved")))
        if up.filter("moved").isEmpty():
            return up.select(F.col("node").alias("id"), F.col("to").alias("root"), "steps")
        up = up.drop("moved")
    ends = up.select(F.col("node").alias("e"), F.col("steps").alias("es"))
    walk = up.join(ends, up["to"] == ends["e"])
    return walk.select(F.col("node").alias("id"), F.when(F.col("es") > 0, F.col("low")).otherwise(F.col("to")).alias("root"), F.when(F.col("es") == 0, F.col("steps")).alias("steps"))
