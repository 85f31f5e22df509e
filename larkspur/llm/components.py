"""Connected components of an edge table, by contraction.

Each round gives every node the first of itself and its neighbours, puts that in place of both ends of every edge, and
drops edges that became loops. The order is that of the ids and of a hash shuffled anew by turns: by ids, stars around
their least node end at once; by a hash only a part of the nodes is first anywhere, so a chain shrinks by a factor. Each round's choices are kept;
walking them back gives each node one of its component, and the least of those that share it is their root. All tables are
written to the shared folder between rounds, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.scratch import Scratch


def connected(s: Scratch, edges: DataFrame) -> DataFrame:
    """node, root for every node with an edge (a, b). Nulls and loops link nothing."""
    now = s.write(edges.select("a", "b").filter("a != b"))
    rounds = []
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        shuffled = F.lit(len(rounds)) if len(rounds) % 2 else None
        order = lambda c: F.struct((F.lit(0) if shuffled is None else F.xxhash64(c, shuffled)).cast("bigint").alias("at"), F.col(c).alias("n"))
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("first"))
        best = s.write(best.select("node", F.least(order("node"), F.col("first"))["n"].alias("to")))
        rounds.append(best)
        moved = now.join(best.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").select("a2", "b")
        moved = moved.join(best.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        now = s.write(moved.select(F.col("a2").alias("a"), F.col("b2").alias("b")).filter("a != b").distinct())
    if not rounds:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[-1].select("node", F.col("to").alias("root"))
    for best in reversed(rounds[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = best.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
        roots = s.write(roots)
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    return s.write(roots.join(least, "root").select("node", F.col("least").alias("root")))
