"""Connected components of a link table, as a few written Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.plans.store import materialize

MAX_ROUNDS = 200


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """Rows (node, component) for every node of the links (a, b); component is the smallest node reachable.

    Alternating large and small stars: each round hangs the neighbours of a node onto its smallest neighbour, which keeps the
    number of links and takes about a logarithm of the longest path in rounds.  Every round is a written table, so a lost
    executor costs a part of one round.  Nodes without links, and null nodes, are not returned.  An empty table gives none.
    """
    pairs = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = None
    for _ in range(MAX_ROUNDS):
        both = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: the larger neighbours of a node go to the smallest of its neighbours and itself
        large = (both.where("b > a").join(least, "a").where("b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: the smaller neighbours and the node itself go to the smallest
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_least, "a")
        small = (joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionAll(small_least.select("a", F.col("m").alias("b"))).distinct())
        pairs = materialize(small, label)
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
