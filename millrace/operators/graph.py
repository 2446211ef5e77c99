"""Connected components of links, without a task or the driver holding a whole component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id and component (its smallest member) of every id in links (a, b).

    Alternates two steps until nothing changes: every node's larger
    neighbours are tied to the smallest node next to it, then every node's
    smaller neighbours are, so that the number of rounds grows with the
    logarithm of a component's size.  A node with many links never gathers
    them: the smallest neighbour is an aggregate, joined back to the links.
    Null and self links count as none.
    """
    edges = links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    for _ in range(most_rounds):
        facts = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
        if facts["n"] == 0 or tuple(facts) == before:
            break
        before = tuple(facts)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = small.where("u <> v").distinct().checkpoint()
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    down = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return down.union(edges.select(F.col("v"), F.col("v"))).distinct()
