"""Connected components of links held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Most edges that are worked on as one partition, whose groupings and joins need no shuffle.
ONE_PARTITION = 100_000


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): component is the smallest node that can be reached.

    Alternating large-star and small-star steps; each round is written to the shared folder, and only two numbers
    of a round reach the driver. Links of one node are never gathered: its minimum is a map-side combined aggregate. Few
    edges are one partition: each shuffle or broadcast of a plan keeps a thread of the driver, with its memory, for a minute.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    few = edges.count() <= ONE_PARTITION  # rounds never add edges

    def one(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if few else df

    state = None
    for _ in range(most_rounds):
        turned = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")
        both = one(edges).select(turned).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = one(both.filter("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(one(small.select("e.u", "e.v").filter("u <> v")).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", F.col("v").alias("w")))
