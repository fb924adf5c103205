"""AS graphs and paths: adjacency, bounded neighbourhoods, downstream relations and a path dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_private_asn
from .tables import stored


def adjacency(paths: DataFrame, path: str = "as_path") -> DataFrame:
    """Undirected (low, high, n_paths) edges between neighbouring public hops of paths; a repeated hop is no edge, and a path
    with an AS set has none."""
    paths = paths.filter(~F.contains(F.col(path), F.lit("{")))
    public = F.filter(F.split(F.col(path), " "), lambda h: ~is_private_asn(h))
    hops = F.transform(public, lambda h: h.try_cast("bigint"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("h") - 2), lambda i: F.struct(F.get("h", i).alias("a"), F.get("h", i + 1).alias("b")))
    rows = paths.select(hops.alias("h")).filter(F.size("h") > 1).select(F.explode(pairs).alias("e")).filter("e.a <> e.b")
    return rows.groupBy(F.least("e.a", "e.b").alias("low"), F.greatest("e.a", "e.b").alias("high")).agg(F.count("*").alias("n_paths"))


def inside_country(edges: DataFrame, countries: DataFrame) -> DataFrame:
    """Edges whose ends are in one country. ``countries``: (asn, country)."""
    low = countries.select(F.col("asn").alias("low"), "country")
    high = countries.select(F.col("asn").alias("high"), F.col("country").alias("other"))
    return edges.join(low, "low").join(high, "high").filter("country = other").select("country", "low", "high", "n_paths")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop) of the nodes within ``hops`` steps of a seed (node), with the fewest steps. One join a step; a step's
    frontier holds only nodes not reached before."""
    both = edges.select(F.col("low").alias("node"), F.col("high").alias("next")).union(edges.select(F.col("high"), F.col("low")))
    reached = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    frontier = reached
    for k in range(1, hops + 1):
        step = frontier.select("node").join(both, "node").select(F.col("next").alias("node")).distinct()
        frontier = step.join(reached, "node", "left_anti").withColumn("hop", F.lit(k))
        reached = reached.union(frontier)
    return reached


def capped_subgraph(edges: DataFrame, seeds: DataFrame, hops: int, max_nodes: int | None = None, max_edges: int | None = None) -> DataFrame:
    """(low, high, n_paths, hop) of the edges at the nodes within ``hops - 1`` steps of a seed (node), with the step that reaches them.

    Without caps all of them. With caps a step's edges are taken in the order of most paths, then numbers, until ``max_edges`` edges are taken or ``max_nodes`` nodes reached, the edge that reaches the cap included; seeds that reach it alone
    have no edges. The last edge that fits is a threshold found by a top-n of as many edges, or first edges of new nodes, as there is room for; the edges up to it are a filter, so only the caps bound what comes together in one place.
    """
    order = F.struct((-F.col("n_paths")).alias("fewer"), "low", "high")
    ends = lambda df: df.select(F.explode(F.array("low", "high")).alias("node"))
    reached = stored(seeds.select("node").distinct().withColumn("step", F.lit(0)))
    taken, n_nodes, n_edges = None, reached.count() if max_nodes is not None else 0, 0
    if (max_nodes is not None and n_nodes >= max_nodes) or max_edges == 0:
        return edges.select("low", "high", "n_paths", F.lit(1).alias("hop")).limit(0)
    edges = stored(edges.select("low", "high", "n_paths"))
    for k in range(1, hops + 1):
        # an edge belongs to the step of its nearer end: those of earlier steps are all taken, or a cap would have ended the loop
        met = edges.join(reached.select(F.col("node").alias("low"), F.col("step").alias("a")), "low", "left").join(reached.select(F.col("node").alias("high"), F.col("step").alias("b")), "high", "left")
        near = met.filter(F.least("a", "b") == k - 1).select("low", "high", "n_paths", order.alias("place"))
        full, limits = False, []
        if max_edges is not None:
            top = near.orderBy("place").limit(max_edges - n_edges).agg(F.count("*").alias("n"), F.max("place").alias("last")).first()
            if n_edges + top["n"] >= max_edges:
                full = True
                limits.append(top["last"])
        if max_nodes is not None:
            first = near.select("place", F.explode(F.array("low", "high")).alias("node")).join(reached, "node", "left_anti").groupBy("node").agg(F.min("place").alias("place"))
            top = first.orderBy("place").limit(max_nodes - n_nodes).agg(F.count("*").alias("n"), F.max("place").alias("last")).first()
            if n_nodes + top["n"] >= max_nodes:
                full = True
                limits.append(top["last"])
        for last in limits:
            bound = F.struct(*[F.lit(last[c]).alias(c) for c in ("fewer", "low", "high")]) if last is not None else None
            near = near.filter(F.col("place") <= bound) if bound is not None else near.limit(0)
        step = stored(near.select("low", "high", "n_paths", F.lit(k).alias("hop")))
        taken = step if taken is None else taken.union(step)
        if full or k == hops:
            break
        reached = reached.union(stored(ends(step).distinct().join(reached, "node", "left_anti").withColumn("step", F.lit(k))))
        if max_edges is not None or max_nodes is not None:
            n_edges, n_nodes = n_edges + step.count(), reached.count() if max_nodes is not None else 0
    return taken


def downstream(paths: DataFrame, affected: DataFrame, path: str = "as_path") -> DataFrame:
    """(affected, origin, n_paths) where an affected AS (asn) stands before the origin of an ordered path."""
    rows = paths.select(F.split(F.col(path), " ").alias("h"), path).filter(F.size("h") > 1).filter(~F.contains(F.col(path), F.lit("{")))
    rows = rows.select(path, F.element_at("h", -1).try_cast("bigint").alias("origin"), F.explode(F.array_distinct(F.slice("h", F.lit(1), F.size("h") - 1))).alias("x"))
    met = rows.select(path, "origin", F.col("x").try_cast("bigint").alias("asn")).filter("asn <> origin").join(affected.select("asn").distinct(), "asn")
    return met.groupBy(F.col("asn").alias("affected"), "origin").agg(F.count("*").alias("n_paths"))


def path_dictionary(paths: DataFrame, path: str = "as_path") -> DataFrame:
    """Different paths with a content-addressed id, their length and how often they occur."""
    found = paths.filter(F.col(path).isNotNull()).groupBy(path).agg(F.count("*").alias("n_uses"))
    return found.select(F.concat(F.lit("path_"), F.substring(F.sha2(path, 256), 1, 24)).alias("path_key"), path, F.size(F.split(path, " ")).cast("bigint").alias("n_hops"), "n_uses")
