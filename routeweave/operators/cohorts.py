"""Fixed populations, incidents and multi-valued entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(events: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """When each member of a growing population was first seen; it counts only from then on."""
    return events.groupBy(*keys).agg(F.min(at).alias("first_seen"))


def expected_directions(routes: DataFrame, prefix: str, peer: str) -> DataFrame:
    """Members of an event cohort: each prefix with the number of peers that had it."""
    return routes.groupBy(prefix).agg(F.count_distinct(peer).alias("expected"))


def direction_classes(cohort: DataFrame, current: DataFrame, prefix: str, peer: str) -> DataFrame:
    """normal, partial or complete loss of each cohort prefix by its visible directions."""
    now = current.join(cohort.select(prefix), prefix, "left_semi").groupBy(prefix).agg(F.count_distinct(peer).alias("visible"))
    joined = cohort.join(now, prefix, "left").withColumn("visible", F.coalesce("visible", F.lit(0)))
    loss = F.when(F.col("visible") == 0, "complete").when(F.col("visible") < F.col("expected"), "partial").otherwise("normal")
    return joined.withColumn("loss", loss)


def roll_up_classes(members: DataFrame, key: str) -> DataFrame:
    """One class of each key from the classes of its members: all complete, all normal, else partial."""
    out = members.groupBy(key).agg(F.count("*").alias("members"), F.count_if(F.col("loss") == "complete").alias("complete"), F.count_if(F.col("loss") == "normal").alias("normal"))
    state = F.when(F.col("complete") == F.col("members"), "complete").when(F.col("normal") == F.col("members"), "normal").otherwise("partial")
    return out.withColumn("loss", state)


def milestones(df: DataFrame, keys: Sequence[str], at: str, **conditions: Column) -> DataFrame:
    """The first time that each named condition holds; NULL where it never does."""
    return df.groupBy(*keys).agg(*[F.min(F.when(c, F.col(at))).alias(name) for name, c in conditions.items()])


def incidents(events: DataFrame, facts: DataFrame, key: str, fact_id: str) -> DataFrame:
    """Events joined to facts by key: matched to one, collision with several, unresolved without any, quarantined without a key."""
    many = facts.groupBy(key).agg(F.count("*").alias("n_facts"), F.min(fact_id).alias("first_fact"))
    joined = events.join(many, key, "left")
    status = F.when(F.col(key).isNull(), "quarantined").when(F.col("n_facts").isNull(), "unresolved").when(F.col("n_facts") > 1, "collision").otherwise("matched")
    return joined.withColumns({"n_facts": F.coalesce("n_facts", F.lit(0)), "status": status})


def entity_weights(df: DataFrame, text: str, weight: str, high: Column, separator: str = ",") -> DataFrame:
    """Summed weight and high-risk rows of each entity of a multi-valued text; an entity named twice in a row counts once."""
    named = F.array_distinct(F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != ""))
    rows = df.select(F.explode(named).alias("entity"), F.col(weight).alias("w"), high.alias("high"))
    return rows.groupBy("entity").agg(F.count("*").alias("n_rows"), F.sum("w").alias("weight"), F.count_if("high").alias("n_high"))


def priority_lists(df: DataFrame, scale: Sequence[Column], lasting: Sequence[Column], n: int, group: str) -> DataFrame:
    """Rows that are among the first ``n`` of their group by scale or by persistence, with both ranks."""
    place = lambda order: F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint")
    return df.withColumns({"scale_rank": place(scale), "lasting_rank": place(lasting)}).filter((F.col("scale_rank") <= n) | (F.col("lasting_rank") <= n))


def candidates(lists: Sequence[tuple[DataFrame, int]], key: str) -> DataFrame:
    """Keys of several ranked lists (key, rank), each list's first n, without repeats and in the order of the lists."""
    out = None
    for k, (df, n) in enumerate(lists):
        rows = df.filter(F.col("rank") <= n).select(key, (F.lit(k * 1_000_000) + F.col("rank")).cast("bigint").alias("position"))
        out = rows if out is None else out.union(rows)
    return out.groupBy(key).agg(F.min("position").alias("position"))


def sticky_origins(events: DataFrame, keys: Sequence[str], order: Sequence[str], origin: str, action: str = "action") -> DataFrame:
    """Number of origins a route has shown since its last withdrawal: a changed path does not drop the old origin."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("life", F.sum(F.when(F.col(action) == "withdraw", 1).otherwise(0)).over(w))
    fresh = Window.partitionBy(*keys, "life", origin).orderBy(*order)
    rows = rows.withColumn("new", F.when(F.col(origin).isNotNull() & (F.row_number().over(fresh) == 1), 1).otherwise(0))
    life = Window.partitionBy(*keys, "life").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*keys, *order, F.sum("new").over(life).alias("origins"))


def nodes_and_links(edges: DataFrame, group: str, affected: DataFrame) -> DataFrame:
    """Nodes, links and affected nodes of each group's graph. ``affected``: (asn)."""
    nodes = edges.select(group, F.explode(F.array("low", "high")).alias("asn")).distinct().join(affected.select("asn").distinct().withColumn("hit", F.lit(1)), "asn", "left")
    counted = nodes.groupBy(group).agg(F.count("*").alias("n_nodes"), F.count("hit").alias("n_affected"))
    return counted.join(edges.groupBy(group).agg(F.count("*").alias("n_links")), group)


def pattern_features(df: DataFrame, keys: Sequence[str], slot: str, ratio: str, denominator: str, directional: float = 2.0, abrupt: float = 8.0) -> DataFrame:
    """Features of a ratio series in percentage points, and the class they give: ``directional`` points are a move, ``abrupt`` ones
    a drop. Classes by precedence: small_denominator below 10, plateau, oscillation, multi_wave from two drops, one of three
    single waves, mixed with another drop, else unmatched."""
    w = Window.partitionBy(*keys).orderBy(slot)
    rows = df.withColumn("d", F.round((F.col(ratio) - F.lag(ratio).over(w)) * 100, 9))
    rows = rows.withColumn("sign", F.when(F.abs("d") >= directional, F.signum("d")))
    before = F.last("sign", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("turn", F.when(F.col("sign") != before, 1))
    out = rows.groupBy(*keys).agg(
        F.max(denominator).alias("denominator"), F.round((F.max(ratio) - F.min(ratio)) * 100, 6).alias("range_points"), F.round(F.coalesce(F.sum(F.abs("d")), F.lit(0.0)), 6).alias("variation"),
        F.count("sign").alias("moves"), F.count("turn").alias("turns"), F.count_if(F.col("d") <= -abrupt).alias("drops"), F.min_by(slot, F.struct(ratio, slot)).alias("extreme_slot"),
        F.min(F.when(F.col("d") >= directional, F.col(slot))).alias("first_rise"), F.min_by(ratio, slot).alias("start"), F.max_by(ratio, slot).alias("end"), F.max(slot).alias("last_slot"), F.min(ratio).alias("least"),
    )
    share = F.when(F.col("moves") > 1, F.col("turns") / (F.col("moves") - 1)).otherwise(0.0)
    single = (F.col("drops") == 1) & (F.col("first_rise").isNull() | (F.col("first_rise") > F.col("extreme_slot"))) & (F.col("extreme_slot") < F.col("last_slot")) & (F.col("end") > F.col("least"))
    ends = F.when(F.col("end") < F.col("start"), "single_wave_partial_rebound").when(F.col("end") == F.col("start"), "single_wave_return_to_window_start").otherwise("single_wave_above_window_start")
    kind = (
        F.when(F.col("denominator") < 10, "small_denominator").when((F.col("range_points") <= 2) & (F.col("variation") <= 10), "plateau")
        .when((F.col("moves") >= 8) & (share >= 0.8) & (F.col("variation") >= 50), "oscillation").when(F.col("drops") >= 2, "multi_wave").when(single, ends)
        .when(F.col("drops") > 0, "mixed").otherwise("unmatched")
    )
    return out.select(*keys, "denominator", "range_points", "variation", "moves", "turns", "drops", "extreme_slot", kind.alias("pattern"))
