"""Sub-prefix hijacks: a prefix whose nearest covering prefix has another origin, the checks that clear it, and its lifecycle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefixes import v4_ancestors, v6_ancestors
from ..functions.scalars import PRIVATE_16
from .features import nearest_covering
from .joins import relation_of

#: How many bits longer than its parent a suspicious IPv4 and IPv6 prefix may be, the reasons to clear it, and the mark of a personal network.
GAP, GAP_V6 = 8, 3
TOO_LONG, MANY_PARENTS, SAME_ORIGINS = "prefix length difference is too large", "parent origin as num more than 1", "same origins"
CLEARED = ("personal network", "private as", "policy", "as rel provider-customer", "as rel peer", "as rel same org", "is AntiDDoS provider")
PERSONAL = "个人"


def sub_prefix_states_v6(routes: DataFrame, gap: int = GAP_V6) -> DataFrame:
    """``sub_prefix_states`` of IPv6 prefixes, ``network`` being struct(hi, lo). Only lengths that the table has are looked up."""
    lengths = [r["length"] for r in routes.filter("length > 0").select("length").distinct().collect()]  # at most 128
    return sub_prefix_states(routes, gap, v6_ancestors(lengths))


def sub_prefix_states(routes: DataFrame, gap: int = GAP, ancestors: Callable[[Column, Column], Column] = v4_ancestors) -> DataFrame:
    """Each different prefix (network, length) of ``routes`` (network, length, origin) with a covering prefix: the parent, both
    origin sets, the origins the parent does not have, and why there is nothing to check."""
    sets = routes.filter("length > 0").groupBy("network", "length").agg(F.sort_array(F.collect_set("origin")).alias("origins"))
    keyed = sets.withColumn("key", F.struct("network", "length"))
    met = nearest_covering(keyed.select("key", "network", "length"), sets, "key", ancestors).select("key.network", "key.length", "parent_network", "parent_length")
    parents = sets.select(F.col("network").alias("parent_network"), F.col("length").alias("parent_length"), F.col("origins").alias("parent_origins"))
    out = sets.join(met, ["network", "length"]).join(parents, ["parent_network", "parent_length"])
    new = F.array_except("origins", "parent_origins")
    reason = (
        F.when(F.col("length") - F.col("parent_length") > gap, TOO_LONG).when(F.size(new) == 0, SAME_ORIGINS)
        .when(F.size("parent_origins") > 1, MANY_PARENTS)
    )
    return out.withColumns({"new_origins": new, "reason": reason})


def cleared_pairs(states: DataFrame, registered: DataFrame, policies: DataFrame, edges: DataFrame, orgs: DataFrame, protectors: DataFrame) -> DataFrame:
    """Each suspicious (network, length, origin) with ``filter_reason``, the first by order over all pairs of the origin and the
    child's registered origins with the parent's and its registered ones; NULL where none clears it.

    ``registered``: (network, length, origin); ``policies``: (asn, other) of import and export lists; ``edges``: (a, b, rel);
    ``orgs``: (asn, org, org_en); ``protectors``: (asn).
    """
    suspects = states.filter("reason IS NULL").select("network", "length", "parent_network", "parent_length", F.explode("new_origins").alias("suspect"), F.get("parent_origins", 0).alias("owner"))
    more = registered.groupBy("network", "length").agg(F.collect_set("origin").alias("more"))
    more_up = more.select(F.col("network").alias("parent_network"), F.col("length").alias("parent_length"), F.col("more").alias("more_up"))
    wide = suspects.join(more, ["network", "length"], "left").join(more_up, ["parent_network", "parent_length"], "left")
    own = lambda one, rest: F.array_distinct(F.concat(F.array(one), F.coalesce(rest, F.array().cast("array<bigint>"))))
    pairs = wide.select("network", "length", "suspect", "owner", F.explode(own("suspect", "more")).alias("a"), "more_up").select("network", "length", "suspect", "owner", "a", F.explode(own("owner", "more_up")).alias("b"))
    different = pairs.select("a", "b").distinct()
    relation = relation_of(different, edges)
    both = policies.select(F.col("asn").alias("a"), F.col("other").alias("b")).union(policies.select("other", "asn")).distinct().withColumn("policy", F.lit(True))
    org = lambda side: orgs.select(F.col("asn").alias(side), F.col("org").alias(f"org_{side}"), F.col("org_en").alias(f"en_{side}"))
    shield = lambda side: protectors.select(F.col("asn").alias(side), F.lit(True).alias(f"shield_{side}"))
    checked = pairs.join(relation, ["a", "b"]).join(both, ["a", "b"], "left")
    for side in ("a", "b"):
        checked = checked.join(org(side), side, "left").join(shield(side), side, "left")
    private = F.col("a").between(PRIVATE_16[0] - 1, PRIVATE_16[1]) | F.col("b").between(PRIVATE_16[0] - 1, PRIVATE_16[1])
    rules = (
        F.contains("org_a", F.lit(PERSONAL)) | F.contains("org_b", F.lit(PERSONAL)), private, F.col("policy"), F.col("relation").isin("customer_provider", "provider_customer"), F.col("relation") == "peer",
        (F.col("a") == F.col("b")) | (F.col("en_a") == F.col("en_b")), F.coalesce("shield_a", "shield_b"),
    )
    found = F.array(*[F.when(holds, F.struct(F.lit(k).alias("rank"), F.lit(name).alias("reason"))) for k, (name, holds) in enumerate(zip(CLEARED, rules))])
    first = F.array_min(F.filter(found, lambda x: x.isNotNull()))
    out = checked.groupBy("network", "length", "suspect", "owner").agg(F.min(first).alias("x"))
    return out.select("network", "length", "suspect", "owner", F.col("x.reason").alias("filter_reason"))


def lifecycle(df: DataFrame, keys: Sequence[str], at: str, flag: str) -> DataFrame:
    """(keys, start_at, end_at) of the times in which a flag holds: it opens with the first row that has it after one that has not,
    and closes at the next row without it; the last may be open."""
    w = Window.partitionBy(*keys).orderBy(at)
    turns = df.withColumn("__before", F.coalesce(F.lag(flag).over(w), F.lit(False))).filter(F.col(flag) != F.col("__before"))
    return turns.withColumn("end_at", F.lead(at).over(w)).filter(flag).select(*keys, F.col(at).alias("start_at"), "end_at")
