"""Joins with the semantics of routing checks: relations with precedence, ordered reasons, time windows, longest prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relation names by precedence.
RELATIONS = ("peer", "customer_provider", "provider_customer")


def best_relations(edges: DataFrame) -> DataFrame:
    """(a, b, place) of the ``edges`` of ``relation_of`` from both ends: the first of ``RELATIONS`` in precedence."""
    mirrored = edges.select("a", "b", "rel").union(edges.select("b", "a", -F.col("rel")))
    place = F.when(F.col("rel") == 0, 0).when(F.col("rel") == 1, 1).otherwise(2)
    return mirrored.groupBy("a", "b").agg(F.min(place).alias("place"))


def relation_of(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The relation of each (a, b): ``edges`` (a, b, rel) hold 0 for peers, 1 where a is b's customer, -1 the other way; they are
    looked up from both ends and the first in precedence wins."""
    joined = pairs.join(best_relations(edges), ["a", "b"], "left")
    return joined.select("a", "b", F.coalesce(F.get(F.array(*map(F.lit, RELATIONS)), F.col("place")), F.lit("none")).alias("relation"))


def first_reason(df: DataFrame, rules: Sequence[tuple[str, Column | tuple[DataFrame, list[str]]]]) -> DataFrame:
    """Adds ``reason``: the first rule that holds. A rule is a condition, or a table and the columns by which a row is in it.
    Spark broadcasts a rule's table where it has measured it to be small."""
    out, chain, flags = df, None, []
    for k, (name, rule) in enumerate(rules):
        if isinstance(rule, tuple):
            table, on = rule
            flag = f"__rule_{k}"
            out = out.join(table.select(*on).distinct().withColumn(flag, F.lit(True)), on, "left")
            flags.append(flag)
            rule = F.col(flag).isNotNull()
        chain = F.when(rule, name) if chain is None else chain.when(rule, name)
    return out.withColumn("reason", chain).drop(*flags)


def within(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, seconds: int) -> DataFrame:
    """Rows of one key whose times differ by at most ``seconds``. Time is cut in buckets of that length and a left row meets three
    of them, so the join has equality keys and a busy key is spread over time."""
    l = left.withColumn("__bucket", F.explode(F.array(*[F.floor(F.col(left_at) / seconds) + d for d in (-1, 0, 1)])))
    r = right.withColumn("__bucket", F.floor(F.col(right_at) / seconds))
    return l.join(r, [key, "__bucket"]).filter(F.abs(F.col(right_at) - F.col(left_at)) <= seconds).drop("__bucket")


def longest_match(addresses: DataFrame, table: DataFrame, address: str) -> DataFrame:
    """The longest prefix (network, length) of ``table`` that holds each address: the masks of the lengths that the table has, at most
    33, are exploded and met by equality."""
    lengths = sorted((r["length"] for r in table.select("length").distinct().collect()), reverse=True)
    size = lambda n: F.lit(1 << (32 - n)).cast("bigint")
    keys = F.array(*[F.struct((F.col(address) - F.pmod(F.col(address), size(n))).alias("network"), F.lit(n).alias("length")) for n in lengths]) if lengths else F.array().cast("array<struct<network:bigint,length:int>>")
    met = addresses.select(address, F.explode(keys).alias("k")).select(address, "k.*").join(table.select("network", "length").distinct(), ["network", "length"])
    best = met.groupBy(address).agg(F.max_by("network", "length").alias("network"), F.max("length").alias("length"))
    return addresses.join(best, address, "left")


def visible_cohort(cohort: DataFrame, current: DataFrame, key: Sequence[str]) -> DataFrame:
    """A fixed population against current routes: a member is visible only with the origin it had. Both have ``origin``."""
    now = current.select(*key, F.col("origin").alias("current_origin"))
    return cohort.join(now, list(key), "left").withColumn("visible", F.coalesce(F.col("origin") == F.col("current_origin"), F.lit(False)))


def mapping_union(base: DataFrame, delta: DataFrame, key: str, value: str) -> DataFrame:
    """A revised mapping: the delta's value where it has one, else the base's; with the side it came from."""
    both = base.select(key, F.col(value).alias("__base")).join(delta.select(key, F.col(value).alias("__delta")), key, "full")
    return both.select(key, F.coalesce("__delta", "__base").alias(value), F.when(F.col("__delta").isNotNull(), "delta").otherwise("base").alias("view"))


def stability_of(routes: DataFrame, known: DataFrame, key: Sequence[str], skip: float = 0.2) -> DataFrame:
    """The stability of the neighbours of each path (0 where unknown), and whether a leak check skips it."""
    joined = routes.join(known, list(key), "left").withColumn("stability", F.coalesce("stability", F.lit(0.0)))
    return joined.withColumn("skipped", F.col("stability") >= skip).drop(*key)
