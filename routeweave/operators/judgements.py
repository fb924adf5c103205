"""Which origin conflicts and leaks are suspicious: the whole chains of rules, each verdict with the first rule that clears it.

``as_info``: a row for each AS (asn text, org, org_en, shield, imports, exports, peers, siblings): import and export lists hold texts like ``AS64500``, peers and siblings AS texts. ``edges``:
(a, b, rel) as in ``relation_of``; ``sibling_edges``: (a, b). All AS numbers are text, as origins may be sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import relation_of

#: The verdicts, marks of persons and of unknown organisations, and the numbers that count as private in either chain.
HIJACK, LEAK = "possible hijack", "possible leak"
TOO_MANY, INVALID, AS_SET, PRIVATE = "moas num more than 2", "invalid asn", "as_set", "private as"
NO_ORG, PERSONAL, UNKNOWN_ORG, SAME_ORG = "personal network or unknown org", "personal network", "unknown org", "org equal"
PERSON, UNKNOWN, UNKNOWN_NAME = "个人", "未知", "未知组织"
CONFLICT_PRIVATE = ((64512, 65535), (4200000000, 4294967294))
LEAK_PRIVATE = ((64511, 65535), (4294967296, None))
INFO = ("org", "org_en", "shield", "imports", "exports", "peers", "siblings")


def _private(asn: Column, ranges: tuple) -> Column:
    number = asn.try_cast("bigint")
    inside = F.lit(False)
    for low, high in ranges:
        inside = inside | ((number >= low) if high is None else number.between(low, high))
    return F.coalesce(inside, F.lit(False))


def _of(as_info: DataFrame, side: str) -> DataFrame:
    return as_info.select(F.col("asn").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in INFO])


def _policy(a: str, b: str) -> Column:
    """The first of both sides' import and export lists that names the other: ``<owner> import filter <other>``."""
    rules = []
    for own, other in ((a, b), (b, a)):
        for kind in ("import", "export"):
            listed = F.coalesce(F.array_contains(f"{own}_{kind}s", F.concat(F.lit("AS"), F.col(other))), F.lit(False))
            rules.append(F.when(listed, F.concat(F.col(own), F.lit(f" {kind} filter "), F.col(other))))
    return F.coalesce(*rules)


def conflict_candidates(conflicts: DataFrame) -> DataFrame:
    """``conflicts`` (prefix, origins array<string>, first_origin) with ``reason`` where the origins alone clear it, and else ``owner`` and ``suspect``. Origins are looked at in order; the owner is the first origin the prefix had."""
    text = lambda x: F.coalesce(F.btrim(x), F.lit(""))

    def one(x: Column) -> Column:
        valid = text(x).rlike("^[0-9]+$") | F.contains(text(x), F.lit("{")) | F.contains(text(x), F.lit("_"))
        return F.when((text(x) == "") | ~valid, INVALID).when(F.contains(text(x), F.lit("{")), AS_SET).when(_private(text(x), CONFLICT_PRIVATE), PRIVATE)

    listed = conflicts.withColumn("__o", F.sort_array(F.array_distinct("origins")))
    alone = F.get(F.filter(F.transform("__o", one), lambda r: r.isNotNull()), 0)
    reason = F.when(F.size("__o") > 2, TOO_MANY).otherwise(alone)
    first = F.get("__o", 0).eqNullSafe(F.col("first_origin"))
    names = {"owner": F.when(first, F.get("__o", 0)).otherwise(F.get("__o", 1)), "suspect": F.when(first, F.get("__o", 1)).otherwise(F.get("__o", 0))}
    return listed.withColumns({"reason": reason} | {k: F.when(reason.isNull(), v) for k, v in names.items()}).drop("__o")


def judge_conflicts(conflicts: DataFrame, as_info: DataFrame, edges: DataFrame, sibling_edges: DataFrame, registered: DataFrame, history: DataFrame) -> DataFrame:
    """(prefix, owner, suspect, verdict) of each conflict: ``possible hijack`` or the first rule that clears it.

    The suspect is held against the owner and then, in order, against every origin registered for the prefix (``registered``: prefix, asn): import and export lists, provider, peer and sibling relations, one English organisation name,
    prefixes that both announced before (``history``: prefix, asn), protection providers, and their own peer and sibling lists. Each different pair of ASes is looked up once; a prefix of many registered origins is one row for each.
    """
    judged = conflict_candidates(conflicts).withColumn("id", F.struct("prefix", "owner", "suspect"))
    open_ = judged.filter("reason IS NULL").select("prefix", "owner", "suspect").distinct()
    others = registered.groupBy("prefix").agg(F.sort_array(F.collect_set("asn")).alias("more"))
    held = F.array_distinct(F.concat(F.array("owner"), F.coalesce("more", F.array().cast("array<string>"))))
    pairs = open_.join(others, "prefix", "left").select("prefix", "owner", "suspect", F.posexplode(held).alias("place", "h"))
    different = pairs.select(F.col("h").alias("a"), F.col("suspect").alias("b")).distinct()
    relation = relation_of(different, edges).select(F.col("a").alias("h"), F.col("b").alias("suspect"), "relation")
    sib = sibling_edges.select(F.col("a").alias("h"), F.col("b").alias("suspect")).union(sibling_edges.select("b", "a")).distinct().withColumn("sibling", F.lit(True))
    before = history.select("prefix", "asn").distinct()
    rows = pairs.join(relation, ["h", "suspect"], "left").join(sib, ["h", "suspect"], "left").join(_of(as_info, "h"), "h", "left").join(_of(as_info, "suspect"), "suspect", "left")
    for side in ("h", "suspect"):
        rows = rows.join(before.select("prefix", F.col("asn").alias(side), F.lit(True).alias(f"{side}_before")), ["prefix", side], "left")
    owner_org = _of(as_info, "owner").select("owner", "owner_org")
    rows = rows.join(owner_org, "owner", "left")
    unnamed = lambda c: F.coalesce(F.contains(c, F.lit(PERSON)) | F.contains(c, F.lit(UNKNOWN)), F.lit(False))
    lists = lambda kind: F.array_union(*[F.array_except(F.coalesce(f"{s}_{kind}", F.array().cast("array<string>")), F.array(s)) for s in ("suspect", "h")])
    either = lambda kind: F.array_contains(lists(kind), F.col("suspect")) | F.array_contains(lists(kind), F.col("h"))
    rule = F.coalesce(
        F.when(unnamed(F.col("owner_org")) | unnamed(F.col("suspect_org")), NO_ORG), _policy("h", "suspect"), F.when(F.col("relation").isin("provider_customer", "customer_provider"), "as rel provider-customer"),
        F.when(F.col("relation") == "peer", "as rel peer"), F.when(F.col("sibling") | (F.col("h_org_en") == F.col("suspect_org_en")), "as rel same org"), F.when(F.col("h_before") & F.col("suspect_before"), F.concat("prefix", F.lit("both in moasset"))),
        F.when(F.col("suspect_shield"), F.concat("suspect", F.lit(" is AntiDDoS provider"))), F.when(F.col("h_shield"), F.concat("h", F.lit(" is AntiDDoS provider"))), F.when(either("peers"), "peer"), F.when(either("siblings"), "siblings"),
    )
    found = rows.withColumn("rule", rule).groupBy("prefix", "owner", "suspect").agg(F.min(F.when(F.col("rule").isNotNull(), F.struct("place", "rule"))).alias("x"))
    told = found.select("prefix", "owner", "suspect", F.coalesce("x.rule", F.lit(HIJACK)).alias("verdict"))
    cleared = judged.filter("reason IS NOT NULL").select("prefix", "owner", "suspect", F.col("reason").alias("verdict"))
    return cleared.union(told)


def judge_leaks(leaks: DataFrame, as_info: DataFrame) -> DataFrame:
    """``leaks`` (leak_by, leak_to, and any others) with ``verdict``: ``possible leak`` or the first rule that clears it. Two ASes without an organisation have the same."""
    rows = leaks.join(_of(as_info, "leak_by"), "leak_by", "left").join(_of(as_info, "leak_to"), "leak_to", "left")
    org = lambda s: F.coalesce(f"{s}_org", F.lit(""))
    by, to = org("leak_by"), org("leak_to")
    verdict = F.coalesce(
        F.when(F.col("leak_by") == F.col("leak_to"), "by equal to"), F.when(F.contains(to, F.lit(PERSON)) | F.contains(by, F.lit(PERSON)), PERSONAL), F.when((by == UNKNOWN_NAME) | (to == UNKNOWN_NAME), UNKNOWN_ORG), F.when(by == to, SAME_ORG),
        F.when(F.contains("leak_to", F.lit("{")) | F.contains("leak_by", F.lit("{")), "as set"), F.when(_private(F.col("leak_to"), LEAK_PRIVATE) | _private(F.col("leak_by"), LEAK_PRIVATE), PRIVATE), _policy("leak_by", "leak_to"), F.lit(LEAK),
    )
    return rows.select(*leaks.columns, verdict.alias("verdict"))
