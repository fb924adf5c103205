"""Address coverage and outage populations kept up to date slot by slot, as signed changes that are summed, never as sets that are carried along.

A slot's state is the state at its end. Networks are whole numbers of ``bits`` bits (32 for IPv4 addresses, 48 for IPv6 /48 blocks).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

#: Classes of a prefix by its visible directions, and of an AS by its prefixes.
NORMAL, PARTIAL, COMPLETE = "normal", "partially_interrupted", "completely_interrupted"
AS_NORMAL, AS_AFFECTED, AS_INTERRUPTED = "normal", "affected", "route_interrupted"


def family_bits(afi: Column) -> Column:
    """Bits of a network number: addresses for IPv4, /48 blocks for IPv6."""
    return F.when(afi == 6, 48).otherwise(32)


def _running(keys: Sequence[str], order: str = "slot"):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def live_coverage(changes: DataFrame, keys: Sequence[str], bits: Column | int = 32) -> DataFrame:
    """(keys, slot, covered) at each slot in which the addresses covered by a set of prefixes change.

    ``changes``: (keys, network, length, slot, d), d memberships more (or less, if negative) of a prefix. Dyadic blocks are worked
    off from the longest length to the shortest that occur: a block with members of its own covers all of itself, one without what its
    blocks below cover, and only changes of that number go up. So a withdrawal uncovers exactly what no other prefix holds, and nothing
    is merged anew for a slot. Each change meets at most one block of each length; changes of a block are summed by slot before its
    window, so a window has at most one row for each slot. Members below zero count as none. Lengths beyond ``bits`` are blocks of one.
    """
    bits = bits if isinstance(bits, Column) else F.lit(bits)
    size = F.pow(F.lit(2.0), bits - F.col("length")).cast("bigint")
    rows = changes.withColumn("length", F.least(F.col("length"), bits)).withColumn("node", F.col("network") - F.pmod(F.col("network"), size))
    steps = stored(rows.groupBy(*keys, "length", "node", "slot").agg(F.sum("d").alias("d")).filter("d <> 0"), ["length"])
    above = None
    for length in sorted((r["length"] for r in steps.select("length").distinct().collect()), reverse=True):  # at most one more than the bits
        own = steps.filter(F.col("length") == length).select(*keys, "node", "slot", "d", F.lit(0).cast("bigint").alias("c"))
        block = F.pow(F.lit(2.0), bits - F.lit(length)).cast("bigint")
        if above is not None:
            own = own.unionByName(above.select(*keys, (F.col("node") - F.pmod(F.col("node"), block)).alias("node"), "slot", F.lit(0).cast("bigint").alias("d"), "c"))
        sums = own.groupBy(*keys, "node", "slot").agg(F.sum("d").alias("d"), F.sum("c").alias("c"))
        here = _running([*keys, "node"])
        now = F.when(F.sum("d").over(here) > 0, block).otherwise(F.sum("c").over(here))
        held = sums.withColumn("now", now)
        before = F.coalesce(F.lag("now").over(Window.partitionBy(*keys, "node").orderBy("slot")), F.lit(0))
        above = held.select(*keys, "node", "slot", (F.col("now") - before).alias("c")).filter("c <> 0")
    if above is None:
        return steps.select(*keys, "slot", F.col("d").alias("covered"))
    total = above.groupBy(*keys, "slot").agg(F.sum("c").alias("c")).filter("c <> 0")
    return total.select(*keys, "slot", F.sum("c").over(_running(keys)).alias("covered"))


def slot_ends(events: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str] = (), action: str = "action") -> DataFrame:
    """(keys, carry, slot, up, d): whether a route is there at the end of each slot in which it has events, and by how much that differs from before."""
    last = events.groupBy(*keys, *carry, "slot").agg(F.max_by(F.when(F.col(action) != "withdraw", 1).otherwise(0), F.struct(*order)).alias("up"))
    before = F.coalesce(F.lag("up").over(Window.partitionBy(*keys).orderBy("slot")), F.lit(0))
    return last.withColumn("d", F.col("up") - before)


def cohort(states: DataFrame, cohorts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A fixed population and what comes beside it. ``states``: (event, prefix, afi, network, length, direction, slot, up, d);
    ``cohorts``: (event, cohort_slot, last_slot).

    First (event, prefix, afi, network, length, expected, slot, d): the prefixes that some direction shows at the cohort slot, and the changes of those
    directions from then on, the first row being the population itself. Second, the changes (event, prefix, afi, network, length, slot, d) of all
    other prefixes after that slot.
    """
    rows = states.join(cohorts, "event").filter(F.col("slot") <= F.col("last_slot"))
    at_start = F.sum(F.when(F.col("slot") <= F.col("cohort_slot"), F.col("d")).otherwise(0)).over(Window.partitionBy("event", "prefix", "direction"))
    named = rows.withColumn("member", at_start > 0)
    expected = F.sum(F.when(F.col("member") & (F.col("slot") <= F.col("cohort_slot")), F.col("d")).otherwise(0)).over(Window.partitionBy("event", "prefix"))
    named = named.withColumn("expected", expected)
    names = ["event", "prefix", "afi", "network", "length"]
    members = named.filter("member").withColumn("slot", F.greatest("slot", "cohort_slot")).groupBy(*names, "expected", "slot").agg(F.sum("d").alias("d"))
    others = named.filter("expected = 0 AND slot > cohort_slot").groupBy(*names, "slot").agg(F.sum("d").alias("d"))
    return members, others


def prefix_classes(members: DataFrame) -> DataFrame:
    """``members`` with ``visible`` directions and ``class`` after each change."""
    visible = F.sum("d").over(_running(["event", "prefix"]))
    return members.withColumn("visible", visible).withColumn("class", F.when(F.col("visible") == F.col("expected"), NORMAL).when(F.col("visible") > 0, PARTIAL).otherwise(COMPLETE))


def asn_classes(classed: DataFrame, origins: DataFrame) -> DataFrame:
    """(event, asn, slot, normal, partial, complete, invisible, class) after each slot with a change: prefixes of each class, and directions that
    miss one. ``classed``: of ``prefix_classes``; ``origins``: (event, prefix, asn), each once; a prefix of several ASes counts for each."""
    own = Window.partitionBy("event", "prefix").orderBy("slot")
    turns = []
    for name, kind in (("normal", NORMAL), ("partial", PARTIAL), ("complete", COMPLETE)):
        here = F.when(F.col("class") == kind, 1).otherwise(0)
        turns.append(F.sum(here - F.coalesce(F.col(f"was_{name}"), F.lit(0))).alias(name))
    lost = F.col("expected") - F.col("visible")
    rows = classed.withColumns({f"was_{n}": F.lag(F.when(F.col("class") == k, 1).otherwise(0)).over(own) for n, k in (("normal", NORMAL), ("partial", PARTIAL), ("complete", COMPLETE))} | {"was_lost": F.lag(lost).over(own)})
    sums = rows.join(origins, ["event", "prefix"]).groupBy("event", "asn", "slot").agg(*turns, F.sum(lost - F.coalesce("was_lost", F.lit(0))).alias("invisible"))
    held = sums.withColumns({c: F.sum(c).over(_running(["event", "asn"])) for c in ("normal", "partial", "complete", "invisible")})
    total = F.col("normal") + F.col("partial") + F.col("complete")
    return held.withColumn("class", F.when(F.col("complete") == total, AS_INTERRUPTED).when(F.col("partial") + F.col("complete") > 0, AS_AFFECTED).otherwise(AS_NORMAL))


def _presence(changes: DataFrame) -> DataFrame:
    """(event, prefix, afi, network, length, slot, d): +1 where the first direction shows a prefix, -1 where the last loses it."""
    held = changes.withColumn("up", (F.sum("d").over(_running(["event", "prefix"])) > 0).cast("int"))
    before = F.coalesce(F.lag("up").over(Window.partitionBy("event", "prefix").orderBy("slot")), F.lit(0))
    return held.withColumn("d", F.col("up") - before).filter("d <> 0").select("event", "prefix", "afi", "network", "length", "slot", "d")


def event_series(states: DataFrame, cohorts: DataFrame, origins: DataFrame) -> DataFrame:
    """One row for each event and slot from its cohort slot to its last: prefixes, directions and ASes of the fixed population by class, the
    addresses and /48 blocks that it still covers, and of prefixes first seen later how many are visible now, how many ever were, and what they cover.

    ``states`` and ``cohorts`` as in ``cohort``, ``origins`` as in ``asn_classes``. First sightings are summed, so no set of prefixes is held from slot to slot. A prefix is one key
    whatever its announcements; the only windows over an event have one row for each slot.
    """
    members, others = (stored(x) for x in cohort(states, cohorts))
    classed = stored(prefix_classes(members))
    own = Window.partitionBy("event", "prefix").orderBy("slot")
    counted = {"normal": F.col("class") == NORMAL, "partial": F.col("class") == PARTIAL, "complete": F.col("class") == COMPLETE}

    def turned(rows: DataFrame, now: dict[str, Column], keys: Window, subject: str) -> DataFrame:
        flags = rows.withColumns({f"__{k}": v.cast("bigint") for k, v in now.items()})
        steps = {f"__d_{k}": F.col(f"__{k}") - F.coalesce(F.lag(f"__{k}").over(keys), F.lit(0)) for k in now}
        return flags.withColumns(steps).groupBy("event", "slot").agg(*[F.sum(f"__d_{k}").alias(f"{subject}_{k}") for k in now])

    prefixes = turned(classed, counted | {"visible_directions": F.col("visible"), "expected_directions": F.col("expected")}, own, "prefix")
    ases = asn_classes(classed, origins)
    by_asn = {"normal": F.col("class") == AS_NORMAL, "affected": F.col("class") == AS_AFFECTED, "interrupted": F.col("class") == AS_INTERRUPTED}
    asns = turned(ases, by_asn, Window.partitionBy("event", "asn").orderBy("slot"), "asn")
    new = stored(_presence(others))
    sightings = new.groupBy("event", "prefix", "afi", "network", "length").agg(F.min("slot").alias("slot")).withColumn("d", F.lit(1).cast("bigint"))

    def counts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("event", "slot").agg(*[F.sum(F.when(F.col("afi") == afi, F.col("d")).otherwise(0)).alias(f"{name}_v{afi}_prefixes") for afi in (4, 6)])

    def coverage(rows: DataFrame, name: str) -> DataFrame:
        live = live_coverage(rows, ["event", "afi"], family_bits(F.col("afi")))
        before = F.coalesce(F.lag("covered").over(Window.partitionBy("event", "afi").orderBy("slot")), F.lit(0))
        steps = live.withColumn("d", F.col("covered") - before)
        kinds = ((4, "addresses"), (6, "blocks_48"))
        return steps.groupBy("event", "slot").agg(*[F.sum(F.when(F.col("afi") == afi, F.col("d")).otherwise(0)).alias(f"{name}_{what}") for afi, what in kinds])

    parts = [prefixes, asns, counts(new, "new"), counts(sightings, "ever"), coverage(_presence(members), "fixed"), coverage(new, "new"), coverage(sightings, "ever")]
    out = cohorts.select("event", F.explode(F.sequence("cohort_slot", "last_slot")).alias("slot"))
    columns: list[str] = []
    for part in parts:
        columns += part.columns[2:]
        out = out.join(part, ["event", "slot"], "left")
    return out.select("event", "slot", *[F.coalesce(F.sum(c).over(_running(["event"])), F.lit(0)).cast("bigint").alias(c) for c in columns])
