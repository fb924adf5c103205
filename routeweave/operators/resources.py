"""Feature rows: what each AS, each country and the collector announce, withdraw and reach at the end of each slot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefixes import skip_reason
from .coverage import live_coverage
from .tables import stored

#: Network bits of the blocks that are counted: /24 and /48.
BLOCK_BITS = {4: 24, 6: 48}


def _levels(asn: Column, country: Column) -> Column:
    row = lambda level, subject: F.struct(F.lit(level).alias("level"), subject.cast("string").alias("subject"))
    return F.explode(F.array(row("asn", asn), row("country", F.coalesce(country, F.lit("unknown"))), row("collector", F.lit("all")))).alias("x")


def feature_rows(events: DataFrame, countries: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(level, subject, slot, announces, withdraws, blocks_24, addresses, blocks_48) of each AS, country and collector in each slot in which it has updates.

    ``events``: (keys, prefix, afi, network, length, slot, action, origin, order); networks are 32-bit numbers for IPv4 and /48 numbers for IPv6. ``countries``: (asn, country). A withdrawal belongs to the last origin that its route had. Blocks are those that the
    prefixes reach that have a route with that origin at the slot's end, counted once at each level whatever overlaps; addresses are the /24 blocks times 256. Prefixes that are too short or excluded do not count.

    Origins of routes change by +1 and -1, blocks are kept by ``live_coverage``, so no set of prefixes is built for a slot; a level's series has one row for each slot.
    """
    route = Window.partitionBy(*keys).orderBy(*order)
    owned = events.withColumn("asn", F.coalesce("origin", F.last("origin", ignorenulls=True).over(route.rowsBetween(Window.unboundedPreceding, 0)))).join(countries, "asn", "left")
    updates = owned.filter("asn IS NOT NULL").select(_levels(F.col("asn"), F.col("country")), "slot", "action").select("x.*", "slot", "action")
    counts = updates.groupBy("level", "subject", "slot").agg(F.count_if(F.col("action") == "announce").alias("announces"), F.count_if(F.col("action") == "withdraw").alias("withdraws"))
    usable = events.filter(skip_reason(F.col("prefix"), F.col("afi"), F.col("length")).isNull())
    ends = usable.groupBy(*keys, "afi", "network", "length", "slot").agg(F.max_by(F.when(F.col("action") != "withdraw", F.col("origin")), F.struct(*order)).alias("now"))
    ends = ends.withColumn("was", F.lag("now").over(Window.partitionBy(*keys).orderBy("slot"))).filter(~F.col("was").eqNullSafe(F.col("now")))
    sides = F.explode(F.filter(F.array(F.struct(F.col("was").alias("asn"), F.lit(-1).alias("d")), F.struct(F.col("now").alias("asn"), F.lit(1).alias("d"))), lambda s: s["asn"].isNotNull())).alias("s")
    moves = ends.select("afi", "network", "length", "slot", sides).select("afi", "network", "length", "slot", "s.*").groupBy("asn", "afi", "network", "length", "slot").agg(F.sum("d").alias("d")).filter("d <> 0")
    moves = moves.join(countries, "asn", "left").select(_levels(F.col("asn"), F.col("country")), "afi", "network", "length", "slot", "d").select("x.*", "afi", F.when(F.col("afi") == 4, F.shiftright("network", 8)).otherwise(F.col("network")).alias("network"), "length", "slot", "d")
    live = live_coverage(moves, ["level", "subject", "afi"], F.when(F.col("afi") == 6, BLOCK_BITS[6]).otherwise(BLOCK_BITS[4]))
    step = F.col("covered") - F.coalesce(F.lag("covered").over(Window.partitionBy("level", "subject", "afi").orderBy("slot")), F.lit(0))
    steps = live.withColumn("step", step).groupBy("level", "subject", "slot").agg(*[F.sum(F.when(F.col("afi") == afi, F.col("step")).otherwise(0)).alias(name) for afi, name in ((4, "blocks_24"), (6, "blocks_48"))])
    so_far = Window.partitionBy("level", "subject").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    both = counts.join(stored(steps), ["level", "subject", "slot"], "full").na.fill(0, ["blocks_24", "blocks_48"]).withColumns({c: F.sum(c).over(so_far) for c in ("blocks_24", "blocks_48")})
    return both.filter("announces IS NOT NULL").select("level", "subject", "slot", "announces", "withdraws", "blocks_24", (F.col("blocks_24") * 256).alias("addresses"), "blocks_48")
