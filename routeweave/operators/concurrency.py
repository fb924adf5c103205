"""Slots as bits: when two populations are hit at the same time, without comparing them slot by slot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .coverage import AS_NORMAL, NORMAL, asn_classes, family_bits, live_coverage
from .tables import stored

#: Slots of one word.
WORD = 32


def slot_words(runs: DataFrame, carry: Sequence[str], first: str = "first", last: str = "last") -> DataFrame:
    """(carry, word, bits): a run of slots as words with one bit for each slot; slots are not listed."""
    rows = runs.select(*carry, first, last, F.explode(F.sequence(F.floor(F.col(first) / WORD), F.floor(F.col(last) / WORD))).alias("word"))
    low, high = F.greatest(F.col(first) - F.col("word") * WORD, F.lit(0)), F.least(F.col(last) - F.col("word") * WORD, F.lit(WORD - 1))
    bits = F.expr(f"shiftleft(1L, cast(least({last} - word * {WORD}, {WORD - 1}) AS int) + 1) - shiftleft(1L, cast(greatest({first} - word * {WORD}, 0) AS int))")
    return rows.filter(high >= low).select(*carry, "word", bits.alias("bits"))


def runs_until(rows: DataFrame, keys: Sequence[str], last_slot: str) -> DataFrame:
    """Each row's state as a run: ``first``, and ``last`` before the next row of its key."""
    after = F.lead("slot").over(Window.partitionBy(*keys).orderBy("slot")) - 1
    return rows.withColumn("first", F.col("slot")).withColumn("last", F.coalesce(after, F.col(last_slot))).filter(F.col("last") >= F.col("first"))


def concurrent_losses(classed: DataFrame, relations: DataFrame, origins: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Each (event, affected, downstream) pair: in how many slots the affected AS is hit and prefixes of the pair are interrupted, the first and
    last of them, and the most prefixes, addresses and /48 blocks of the pair that are interrupted in one; 0 and NULL where there is no such slot.

    ``classed``: of ``prefix_classes``; ``relations``: (event, affected, downstream, prefix); ``origins``: (event, prefix, asn); ``cohorts``: (event, cohort_slot, last_slot). An AS is hit while a
    prefix of its own is interrupted. Its slots are words of bits, met by the words of a pair's runs of equal state by equality and joined with AND. A pair's own
    series changes where one of its prefixes does; an AS is one row for each word, whatever the number of its pairs.
    """
    ends = cohorts.select("event", "last_slot")
    hit = runs_until(asn_classes(classed, origins).join(ends, "event"), ["event", "asn"], "last_slot").filter(F.col("class") != AS_NORMAL)
    active = slot_words(hit, ["event", "asn"]).groupBy("event", F.col("asn").alias("affected"), "word").agg(F.bit_or("bits").alias("active"))
    own = Window.partitionBy("event", "prefix").orderBy("slot")
    turns = classed.withColumn("lost", (F.col("class") != NORMAL).cast("bigint")).withColumn("d", F.col("lost") - F.coalesce(F.lag("lost").over(own), F.lit(0))).filter("d <> 0")
    pair = ["event", "affected", "downstream"]
    relations = stored(relations.select(*pair, "prefix").distinct())
    changes = stored(turns.select("event", "prefix", "afi", "network", "length", "slot", "d").join(relations, ["event", "prefix"]))
    counts = changes.groupBy(*pair, "slot").agg(F.sum("d").alias("prefixes"))
    live = live_coverage(changes, [*pair, "afi"], family_bits(F.col("afi")))
    step = F.col("covered") - F.coalesce(F.lag("covered").over(Window.partitionBy(*pair, "afi").orderBy("slot")), F.lit(0))
    covered = live.withColumn("step", step).groupBy(*pair, "slot").agg(*[F.sum(F.when(F.col("afi") == afi, F.col("step")).otherwise(0)).alias(name) for afi, name in ((4, "addresses"), (6, "blocks_48"))])
    so_far = Window.partitionBy(*pair).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    values = ["prefixes", "addresses", "blocks_48"]
    series = counts.join(covered, [*pair, "slot"], "left").na.fill(0, values).withColumns({c: F.sum(c).over(so_far) for c in values})
    runs = runs_until(series.join(ends, "event"), pair, "last_slot").filter("prefixes > 0")
    met = slot_words(runs, [*pair, *values]).join(active, ["event", "affected", "word"]).withColumn("both", F.col("bits").bitwiseAND(F.col("active"))).filter("both <> 0")
    found = met.groupBy(*pair).agg(
        F.sum(F.bit_count("both")).alias("slots"), F.min(F.expr(f"word * {WORD} + bit_count((both & -both) - 1)")).alias("first_slot"), F.max(F.expr(f"word * {WORD} + length(bin(both)) - 1")).alias("last_slot"),
        *[F.max(c).alias(f"peak_{c}") for c in values],
    )
    named = relations.groupBy(*pair).agg(F.count("*").alias("pair_prefixes"))
    return named.join(found, pair, "left").na.fill(0, ["slots", *(f"peak_{c}" for c in values)])


def affected_ases(classed: DataFrame, origins: DataFrame) -> DataFrame:
    """(event, asn, event_class, peak_partial, peak_complete, peak_invisible) of every AS that was ever hit: its worst class, and the peaks of its counts."""
    peaks = asn_classes(classed, origins).groupBy("event", "asn").agg(
        F.max((F.col("complete") == F.col("normal") + F.col("partial") + F.col("complete")).cast("int")).alias("cut"), F.max((F.col("class") != AS_NORMAL).cast("int")).alias("hit"),
        F.max("partial").alias("peak_partial"), F.max("complete").alias("peak_complete"), F.max("invisible").alias("peak_invisible"),
    )
    return peaks.filter("hit = 1").select("event", "asn", F.when(F.col("cut") == 1, "route_interrupted").otherwise("affected").alias("event_class"), "peak_partial", "peak_complete", "peak_invisible")
