"""What is read off an outage's population: AS records of an episode, country summaries of every slot, AS lists with filters and pages, key facts, and probes of dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .concurrency import WORD, runs_until
from .coverage import AS_AFFECTED, AS_INTERRUPTED, COMPLETE, asn_classes
from .intervals import runs_of

#: Names of AS states in lists, and most rows of a page.
LISTED = {"normal": "fully_visible", AS_AFFECTED: "partially_visible", AS_INTERRUPTED: "fully_invisible"}
PAGE = 60


def episode_as_records(classed: DataFrame, origins: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row for each episode and AS of its population: prefixes lost at its onset, at its peak, at its end and ever in it, whether the AS is a member of each, the first and last slot with a loss, and the slot from which
    it had none to the end (NULL if it lost none, or still does).

    ``classed``: of ``coverage.prefix_classes``; ``origins``: (event, prefix, asn); ``episodes``: (episode, event, onset, peak, last), slots. A prefix is lost while no direction shows it. Losses are runs of slots; runs and
    episodes meet by words of slots, and a prefix that is lost several times is one row of an AS before prefixes are counted, so no slot is listed.
    """
    ends = classed.groupBy("event").agg(F.max("slot").alias("final")).join(episodes.groupBy("event").agg(F.max("last").alias("until")), "event").select("event", F.greatest("final", "until").alias("last_slot"))
    lost = runs_until(classed.join(ends, "event"), ["event", "prefix"], "last_slot").filter(F.col("class") == COMPLETE).select("event", "prefix", "first", F.col("last").alias("to"))
    words = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / WORD), F.floor(F.col(high) / WORD))).alias("word")
    spans = episodes.select("*", words("onset", "last"))
    met = lost.select("*", words("first", "to")).join(spans, ["event", "word"]).filter((F.col("first") <= F.col("last")) & (F.col("to") >= F.col("onset")))
    holds = lambda slot: F.max((F.col(slot) >= F.col("first")) & (F.col(slot) <= F.col("to")))
    losses = met.groupBy("episode", "event", "prefix").agg(
        holds("onset").alias("trigger"), holds("peak").alias("peak"), holds("last").alias("end"), F.min(F.greatest("first", "onset")).alias("first"), F.max(F.least("to", "last")).alias("to"), F.max("last").alias("until")
    )
    per_as = losses.join(origins, ["event", "prefix"]).groupBy("episode", "event", "asn").agg(
        *[F.count_if(c).alias(f"{c}_prefixes") for c in ("trigger", "peak", "end")], F.count("*").alias("cumulative_prefixes"), F.min("first").alias("first_damaged"), F.max("to").alias("last_damaged"), F.max("until").alias("until")
    )
    members = classed.select("event", "prefix").distinct().join(origins, ["event", "prefix"]).groupBy("event", "asn").agg(F.count("*").alias("fixed_prefixes"))
    every = episodes.select("episode", "event").join(members, "event").join(per_as, ["episode", "event", "asn"], "left").na.fill(0, [*(f"{c}_prefixes" for c in ("trigger", "peak", "end")), "cumulative_prefixes"])
    flags = {f"{c}_member": F.col(f"{c}_prefixes") > 0 for c in ("trigger", "peak", "cumulative", "end")}
    recovered = F.when((F.col("cumulative_prefixes") > 0) & (F.col("end_prefixes") == 0) & (F.col("last_damaged") < F.col("until")), F.col("last_damaged") + 1)
    return every.withColumns(flags | {"recovered_from": recovered}).drop("until")


def country_summaries(states: DataFrame, members: DataFrame, origins: DataFrame, cohorts: DataFrame) -> DataFrame:
    """One row for each country and slot: fixed and visible directions of the population, all directions that are there now, in all and of each family, and ASes of the population that are visible, affected and fully invisible.

    ``states`` as for ``coverage.cohort``, whose first result is ``members``; a country is an ``event``. An AS is affected if it misses a direction, and then still visible unless it misses all. Everything is signed changes by
    slot, summed once over the slots of a country.
    """
    own = Window.partitionBy("event", "asn").orderBy("slot")
    held = members.join(origins, ["event", "prefix"]).withColumn("t", F.when(F.row_number().over(Window.partitionBy("event", "prefix", "asn").orderBy("slot")) == 1, F.col("expected")).otherwise(0))
    sums = held.groupBy("event", "asn", "slot").agg(F.sum("d").alias("d"), F.sum("t").alias("t"))
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    now = sums.withColumns({"v": F.sum("d").over(so_far), "all": F.sum("t").over(so_far)})
    flags = {"visible_asns": F.col("v") > 0, "affected_asns": F.col("v") < F.col("all"), "invisible_asns": F.col("v") == 0}
    turned = now.withColumns({k: v.cast("bigint") for k, v in flags.items()})
    steps = turned.withColumns({f"__{k}": F.col(k) - F.coalesce(F.lag(k).over(own), F.lit(0)) for k in flags})
    ases = steps.groupBy("event", "slot").agg(*[F.sum(f"__{k}").alias(k) for k in flags])
    family = lambda name, value: [F.sum(value).alias(name), *[F.sum(F.when(F.col("afi") == afi, value).otherwise(0)).alias(f"{name}_v{afi}") for afi in (4, 6)]]
    first = F.row_number().over(Window.partitionBy("event", "prefix").orderBy("slot")) == 1
    fixed = members.withColumn("t", F.when(first, F.col("expected")).otherwise(0)).groupBy("event", "slot").agg(*family("baseline", F.col("t")), *family("visible", F.col("d")))
    bounds = cohorts.select("event", "cohort_slot", "last_slot")
    moved = states.join(bounds, "event").filter(F.col("slot") <= F.col("last_slot")).withColumn("slot", F.greatest("slot", "cohort_slot"))
    current = moved.groupBy("event", "slot").agg(*family("current", F.col("d")))
    out, columns = bounds.select("event", F.explode(F.sequence("cohort_slot", "last_slot")).alias("slot")), []
    for part in (fixed, current, ases):
        columns += part.columns[2:]
        out = out.join(part, ["event", "slot"], "left")
    slots = Window.partitionBy("event").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    total = out.select("event", "slot", *[F.coalesce(F.sum(c).over(slots), F.lit(0)).cast("bigint").alias(c) for c in columns])
    return total.withColumn("visible_ratio", F.try_divide(F.col("visible").cast("double"), F.col("baseline").cast("double")))


def asn_overview(classed: DataFrame, origins: DataFrame, cohorts: DataFrame) -> DataFrame:
    """(event, asn, families, baseline, and for each state its slots and its longest run) of every AS of a population: the rows that lists of ASes show."""
    ends = cohorts.select("event", "last_slot")
    runs = runs_until(asn_classes(classed, origins).join(ends, "event"), ["event", "asn"], "last_slot")
    # rows of equal state that follow each other are one run
    merged = runs_of(runs.withColumn("n_slots", F.col("last") - F.col("first") + 1), ["event", "asn"], "first", "class").select("event", "asn", "class", F.col("first").alias("begin"), F.col("last").alias("last_begin"))
    joined = merged.join(runs.select("event", "asn", F.col("first").alias("last_begin"), "last"), ["event", "asn", "last_begin"]).withColumn("n", F.col("last") - F.col("begin") + 1)
    sums = joined.groupBy("event", "asn").agg(*[f(F.when(F.col("class") == c, F.col("n")).otherwise(0)).cast("bigint").alias(f"{kind}_{name}") for c, name in LISTED.items() for kind, f in (("slots", F.sum), ("longest", F.max))])
    held = classed.select("event", "prefix", "afi", "expected").distinct().join(origins, ["event", "prefix"]).groupBy("event", "asn").agg(F.sort_array(F.collect_set("afi")).alias("families"), F.sum("expected").alias("baseline"))
    return held.join(sums, ["event", "asn"])


def filter_ases(rows: DataFrame, query: str = "", family: str = "all", state: str = "all") -> DataFrame:
    """Rows of ``asn_overview`` whose number contains ``query`` (``AS`` in front is dropped), that have the ``family`` (ipv4, ipv6, dual) and were ever in ``state`` (partial, invisible)."""
    text = query.strip().lower().removeprefix("as")
    holds = F.lit(True)
    if text:
        holds = holds & F.contains(F.col("asn").cast("string"), F.lit(text))
    wanted = {"ipv4": (4,), "ipv6": (6,), "dual": (4, 6)}.get(family, ())
    for afi in wanted:
        holds = holds & F.array_contains("families", afi)
    column = {"partial": "slots_partially_visible", "partially_visible": "slots_partially_visible", "invisible": "slots_fully_invisible", "fully_invisible": "slots_fully_invisible"}.get(state)
    return rows.filter(holds & (F.col(column) > 0) if column else holds)


def as_order(sort: str = "invisible") -> list[Column]:
    """How lists are sorted: longest ``invisible`` or ``partial`` run, ``baseline`` size, or ``asn``; equal ones by number."""
    keys = {"partial": ["longest_partially_visible", "slots_partially_visible"], "baseline": ["baseline"], "asn": []}.get(sort, ["longest_fully_invisible", "slots_fully_invisible"])
    return [*(F.desc(k) for k in keys), F.asc("asn")]


def page(rows: DataFrame, order: Sequence[Column], number: int = 1, size: int = PAGE, most: int = PAGE) -> DataFrame:
    """One page of ``rows`` with ``position`` from 1, and on each row ``total``, ``page`` and ``pages``; a number beyond the last page is the last. Only the rows up to the page come together."""
    size = min(most, max(1, size))
    total = rows.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    shown = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    place = (F.row_number().over(Window.orderBy(*order)) + (number - 1) * size).alias("position")  # at most ``most`` rows
    return shown.select("*", place, F.lit(total).cast("bigint").alias("total"), F.lit(number).alias("page"), F.lit(pages).alias("pages"))


def downstream_rows(pairs: DataFrame, affected: int | None = None, scope: str = "all", query: str = "") -> DataFrame:
    """Pairs of ``concurrency.concurrent_losses`` of one affected AS, those with slots in common only when the ``scope`` is ``concurrent``, and whose numbers contain ``query``."""
    holds = F.lit(True) if affected is None else F.col("affected") == affected
    if scope == "concurrent":
        holds = holds & (F.col("slots") > 0)
    if text := query.strip().lower().removeprefix("as"):
        holds = holds & (F.contains(F.col("affected").cast("string"), F.lit(text)) | F.contains(F.col("downstream").cast("string"), F.lit(text)))
    return pairs.filter(holds)


def key_facts(series: DataFrame, counts: Sequence[str] = ()) -> DataFrame:
    """One row for each subject of a series (subject, slot, value, counts): value and slot at the start, at the end and lowest; the largest drop from one observed slot to the next; what was lost from the start to the lowest, won back from there to the end,
    which share of the loss that is, and what the end still lacks; and of each count its peak and where. NULL values are no slots; the first of equal ones counts."""
    seen = series.filter(F.col("value").isNotNull())
    step = F.col("value") - F.lag("value").over(Window.partitionBy("subject").orderBy("slot"))
    drops = seen.withColumn("step", step)
    at = lambda c: F.struct(F.col(c), F.col("slot"))
    peaks = [F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col(c)).alias("less"), "slot"))).alias(f"__{c}") for c in counts]
    facts = drops.groupBy("subject").agg(
        F.min("slot").alias("start_slot"), F.min_by("value", "slot").alias("start_value"), F.max("slot").alias("end_slot"), F.max_by("value", "slot").alias("end_value"), F.min(at("value")).alias("__low"),
        F.min(F.when(F.col("step") < 0, at("step"))).alias("__drop"), *peaks,
    )
    lost, won = F.col("start_value") - F.col("__low.value"), F.col("end_value") - F.col("__low.value")
    return facts.select(
        "subject", "start_slot", "start_value", "end_slot", "end_value", F.col("__low.slot").alias("lowest_slot"), F.col("__low.value").alias("lowest_value"), F.col("__drop.slot").alias("drop_slot"), (-F.col("__drop.step")).alias("largest_drop"),
        lost.alias("lost"), F.try_divide(lost, F.col("start_value")).alias("lost_ratio"), won.alias("recovered"), F.when(lost > 0, won / lost).alias("recovered_share"), (F.col("start_value") - F.col("end_value")).alias("end_gap"),
        *[c for n in counts for c in ((-F.col(f"__{n}.less")).alias(f"{n}_peak"), F.col(f"__{n}.slot").alias(f"{n}_peak_slot"))],
    )


def incident_mappings(incidents: DataFrame, mappings: DataFrame) -> DataFrame:
    """(incident, episodes, relation) of every incident: the episodes that stated evidence (incident, episode, relation, causal) links to it, none of which may claim a cause, with all of their relations; ``no_correspondence`` where there is none. Nothing is guessed."""
    stated = mappings.filter((F.col("relation") != "no_correspondence") & ~F.coalesce("causal", F.lit(True)))
    linked = stated.groupBy("incident").agg(F.sort_array(F.collect_set("episode")).alias("episodes"), F.sort_array(F.collect_set("relation")).alias("relations"))
    out = incidents.select("incident").distinct().join(linked, "incident", "left")
    return out.select("incident", F.coalesce("episodes", F.array().cast(mappings.schema["episode"].dataType.simpleString().join(("array<", ">")))).alias("episodes"), F.coalesce(F.array_join("relations", ","), F.lit("no_correspondence")).alias("relation"))


def probe_table(df: DataFrame, key: Column, valid: Column, lists: Sequence[str] = (), targets: Sequence[str] = ()) -> DataFrame:
    """One row of counts that tell whether a dimension table can be used: rows, different valid keys, rows with an empty or an invalid key, rows that repeat a valid key, cells of ``lists`` (text of a list) that cannot be read, and items of ``targets`` among
    them that are no AS number. Each row is seen once; keys are counted by key, so a key that a third of the rows have is one row of the shuffle's result."""
    from ..functions.scalars import literal_list, normalize_asn

    empty = (key.isNull() | (F.btrim(key.cast("string")) == "")).alias("__empty")
    read = {c: F.when(F.col(c).isNotNull() & (F.btrim(F.col(c)) != ""), literal_list(F.col(c))) for c in lists}
    present = {c: F.col(c).isNotNull() & (F.btrim(F.col(c)) != "") for c in lists}
    unsafe = sum((F.when(present[c] & v.isNull(), 1).otherwise(0) for c, v in read.items()), F.lit(0))
    bad = sum((F.coalesce(F.size(F.filter(read[c], lambda x: normalize_asn(x).isNull())), F.lit(0)) for c in targets), F.lit(0))
    marked = df.select(F.when(~empty & valid, key.cast("string")).alias("__key"), empty, (~empty & ~F.coalesce(valid, F.lit(False))).alias("__invalid"), unsafe.alias("__unsafe"), bad.alias("__bad"))
    usable = ~F.col("__empty") & ~F.col("__invalid")
    by_key = marked.groupBy("__key", "__empty", "__invalid").agg(F.count("*").alias("n"), F.sum(F.when(usable, F.col("__unsafe")).otherwise(0)).alias("unsafe"), F.sum(F.when(usable, F.col("__bad")).otherwise(0)).alias("bad"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return by_key.agg(
        total("n").alias("rows"), F.count_if(F.col("__key").isNotNull()).alias("valid_keys"), total(F.when(F.col("__empty"), F.col("n"))).alias("empty_keys"), total(F.when(F.col("__invalid"), F.col("n"))).alias("invalid_keys"),
        total(F.when(F.col("__key").isNotNull(), F.col("n") - 1)).alias("repeated_keys"), total("unsafe").alias("unsafe_lists"), total("bad").alias("bad_targets"),
    )


def with_coordinates(rows: DataFrame, countries: DataFrame, key: str) -> DataFrame:
    """``rows`` with latitude and longitude of their country (``countries``: key, lat, lon); NULL where the table lacks it."""
    return rows.join(countries.groupBy(key).agg(F.min(F.struct("lat", "lon")).alias("__place")), key, "left").select(*rows.columns, F.col("__place.lat").alias("lat"), F.col("__place.lon").alias("lon"))
