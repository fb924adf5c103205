"""Column functions on AS paths, AS numbers, times, locators and event attributes. All are built from Spark SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT_SECONDS = 300
BUSINESS_OFFSET_SECONDS = 28_800

# Private AS number ranges.
PRIVATE_16 = (64512, 65535)
PRIVATE_32 = (4200000000, 4294967294)


def slot_of(epoch_s: Column, seconds: int = SLOT_SECONDS) -> Column:
    """Start of the half-open slot that holds a time in seconds."""
    return epoch_s - F.pmod(epoch_s, F.lit(seconds))


def slot_before(epoch_s: Column, seconds: int = SLOT_SECONDS) -> Column:
    """Last slot that starts strictly before a time."""
    return F.floor((epoch_s - 1) / seconds).cast("bigint") * seconds


def slot_at_or_after(epoch_s: Column, seconds: int = SLOT_SECONDS) -> Column:
    return F.ceil(epoch_s / seconds).cast("bigint") * seconds


def business_to_utc(local: Column) -> Column:
    """UTC+8 wall time to UTC."""
    return local - F.make_interval(secs=F.lit(BUSINESS_OFFSET_SECONDS))


def hops(as_path: Column) -> Column:
    return F.filter(F.split(as_path, " "), lambda h: h != "")


def is_private_asn(asn: Column, sets_are_private: bool = False) -> Column:
    """True for a number in a private range, or of the form ``public_private``. An AS set (``{``) is private only in one variant."""
    number = asn.try_cast("bigint")
    private = number.between(*PRIVATE_16) | number.between(*PRIVATE_32)
    marked = F.contains(asn, F.lit("_")) | (F.contains(asn, F.lit("{")) if sets_are_private else F.lit(False))
    return F.coalesce(private, F.lit(False)) | marked


def origin_asn(as_path: Column) -> Column:
    """The last hop that is not private, or the last hop where all are."""
    path = hops(as_path)
    return F.coalesce(F.try_element_at(F.filter(path, lambda h: ~is_private_asn(h)), F.lit(-1)), F.try_element_at(path, F.lit(-1)))


def origin_public(as_path: Column) -> Column:
    """The last hop outside the 16-bit private range; NULL for a path with an AS set or only private hops."""
    public = F.filter(hops(as_path), lambda h: ~F.coalesce(h.try_cast("bigint").between(*PRIVATE_16), F.lit(False)))
    return F.when(~F.contains(as_path, F.lit("{")), F.try_element_at(public, F.lit(-1)))


def origin_of_segments(segments: Column) -> Column:
    """struct(state, origins, reason) of ``array<struct<segment_type, asns>>``: a final sequence is resolved, a final set of
    several is a conflict, a confederation or no path unknown."""
    last = F.try_element_at(segments, F.lit(-1))
    asns = F.array_sort(F.array_distinct(last["asns"]))
    kind = last["segment_type"]

    def state(name: str, origins: Column, reason: str | None) -> Column:
        return F.struct(F.lit(name).alias("state"), origins.alias("origins"), F.lit(reason).cast("string").alias("reason"))

    none = F.array().cast("array<bigint>")
    return (
        F.when(segments.isNull() | (F.size(segments) == 0) | (F.size(last["asns"]) == 0), state("unknown", none, "empty_path"))
        .when(kind == "as_sequence", state("resolved", F.array(F.try_element_at(last["asns"], F.lit(-1))).cast("array<bigint>"), None))
        .when((kind == "as_set") & (F.size(asns) == 1), state("resolved", asns, None))
        .when(kind == "as_set", state("conflict", asns, "terminal_as_set"))
        .otherwise(state("unknown", none, "confederation"))
    )


def path_length(segments: Column) -> Column:
    """Hops of typed segments: a set counts one, confederations none."""
    return F.aggregate(
        segments, F.lit(0), lambda n, s: n + F.when(s["segment_type"] == "as_sequence", F.size(s["asns"])).when(s["segment_type"] == "as_set", 1).otherwise(0)
    )


def path_text(segments: Column) -> Column:
    one = lambda s: F.when(s["segment_type"] == "as_set", F.concat(F.lit("{"), F.array_join(s["asns"].cast("array<string>"), ","), F.lit("}"))).otherwise(F.array_join(s["asns"].cast("array<string>"), " "))
    return F.array_join(F.transform(segments, one), " ")


def collapse_prepends(path: Column) -> Column:
    """Drop hops that repeat the hop before them."""
    return F.filter(path, lambda h, i: (i == 0) | (h != F.get(path, i - 1)))


def duration_text(seconds: Column) -> Column:
    """``d days h hours m minutes s seconds``, without leading zero parts."""
    d, h, m, s = (F.floor(seconds / 86400), F.floor(seconds % 86400 / 3600), F.floor(seconds % 3600 / 60), seconds % 60)
    part = lambda n, name, show: F.when(show, F.concat(n.cast("bigint").cast("string"), F.lit(f" {name}")))
    return F.concat_ws(" ", part(d, "days", d > 0), part(h, "hours", seconds >= 3600), part(m, "minutes", seconds >= 60), part(s, "seconds", F.lit(True)))


def duration_seconds(text: Column) -> Column:
    """Seconds of ``N days HH:MM:SS`` (days optional); NULL where it does not fit."""
    pattern = r"^(?:(\d+) days? ?)?(\d+):(\d{2}):(\d{2})$"
    group = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("bigint")
    return F.when(text.rlike(pattern), F.coalesce(group(1), F.lit(0)) * 86400 + group(2) * 3600 + group(3) * 60 + group(4))


def normalize_asn(text: Column) -> Column:
    """Number of ``AS123``, ``as 123`` or ``123``; NULL out of the 32-bit range."""
    n = F.nullif(F.regexp_extract(F.trim(text), r"^(?:[Aa][Ss])?\s*(\d{1,10})$", 1), F.lit("")).cast("bigint")
    return F.when(n.between(0, 4294967295), n)


def normalize_country(text: Column) -> Column:
    code = F.upper(F.trim(text))
    return F.when(code.rlike("^[A-Z]{2}$"), code)


def risk_level(text: Column) -> Column:
    """high, middle or low of several spellings."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("high", "h", "3"), "high").when(t.isin("middle", "medium", "m", "2"), "middle").when(t.isin("low", "l", "1"), "low")


def parse_locator(url: Column) -> Column:
    """struct(event_type, time, problem, event_id, source, error) of a five-part locator."""
    parts = F.split(url, "/")
    error = (
        F.when(url.isNull() | (url == ""), "empty")
        .when(F.size(parts) != 5, "part_count")
        .when(F.exists(parts, lambda p: p == ""), "empty_part")
        .when(~F.get(parts, 1).rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), "time")
        .when(~F.get(parts, 3).rlike(r"^\d+$"), "event_id")
    )
    part = lambda k: F.when(error.isNull(), F.get(parts, k))
    return F.struct(part(0).alias("event_type"), part(1).alias("time"), part(2).alias("problem"), part(3).cast("bigint").alias("event_id"), part(4).alias("source"), error.alias("error"))


def literal_list(text: Column) -> Column:
    """Items of ``['a', "b", 3]``-like text; NULL where it is no list."""
    body = F.regexp_extract(F.trim(text), r"^[\[({](.*)[\])}]$", 1)
    items = F.transform(F.split(body, ","), lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", ""))
    return F.when(F.trim(text).rlike(r"^[\[({].*[\])}]$"), F.filter(items, lambda x: x != ""))


def embedded_times(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})"), 1)


def asn_tokens(text: Column) -> Column:
    """Different AS numbers named in a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?<![0-9A-Za-z])(?:[Aa][Ss])?(\d{1,10})(?![0-9A-Za-z])"), 1), lambda x: x.cast("bigint")))


def mentions_asn(text: Column, asn: int) -> Column:
    """Does a text name the number on digit boundaries (3356 is not in 53356)?"""
    return text.rlike(rf"(^|[^0-9])(?:AS)?{asn}([^0-9]|$)")


def change_rate(current: Column, previous: Column) -> Column:
    """Percent change; NULL where the previous value is zero or missing."""
    return F.when(previous != 0, (current - previous) / previous * 100)


def volatility(values_stddev: Column, values_mean: Column) -> Column:
    return F.when(values_mean != 0, values_stddev / values_mean * 100)


def stable_id(prefix: str, *columns: str, length: int = 24) -> Column:
    """``prefix`` and the first hex digits of the SHA-256 of the canonical JSON of ``columns`` in name order."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), 1, length))


def hijack_severity(sites: Column, servers: Column, important: Column) -> Column:
    """high above 30 sites, 15 authoritative servers or for important names; middle with any site or server."""
    return F.when((sites > 30) | (servers > 15) | important, "high").when((sites > 0) | (servers > 0), "middle").otherwise("low")


def as_outage_level(important: Column, total: Column, peak_ratio: Column) -> Column:
    """high for an important AS with over 10 prefixes; middle for over 500 prefixes of which over 0.3 were down at the peak."""
    return F.when(important & (total > 10), "high").when((total > 500) & (peak_ratio > 0.3), "middle").otherwise("low")


def country_outage_level(total: Column, down: Column) -> Column:
    """high from 0.075 of at least 100 ASes, five or more; middle from 0.05 and below 0.075; all else is low."""
    ratio = down / total
    return F.when((ratio >= 0.075) & (total >= 100) & (down >= 5), "high").when((ratio >= 0.05) & (ratio < 0.075), "middle").otherwise("low")


def phase_status(paths: Column, applicable: Column, retained: Column, collision: Column) -> Column:
    """State of the evidence of one phase of an event."""
    return (
        F.when(~applicable, "not_applicable").when(collision, "collision").when(~retained, "not_retained").when(F.coalesce(F.size(paths), F.lit(0)) == 0, "observed_no_path").otherwise("observed_paths")
    )


def query_kind(text: Column) -> Column:
    """as, collector or country: what a user's search text names."""
    t = F.trim(text)
    return F.when(t.rlike(r"^(?i:as)?\d+$"), "as").when(t.rlike(r"^(?i:rrc|route-views)[\w.-]*$"), "collector").otherwise("country")


def combined_class(classes: Column, families: int) -> Column:
    """One class of the classes an AS has in its address families."""
    known = F.filter(classes, lambda c: c.isNotNull() & (c != "unknown"))
    return (
        F.when(F.size(known) < families, "unknown").when(F.forall(known, lambda c: c == "visible"), "visible").when(F.forall(known, lambda c: c == "invisible"), "invisible").otherwise("partially_visible")
    )
